"""What a Python worker keeps from task to task: workers outlive the tasks and stages that they serve."""

import numpy as np
import pyarrow as pa

from candlewick.llm import byte_bpe, dealing, decontaminate, jaccard, line_dedup
from candlewick.llm import kernels as K


def packed_texts(texts: list[bytes]) -> bytes:
    return K.pack_columns(np.arange(len(texts)), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))


def test_large_texts_leave_no_large_tables(monkeypatch):
    monkeypatch.setattr(K, "_POWERS", {})
    buf = np.random.default_rng(1).integers(0, 256, 5_000_000).astype(np.uint8)
    long = K.SpanHash(K.BYTE_WORDS[buf])(np.array([0, 4_000_000]), np.array([3, 4_000_007]))
    assert sum(len(x) for x in K._POWERS.values()) <= 2 * K.POWERS_KEPT
    short = [K.SpanHash(K.BYTE_WORDS[buf[a:b]])(np.array([0]), np.array([b - a]))[0] for a, b in ((0, 3), (4_000_000, 4_000_007))]
    assert long.tolist() == short
    assert sum(len(x) for x in K._POWERS.values()) <= 2 * K.POWERS_KEPT


def test_packed_texts_are_hashed_in_slices(monkeypatch):
    monkeypatch.setattr(K, "_POWERS", {})
    texts = [b" ".join(b"w%d" % (i * j % 977) for j in range(2000)) for i in range(1, 600)] + [b"", b"one two"]
    sets = dict(jaccard.sets_of(packed_texts(texts)))
    assert len(K._POWERS["up"]) < 2 * K.SLICE < sum(map(len, texts))
    whole = next(K.slices(pa.array(texts, pa.binary()), 1 << 30))
    assert all((sets[i] == own).all() for i, own in enumerate(jaccard.shingles(whole)))


def test_slices_of_packed_rows_keep_them_together():
    texts = ["a" * 5, None, "", "b" * 30, "c", "d" * 9]
    docs = pa.record_batch([pa.array([1, None, 3, 4, 5, 6], pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    s = next(K.slices(docs.column(1)))
    doc, twin = dealing.row_names(docs.column(0), s)
    key, valid = dealing.row_key(doc, twin), twin >> np.uint64(63) == 0
    sink = pa.BufferOutputStream()
    rest = pa.table({"x": [f"x{i}" for i in range(6)]})
    with pa.ipc.new_stream(sink, rest.schema) as out:
        out.write_table(rest)
    payload = K.pack_columns(key, doc, valid, np.where(s.valid, np.diff(s.offsets), -1), s.buf, np.frombuffer(sink.getvalue(), np.uint8))
    for limit in (None, 1, 6, 31, 100):
        got = list(dealing.read_texts([(0, payload)], limit))
        assert len(got) == 1 if limit in (None, 100) else len(got) > 1
        assert np.concatenate([g[0] for g in got]).tolist() == key.tolist()
        assert [x for g in got for x in g[1].to_pylist()] == docs.column(0).to_pylist()
        assert [g[2].text(i).decode() if g[2].valid[i] else None for g in got for i in range(g[2].n)] == texts
        assert [x for g in got for x in g[3]["x"].to_pylist()] == rest["x"].to_pylist()


def test_a_worker_drops_what_another_operator_built(monkeypatch):
    monkeypatch.setattr(K, "_BUILT", {})
    monkeypatch.setattr(byte_bpe, "Codec", lambda raw: ["codec", raw])
    assert byte_bpe.worker_codec(b"ranks") is byte_bpe.worker_codec(b"ranks")
    items = [(1, "one two three")]
    assert decontaminate.worker_benchmark(items, 10) is decontaminate.worker_benchmark(items, 10)
    assert len(K._BUILT) == 1
    given = []
    monkeypatch.setattr(K, "give_back", lambda: given.append(1))
    assert list(dealing.bound(line_dedup.intervals, 3)(iter([]))) == [] and not K._BUILT and given == [1]


def test_freed_memory_goes_back():
    def held() -> int:
        return next(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon"))

    # small blocks with one that stays above them: the allocator keeps all of them otherwise
    blocks = [np.zeros(60_000, np.uint8) + 1 for _ in range(3000)]
    last = blocks[-1]
    blocks.clear()
    before = held()
    K.give_back()
    assert before - held() > 100_000 and last.any()
