"""Operators of the llm subpackage against brute force on small fixtures."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import byte_bpe, components, dealing, decontaminate, html_extract, jaccard, kernels, line_dedup, quality, session, suffix_dedup, topk, toxicity, warc
from candlewick.llm.folds import sample

DOCS = "doc_id long, text string, source string, lang string"
RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdeéß中"), RNG.integers(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(VOCABULARY[k] for k in rng.integers(0, len(VOCABULARY), n))


PASSAGE = prose(60, 1)
TEXTS = [
    None, "", "   \n ", "one", "One", "a b c", prose(120, 2), prose(120, 2), prose(120, 2).upper(), prose(120, 3) + " " + PASSAGE, PASSAGE, prose(30, 4) + "\n" + PASSAGE + "\n" + prose(30, 5),
    prose(200, 6), prose(200, 6) + " extra words here", "x" * 250, "x" * 99, "ab" * 400, "\n".join([prose(12, 7), prose(14, 8), prose(13, 9)]), "\n".join([prose(12, 10), prose(14, 8), prose(13, 9)]), "\n\n\n", prose(6000, 11),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(TEXTS)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def raw(t):
    return (t or "").encode()


# --- 1


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANK_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs, empty):
    enc = reference_encoding()
    path = public_tokenizers.path(byte_bpe.RANK_FILE)
    got = {r.doc_id: r for r in byte_bpe.tokenised(docs, path, with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        want = enc.encode_ordinary(t or "")
        assert list(got[i].ids) == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(raw(t)).hexdigest()
    assert byte_bpe.tokenised(empty, path).count() == 0


ENCODING, CODEC = reference_encoding(), byte_bpe.Codec(byte_bpe.rank_bytes(public_tokenizers.path(byte_bpe.RANK_FILE)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["'s", "'ll", " 're", "  ", "\n", " ", "don't", "\x1c", "12", "!?", "é'm"])), max_size=8).map("".join))
def test_bpe_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    want = ENCODING.encode_ordinary(text)
    ids, before = CODEC.encode(next(kernels.slices(pa.array([text]))))
    assert ids.tolist() == want and CODEC.encode_text(text.encode()).tolist() == want


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "TRANSITIONS", 5)
    small = byte_bpe.Codec(byte_bpe.rank_bytes(public_tokenizers.path(byte_bpe.RANK_FILE)))
    for word in ("incomprehensibilities", "zzzzqqqq", "éèêë" * 9, "a" * 500):
        assert small.encode_text(word.encode()).tolist() == ENCODING.encode_ordinary(word)


def test_streaming_decode_holds_unfinished_characters():
    stream, text = byte_bpe.Utf8Stream(), "a€𝄞é"
    assert "".join(stream.feed(bytes([b])) for b in text.encode()) == text
    stream.feed("€".encode()[:2])
    with pytest.raises(ValueError):
        stream.end()


# --- 2


def test_arc_versions_become_equal_warc():
    content = b"HTTP/1.0 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    made = []
    for version in (b"1", b"2"):
        (arc,) = warc.parse_arc(warc.arc_archive(version, [(b"http://x/", content)]))
        made.append(warc.to_warc(arc))
    assert made[0].header == made[1].header and made[0].header["WARC-Date"] == "2000-01-01T00:00:00Z"
    assert warc.hex_digest(made[0].header["WARC-Payload-Digest"]) == hashlib.sha1(b"hello").hexdigest()
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_archive(b"1", [(b"http://x/", content)])[:-4]))


@pytest.mark.parametrize("date,want", [("19970814123456", "1997-08-14T12:34:56Z"), ("20041231", "2004-12-31T00:00:00Z"), ("199912312359", "1999-12-31T23:59:00Z")])
def test_dates_and_references_are_converted(date, want):
    content = b"HTTP/1.0 200 OK\r\nX-Page-Id: 4\r\n\r\nbody"
    arc = warc.ArcRecord({"URL": "http://x/", "Archive-date": date, "IP-address": "1.2.3.4"}, content)
    first = warc.to_warc(arc).header
    again = warc.to_warc(warc.ArcRecord(arc.header | {"URL": "http://y/"}, content.replace(b"4", b"3")), (4, "http://x/")).header
    assert first["WARC-Date"] == again["WARC-Refers-To-Date"] == want and first["WARC-IP-Address"] == "1.2.3.4"
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] != again["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == "http://x/"


def test_archives_of_repeated_ids(spark):
    big, other = "é" * 600, "y" * 1200
    pages = [(1, "u", big), (1, "u", other), (2, "v", big), (2, "v", big), (None, "w", big), (3, None, other)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()), key=repr)
    assert got == sorted([(1, 1200, "revisit", 2), (1, 1200, "revisit", 3), (2, 1200, "response", None), (2, 1200, "response", None), (None, 1200, "response", None), (3, 1200, "response", None)], key=repr)


def test_archives_round_trip_with_revisits(spark):
    big, small = "é" * 600, "tiny"
    pages = [(1, "http://a b/", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "", None), (6, "u", ""), (9, "u", big), (7, "u", "y" * 1000), (8, "u", "y" * 999)]
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)).collect()}
    for i, _, html in pages:
        assert got[i].payload_bytes == len(raw(html)) and got[i].payload_digest == hashlib.sha1(raw(html)).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 9) if i in (1, 2) else ("response", None))
    assert got[1].url == "http://a%20b/" and got[2].url == "urn:page:2" and len({r.record_id for r in got.values()}) == 9
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    (nameless,) = warc.archived(spark.createDataFrame([(None, None, "x")], "page_id long, url string, html string")).collect()
    assert nameless.page_id is None and nameless.payload_bytes == 1


# --- 3


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_decontamination_equals_brute_force(spark, docs, empty):
    items = [(1, PASSAGE), (2, "one"), (3, None), (4, "!!"), (5, prose(120, 2)[:300]), (6, prose(9, 2)), (7, PASSAGE), (8, "B C")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, t in enumerate(TEXTS):
        ws, hit, found = words_of(t), set(), set()
        for item, text in items:
            own = words_of(text)
            n = min(10, len(own))
            wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(ws) - n + 1):
                if n and tuple(ws[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(item)
        names = ",".join(sorted(map(str, found)))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)), i
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.stage(docs, bench).count() == sum(not r.contaminated for r in got.values())


# --- 4


def line_brute(texts, least=64):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        ls = t.split("\n") if t is not None else []
        gone = set()
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                run = "\n".join(ls[a : b + 1])
                if len(run.encode()) >= least:
                    if run in seen:
                        gone.update(range(a, b + 1))
                    seen.add(run)
        kept = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out[i] = (len(ls), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_line_dedup_equals_brute_force(spark, docs, empty):
    assert {r.doc_id: tuple(r)[1:] for r in line_dedup.deduplicated(docs).collect()} == line_brute(TEXTS)
    rng = np.random.default_rng(2)
    pool = [prose(k % 5, k) for k in range(12)]
    texts = ["\n".join(pool[k] for k in rng.integers(0, 12, rng.integers(1, 9))) for _ in range(60)]
    own = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in line_dedup.deduplicated(own).collect()} == line_brute(texts)
    assert line_dedup.deduplicated(empty).count() == 0


def test_short_lines_that_end_a_repeated_run_go_too(spark):
    run = prose(20, 61) + "\nshort end"
    rows = [(0, run, 0), (1, "head\n" + run + "\ntail", 0), (2, "short end\nelse", 0), (3, "begin\n" + run, 0), (4, "", 0)]
    got = {r.doc_id: (r.n_removed, r.n_runs) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, kept_id int")).collect()}
    assert got == {0: (0, 0), 1: (2, 1), 2: (0, 0), 3: (2, 1), 4: (0, 0)}
    own = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, kept int, kept_id string, key string")
    left = {r.doc_id: r.text for r in line_dedup.stage(own).collect()}
    assert left == {0: run, 1: "head\ntail", 2: "short end\nelse", 3: "begin", 4: ""} and line_dedup.stage(own).columns == own.columns


def test_line_stage_keeps_columns_and_drops_emptied(spark):
    rows = [(1, prose(30, 1), "a", "x", 0), (2, prose(30, 1), "b", "x", 0), (3, None, "c", "x", 0), (4, "short\n" + prose(30, 1), "d", None, 0)]
    got = {r.doc_id: r for r in line_dedup.stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert set(got) == {1, 3, 4} and got[4].text == "short" and got[4].n_chars == 5 and got[3].text is None


# --- 5


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, (180, 8)).tolist()
    for i in range(60, 110):
        x[i] = x[60]
    x[3], x[5][2], x[7][1] = None, None, float("inf")
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame).collect())
    ok = {i: np.floor(64 * np.array(v)).astype(int) for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:20]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id = 20")).count() == 0


def test_top_k_of_large_components_and_repeated_ids(spark):
    x = {20: [1e30, 1.0], 1: [1.0, 1.0], 2: [-3e25, 0.0], 40: [2e9, 1.0], 3: [2.5e9, -1.0], -1: [0.5, 0.5], -20: [1e300, -1e300]}
    rows = [*x.items(), (1, x[1]), (40, x[40]), (None, [9.0, 9.0])]
    got = {(r.query_id, r.vec_id): (r["rank"], r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    whole = {i: [int(np.floor(64 * c)) for c in v] for i, v in x.items()}
    cut = lambda v: min(max(v, -(1 << 63)), (1 << 63) - 1)
    for q in (20, 40, -20):
        best = sorted((-cut(sum(a * b for a, b in zip(whole[q], whole[c]))), c) for c in x if c != q)
        assert [got[q, c] for _, c in best] == [(k + 1, -s) for k, (s, _) in enumerate(best)]
    assert len(got) == 3 * 6


def test_pivots_eliminate_candidates():
    """Vectors in clusters: most candidates are left out, and blocks in any cut give the same lists."""
    rng = np.random.default_rng(12)
    x = np.floor(64 * (rng.normal(0, 2, (20, 1, 8)) + rng.normal(0, 0.05, (20, 200, 8)))).reshape(-1, 8)
    ids = np.arange(len(x))
    table = topk.distances(x, topk.chosen_pivots(x[::7]))
    block = topk.Block(ids[::20], x[::20], table[::20], 20)
    for a in range(0, len(x), 700):
        block.meet(ids[a : a + 700], x[a : a + 700], table[a : a + 700])
    want = x[::20] @ x.T
    want[np.arange(200), ids[::20]] = -1e18
    assert (block.score == np.sort(want, 1)[:, ::-1][:, :20]).all() and block.evaluated < block.met / 2


def test_grid_moves_vectors_to_few_blocks():
    assert topk.grid(2564, 24, 20) == (1, 24) and topk.grid(0, 24, 20) == (1, 24)
    assert topk.grid(10**6, 3000, 20) == (123, 25)


# --- 6 and 7


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        text = prose(60, 100 + i)
        bad, foul = i % 6 == 0, i % 5 == 1
        if foul:
            text = text.replace(" ", " vileword ", 4).replace("a", "a nastyword ", 2)
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "s", None))
        labels.append((i, int(not bad), int(foul)))
    docs = spark.createDataFrame([*rows, (600, None, "s", None), (601, "", "s", None)], DOCS)
    return docs, spark.createDataFrame([*labels, (600, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def check(rows, truth, cut):
    right = n = 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < 600:
            n += 1
            right += r.predicted == truth(r.doc_id)
    return right / n


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    net = quality.train(sample(docs, labels, "quality", quality.SAMPLE, quality.SAMPLE_BYTES))
    got = quality.scored(docs, net).collect()
    assert len(got) == 602 and check(got, lambda i: int(i % 6 != 0), 0.3) > 0.97
    kept = quality.stage(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_quality_without_labels(labelled):
    docs, labels = labelled
    net = quality.train(sample(docs, labels.limit(0), "quality", 10, 1 << 20))
    assert quality.scored(docs, net).count() == 602


def test_samples_pass_over_rows_too_long(spark):
    """The byte bound holds before texts are collected; of repeated ids one counts."""
    rows = [(i, prose(60, i), "s", None) for i in range(40)] + [(i, prose(9, i), "s", None) for i in range(40)] + [(i, "x" * 90_000, "s", None) for i in (40, 41, 42)] + [(43, None, "s", None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(44)] + [(7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    train = [i for i in range(44) if zlib.crc32(str(i).encode()) % 5]
    got = sample(docs, labels, "quality", 100, 80_000)
    assert [r[0] for r in got] == [i for i in train if i not in (40, 41, 42)] and sum(len(r[1].encode()) for r in got) <= 80_000
    assert len(sample(docs, labels, "quality", 100, 2_000)) < len(got) and len(sample(docs, labels, "quality", 5, 80_000)) <= 5
    assert len(sample(docs.where("doc_id > 39 and doc_id < 43"), labels, "quality", 100, 10)) == 1
    assert sample(docs.limit(0), labels, "quality", 100, 10) == []


def slice_of(texts):
    return next(kernels.slices(pa.array(texts, pa.string())))


def test_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(0, 1, (8, 256, 12)).astype(np.float32), rng.normal(0, 1, 12).astype(np.float32), rng.normal(0, 1, 13))
    texts = ["", "short", "a" * 128, prose(80, 3), prose(300, 4)]
    for got, t in zip(quality.scores(net, slice_of(texts)), texts):
        b = t.encode()
        blocks = max(1, -(-len(b) // 128))
        b += bytes(blocks * 128 - len(b) + 128)
        chunks = []
        for c in range(max(1, blocks - 1)):
            spots = range(c * 128, min(c + 2, blocks) * 128, 4)
            top = np.max([net.bias + sum(net.taps[j, b[k + j] if k + j < len(b) else 0] for j in range(8)) for k in spots], 0)
            chunks.append(1 / (1 + np.exp(-(np.maximum(top, 0) @ net.head[:-1] + net.head[-1]))))
        assert got == pytest.approx(np.mean(chunks), rel=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(0, 0.3, (8, 256, 12)), rng.normal(0, 0.3, 12), rng.normal(0, 0.3, 13))
    text, first = quality.padded(slice_of([prose(60, 5), prose(90, 6), ""]))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality.forward(net, text, first).text
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip((net.taps, net.bias, net.head), quality.gradients(net, text, first, y)):
        for k in np.unique(np.concatenate([np.argsort(np.abs(g).ravel())[-6:], [0]])):
            old, h = w.flat[k], 1e-5
            w.flat[k] = old + h
            up = loss()
            w.flat[k] = old - h
            down = loss()
            w.flat[k] = old
            assert g.flat[k] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-7)


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    assert len(got) == 602 and check(got, lambda i: int(i % 5 == 1), 0.5) > 0.95
    assert toxicity.scored(docs, toxicity.fitted(docs, labels.limit(0))).count() == 602


def kneser_ney_brute(counted, texts):
    """Evidence of texts by plain counts over (text, toxic) rows."""
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", raw(t).lower())
    pairs = {p for t, _ in counted for p in zip([None, *split(t)], split(t))}
    m = collections.Counter(w for _, w in pairs)
    q = []
    for k in (0, 1):
        c = collections.Counter(w for t, y in counted if y == k for w in set(split(t)))
        many = [sum(x == i for x in c.values()) for i in range(6)]
        y = many[1] / (many[1] + 2 * many[2])
        d = [0, *(min(max(i - (i + 1) * y * many[i + 1] / many[i], 0.1), i) if many[i] else i / 2 for i in (1, 2, 3))]
        back = sum(d[min(x, 3)] for x in c.values())
        q.append({w: (c[w] - d[min(c[w], 3)] + m[w] / len(pairs) * back) / sum(c.values()) for w in m})
    assert [sum(x.values()) for x in q] == pytest.approx([1, 1])
    weight = {w: np.log(0.99 + 0.01 * q[1][w] / q[0][w]) for w in m}
    return [sum(weight.get(w, 0) for w in split(t)) / max(len(split(t)), 1) for t in texts], weight


@pytest.mark.parametrize("common", [0, 5, 1 << 18])
def test_toxicity_scores_by_exact_counts(spark, monkeypatch, common):
    """Against plain counts: no word is left out, in any chunking, with a bitmap that marks too many, for repeated and null ids, with any part of the words in the table of common ones."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "FLUSH", 400)
    monkeypatch.setattr(toxicity, "MARKS", 64)
    texts = [" ".join(w + (" vile" + "aeiou"[k % 5] if i % 3 == 0 and k % 9 == 0 else "") for k, w in enumerate(prose(80, 700 + i % 30).split())) for i in range(120)]
    rows = [(i, t, "s", None) for i, t in enumerate(texts)] + [(None, texts[3], "s", None), (500, None, "s", None), (3, texts[0] + " vilea", "s", None), (501, "", "s", None), (None, texts[3], "s", None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(3, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 7)
    model = toxicity.fitted(docs, labels)
    train = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    chosen = sorted((i for i in train if zlib.crc32(str(i).encode()) % 5 == 4), key=dict((r[0], r[1]) for r in spark.range(120).selectExpr("id", "xxhash64(id)").collect()).get)[:7]
    counted = [(t, int(i % 3 == 0)) for i, t, _, _ in rows if i in train and i not in chosen]
    want, weight = kneser_ney_brute(counted, [r[1] for r in rows])
    assert min(weight.values()) < 0 < min(weight[b"vile" + bytes([c])] for c in b"aeiou" if b"vile" + bytes([c]) in weight)
    got = sorted(((r.doc_id, r.evidence) for r in model.found.collect()), key=repr)
    for a, b in zip(got, sorted(((r[0], x) for r, x in zip(rows, want)), key=repr), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])
    assert len(toxicity.scored(docs, model).collect()) == len(rows)


def test_pairs_survive_packing():
    rng = np.random.default_rng(3)
    word, before = rng.integers(0, 50, 77).astype(np.uint64), rng.integers(0, 9, 77).astype(np.uint64)
    got = toxicity.unpack_pairs([(0, toxicity.pack_pairs(word, before)), (0, toxicity.pack_pairs(word[:1], before[:1]))])
    assert sorted(zip(*(x.tolist() for x in got))) == sorted([*zip(word.tolist(), before.tolist()), (word[0], before[0])])


def test_toxicity_learns_a_phrase(spark):
    """Two phrases that never vary, each word after one other: every held-out row is told apart."""
    docs = spark.createDataFrame([(i, "hate you fool" if i % 2 else "nice day today", "s", None) for i in range(199)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(199)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect())


def test_toxicity_counts_all_rows_but_the_sample(labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    training, seen, count = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(600)), [], toxicity.counted
    monkeypatch.setattr(toxicity, "counted", lambda d, own: seen.append(own.where("doc_id < 600").count()) or count(d, own))
    toxicity.fitted(docs, labels)
    assert seen == [training - 10]


# --- 8


def jaccard_brute(texts):
    sets = {}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    label = dict.fromkeys(sets)
    for i in sets:
        label[i] = i
    for _ in sets:
        for i in sets:
            for j in range(i):
                k = len(sets[i] & sets[j])
                if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_equals_brute_force(spark, docs, empty):
    assert {r.doc_id: tuple(r)[1:] for r in jaccard.linked(docs).collect()} == jaccard_brute(TEXTS)
    rng = np.random.default_rng(8)
    base, texts = prose(90, 50).split(), []
    for i in range(70):
        own = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 5)):
            own[k] = f"w{i}x{k}"
        texts.append(" ".join(own[: int(rng.integers(70, 91))]) if i % 3 else prose(80, 60 + i // 9) + " " + " ".join(own[:20]))
    own = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).repartition(4)
    assert {r.doc_id: tuple(r)[1:] for r in jaccard.linked(own).collect()} == jaccard_brute(texts)
    assert jaccard.linked(empty).count() == 0


def test_near_copies_all_meet(spark):
    """A large group of different near copies, chained only by links."""
    base, texts = prose(100, 70).split(), []
    for i in range(150):
        own = list(base)
        own[(i * 7) % 100] = f"edit{i}"
        texts.append(" ".join(own))
    got = jaccard.linked(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).repartition(5))
    assert {r.component_id for r in got.collect()} == {0}
    assert jaccard.stage(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).count() == 1


@pytest.mark.parametrize("many", [200, 400])
def test_near_copies_make_few_links(spark, monkeypatch, many):
    """Copies with one to three edits each: links in proportion to the documents, whatever the group's size."""
    base, made, keep = prose(120, 71).split(), [], jaccard.kept
    rng = np.random.default_rng(6)
    texts = []
    for i in range(many):
        own = list(base)
        for k in rng.integers(0, 120, 1 + i % 3):
            own[k] = f"edit{i}x{k}"
        texts.append(" ".join(own))

    def counted(spark, frame, name):
        out = keep(spark, frame, name)
        if name == "links":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "kept", counted)
    got = jaccard.linked(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).repartition(4)).collect()
    sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (t.split() for t in texts)]
    label, todo = {}, []
    for i in range(many):
        if i not in label:
            label[i], todo = i, [i]
        while todo:
            j = todo.pop()
            near = [k for k in range(many) if k not in label and 100 * len(sets[j] & sets[k]) >= 75 * len(sets[j] | sets[k])]
            label |= dict.fromkeys(near, i)
            todo += near
    assert {r.doc_id: r.component_id for r in got} == label and len(set(label.values())) < many
    assert len(made) == 3 and sum(made) < 2 * many


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b = prose(60, 72), prose(60, 73)
    rows = [(1, a, 0), (1, b, 0), (2, b, 0), (3, a + " more", 0), (-1, prose(60, 74), 0), (None, a, 0), (None, prose(60, 74), 0), (9, None, 0)]
    got = sorted((tuple(r) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(3)).collect()), key=repr)
    assert got == sorted([(1, 56, 1), (2, 56, 1), (3, 57, 1), (-1, 56, -1), (9, 0, 9), (None, 56, None), (None, 56, None)], key=repr)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- 9

PROSE = "The committee met on Tuesday, and after a long discussion, which few had expected, it agreed on a plan for the coming year."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="ad">Buy now, cheap, today, and get another one for free, forever and ever!</div>
<div id=content><h1>Plan &amp; year</h1><p>{PROSE}<br>Next&nbsp;line<p><b>Bold</b>er text, with commas, and more of it to read. {PROSE}
<div class="share">Share this</div><ul><li>First point<li>Second point</ul><script>var x="</p>";</script><form><input>Sign up, please, now</form></div>
<div class="comments"><p>{PROSE} I think, says a reader, that this is wrong, all wrong.</p></div><aside><p>{PROSE}</p></aside><footer>&copy; me</footer></body></html>"""


def test_extraction_keeps_the_article_only():
    want = f"Plan & year {PROSE} Next line Bolder text, with commas, and more of it to read. {PROSE} First point Second point"
    assert html_extract.extract(PAGE) == want


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<nav>Menu</nav>", ""), ("<article><p>" + PROSE + "<footer>x", PROSE), ('<div class="ad"><article><p>' + PROSE + "</article>", PROSE), ("a < b & c", "a < b & c"), ("<script>never closed " + PROSE, "")])
def test_extraction_of_odd_pages(page, want):
    assert html_extract.extract(page) == want


def test_only_the_best_article_frees_its_parents():
    main = f"<main><article><p>{PROSE}</p><p>{PROSE} Again.</p>"
    end = "</article></main>"
    teaser = f'<aside class=sidebar><article class=teaser><p>{PROSE} Teaser.</p></article><article><p>Short, see more, of it, here, now and then.</p></article></aside>'
    assert html_extract.extract(main + end + teaser) == html_extract.extract(teaser + main + end) == f"{PROSE} {PROSE} Again."
    comments = f'<article class="comment"><p>{PROSE} I, a reader, think so, too.</p></article>'
    assert html_extract.extract(main + comments + end) == f"{PROSE} {PROSE} Again."
    assert html_extract.extract(f'<div class="overlay"><article><p>{PROSE}</p></article></div><p>Short one.</p>') == PROSE


@pytest.mark.parametrize("tag", ['<p title=5">', "<p title=it's>", '<p title="a>b">', "<p a=b/>", '<p "odd" = x>', "<p class=>", "<p\nid='x'class=y>"])
def test_attributes_are_no_text(tag):
    assert html_extract.extract(f"<div>{tag}{PROSE}</p></div>") == PROSE


def test_extraction_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "u", PAGE, "x", 1)] * 2 + [(None, None, "<p>" + PROSE, "y", 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extracted(frame).collect()
    assert len(got) == 3 and [r.text for r in got if r.page_id is None] == [PROSE]
    assert html_extract.extracted(frame.limit(0)).count() == 0


def test_extraction_rows(spark):
    got = html_extract.extracted(spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3)], "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.n_chars == len(r.text)) for r in sorted(got)] == [(1, True), (2, True)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/ \"'=&;!-abpdivnav", max_size=60))
def test_extraction_never_fails(page):
    assert html_extract.extract(page) == html_extract.extract(page).strip()


# --- 10


def suffix_brute(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = raw(t)
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, docs, empty):
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(docs).collect()} == suffix_brute(TEXTS)
    rng = np.random.default_rng(3)
    pieces = ["".join(rng.choice(list("ab"), 130)) for _ in range(5)] + ["z" * 140, "ab" * 70]
    texts = ["".join(pieces[k][: int(rng.integers(60, 141))] for k in rng.integers(0, 7, 4)) for _ in range(40)]
    own = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).repartition(4)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(own).collect()} == suffix_brute(texts)
    assert suffix_dedup.deduplicated(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=40), min_size=1, max_size=5), st.integers(2, 6))
def test_interval_expansion_finds_common_prefixes(texts, length):
    symbols = np.concatenate([np.append(np.frombuffer(t.encode(), np.uint8).astype(np.uint16) + 1, 0) for t in texts]).astype(np.uint16)
    order, equal = suffix_dedup.repeats(symbols, length)
    whole = symbols.tolist()
    for i in range(1, len(order)):
        a, b = whole[order[i - 1] : order[i - 1] + length], whole[order[i] : order[i] + length]
        assert equal[i] == (a == b and len(a) == length and 0 not in a)


def test_repeated_rows_lose_all_copies_but_one(spark):
    """Rows of one id are judged one by one, null ids too; each keeps its other columns."""
    block, other = prose(40, 31), prose(40, 32)
    rows = [(7, block, "a", "x"), (7, block, "b", "x"), (7, "short\n" + block + "\n" + other, "c", "x"), (8, other, "d", "x"), (None, block, "e", "x"), (None, prose(40, 33), "f", None), (None, prose(40, 33), "f", None), (-1, prose(40, 34), "g", "x")]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, suffix_hash(r[1])))
    for got, brute in ((line_dedup.deduplicated(own), line_brute), (suffix_dedup.deduplicated(own), suffix_brute)):
        want = brute([r[1] for r in order])
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((r[0], *want[i])) for i, r in enumerate(order))
    left = line_dedup.stage(own)
    assert left.columns == own.columns
    texts = [r.text for r in left.collect()]
    assert sum((t or "").count(block) for t in texts) == sum(t.count(other) for t in texts) == sum(t.count(prose(40, 33)) for t in texts) == 1
    assert [r.source for r in left.where("doc_id is null").collect()] == ["f"]


def test_repeats_at_the_end_of_a_very_long_text(spark, tmp_path):
    """A passage behind 17 MiB of other bytes, longer than an anchor's places and any slice."""
    rng = np.random.default_rng(21)
    noise = rng.integers(97, 123, 17 << 20).astype(np.uint8)
    noise[::90] = 10
    passage = prose(40, 81)
    long = noise.tobytes().decode() + "\n" + passage
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": pa.array([passage, long, "x"]), "kept": ["a", "b", "c"]}), f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    size = len(passage.encode())
    assert {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(docs).collect()} == {1: 0, 2: size, 3: 0}
    assert {r.doc_id: r.n_removed for r in line_dedup.deduplicated(docs).collect()} == {1: 0, 2: 1, 3: 0}
    item = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, item).collect()} == {1: True, 2: True, 3: False}
    assert {r.doc_id: r.component_id for r in jaccard.linked(docs).collect()} == {1: 1, 2: 2, 3: 3}


def test_scanning_operators_take_repeated_null_and_clashing_rows(spark):
    rows = [(1, prose(20, 1), "a", 1.0), (1, prose(20, 1), "b", 2.0), (1, prose(9, 2), "c", 3.0), (None, prose(20, 1), "d", 4.0), (None, None, "e", 5.0), (2, "", "f", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, score double").repartition(3)
    path = public_tokenizers.path(byte_bpe.RANK_FILE)
    want = sorted((repr((i, len(ENCODING.encode_ordinary(t or "")))) for i, t, _, _ in rows))
    assert sorted(repr((r.doc_id, r.n_tokens)) for r in byte_bpe.tokenised(docs, path).collect()) == want
    bench = spark.createDataFrame([(1, prose(20, 1), 0), (1, prose(20, 1), 0), (None, "x", 0)], "item_id long, text string, doc_id int")
    assert sorted(repr((r.doc_id, r.n_hit)) for r in decontaminate.contamination(docs, bench).collect()) == sorted(repr((i, 20 if t == prose(20, 1) else 0)) for i, t, _, _ in rows)
    assert decontaminate.stage(docs, bench).columns == docs.columns and decontaminate.stage(docs, bench).count() == 3
    net = quality.train([])
    assert quality.scored(docs, net).count() == 6 and quality.stage(docs, net).columns == docs.columns
    assert quality.scored(docs.limit(0), net).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, labels)
    assert toxicity.scored(docs, model).count() == 6 and toxicity.scored(docs.limit(0), model).count() == 0
    for stage in (line_dedup.stage, jaccard.stage):
        assert stage(docs).columns == docs.columns


def suffix_hash(t):
    s = next(kernels.slices(pa.array([t])))
    return int(dealing.row_names(pa.array([0]), s)[1][0])


def test_anchors_reach_past_the_places_of_a_key():
    """Equal strings get equal anchors, and every string one context, on both sides of a window's border."""
    rng = np.random.default_rng(9)
    block = rng.integers(97, 123, 300).astype(np.uint8)
    buf = np.concatenate([rng.integers(97, 123, 700).astype(np.uint8), block, rng.integers(97, 123, 650).astype(np.uint8), block, block[:150]])
    offsets = np.array([0, 0, len(buf) - 150, len(buf)])
    for bits in (9, 10, 24):
        gram, _, text, start, many = suffix_dedup.anchors(buf, offsets, bits=bits)
        owner = {int(s) + k: (int(g), int(x)) for g, x, s, m in zip(gram, text, start, many) for k in range(m)}
        assert len(owner) == many.sum() and sorted(owner) == [*range(len(buf) - 249), *range(len(buf) - 150, len(buf) - 99)]
        for k in range(201):
            assert owner[700 + k] == owner[1650 + k] and owner[700 + k][1] == 1
        assert all(owner[len(buf) - 150 + k] == (owner[700 + k][0], 2) for k in range(51))


def test_near_duplicates_keep_rows_without_an_id(spark):
    near = prose(200, 51)
    rows = [(1, near, "s", None), (None, near + " more", "s", None), (None, prose(200, 52), "s", None), (None, prose(200, 52), "s", None), (None, None, "s", None), (None, None, "t", None)]
    got = jaccard.stage(spark.createDataFrame(rows, DOCS).repartition(2))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, near), (None, prose(200, 52)), (None, None), (None, None)], key=repr)


# --- shared


def test_slices_hold_whole_rows():
    column = pa.array(["a" * 10, None, "", "b" * 50, "c"])
    got = [(s.first, s.n, s.buf.tobytes()) for s in kernels.slices(column.slice(1), 20)]
    assert b"".join(x[2] for x in got) == b"b" * 50 + b"c" and sum(x[1] for x in got) == 4


def test_most_is_full_at_any_size(spark):
    """Whole classes of counts go along while there is room; of the next one a part, also where it is the first."""
    frame = spark.createDataFrame([(k, 1 << k) for k in range(12)], "k long, many long")
    assert {r.k for r in session.most(frame, "k", "many", 7).collect()} == set(range(5, 12))
    assert session.most(frame.limit(0), "k", "many", 7).count() == 0 and session.most(frame, "k", "many", 0).count() == 0
    even = spark.range(20_000).selectExpr("id k", "5L many")
    assert 4_600 < session.most(even, "k", "many", 5_000).count() < 5_400
    mixed = even.unionByName(spark.range(100_000, 100_010).selectExpr("id k", "90L many"))
    got = session.most(mixed, "k", "many", 5_000).collect()
    assert sum(r.many == 90 for r in got) == 10 and 4_600 < len(got) < 5_400
