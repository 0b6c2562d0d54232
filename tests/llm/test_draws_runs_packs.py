"""Resampling, periodic runs and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlewick.llm import kernels, packing, periodic, ranked, resampling
from tests.llm.test_llm import DOCS, PASSAGE, TEXTS, prose

MORE = [
    *TEXTS, "la " * 300, "na na na na na na end", "a b a b a b a b", "\n".join(["the same line again"] * 9), " ".join(["x y z"] * 40 + ["q"] + ["x y z"] * 40), prose(900, 12) + " " + prose(7, 13) * 5,
]


def rows_of(texts):
    """Every text under an id of its own, then repeated ids with equal and other texts, and null ids."""
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(3, texts[3]), (5, prose(70, 40)), (5, prose(70, 40)), (None, prose(60, 41)), (None, None), (None, prose(60, 41))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(MORE)
    return spark.createDataFrame([(i, t, "s", None, 1, 2, 3) for i, t in rows], DOCS + ", key int, length int, rank int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 11

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features_of(text, order):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def drawn(rows, target, percent, min_words, order, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features_of(text, order)))
    for text in target:
        t.update(map(bucket, features_of(text, order)))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        f = features_of(text, order)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(r, []).append(place)
    return [(*r[:4], ranks[r].pop() if ranks.get(r) else None) for r in out]


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize(("percent", "min_words", "order", "buckets", "seed"), [(10, 20, 1, 10_000, 2024), (60, 1, 3, 97, 7), (100, 0, 2, 10_000, 1), (0, 20, 1, 10, 1)])
def test_resampling_equals_brute_force(spark, docs, percent, min_words, order, buckets, seed):
    target = [PASSAGE, None, "", prose(40, 50)]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in resampling.resampled(docs, goal, percent, min_words, order, buckets, seed).collect()]
    assert sorted(got, key=key) == sorted(drawn(rows_of(MORE), target, percent, min_words, order, buckets, seed), key=key)


def test_resampling_of_empty_tables(spark, docs, empty):
    goal = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(empty, goal).count() == 0
    assert resampling.resampled(docs, goal).where("rank is not null").count() == sum(len(words_of(t)) >= 20 for _, t in rows_of(MORE)) // 10


def test_resampling_of_a_very_long_text(spark):
    text = prose(2_500_000, 60)
    assert len(text.encode()) > 16 << 20
    d = spark.createDataFrame([(1, text), (2, prose(30, 61))], "doc_id long, text string")
    got = {r.doc_id: r for r in resampling.resampled(d, d.limit(0), percent=50).collect()}
    assert got[1].n_features == len(words_of(text)) and sorted(r.rank or 0 for r in got.values()) == [0, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=100), max_size=30))
def test_crc32_of_spans(parts):
    parts = parts + [b"x" * 300]
    ends = np.cumsum([len(p) for p in parts])
    got = resampling.crc32(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("k", [1, 2, 499, 500, 777, 1000])
def test_kth_key(spark, k):
    rng = random.Random(3)
    values = [(rng.choice([-5, 0, 0, 0, 9]), i) for i in range(1000)]
    table = spark.createDataFrame(values, "a long, b long").repartition(4).select(F.struct("a", "b").alias("key"))
    want = sorted(values)[k - 1]
    assert table.where(F.col("key") <= ranked.kth(table, k, 5, 3)).count() == k
    assert [tuple(r["key"]) for r in table.where(F.col("key") == ranked.kth(table, k, 5, 3)).collect()] == [want]
    assert ranked.kth(table, 0) is None


def test_rows_are_numbered_in_order(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["x"] == r["index"] for r in ranked.numbered(table, [F.col("x")], "numbers").collect())
    assert ranked.numbered(table.limit(0), [F.col("x")], "numbers").count() == 0


# --- 12


def runs_of(words, least=6, times=4):
    """Every run by comparison at every period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        j = 0
        while j < n - q:
            k = j
            while k < n - q and words[k] == words[k + q]:
                k += 1
            s = words[j : k + q]
            if k > j and len(s) >= max(least, times * q) and not any(all(s[x] == s[x + r] for x in range(len(s) - r)) for r in range(1, q)):
                out.append((j, len(s), q))
            j = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.integers(1, 9), st.integers(0, 3)), max_size=5), min_size=1, max_size=4))
def test_runs_equal_brute_force(parts):
    texts = [[w for base, times, cut in p for w in (base * times)[cut:]] for p in parts]
    before = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, period = periodic.found_runs(np.array([ord(w) for t in texts for w in t], np.uint64), before)
    assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == [(int(before[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in runs_of(t)]


def test_runs_of_documents(spark, docs, empty):
    want = []
    for i, text in rows_of(MORE):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n and i is not None:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = runs_of(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for j, w in enumerate(words) if j not in gone))))
    got = [tuple(r) for r in periodic.digests(periodic.collapsed(docs, plant=True)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 6
    assert periodic.digests(periodic.collapsed(empty)).count() == 0


def test_runs_of_a_very_long_text(spark):
    text = prose(100, 70) + " " + " ".join(["tick", "tock", "tack"] * 1_300_000) + " end"
    assert len(text) > 16 << 20
    row = periodic.collapsed(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(100, 3_900_000, 3)] and row.text == prose(100, 70) + " tick tock tack end"


# --- 13

PATH = public_tokenizers.path(packing.TOKENIZER_FILE)
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True
ENCODER = packing.Encoder(open(PATH, encoding="utf-8").read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["'s", "'ll", " 're", "  ", "\n", " ", "don't", "12", "!?", "é'm", "<|endoftext|>"])), max_size=8).map("".join))
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, _ = ENCODER(next(kernels.slices(pa.array([text]))))
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_rare_pieces(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 50)
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    for seed in range(6):
        text = prose(80, seed)
        assert encoder(next(kernels.slices(pa.array([text]))))[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert len(encoder.names) <= 50


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packs_hold_every_id_once(spark, docs, capacity):
    want = Counter((i, tuple([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows_of(MORE))
    found = packing.placed(packing.pieces(docs, PATH, capacity).withColumn("index", F.lit("clash")).drop("index"), capacity).collect()
    # pieces of a document: repeated ids and texts make equal rows, so count them by start
    by = {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= capacity
        by.setdefault((r.doc_id, r.doc_tokens), Counter())[(r.start, tuple(ids))] += 1
    for (i, ids), many in want.items():
        own = by[(i, len(ids))]
        for start in range(0, len(ids), capacity):
            assert own[(start, ids[start : start + capacity])] >= many
    assert sum(r.length for r in found) == sum(len(ids) * many for (_, ids), many in want.items())
    packs = {}
    for r in found:
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(packs) == list(range(len(packs)))
    for own in packs.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= capacity
    assert len(packs) <= 1.1 * sum(r.length for r in found) / capacity + 1


def test_packing_of_nothing(empty):
    assert packing.placed(packing.pieces(empty, PATH)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_shortest_pack_first_is_that_of_single_pieces(histogram):
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = min(range(len(packs)), key=lambda k: sum(packs[k]), default=None)
            if at is None or sum(packs[at]) + length > 32:
                packs.append([length])
            else:
                packs[at].append(length)
    got = packing.shortest_pack_first(histogram, 32)
    assert Counter(x for lengths, many in got for x in lengths * many) == Counter(histogram)
    assert sorted(sum(p) for p in packs) == sorted(sum(lengths) for lengths, many in got for _ in range(many))


def test_packing_of_one_length(spark):
    d = spark.createDataFrame([(i, "word " * 3) for i in range(5000)] + [(i, prose(400, i)) for i in range(40)], "doc_id long, text string").repartition(4)
    found = packing.placed(packing.pieces(d, PATH)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in found) and sum(r.n for r in found) > 0.97 * 1024 * len(found)
