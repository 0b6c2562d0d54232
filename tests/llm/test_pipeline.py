"""The pipeline against the same stages by brute force, and as registered."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from candlewick.llm import kernels, quality
from candlewick.llm.folds import sample
from tests.llm import test_llm as T


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(160):
        text = T.prose(50, 1000 + i // 2 * (i % 3 > 0) + i * (i % 3 == 0))
        if i % 7 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        if i % 11 == 3:
            text += "\n" + T.PASSAGE
        if i % 10 == 9:
            text += "\n" + T.prose(20, 5) + "\nmore " + str(i)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 7 != 0), 0))
    rows += [(160, None, None, "s", None), (161, "", "en", None, 0), (162, rows[5][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, T.PASSAGE)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    net = quality.train(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", quality.SAMPLE, quality.SAMPLE_BYTES))
    ids = sorted(rows)
    score = np.concatenate([quality.scores(net, s) for s in kernels.slices(pa.array([rows[i] for i in ids], pa.string()))])
    kept = [i for i, p in zip(ids, score) if p >= quality.THRESHOLD]
    # later copies of repeated lines
    seen, texts = set(), {}
    for i in kept:
        lines = rows[i].split("\n") if rows[i] is not None else []
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = "\n".join(lines[a : b + 1])
                if len(run.encode()) >= 64:
                    if run in seen:
                        gone.update(range(a, b + 1))
                    seen.add(run)
        if not gone or len(gone) < len(lines):
            texts[i] = None if rows[i] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    order = sorted(texts)
    label = T.jaccard_brute([texts[i] for i in order])
    first = [i for k, i in enumerate(order) if label[k][1] == k]
    wins = {tuple(T.words_of(T.PASSAGE)[k : k + 10]) for k in range(51)}
    clean = [i for i in first if not any(tuple(T.words_of(texts[i])[k : k + 10]) in wins for k in range(len(T.words_of(texts[i])) - 9))]
    want = {i: hashlib.sha256(np.array(T.ENCODING.encode_ordinary(texts[i] or ""), "<u4").tobytes()).hexdigest() for i in clean}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 20 < len(got) < 160


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_everything_is_registered():
    found = __spark_entry__.queries()
    assert {f"op{k}_" for k in range(1, 11)} <= {n[: n.index("_") + 1] for n in found if n.startswith("op")} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
