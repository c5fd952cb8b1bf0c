"""Weights against a plain computation, the exact top k, and what is kept of labelled documents."""

import math

import numpy as np
from pyspark.sql import functions as F

from arrayloom.llm import quality_classifier as c


def test_weights_by_brute_force(spark, documents):
    texts = ["good plain words here"] * 4 + ["junk ### junk ###", None, "", "good words " * 3000, "plain"]
    docs = documents(*texts).withColumn("key", F.lit("clash")).withColumn("note", F.lit("x"))
    labels = spark.createDataFrame([(0, 1), (1, 1), (4, 0), (0, 1), (None, 1), (7, None)], "doc_id long, quality int")
    raw, good = {}, {}
    for i, t in enumerate(texts):
        for b in c.ngrams(t):
            raw[b] = raw.get(b, 0) + 1
            if i in (0, 1):
                good[b] = good.get(b, 0) + 1
    n, m = sum(raw.values()), sum(good.values())
    ratio = {b: math.log((good.get(b, 0) + 1) / (m + c.BUCKETS)) - math.log((raw[b] + 1) / (n + c.BUCKETS)) for b in raw}
    rows = c.resample(docs.repartition(3), labels, k=5).collect()
    assert len(rows) == len(texts) and rows[0]["note"] == "x" and sum(r["kept"] for r in rows) == 5
    for r in rows:
        found = c.ngrams(texts[r["doc_id"]])
        assert r["n_ngrams"] == len(found)
        assert abs(r["log_weight"] - sum(ratio[b] for b in found)) < 1e-6 * max(1, len(found))


def test_top_is_exact(spark, monkeypatch):
    monkeypatch.setattr(c, "FEW", 10)
    monkeypatch.setattr(c, "BINS", 7)
    keys = np.round(np.random.default_rng(2).normal(size=700), 2)  # with ties
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(keys)], "doc_id long, key double").repartition(4)
    order = sorted(range(700), key=lambda i: (-keys[i], i))
    for k in (0, 1, 350, 699, 700, 900):
        assert {r["doc_id"] for r in c.top(rows, k).filter("kept").collect()} == set(order[:k])
        assert c.top(rows, k).count() == 700
    same = spark.createDataFrame([(i, 1.0) for i in range(50)], "doc_id long, key double")
    assert {r["doc_id"] for r in c.top(same, 20).filter("kept").collect()} == set(range(20))


def test_ties_of_any_number(spark, monkeypatch):
    """Repeated rows and null ids, more than are ever sorted together, share the key of the k-th."""
    monkeypatch.setattr(c, "FEW", 5)
    monkeypatch.setattr(c, "BINS", 4)
    ids = [*range(40), *[7] * 60, *[None] * 50, 2**62, 2**62 + 1, -(2**63)]
    rows = spark.createDataFrame([(i, 1.0 if n % 9 else 2.0) for n, i in enumerate(ids)], "doc_id long, key double").repartition(5).cache()
    order = sorted(((-r["key"], r["doc_id"] is None, r["doc_id"] or 0) for r in rows.collect()))
    for k in (1, 17, 30, 60, 100, 130, 152):
        out = c.top(rows, k).collect()
        assert len(out) == len(ids)
        assert sorted((-r["key"], r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["kept"]) == order[:k]


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    rows = c.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_empty(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert c.resample(documents(), labels).count() == 0
    assert [r["log_weight"] for r in c.resample(documents("a", None), labels).collect()] == [0.0, 0.0]
