"""Held-out accuracy of the compression classifier, and its defined results."""

import numpy as np
from pyspark.sql import functions as F

from arrayloom.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    hit = np.array([r["predicted"] for r in rows])
    assert auc > 0.92
    assert (hit & y).sum() / y.sum() > 0.7
    assert (hit & (1 - y)).sum() / (1 - y).sum() < 0.02


def test_features_by_brute_force():
    """Windows, savings and what is made of them, by plain steps."""
    import zstandard

    rnd = np.random.default_rng(1)
    text = " ".join(rnd.choice(["vile", "Gronker,", "and", "the", "road", "was", "dry", "x9"], 700))
    ordinary, toxic = b"the road was dry and the day was long", b" vile gronker vile "
    got = toxicity.Savings(ordinary, toxic).features(text)
    words = text.lower().encode().split()
    windows = [b" ".join(words[i : i + 16]) for i in range(0, 700, 16)]
    want = [np.log1p(len(windows))]
    for level in toxicity.LEVELS:
        sizes = []
        for content in (ordinary, toxic + ordinary):
            kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(level=level, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append([len(tool.compress(w)) for w in windows])
        saved = sorted((a - b for a, b in zip(*sizes, strict=True)), reverse=True)
        n = len(saved)
        want += [
            min(saved[0], 12), min(sum(saved[:3]) / 3, 12), sum(saved[:10]) / 10, sum(saved) / n, sum(x >= 2 for x in saved) / n,
            sum(x >= 3 for x in saved) / n, np.log1p(sum(x >= 3 for x in saved)), sum(min(max(x, 0), 8) for x in saved) / n,
        ]
    assert np.allclose(got, want) and max(want) > 3


def test_what_is_learned_from_is_bounded_by_rows(spark, documents, monkeypatch):
    """Repeated ids are taken once, whole texts or none, so many bytes a class."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    docs = documents(*[("bad gronker day " if i % 2 else "long dry road ") * (1 + i % 5) for i in range(80)])
    docs = docs.union(docs).union(documents("road " * 10_000))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    seen = []
    whole = toxicity.train_dictionaries
    monkeypatch.setattr(toxicity, "train_dictionaries", lambda a, b: (seen.append((a, b)), whole(a, b))[1])
    toxicity.fit(docs, labels)
    (ordinary, toxic), = seen
    assert ordinary and toxic and all(sum(len(b" ".join(d)) for d in side) <= 2000 for side in (ordinary, toxic))
    assert all(len(d) % 3 == 0 and len(d) <= 15 for d in ordinary + toxic)


def test_texts_of_all_kinds(spark, documents):
    bad, good = "what a vilest gronker you are ", "the day was long and the road was dry "
    docs = documents(*[good * 3 + bad * 2 * (i % 2) for i in range(60)], None, "", "x" * 100_000, good * 3)
    labels = docs.select("doc_id", F.when(F.col("text").contains("gronker"), 1).otherwise(0).alias("toxic")).filter("doc_id < 60")
    model = toxicity.fit(docs.withColumn("toxic", F.lit("clash")), labels.union(labels))
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text").union(docs.select("doc_id", "text")), model).collect()}
    assert len(rows) == 64 and all(0 <= x <= 1 for x in rows.values())
    assert rows[60] == rows[61] and rows[62] < 0.5 and rows[63] == rows[0]
    assert min(rows[i] for i in range(1, 60, 2)) > max(rows[i] for i in range(0, 60, 2))


def test_without_labels_or_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(documents("a", "b"), labels).prior == 0
    model = toxicity.fit(documents("a", "b"), labels)
    assert {r["score"] for r in toxicity.score(documents("a", None), model).collect()} == {0.0}
    assert toxicity.score(documents(), model).count() == 0
