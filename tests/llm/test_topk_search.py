"""Exact top k against scores of every document."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arrayloom.llm import topk_search as s


def brute(docs, queries, k):
    bags = [(i, Counter((t or "").lower().encode().split())) for i, t in docs]
    n = len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / max(1, n)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for q, text in queries:
        words = sorted(set((text or "").lower().encode().split()))
        scored = []
        for i, b in bags:
            size = sum(b.values())
            x = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in words if w in b)
            if x > 0:
                scored.append((-round(x, 9), i))
        out[q] = sorted(scored, key=lambda e: (e[0], e[1] is None, e[1]))[:k]
    return out


def agree(rows, want):
    """Ids, ranks and scores. Scores within rounding of each other are ties, which go to the lesser id."""
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r[0], []).append((r["rank"], r["doc_id"], r["score"]))
    assert set(got) == {q for q, best in want.items() if best}
    for q, best in want.items():
        mine = got.get(q, [])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        for (_, doc, score), (x, i) in zip(mine, best, strict=True):
            assert doc == i and abs(score + x) < 1e-9 * max(1, abs(x)), (q, mine, best)


@pytest.mark.parametrize("shard", [8192, 37])
def test_against_every_document(spark, documents, monkeypatch, shard):
    monkeypatch.setattr(s, "SHARD_DOCS", shard)
    monkeypatch.setattr(s, "BLOCK_DOCS", 4)
    rnd = random.Random(4)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 80))) for _ in range(400)] + [None, "", "w1 W1 w2"] * 2 + ["w1 w2 w3 only"] * 30
    docs = documents(*texts).withColumn("score", F.lit("clash")).repartition(3)
    queries = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query"), "text")
    rows = s.top_k(docs, queries.union(queries), k=5, block_words=800).collect()
    agree(rows, brute(list(enumerate(texts)), [(i, t) for i, t in enumerate(texts) if i % 7 == 0], 5))


def test_ties_go_to_the_lesser_id_whatever_the_shard(spark, monkeypatch):
    """Many copies over shards and partitions, ids falling, repeated and null."""
    monkeypatch.setattr(s, "SHARD_DOCS", 7)
    rows = [(900 - i, "a b c d" if i % 3 else f"a b x{i}") for i in range(90)] + [(5, "a b c d")] * 3 + [(None, "a b c d")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "a c"), (2, "d d D"), (3, "x3 a"), (4, "nothing here")], "query long, text string")
    agree(s.top_k(docs, queries, k=6).collect(), brute(rows, [(1, "a c"), (2, "d"), (3, "x3 a"), (4, "nothing here")], 6))
    everything = s.top_k(docs, queries.filter("query = 2"), k=100).collect()
    assert [r["doc_id"] for r in sorted(everything, key=lambda r: r["rank"])] == [*[5] * 3, *sorted(i for i, t in rows if t == "a b c d" and i not in (5, None)), None, None]


def test_blocks_are_skipped(documents, monkeypatch):
    """Most documents are never scored in full, and a floor leaves fewer."""
    rnd = random.Random(8)
    vocabulary = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(4000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(1000)]
    shard = s.Collected(0)
    for i, t in enumerate(texts):
        shard.add(i, s.words_of(t))
    row = shard.row().to_pylist()[0]
    row = {c: __import__("numpy").frombuffer(row[c], k) if k else row[c] for c, k in (("ids", None), ("sizes", "i8"), ("starts", "i8"), ("places", "i4"), ("counts", "i4"))}
    np = s.np
    df = np.bincount(row["places"]).astype(float)
    idf = np.log(1 + (1000 - df + 0.5) / (df + 0.5))
    made = s.Shard(row, np.arange(len(df)), idf, 60.0, np.flatnonzero(df > 1000 / s.COMMON))
    scored = []
    whole = made.score
    made.score = lambda sums, rows, docs: (scored.append(len(docs)), whole(sums, rows, docs))[1]
    queries = [row["places"][row["starts"][i] : row["starts"][i + 1]] for i in range(0, 1000, 50)]
    found = list(made.best(queries, 3, np.zeros(len(queries))))
    assert sum(scored) < 0.5 * 1000 * len(queries) and all(i * 50 in docs for i, (docs, _) in enumerate(found))


def test_few_documents_are_scored_in_full():
    """Where bounds by block are loose (common words of very different weight), bounds by document leave few beside the first 4 * k."""
    np = s.np
    rnd = random.Random(9)
    shard = s.Collected(0)
    for i in range(2000):
        shard.add(i, s.words_of(" ".join(f"c{j}" for j in range(30) for _ in range(rnd.choice((0, 0, 1, 1, 2, 9)))) + f" r{i % 40}"))
    row = shard.row().to_pylist()[0]
    row = {c: np.frombuffer(row[c], k) if k else row[c] for c, k in (("ids", None), ("sizes", "i8"), ("starts", "i8"), ("places", "i4"), ("counts", "i4"))}
    df = np.bincount(row["places"]).astype(float)
    made = s.Shard(row, np.arange(len(df)), np.log(1 + (2000 - df + 0.5) / (df + 0.5)), 70.0, np.flatnonzero(df > 2000 / s.COMMON))
    queries = [np.sort(row["places"][row["starts"][i] : row["starts"][i + 1]]) for i in range(0, 2000, 100)]
    scored, whole = [], made.score
    made.score = lambda sums, rows, docs: (scored.append(len(docs)), whole(sums, rows, docs))[1]
    found = list(made.best(queries, 5, np.zeros(len(queries))))
    assert sum(scored) < 2 * 4 * 5 * len(queries)
    for query, (docs, scores) in zip(queries, found, strict=True):
        every = whole(made.added(query[made.row[query] < 0]), made.row[query][made.row[query] >= 0], np.arange(2000))
        best = np.lexsort((np.arange(2000), -every))[:5]
        assert sorted(docs.tolist()) == sorted(best.tolist()) and sorted(scores) == sorted(every[best])


def test_scores_do_not_depend_on_their_company():
    """The sum over common words is in one order, whatever documents are scored together."""
    rng = s.np.random.default_rng(5)
    shard = s.Shard.__new__(s.Shard)
    shard.by_doc = rng.random((300, 500)) * 10.0 ** rng.integers(-6, 6, (300, 500))
    sums, rows = rng.random(500), s.np.flatnonzero(rng.random(300) < 0.4)
    want = sums.copy()
    total = s.np.zeros(500)
    for r in rows:
        total = total + shard.by_doc[r]
    want += total
    for size in (1, 2, 3, 7, 64, 500):
        docs = rng.choice(500, size, replace=False)
        assert (shard.score(sums, rows, docs) == want[docs]).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = s.op2_topk_search(spark, sf).collect()
    agree(rows, brute(docs, [x for x in docs if x[0] % 50 == 0], s.K))


def test_empty(spark, documents):
    none = documents()
    assert s.top_k(none, none.select(F.col("doc_id").alias("query"), "text")).count() == 0
    some = documents("a b", "b", None)
    assert s.top_k(none, some.select(F.col("doc_id").alias("query"), "text")).count() == 0
