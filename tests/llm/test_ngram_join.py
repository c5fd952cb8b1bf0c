"""The join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.llm import ngram_join as j


def sets_of(text):
    w = (text or "").encode().split()
    if not w:
        return frozenset()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(texts, threshold=0.8):
    """links and least member of the class of each text, by an inverted index over all shingles."""
    sets = [sets_of(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for k in holders[x]:
                if k != i:
                    both[k] += 1
        for k, n in both.items():
            if n >= threshold * (len(s) + len(sets[k]) - n) - 1e-9:
                links[i] += 1
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(texts))]


def near(words, rnd, share):
    return " ".join(w if rnd.random() > share else f"x{rnd.randrange(10**6)}" for w in words)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    out = []
    for g in range(30):
        words = [f"g{g}w{rnd.randrange(10**5)}" for _ in range(rnd.choice([8, 40, 150, 400]))]
        out += [near(words, rnd, 0.012) for _ in range(rnd.choice([1, 2, 3, 12]))]
    base = [f"b{i}" for i in range(120)]
    out += [" ".join(base[:100] + [f"t{i}"] + base[100:]) for i in range(150)]  # one large group
    out += [None, "", "  ", "one two", "one two", "one  two", "one two three four five"] + ["the same words again and again here"] * 40
    out += [" ".join(f"z{i}_{k}" for k in range(300)) for i in range(30)]
    return out


def check(rows, texts):
    links, least = brute(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}
    assert len(rows) == len(texts)
    assert got == {i: (least[i], links[i]) for i in range(len(texts))}


def test_against_all_pairs(spark, documents, texts):
    docs = documents(*texts).withColumn("rep", F.lit("clash")).withColumn("class_id", F.lit(1)).repartition(3)
    check(j.similar(docs).withColumnRenamed("id", "doc_id").collect(), texts)


def test_small_buckets_and_blocks(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(j, "BUCKET", 8)
    monkeypatch.setattr(j, "BLOCK", 16)
    monkeypatch.setattr(j, "BROADCAST_IDS", 0)
    check(j.similar(documents(*texts)).withColumnRenamed("id", "doc_id").collect(), texts)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in docs] == list(range(len(docs)))
    check(j.op5_ngram_join(spark, sf).collect(), [r["text"] for r in docs])


def as_documents(rows):
    """Rows (id, text) as documents, ids with a set, in the order of their ids; links and least id of the class of each."""
    known = sorted({(i, sets_of(t)) for i, t in rows if sets_of(t)}, key=lambda d: (d[0], sorted(d[1])))
    holders, links, root = defaultdict(set), [0] * len(known), list(range(len(known)))
    for k, (_, s) in enumerate(known):
        for x in s:
            holders[x].add(k)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, s) in enumerate(known):
        for m in set().union(*(holders[x] for x in s)) - {k}:
            both = len(s & known[m][1])
            if both >= 0.8 * (len(s) + len(known[m][1]) - both) - 1e-9:
                links[k] += 1
                p, q = find(k), find(m)
                root[max(p, q)] = min(p, q)
    return {d: (links[k], known[find(k)][0], find(k)) for k, d in enumerate(known)}


def repeated_rows(texts):
    """Rows with ids repeated: whole rows, with other blanks, with near and with other words; without words; null."""
    rows = list(enumerate(texts))
    rows += rows[:25] * 2 + [(i, f" {texts[i]}  ") for i in range(5, 20)] + [(i, texts[i + 40]) for i in range(10)] + [(i, f"{texts[i]} more") for i in range(20, 30)]
    return rows + [(3, None), (3, ""), (7, " "), (None, texts[0]), (None, texts[0]), (None, "only this one here"), (None, None), (None, None)]


def with_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = {r["text"]: r["id"] for r in docs.filter("doc_id IS NULL").select("text", j._id().alias("id")).distinct().collect()}
    return docs, [(given[t] if i is None else i, t) for i, t in rows]


def test_small_repeats(spark):
    base = [f"w{i}" for i in range(40)]
    one, two = " ".join(base), " ".join([*base, "end"])
    for rows, want in (([(1, one), (1, one), (4, two)], {1: (1, 1), 4: (1, 1)}), ([(1, one)] * 3, {1: (1, 0)}), ([(1, one), (2, one), (2, one)], {1: (1, 1), 2: (1, 1)})):
        got = j.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and {r["id"]: (r["class_id"], r["n_links"]) for r in got} == want


def test_repeated_ids(spark, texts):
    docs, rows = with_ids(spark, repeated_rows(texts))
    want = as_documents(rows)
    got = sorted((r["id"], r["class_id"], r["n_links"]) for r in j.similar(docs).collect())
    assert got == sorted((i, *((want[i, sets_of(t)][1], want[i, sets_of(t)][0]) if sets_of(t) else (i, 0))) for i, t in rows)


@pytest.mark.parametrize("bound", [j.BROADCAST_IDS, 0])
def test_one_of_each_class_stays(spark, texts, monkeypatch, bound):
    monkeypatch.setattr(j, "BROADCAST_IDS", bound)
    docs, rows = with_ids(spark, repeated_rows(texts))
    docs = docs.withColumn("id", F.lit("clash")).withColumn("__key", F.lit(1))
    want = as_documents(rows)
    kept = j.representatives(docs)
    assert kept.columns == docs.columns
    mine = kept.withColumn("given", j._id()).collect()
    wordless = sorted(r["given"] for r in mine if not sets_of(r["text"]))
    assert wordless == sorted({i for i, t in rows if not sets_of(t)})
    classes = [want[r["given"], sets_of(r["text"])] for r in mine if sets_of(r["text"])]
    assert sorted(c for _, _, c in classes) == sorted({c for _, _, c in want.values()})  # one row a class
    assert all(r["given"] == want[r["given"], sets_of(r["text"])][1] for r in mine if sets_of(r["text"]))


def test_recall_at_the_threshold(spark):
    """Pairs at 0.8 to 0.83, each alone, without the help of other copies."""
    rnd = random.Random(3)
    rows = []
    for g in range(400):
        words = [f"p{g}w{rnd.randrange(10**6)}" for _ in range(204)]
        new = list(words)
        for at in rnd.sample(range(0, 200, 6), 4):
            new[at + 2] = f"x{g}_{at}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(new))]
    alike = [k for k in range(400) if len(a := sets_of(rows[2 * k][1])) and len(a & (b := sets_of(rows[2 * k + 1][1]))) >= 0.8 * len(a | b)]
    got = {r["id"]: r["n_links"] for r in j.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(got[2 * k] for k in alike) / len(alike)
    print(f"recall at the threshold: {recall:.4f} of {len(alike)} pairs")
    assert len(alike) > 300 and recall >= 0.99


def test_parts_of_a_large_group(spark, documents, monkeypatch):
    """A chain of near copies, dealt into few parts, each compared in small blocks."""
    monkeypatch.setattr(j, "BLOCK", 16)
    monkeypatch.setattr(j, "PARTS", 3)
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[k : k + 100]) for k in range(300)]
    check(j.similar(documents(*texts)).withColumnRenamed("id", "doc_id").collect(), texts)


def test_empty(spark, documents):
    assert j.similar(documents()).count() == 0
    assert j.representatives(documents(None, "", "a")).count() == 3


def test_overlaps():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 20_000, n).astype(np.uint64)) for n in (1, 50, 9000, 15_000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (j.overlaps(sets)[np.triu_indices(4, 1)] == np.array(want)[np.triu_indices(4, 1)]).all()
    assert (j.overlaps(sets[:3], sets[1:]) == np.array(want)[:3, 1:]).all()


def test_memory_of_comparisons_does_not_grow_with_the_sets():
    """Two blocks of the longest texts (20,000 words): what is held beside the sets stays bounded, the numbers are exact."""
    import tracemalloc

    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 40_000, np.uint64)
    a, b = ([np.unique(rng.choice(pool, 20_000)) for _ in range(j.BLOCK)] for _ in range(2))
    tracemalloc.start()
    both = j.overlaps(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    for x, y in ((0, 0), (3, 5), (127, 64)):
        assert both[x, y] == len(np.intersect1d(a[x], b[y]))
    assert (j.overlaps(a[:9])[2, 3:] == [len(np.intersect1d(a[2], x)) for x in a[3:9]]).all()
