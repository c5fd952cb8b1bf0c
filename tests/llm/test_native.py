"""Quality rules and mixing: SQL agreement, brute force and the defined results."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from arrayloom.llm import mixing, quality_rules, registry

from .test_pipeline import WORD, passes


def plain(v):
    return float(f"{v:.12g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", registry.ORACLES)
def test_agrees_with_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want)


def brute(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_measures_by_brute_force(spark, documents):
    rnd = random.Random(9)
    parts = ["a", "b", "Ab", "é", "😀", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "#", "|", "a b c", "\r\n"]
    texts = [None, "", " \n ", "a b c", "a b c a b c", "a a a a", "x" * 100_000, "w " * 30_000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    docs = documents(*texts).withColumn("n_words", F.lit("clash")).withColumn("l", F.lit(1))
    rows = quality_rules.ledger(docs.union(docs.limit(3))).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), repr(t)
        assert (r["failed_rules"] == 0) == passes(t or "")


def test_filter_keeps_own_columns(spark, documents):
    good = " ".join(f"word{i}" for i in range(80))
    docs = documents(good, "short", None).withColumn("failed_rules", F.lit("mine"))
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and [(r["doc_id"], r["failed_rules"]) for r in kept.collect()] == [(0, "mine")]
    assert quality_rules.filter_documents(documents()).count() == 0


def test_clashing_names(spark, documents):
    names = ("__m", "w", "own", "size", "copies", "copy", "target", "source_size", "rate", "key", "salt", "of", "__rate", "__source", "__size", "__copies", "__copy")
    docs = documents("a b c", None, " ".join(f"w{i}" for i in range(70)))
    for name in names:
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    kept = [n for n in names if n not in quality_rules.MEASURES]
    for out in (quality_rules.ledger(docs), quality_rules.filter_documents(docs), mixing.mix(docs)):
        rows = out.collect()
        assert rows and all(r[n] == f"my {n}" for r in rows for n in kept)
    assert mixing.mix(docs).columns == docs.columns


def test_ablation_from_the_ledger_alone(spark):
    masks = [0] * 5 + [1] * 3 + [1 | 4] * 2 + [4] * 7
    rows = {r["rule"]: r for r in quality_rules.ablation(spark.createDataFrame([(m,) for m in masks], "failed_rules long")).collect()}
    assert (rows["too_few_words"]["failed"], rows["too_few_words"]["alone"], rows["too_few_words"]["kept_without"]) == (5, 3, 8)
    assert (rows["symbols"]["failed"], rows["symbols"]["alone"], rows["symbols"]["kept_without"]) == (9, 7, 12)
    assert rows["upper_case"]["failed"] == 0
    none = quality_rules.ablation(spark.createDataFrame([], "failed_rules long")).collect()
    assert all(r["failed"] == 0 and r["kept_without"] == 0 for r in none)


def level(sizes, weights):
    """Targets by sharing again and again what stops at the ceiling."""
    total, free = 1.5 * sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while free:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        share = {i: left * weights[i] / sum(weights[k] for k in free) for i in free}
        over = {i for i in free if share[i] > 2 * sizes[i]}
        if not over:
            for i in free:
                target[i] = share[i]
            return target
        for i in over:
            target[i] = 2 * sizes[i]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 1, 7, 3, 100], [0, 5, 0], [1], [0, 0], [3] * 12, [1000, 1, 1, 1]])
def test_targets_level_out(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(rows).orderBy("source").collect()]
    want = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(got, want, strict=True)), (got, want)


def test_mix_meets_targets_and_repeats(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(1, 30), "en", ["a", "b", "c", None, "d"][min(4, int(rnd.expovariate(1.2)))], 0) for i in range(6000)] + [(None, None, None, "e", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("rate", F.lit("clash"))
    rows = mixing.copies(docs, sized=True).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r["own"]["source"]] += r["size"] * r["copies"]
        size[r["own"]["source"]] += r["size"]
        target[r["own"]["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.12 * t + 1e-9 and t <= 2 * size[s]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = Counter(r["doc_id"] for r in mixed.collect())
    assert count == Counter(r["doc_id"] for r in mixing.mix(docs.repartition(7)).collect())
    assert count == Counter({r["own"]["doc_id"]: r["copies"] for r in rows if r["copies"] and r["own"]["doc_id"] is not None})


def test_salted_rates_are_the_same(spark, documents, monkeypatch):
    docs = documents(*["a b c"] * 50).union(documents(*["a b"] * 30, source=None))
    here = sorted(r["copies"] for r in mixing.copies(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(r["copies"] for r in mixing.copies(docs).collect()) == here


def test_empty_mix(spark, documents):
    assert mixing.mix(documents()).count() == 0
    assert mixing.mix(documents(None, "")).count() == 0
