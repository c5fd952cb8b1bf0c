"""Scratch tables and components."""

import random

import pytest

from arrayloom.llm import _shared
from arrayloom.llm.components import components


def test_scratch_tables_go_when_told(spark):
    _shared.cleanup(spark)
    kept = _shared.materialise(spark.range(5), "numbers")
    assert kept.count() == 5
    assert _shared.cleanup(spark) == 1 and _shared.cleanup(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
        kept.agg({"id": "sum"}).collect()


@pytest.mark.parametrize("shape", ["path", "star", "random", "pairs"])
def test_components(spark, shape):
    rnd = random.Random(7)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 200)] + [(500, 501), (501, 502)],
        "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)],
        "pairs": [(2 * i + 1, 2 * i) for i in range(50)] * 2,
    }[shape]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
