"""Array frames and conversions at their limits."""

import math

import pytest
from pyspark.sql import functions as F

from arrayloom.errors import LinkError, SelectionError, TypeMismatchError, UnsupportedError
from arrayloom.functions import convert as cv
from arrayloom.operators import chunkmath, objects, tables
from arrayloom.operators.frame import ArrayFrame

SPECIAL = [0.0, -0.0, 2.7, -2.7, 127.9, 128.0, -128.9, -129.0, 255.5, 256.0, 1e20, -1e20, 2.0**63, -(2.0**63), 2.0**64, 2.0**63 - 1024, math.inf, -math.inf, math.nan, None]


@pytest.mark.parametrize("target", ["i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64"])
def test_floats_cut_and_saturate(spark, target):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(SPECIAL)], "i long, x double").withColumn("y", cv.convert(F.col("x"), "f64", target))
    low, high = cv.limits(target)
    for r in rows.collect():
        x = SPECIAL[r["i"]]
        want = None if x is None else 0 if math.isnan(x) else low if x <= low else high if x >= high else int(x)
        assert (None if r["y"] is None else int(r["y"])) == want, (x, r["y"], want)


@pytest.mark.parametrize("source", ["i8", "i64", "u32", "u64"])
@pytest.mark.parametrize("target", ["i8", "i32", "i64", "u8", "u32", "u64", "f64"])
def test_integers_saturate(spark, source, target):
    low, high = cv.limits(source)
    values = sorted({low, high, 0, 1, max(low, -1), min(high, 127), min(high, 128), min(high, 2**32), min(high, 2**63)})
    kind = cv.ELEMENTS[source].simpleString()
    rows = spark.createDataFrame([(str(v),) for v in values], "s string").select("s", cv.convert(F.col("s").cast(kind), source, target).alias("y"))
    for r in rows.collect():
        v = int(r["s"])
        if target == "f64":
            assert r["y"] == float(v)
        else:
            lo, hi = cv.limits(target)
            assert int(r["y"]) == max(lo, min(hi, v))


def test_narrowing_floats_overflows_to_infinity(spark):
    got = spark.createDataFrame([(1e300,), (-1e300,), (0.1,)], "x double").select(cv.convert(F.col("x"), "f64", "f32").alias("y")).collect()
    assert [r["y"] for r in got][:2] == [math.inf, -math.inf] and abs(got[2]["y"] - 0.1) < 1e-8


@pytest.fixture
def grid(spark):
    df = spark.range(23 * 10).select(F.expr("id div 10").alias("i0"), (F.col("id") % 10).alias("i1"), (F.col("id") * 0.5).alias("value"))
    return ArrayFrame(df, (23, 10), "f64", (4, 3), fill=-1.0)


def test_windows_and_regions(grid):
    for start, count, want in [(0, 23, 230), (22, 1, 10), (7, 0, 0), (23, 5, 0), (21, 100, 20)]:
        assert grid.rows(start, count).df.count() == want
    assert grid.region((22, 9), (1, 1)).df.collect()[0]["value"] == 114.5
    for bad in (((0,), (1,)), ((0, 0), (24, 1)), ((0, -1), (1, 1))):
        with pytest.raises(SelectionError):
            grid.region(*bad)
    with pytest.raises(UnsupportedError):
        grid.strided(2)
    with pytest.raises(SelectionError):
        grid.rows(-1, 2)


def test_filters_reach_the_scan(spark, tmp_path, grid):
    grid.df.write.parquet(str(tmp_path / "p"))
    a = grid._with(spark.read.parquet(str(tmp_path / "p")))
    plan = a.region((4, 3), (2, 2)).df.select("value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(i0)" in plan and "GreaterThanOrEqual(i0,4)" in plan


def test_chunks_and_density(grid):
    index = grid.chunk_index().collect()
    assert len(index) == 6 * 4 and grid.chunk_grid() == (6, 4)
    assert sum(r["n_elements"] for r in index) == 230 and sum(r["is_partial"] for r in index) == 6 + 4 - 1
    assert tuple(grid.is_dense().first()) == (230, 0, 0, 0)
    holes = grid._with(grid.df.filter("i0 <> 3").union(grid.df.filter("i0 = 1")))
    assert tuple(holes.is_dense().first()) == (230, 10, 10, 0)
    stray = grid.df.filter("i0 <> 3").union(grid.df.filter("i0 = 1 AND i1 < 2").withColumn("i0", F.lit(999).cast("long")))
    assert tuple(grid._with(stray).is_dense().first()) == (230, 10, 0, 2)
    assert grid._with(grid.df.filter("i0 <> 3")).densify().df.filter("value = -1").count() == 10


def test_changes_check_type_and_shape(grid):
    longer = grid.append(grid.rows(0, 2), grid.rows(0, 1))
    assert longer.shape == (26, 10) and longer.df.filter("i0 = 25").agg(F.sum("value")).first()[0] == sum(i * 0.5 for i in range(10))
    with pytest.raises(TypeMismatchError):
        grid.append(grid.transpose())
    with pytest.raises(TypeMismatchError):
        grid.overwrite(grid.rows(0, 2))
    with pytest.raises(TypeMismatchError):
        grid.append(grid.as_("i32"))
    assert grid.transpose().shape == (10, 23)


def test_scale_and_bits(spark):
    df = spark.createDataFrame([(0, 1.26), (1, 1.0), (2, 5.05), (3, -1.5)], "i0 long, value double")
    got = {r["i0"]: r["value"] for r in chunkmath.decimal_scale(ArrayFrame(df, (4,), "f64", (2,)), 1).df.collect()}
    assert abs(got[0] - 1.3) < 1e-12 and abs(got[2] - (66 / 10 - 1.5)) < 1e-12
    ints = spark.createDataFrame([(0, 5), (1, 5), (2, 0), (3, 256)], "i0 long, value long")
    a = ArrayFrame(ints, (4,), "i64", (2,))
    assert [r["minbits"] for r in chunkmath.min_bits(a).orderBy("min_value").collect()] == [9, 0]
    assert [r["minbits"] for r in chunkmath.min_bits(a, True).orderBy("min_value").collect()] == [9, 1]
    halves = spark.createDataFrame([(x,) for x in (0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994)], "x double").select(chunkmath.half_away(F.col("x")))
    assert [r[0] for r in halves.collect()] == [1, -1, 2, 3, -3, 0]


def test_links_chain_dangle_and_loop(spark):
    chain = [("/d", "/", "d", "dataset", 1, None)] + [(f"/l{i}", "/", f"l{i}", "soft", None, "/d" if i == 0 else f"/l{i - 1}") for i in range(40)] + [("/x", "/", "x", "soft", None, "/no")]
    found = {r["path"]: r["final"] for r in objects.resolve_links(spark.createDataFrame(chain, objects.CATALOG)).collect()}
    assert found["/l39"] == "/d" and found["/x"] is None
    loop = spark.createDataFrame([("/a", "/", "a", "soft", None, "/b"), ("/b", "/", "b", "soft", None, "/a")], objects.CATALOG)
    with pytest.raises(LinkError):
        objects.resolve_links(loop)


def test_table_values(spark):
    df = spark.createDataFrame([(0, "b", 2), (1, "a", 1)], "i long, k string, v int")
    assert tables.to_map(df, "k", "v").first()["map"] == {"a": 1, "b": 2}
    codes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "c int").select(tables.categorical_labels(F.col("c"), ["x", "y"]))
    assert [r[0] for r in codes.collect()] == [None, "x", "y", None]


def test_selections_compose(grid):
    cut = grid.region((5, 2), (10, 6))
    assert [r["value"] for r in cut.rows(2, 1).region((0, 3), (1, 1)).df.collect()] == [(7 * 10 + 5) * 0.5]
    assert cut.rows(20, 5).df.count() == 0 and cut.rows(8, 100).shape == (2, 6)
    with pytest.raises(SelectionError):
        cut.region((0, 0), (11, 1))
    holes = cut._with(cut.df.filter("i0 <> 6"))
    dense = {(r["i0"], r["i1"]): r["value"] for r in holes.densify().df.collect()}
    assert len(dense) == 60 and dense[6, 2] == -1 and dense[14, 7] == (14 * 10 + 7) * 0.5
    assert tuple(holes.is_dense().first()) == (60, 6, 0, 0)
    joined = {(r["i0"], r["i1"]): r["value"] for r in cut.append(grid.region((20, 2), (3, 6))).df.collect()}
    assert len(joined) == 78 and joined[15, 2] == (20 * 10 + 2) * 0.5 and (17, 7) in joined
    again = cut.rebased()
    assert again.origin == (0, 0) and again.df.agg(F.max("i0"), F.min("i1")).first() == (9, 0)
    assert cut.transpose().origin == (2, 5) and cut.transpose().rows(1, 1).df.filter("i0 <> 3").count() == 0


def test_patches_stay_within(spark, grid, monkeypatch):
    from arrayloom.operators import frame

    new = spark.createDataFrame([(3, 4, 77.0), (22, 9, 78.0)], "i0 long, i1 long, value double")
    holes = grid._with(grid.df.filter("i0 <> 3"))
    for bound in (frame.PATCH_ROWS, 0):
        monkeypatch.setattr(frame, "PATCH_ROWS", bound)
        got = {(r["i0"], r["i1"]): r["value"] for r in holes.patch(new).df.collect()}
        assert len(got) == 221 and got[3, 4] == 77 and got[22, 9] == 78 and got[0, 1] == 0.5
        with pytest.raises(Exception, match="no place 23, 0"):
            grid.patch(spark.createDataFrame([(23, 0, 1.0)], "i0 long, i1 long, value double")).df.collect()


def test_nested_arrays_keep_places(grid):
    rows = {r["i0"]: r["values"] for r in grid._with(grid.df.filter("NOT (i0 = 2 AND i1 IN (0, 4))")).region((1, 0), (3, 10)).nested().collect()}
    assert rows[1] == [(10 + k) * 0.5 for k in range(10)]
    assert rows[2] == [None if k in (0, 4) else (20 + k) * 0.5 for k in range(10)]


def test_absent_elements_are_stored_as_the_fill(spark, grid, tmp_path):
    from arrayloom.sources import codecs
    from arrayloom.sources.datasource import read_frame, write_frame

    holes = grid._with(grid.df.filter("NOT (i0 = 2 AND i1 = 5)"))
    path = str(tmp_path / "f.h5")
    write_frame(holes, path, "/x", [("deflate", 1)])
    got = {(r["i0"], r["i1"]): r["value"] for r in read_frame(spark, path, "/x").df.collect()}
    assert len(got) == 230 and got[2, 5] == -1 and got[2, 6] == 13
    window = codecs.roundtrip(grid.region((5, 3), (7, 5)), [("shuffle", None)])
    assert {(r["i0"], r["i1"]): r["value"] for r in window.df.collect()} == {(i, j): ((i + 5) * 10 + j + 3) * 0.5 for i in range(7) for j in range(5)}
