"""Columns that go to files by way of executors: little comes to the driver, and the files hold every element in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.mat import objects as mo
from arrayloom.mat import register_table, scan, write_mat
from arrayloom.plans import catalogue
from arrayloom.sources import datasource
from arrayloom.sources.h5 import File, String, of_element
from arrayloom.sources.spool import spool_elements

SF = "/root/testdata/sf0.001"


@pytest.fixture
def to_driver(spark, monkeypatch):
    """How many rows each call brings to the driver."""
    kind, seen = type(spark.range(1)), []
    for name in ("collect", "toArrow", "toPandas"):

        def counted(df, real=getattr(kind, name)):
            out = real(df)
            seen.append(getattr(out, "num_rows", None) or len(out))
            return out

        monkeypatch.setattr(kind, name, counted)
    return seen


@pytest.mark.parametrize("name", ["compound_project", "compound_read", "mat_table", "mat_timetable_regular", "mat_datetime_ns", "mat_duration_seconds", "categorical_labels", "mat_matrix", "h5_tree2", "swmr_prefix", "complex_read", "fixed_string_nullterm", "fixed_string_nullpad", "fixed_string_spacepad"])
def test_no_column_comes_to_the_driver(spark, to_driver, name):
    found = catalogue.QUERIES[name](spark, SF)
    assert sum(to_driver) < 100
    assert found.count() >= (70 * 31 if name == "h5_tree2" else 1000)


def test_spooled_elements_are_in_order_and_read_in_parts(spark, tmp_path):
    df = spark.range(0, 5000, 1, 7).select((F.lit(4999) - F.col("id")).alias("k"), (F.col("id") * 2).alias("v")).filter("k % 5 > 0")
    x = spool_elements(df, "k", str(tmp_path), x=(of_element("i32"), F.col("v")))["x"]
    want = np.array([2 * (4999 - k) for k in range(5000) if k % 5], "i4")
    assert len(x) == 4000 and (x.read() == want).all() and (x.read(1234, 600) == want[1234:1834]).all() and len(x.read(3990, 100)) == 10
    assert b"".join(x.runs()) == want.tobytes()
    path = str(tmp_path / "f.h5")
    datasource.write_spool(spark, x, path, "/x", 300, [("shuffle", None), ("deflate", 1)], rows=3100)
    with File(path) as file:
        assert (file.read("/x") == want[:3100]).all()
    x.drop()
    assert not list(tmp_path.glob("*.spool")) and not list(tmp_path.glob("*.payload"))


def test_no_rows_and_nulls(spark, tmp_path):
    none = spool_elements(spark.range(0), "id", str(tmp_path), x=(String(3), F.col("id").cast("string")))["x"]
    datasource.write_spool(spark, none, str(tmp_path / "f.h5"), "/x", 10)
    assert datasource.read_frame(spark, str(tmp_path / "f.h5"), "/x").df.count() == 0
    with pytest.raises(Exception, match="null has no stored value"):
        spool_elements(spark.range(3), "id", str(tmp_path), x=(of_element("i64"), F.expr("nullif(id, 1)")))


@pytest.mark.parametrize("timed", [None, "regular", "datetime"])
def test_tables_are_read_in_runs_of_rows(spark, tmp_path, timed):
    n, path = 17, str(tmp_path / "t.mat")
    columns = {
        "text": mo.Strings([None if i % 5 == 2 else "\U0001f600é" * (i % 4) + str(i) for i in range(n)]),
        "ts": mo.Datetime(np.arange(n) * 1000.0, np.full(n, 0.25), "UTC"),
        "gap": mo.Duration(np.arange(n) / 7),
        "label": mo.Categorical(np.arange(n).reshape(-1, 1) % 3, ["a", "b"]),
        "flag": np.arange(n) % 2 == 0,
        "pair": np.arange(2 * n).reshape(n, 2) / 3,
        "other": mo.Strings([str(i) for i in range(n)]),
    }
    times = {"origin": mo.Duration(np.array([5.0])), "specifiedAsRate": True, "sampleRate": 3.0} if timed == "regular" else mo.Datetime(np.arange(n) * 7.0)
    value = mo.Table(columns) if timed is None else mo.Timetable(columns, row_times=times)
    write_mat(path, {"t": value})
    got = scan.table(spark, path, "t", 6, 3)
    assert got.rdd.getNumPartitions() == 3
    want = value.frame(spark)
    assert got.dtypes == want.dtypes and got.collect() == want.collect() == register_table(spark, path, "t").collect()


def test_tables_of_other_parts_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "t.mat")
    for i, value in enumerate((mo.Table({"x": np.zeros((0, 1))}), mo.Table({"x": ["a", "b"]}), mo.Table({"x": np.arange(2.0)}, ["r", "s"]))):
        write_mat(path, {"t": value})
        assert scan.table(spark, path, "t") is None, i
        assert register_table(spark, path, "t").count() == value.num_rows


def test_missing_strings_and_rows_of_long_arrays(spark, tmp_path):
    df = spark.createDataFrame([(2, "z"), (0, None), (1, "")], "k long, s string")
    found = mo.spooled(df, "k", str(tmp_path), "s", k=(of_element("i64"), F.col("k")))
    write_mat(str(tmp_path / "t.mat"), {"t": mo.Table(found)})
    assert [tuple(r) for r in register_table(spark, str(tmp_path / "t.mat"), "t").select("k", "s").collect()] == [(0, None), (1, ""), (2, "z")]
    write_mat(str(tmp_path / "x.mat"), {"x": np.arange(24.0).reshape(2, 3, 4)})
    with File(str(tmp_path / "x.mat")) as file:
        whole = file.read("/x")
        x = file.resolve("/x")
        for start, count in (((1, 0, 1), (1, 3, 1)), ((2, 1, 1), (1, 1, 1)), ((1, 2, 0), (2, 1, 1)), ((0, 0, 0), (4, 3, 2))):
            assert (file.stored(x, start, count) == whole[tuple(slice(s, s + c) for s, c in zip(start, count, strict=True))]).all()
