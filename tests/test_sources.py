"""Scans, pruning, writing, following and editing files through Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.errors import NotFoundError, SelectionError, TypeMismatchError
from arrayloom.operators.frame import ArrayFrame
from arrayloom.sources import datasource as ds
from arrayloom.sources.h5 import Compound, File, FileBuilder, Fixed, Reference, String
from arrayloom.sources.session import Appender, Session, digest, load, repack


@pytest.fixture
def path(tmp_path):
    b = FileBuilder()
    b.create_dataset("e", np.arange(230).reshape(23, 10) * 0.5 - 3, chunks=(4, 3), filters=[("shuffle", None), ("deflate", 4)])
    b.create_dataset("u", np.array([0, 2**64 - 1], "u8"))
    g = b.create_group("g")
    g.create_dataset("names", ["one", "två", ""]).set_attr("n", 3)
    g.create_dataset("rec", [{"a": 1, "s": "x"}, {"a": 2, "s": "yy"}], kind=Compound.packed(a=Fixed(4), s=String(2)))
    g.create_dataset("hole", shape=(7,), kind=Fixed(4), chunks=(3,), fill=5)
    b.create_dataset("refs", [g.members["names"]], kind=Reference())
    b.create_dataset("grow", np.arange(10), chunks=(4,), maximum=(None,))
    b.link("soft", "/g/names")
    b.write(str(tmp_path / "f.h5"))
    return str(tmp_path / "f.h5")


def values(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def test_scan_and_selections(spark, path):
    a = ds.read_frame(spark, path, "e", partitions=5)
    want = np.arange(230).reshape(23, 10) * 0.5 - 3
    assert a.shape == (23, 10) and a.element == "f64" and a.chunks == (4, 3)
    assert values(a.df) == {(i, j): want[i, j] for i in range(23) for j in range(10)}
    assert values(a.region((3, 2), (9, 5)).df) == {(i, j): want[i, j] for i in range(3, 12) for j in range(2, 7)}
    window = spark.read.format("h5").options(path=path, dataset="e", rowStart=19, rowCount=40).load()
    assert window.count() == 40
    region = spark.read.format("h5").options(path=path, dataset="e", start="1,1", count="2,3").load()
    assert values(region) == {(i, j): want[i, j] for i in (1, 2) for j in (1, 2, 3)}
    with pytest.raises(Exception, match="SelectionError"):
        spark.read.format("h5").options(path=path, dataset="e", start="1,1", count="99,3").load().count()


def test_filters_prune_chunks(path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    source = ds.H5Source({"path": path, "dataset": "e", "partitions": "1000"})
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("i0", T.LongType()), T.StructField("i1", T.LongType()), T.StructField("value", T.DoubleType())])
    reader = source.reader(schema)
    assert len(reader.partitions()) == 6 * 4
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("i0",), 4), LessThan(("i0",), 9), EqualTo(("i1",), 9)]))) == 3
    parts = reader.partitions()
    assert len(parts) == 2 and sum(b.num_rows for p in parts for b in reader.read(p)) == 5


def test_kinds_of_values(spark, path):
    ds.register(spark)
    load_ = lambda d, **o: spark.read.format("h5").options(path=path, dataset=d, **o).load()
    assert values(load_("u")) == {(0,): 0, (1,): 2**64 - 1}
    assert values(load_("soft")) == {(0,): "one", (1,): "två", (2,): ""}
    assert [tuple(r["value"]) for r in load_("g/rec").orderBy("i0").collect()] == [(1, "x"), (2, "yy")]
    assert values(load_("g/hole")) == {(i,): 5 for i in range(7)}
    assert load_("e", mode="chunks").count() == 24
    found = {r["path"]: r for r in ds.catalog(spark, path).collect()}
    assert found["/soft"]["kind"] == "soft" and found["/g"]["kind"] == "group" and found["/g/names"]["address"] == load_("refs").first()["value"]


@pytest.mark.parametrize("filters", [[], [("deflate", 5)], [("shuffle", None), ("lzf", None)], [("scaleoffset", ["integer", 0])]])
def test_write_and_read_back(spark, tmp_path, filters):
    n, target = 1000, str(tmp_path / "w.h5")
    frame = ArrayFrame(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") % 37).cast("int").alias("value")), (n,), "i32", (128,))
    filters = [(a, tuple(b) if isinstance(b, list) else b) for a, b in filters]
    ds.write_frame(frame, target, "/deep/v", filters, maximum=(None,))
    assert (File(target).read("/deep/v") == np.arange(n) % 37).all()
    ds.write_frame(frame, target, "/deep/w", [], mode="append", append=True)
    assert {r["path"] for r in ds.catalog(spark, target).collect()} == {"/deep", "/deep/v", "/deep/w"}
    assert values(ds.read_frame(spark, target, "/deep/w").df) == {(i,): i % 37 for i in range(n)}
    assert not list(tmp_path.glob("*.payload"))


def test_following_is_a_prefix(spark, path, tmp_path):
    ds.register(spark)
    stream = spark.readStream.format("h5").options(path=path, dataset="grow").load()
    q = stream.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert values(spark.table("followed")) == {(i,): i for i in range(10)}
        with Session(path) as s:
            s.append("grow", np.arange(10, 17))
        q.processAllAvailable()
        assert values(spark.table("followed")) == {(i,): i for i in range(17)} and spark.table("followed").count() == 17
    finally:
        q.stop()


def test_session_edits(path):
    with Session(path) as s:
        s.append("grow", np.arange(10, 13), np.arange(13, 20))
        s.overwrite("u", np.array([7, 8], "u8"))
        s.delete("g/hole")
        s.copy("g", "h")
        s.set_attr("e", "unit", "K")
        s.create_group("new").create_dataset("z", np.zeros(2))
    f = File(path)
    assert f.read("grow").tolist() == list(range(20)) and f.read("u").tolist() == [7, 8]
    assert f.read("h/names") == ["one", "två", ""] and f.read("refs")[0] == f.resolve("g/names").address
    assert f.attributes(f.resolve("e"))["unit"] == "K" and f.attributes(f.resolve("g/names"))["n"] == 3
    assert f.read("new/z").tolist() == [0, 0]
    with pytest.raises(NotFoundError):
        f.resolve("g/hole")


def test_failed_edit_leaves_the_file(path):
    before = open(path, "rb").read()
    with pytest.raises(TypeMismatchError), Session(path) as s:
        s.delete("e")
        s.append("grow", np.arange(3.0))
    assert open(path, "rb").read() == before
    s = Session(path)
    s.delete("e")
    s.rollback()
    assert s.get("e").shape == (23, 10)


def test_repack_copies_stored_chunks(path, tmp_path):
    target = str(tmp_path / "r.h5")
    repack(path, target, ("g/hole", "u"))
    a, b = File(path), File(target)
    same = lambda f: [f.bytes_at(c.address, c.size) for c in f.chunks(f.resolve("e"))]
    assert same(a) == same(b) and digest(path, "e") == digest(target, "e")
    with pytest.raises(NotFoundError):
        b.resolve("u")
    with pytest.raises(NotFoundError):
        repack(path, target, ("nothing",))


def test_appender_writes_whole_chunks(path):
    a = Appender(path, "grow")
    a.append(np.arange(10, 13))
    assert a.buffered_elements == 1 and len(File(path).read("grow")) == 12
    a.append(np.arange(13, 15))
    a.flush()
    assert File(path).read("grow").tolist() == list(range(15))
    a.append(np.arange(15, 16))
    assert len(a.discard()) in (0, 8)


def test_selections_keep_their_errors(spark, path):
    a = ds.read_frame(spark, path, "e")
    for bad in (((0,), (1,)), ((0, 0), (24, 1)), ((-1, 0), (1, 1))):
        with pytest.raises(SelectionError):
            a.region(*bad)
    assert load(path).members.keys() == {"e", "u", "g", "refs", "grow", "soft"}


def test_named_types_are_shared_and_survive_edits(tmp_path):
    b = FileBuilder()
    named = b.commit_datatype("T", Fixed(2))
    b.create_dataset("a", np.arange(3), kind=named).set_attr("unit", "m")
    b.create_dataset("b", np.arange(2), kind=named)
    b.create_dataset("c", np.arange(2))
    path = str(tmp_path / "n.h5")
    b.write(path)
    assert File(path).type_references("T") == 2 and File(path).read("a").tolist() == [0, 1, 2]
    with Session(path) as s:
        s.delete("b")
        s.remove_attr("a", "unit")
        with pytest.raises(NotFoundError):
            s.remove_attr("a", "unit")
    f = File(path)
    assert f.type_references("T") == 1 and f.resolve("a").kind == Fixed(2) and f.attributes(f.resolve("a")) == {}
    with Session(path) as s:
        s.delete("T")
    assert File(path).read("a").tolist() == [0, 1, 2]


def test_edits_keep_all_that_a_file_says(tmp_path):
    """More attributes and links than a header holds, settings, fill times and named types outlive a session and a repack."""
    from arrayloom.sources.h5 import File, FileBuilder, FileSpaceInfo, FillTime, Fixed, file_space_info
    from arrayloom.sources.session import Session, repack

    builder = FileBuilder(space=FileSpaceInfo("page", page_size=8192), link_phase_change=(3, 2))
    shared = builder.commit_datatype("shared", Fixed(2))
    for i in range(12):
        builder.create_dataset(f"d{i}", np.arange(i + 3), chunks=(2,), maximum=(None,), fill_time=FillTime.NEVER).set_attr("n", i)
        builder.set_attr(f"a{i}", np.arange(i, dtype="<f4"))
    builder.set_attr_committed("typed", np.arange(3), shared)
    path, other = str(tmp_path / "f.h5"), str(tmp_path / "g.h5")
    builder.write(path)
    with Session(path) as s:
        s.append("d3", np.arange(2))
        s.set_attr("d4", "m", 9)
    repack(path, other, ("d11",))
    for name, n in ((path, 12), (other, 11)):
        with File(name) as f:
            root = f.resolve("/")
            attrs = f.attributes(root)
            assert len(attrs) == 13 and attrs["a11"].tolist() == list(range(11)) and attrs["typed"].tolist() == [0, 1, 2]
            assert list(f.links(root)) == ["shared", *(f"d{i}" for i in range(n))] and f.link_phase_change(root) == (3, 2)
            assert file_space_info(f).page_size == 8192 and f.fill_time(f.resolve("/d5")) is FillTime.NEVER
            assert f.read("/d3").tolist() == [0, 1, 2, 3, 4, 5, 0, 1] and f.attributes(f.resolve("/d4")) == {"n": 4, "m": 9}


def test_attributes_of_variable_length(tmp_path):
    from arrayloom.sources.h5 import File, FileBuilder, Fixed, VarString, Vlen
    from arrayloom.sources.session import Session

    builder, path = FileBuilder(), str(tmp_path / "f.h5")
    builder.set_attr("one", "vär", VarString()).set_attr("many", ["a", "", "ccc"], VarString()).set_attr("rows", [[1, 2], [], [3]], Vlen(Fixed(2))).set_attr("row", [4, 5], Vlen(Fixed(4)))
    builder.write(path)
    for _ in range(2):
        with File(path) as f:
            attrs = f.attributes(f.resolve("/"))
            assert attrs == {"one": "vär", "many": ["a", "", "ccc"], "rows": [[1, 2], [], [3]], "row": [4, 5]}
        with Session(path) as s:
            if "x" in s.tree.members:
                s.overwrite("x", np.arange(3) * 2)
            else:
                s.create_dataset("x", np.arange(3))
