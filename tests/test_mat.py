"""MATLAB files and the typed facade."""

import math

import numpy as np
import pytest

from arrayloom.api import ArrayFile, StringLimits, convert_array
from arrayloom.errors import FormatError, NotFoundError, SelectionError, TypeMismatchError
from arrayloom.mat import Char, Empty, dedupe_name, is_valid_name, read_mat, register_table, sanitize_name, variable_frame, variables, write_mat
from arrayloom.mat.values import MatBuilder, header, matrix_dims, vector_dims, verify_header
from arrayloom.sources.h5 import File, FileBuilder, Fixed, Reference

VALUES = {
    "scalar": 2.5, "int": np.int16(-3), "big": np.uint64(2**64 - 1), "flag": True, "text": "täxt 😀", "none": "",
    "matrix": np.arange(6.0).reshape(2, 3), "cube": np.arange(24, dtype="i4").reshape(2, 3, 4), "vector": np.arange(3, dtype="u1"),
    "mask": np.array([[True, False]]), "z": np.array([[1 + 2j, 3 - 1j]]), "cell": [1.0, "a", [np.arange(2)], {"q": 1.0}],
    "nested": {"a": {"b": "deep"}, "list": ["x", "y"]}, "empty": np.zeros((0, 4)), "char": Char("c"), "nocells": [],
}


@pytest.fixture
def path(tmp_path):
    write_mat(str(tmp_path / "f.mat"), VALUES, deflate=3)
    return str(tmp_path / "f.mat")


def test_values_there_and_back(path):
    got = read_mat(path)
    assert list(got) == list(VALUES)
    assert got["scalar"] == 2.5 and got["int"] == -3 and got["int"].dtype == np.int16 and got["big"] == 2**64 - 1 and got["flag"] is np.True_
    assert got["text"] == "täxt 😀" and got["none"] == "" and got["char"] == "c" and got["nocells"] == []
    for k in ("matrix", "cube", "mask", "z"):
        assert (got[k] == VALUES[k]).all() and got[k].dtype == VALUES[k].dtype
    assert got["vector"].shape == (3, 1) and got["empty"].shape == (0, 4)
    assert got["cell"][0] == 1 and got["cell"][1] == "a" and got["cell"][2][0].reshape(-1).tolist() == [0, 1] and got["cell"][3] == {"q": 1.0}
    assert got["nested"] == {"a": {"b": "deep"}, "list": ["x", "y"]}


def test_stored_dimensions_are_reversed(path):
    f = File(path)
    assert f.resolve("cube").shape == (4, 3, 2) and f.attributes(f.resolve("cube"))["MATLAB_class"] == "int32"
    assert f.attributes(f.resolve("flag"))["MATLAB_int_decode"] == 1


def test_header(path):
    data = open(path, "rb").read(512)
    verify_header(data)
    assert data[:19] == b"MATLAB 7.3 MAT-file" and data[124:128] == b"\0\2IM" and len(header("ü" * 300)) == 512 and header("ü")[:1] == b"?"
    with pytest.raises(FormatError):
        verify_header(bytes(512))


def test_names():
    assert [sanitize_name(n) for n in ("", "ok", "1a", "_a", "é", "a b", "end", "a-é")] == ["x", "ok", "x1a", "x_a", "x_", "a_b", "end_", "a__"]
    assert is_valid_name("a1_") and not any(map(is_valid_name, ("", "1a", "_a", "while", "é", "a" * 2049)))
    assert dedupe_name("a", {"a", "a_1"}) == "a_2" and dedupe_name("b", {"a"}) == "b" and len(dedupe_name("a" * 2048, {"a" * 2048})) == 2048
    assert vector_dims(0) == (0, 0) and vector_dims(3) == (3, 1) and vector_dims(3, True) == (1, 3) and matrix_dims(()) == (1, 1) and matrix_dims((2, 3, 4)) == (2, 3, 4)


def test_strict_names_and_rows(tmp_path):
    with pytest.raises(TypeMismatchError):
        write_mat(str(tmp_path / "x.mat"), {"1a": 1.0}, names="strict")
    write_mat(str(tmp_path / "x.mat"), {"1a": np.arange(3.0), "x1a": 2.0, "e": Empty("struct")}, row=True)
    got = read_mat(str(tmp_path / "x.mat"))
    assert got["x1a"].shape == (1, 3) and got["x1a_1"] == 2.0 and got["e"] == []


def test_through_spark(spark, path, tmp_path):
    rows = {r["name"]: r for r in variables(spark, path).collect()}
    assert rows["cube"]["dims"] == [2, 3, 4] and rows["cube"]["class"] == "int32" and rows["empty"]["n_elements"] == 0 and rows["nested"]["class"] == "struct"
    frame = variable_frame(spark, path, "matrix")
    assert frame.shape == (2, 3) and {(r["i0"], r["i1"]): r["value"] for r in frame.df.collect()} == {(i, j): 3.0 * i + j for i in range(2) for j in range(3)}
    write_mat(str(tmp_path / "t.mat"), {"t": {"id": np.arange(3), "name": ["a", "b", "c"]}})
    assert [tuple(r) for r in register_table(spark, str(tmp_path / "t.mat"), "t").orderBy("row_number").collect()] == [(0, 0, "a"), (1, 1, "b"), (2, 2, "c")]


@pytest.fixture
def opened():
    b = FileBuilder()
    g = b.create_group("g")
    g.create_dataset("x", np.array([[-1.5, 300.0], [math.nan, 1e30]])).set_attr("unit", "m")
    g.create_dataset("s", ["a", "", "ü"])
    g.create_group("sub")
    g.commit_datatype("T", Fixed(2))
    b.create_dataset("r", [g.members["x"], None], kind=Reference())
    b.create_dataset("c", np.arange(10, dtype="i8"), chunks=(4,), filters=[("deflate", 1)], maximum=(None,))
    return ArrayFile(b.finish())


def test_facade(opened):
    g = opened.group("g")
    assert (g.datasets(), g.groups(), g.named_datatypes()) == (["x", "s"], ["sub"], ["T"]) and g.named_datatype("T") == Fixed(2)
    x = g.dataset("x")
    assert x.shape == (2, 2) and x.attrs == {"unit": "m"} and x.layout == "contiguous" and x.element_size == 8
    assert x.read_i8().tolist() == [[-1, 127], [0, 127]] and x.read_u8_rows(0, 9).tolist() == [[0, 255], [0, 255]] and x.read_f32_region((0, 1), (1, 1)).tolist() == [[300.0]]
    s = g.dataset("s")
    assert s.read_vlen_strings() == ["a", "", "ü"] and s.vlen_payload_size() == 3
    seen = []
    s.visit_vlen_strings(lambda i, t: seen.append((i, t)), rows=2)
    assert seen == [(0, "a"), (1, ""), (2, "ü")]
    for limit in (StringLimits(max_elements=2), StringLimits(max_payload_bytes=2)):
        with pytest.raises(SelectionError):
            s.read_vlen_strings(limit)
    with pytest.raises(TypeMismatchError):
        s.read_f64()
    found = opened.dataset("r").dereference()
    assert found[0].path == "/g/x" and found[1] is None
    c = opened.dataset("/c")
    assert c.chunk_shape == (4,) and c.maxshape == (None,) and c.filters == [1] and len(c.chunks()) == 3 and c.chunk_index == "extensible"
    assert c.verify_provenance() is None and c.read_raw((2,), (1,)) == (2).to_bytes(8, "little")
    with pytest.raises(NotFoundError):
        opened.group("c")


def test_numpy_conversion_is_the_same():
    x = np.array([0, 2.7, -2.7, 1e20, -1e20, np.nan, np.inf, 2.0**63, 2.0**64])
    assert convert_array(x, "i64").tolist() == [0, 2, -2, 2**63 - 1, -(2**63), 0, 2**63 - 1, 2**63 - 1, 2**63 - 1]
    assert convert_array(x, "u64").tolist() == [0, 2, 0, 2**64 - 1 if 1e20 > 2**64 else 10**20, 0, 0, 2**64 - 1, 2**63, 2**64 - 1]
    assert convert_array(np.array([-1, 300]), "u8").tolist() == [0, 255] and convert_array(np.array([2**64 - 1], "u8"), "i64").tolist() == [2**63 - 1]


def objects_file():
    from arrayloom.mat import objects as o

    when = o.Datetime(np.array([0.0, 1.5e12, -3.0]), np.array([0.25, 0.0, 0.5]), "UTC", "uuuu")
    step = {"origin": o.Duration(np.array([1000.0])), "specifiedAsRate": False, "sampleRate": 4.0, "stepSize": o.Duration(np.array([250.0]))}
    table = o.Table({"n": np.array([1.0, 2.0, 3.0]), "s": o.Strings(["a", None, "ü😀"]), "t": when, "c": o.Categorical(np.array([1, 0, 2]), ["low", "high"]), "m": np.arange(6.0).reshape(3, 2)}, ["x", "y", "z"])
    return o, {
        "text": o.Strings(["one", "", None, "vier", "fünf", "six"], (2, 3)), "when": when, "long": o.Duration(np.array([1500.0, 2.0]), "s"),
        "kinds": o.Categorical(np.array([2, 0, 1], "u1"), ["a", "b"], is_ordinal=True), "table": table,
        "rows": o.Timetable({"v": np.array([5.0, 6.0, 7.0, 8.0])}, row_times=step),
        "rated": o.Timetable({"v": np.arange(3.0)}, row_times={"origin": o.Datetime(np.array([1e12]), np.array([0.5])), "specifiedAsRate": True, "sampleRate": 3.0}),
        "map": o.Map({"a": 1.0, "b": 2.5}), "mixed": o.Map({1: "x", 2: np.arange(3.0)}), "other": o.Opaque("my.Thing", {"p": 3.0, "flag": True}), "plain": np.arange(3.0),
    }


def test_objects_there_and_back(tmp_path):
    o, values = objects_file()
    path = str(tmp_path / "objects.mat")
    write_mat(path, values)
    got = read_mat(path)
    assert got["text"] == o.Strings(["one", "", None, "vier", "fünf", "six"], (2, 3))
    assert got["when"].nanoseconds().reshape(-1).tolist() == values["when"].nanoseconds().tolist() and (got["when"].tz, got["when"].fmt) == ("UTC", "uuuu")
    assert got["long"].seconds().reshape(-1).tolist() == [1.5, 0.002] and got["long"].fmt == "s"
    assert got["kinds"].labels() == ["b", None, "a"] and got["kinds"].is_ordinal and not got["kinds"].is_protected
    table = got["table"]
    assert (table.num_rows, table.num_variables, table.variable_names, table.row_names) == (3, 5, ["n", "s", "t", "c", "m"], ["x", "y", "z"])
    assert table.column("s").values == ["a", None, "ü😀"] and table.column("c").labels() == ["low", None, "high"] and table.column("m").tolist() == [[0, 1], [2, 3], [4, 5]]
    assert got["rows"].times().millis.tolist() == [1000, 1250, 1500, 1750]
    rated = got["rated"].times()
    assert rated.millis.tolist() == [1e12 + k * 1000 / 3.0 for k in range(3)] and abs(rated.sub_ms[1] - 0.5) < 1e-3
    assert got["map"] == {"a": 1.0, "b": 2.5} and list(got["mixed"]) == ["1", "2"] and got["mixed"]["1"] == "x"
    assert got["other"].class_name == "my.Thing" and got["other"].values["p"] == 3.0 and got["other"].values["flag"] is True
    assert got["plain"].reshape(-1).tolist() == [0, 1, 2] and "#subsystem#" not in got


def test_tables_of_objects_as_frames(spark, tmp_path):
    _, values = objects_file()
    path = str(tmp_path / "objects.mat")
    write_mat(path, values)
    rows = register_table(spark, path, "table").orderBy("row_number").collect()
    assert [(r["row_number"], r["row_name"], r["n"], r["s"], r["c"], list(r["m"])) for r in rows] == [(0, "x", 1.0, "a", "low", [0, 1]), (1, "y", 2.0, None, None, [2, 3]), (2, "z", 3.0, "ü😀", "high", [4, 5])]
    assert [r["row_time_ms"] for r in register_table(spark, path, "rows").orderBy("row_number").collect()] == [1000, 1250, 1500, 1750]


def test_damaged_objects_are_errors():
    from arrayloom.errors import FormatError
    from arrayloom.mat import objects as o

    blob = o.Interned(lambda v: v)
    words = blob.add(o.Duration(np.array([1.0])))
    whole = blob.blob()
    store = o.Store([0, 0, 0, 0], whole)
    assert store.of(words, lambda a: np.array([1.0]) if a == 0 else "").millis.tolist() == [1.0]
    for bad in (whole[:30], whole[:8] + b"\xff" * 32 + whole[40:], b"\x09" + whole[1:]):
        with pytest.raises(FormatError):
            o.Store([0, 0, 0, 0], bad)
    with pytest.raises(FormatError):
        store.of(np.array([o.MARK, 2, 1, 1, 9, 1], "<u4"), lambda a: 0)
    with pytest.raises(FormatError):
        store.of(np.array([1, 2, 1, 1, 1, 1], "<u4"), lambda a: 0)
    with pytest.raises(FormatError):
        o.Strings.of_words(np.array([1, 2, 1, 1, 50], "u8"))
    with pytest.raises(FormatError):
        o.Categorical(np.array([3]), ["a"]).labels()
    assert store.enumeration(1, [1, 2], [1, 0, 1]).names == [store.name(2), store.name(1), store.name(2)]


def test_enumeration_arrays():
    o, _ = objects_file()
    builder = MatBuilder()
    builder.write("d", o.Duration(np.array([1.0])))
    group = builder.file.create_group("e")
    for name, data in (("EnumerationInstanceTag", [o.MARK]), ("ClassName", [1]), ("ValueNames", [1, 2]), ("ValueIndices", [0, 1, 0])):
        group.create_dataset(name, np.array([data], "<u4"))
    got = read_mat(builder.finish())
    assert got["e"].names == ["duration", "millis", "duration"] and len(got["e"]) == 3 and got["e"].class_name == "duration"


def test_options_of_the_writer():
    from arrayloom.mat import objects as o
    from arrayloom.mat.values import StructArray, elem_size

    def back(value, **how):
        return read_mat(MatBuilder(**how).write("v", value).finish()).get("v", "left out")

    assert back("text", strings="string") == o.Strings(["text"], (1, 1)) and back("text") == "text"
    assert back(None).shape == (0, 0) and back(None, nulls="struct") == [] and back(None, nulls="skip") == "left out"
    assert back({"a": 1.0, "b": None}, nulls="skip") == {"a": 1.0} and back([1.0, None, 2.0], nulls="skip") == [1.0, 2.0]
    with pytest.raises(TypeMismatchError):
        back({"a": None}, nulls="error")
    assert back([]) == [] and back([], sequences="double").shape == (0, 0)
    assert back(np.array(["x"], object), unsupported="skip") == "left out"
    with pytest.raises(TypeMismatchError):
        back(np.array(["x"], object))
    for bad in ({"strings": "utf8"}, {"nulls": "no"}, {"deflate": 11}):
        with pytest.raises(TypeMismatchError):
            MatBuilder(**bad)
    whole = np.array([(1, -2), (3, 4)], [("real", "<i2"), ("imag", "<i2")])
    got = back(whole)
    assert got["real"].reshape(-1).tolist() == [1, 3] and got["imag"].reshape(-1).tolist() == [-2, 4] and got.dtype["real"] == np.dtype("<i2")
    assert back(StructArray({"a": [1.0, 2.0], "b": ["x", "y"]})) == [{"a": 1.0, "b": "x"}, {"a": 2.0, "b": "y"}] and back(StructArray({"a": []})) == []
    with pytest.raises(TypeMismatchError):
        StructArray({"a": [1], "b": []})
    assert [elem_size(c) for c in ("double", "int16", "char", "logical", "cell")] == [8, 2, 2, 1, None]
