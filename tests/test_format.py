"""The file format: checksums with published values, every layout and type there and back, and damage."""

import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arrayloom.errors import ChecksumError, FormatError, LinkError, NotFoundError, SelectionError, TypeMismatchError, UnsupportedError
from arrayloom.options import MetadataCache
from arrayloom.sources import codecs
from arrayloom.sources.h5 import Compound, Enum, File, FileBuilder, Fixed, Float, Opaque, Reference, String, VarString, Vlen, is_h5, is_h5_bytes
from arrayloom.sources.h5.checksum import lookup3
from arrayloom.sources.h5.writer import Soft

TYPES = ["i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8", "f4", "f8"]
WINDOWS = lambda n: [(0, n), (0, 1), (n // 2, n - n // 2), (n - 1, 1), (n // 3, n // 3), (0, 0), (n, 5), (n - 2, 100)]
ARRAYS = {
    "x": (np.arange(100) * 1.5, None, []),
    "m": (np.arange(60.0).reshape(20, 3), None, []),
    "c": (np.arange(1000) * 0.25, (64,), [("deflate", 4)]),
    "frames": ((np.arange(120) % 251).astype("u1").reshape(10, 2, 2, 3), (1, 2, 2, 3), [("deflate", 4)]),
    "d": (np.arange(200.0).reshape(50, 4), (8, 4), [("deflate", 2)]),
    "t": (np.arange(120.0).reshape(20, 6), (4, 2), []),
    "e": (np.arange(230).reshape(23, 10) * 0.5 - 3, (4, 3), [("shuffle", None), ("deflate", 4)]),
    "img": ((np.arange(1365) % 251).astype("u1").reshape(13, 5, 7, 3), (4, 2, 3, 2), [("deflate", 2)]),
}


def test_checksum_of_published_texts():
    assert lookup3(b"") == 0xDEADBEEF
    assert lookup3(b"Four score and seven years ago") == 0x17770551
    assert lookup3(b"Four score and seven years ago", 1) == 0xCD628161


@pytest.fixture(scope="module")
def arrays():
    b = FileBuilder()
    for name, (data, chunks, filters) in ARRAYS.items():
        b.create_dataset(name, data, chunks=chunks, filters=filters)
    return File(b.finish())


@pytest.mark.parametrize("name", ARRAYS)
def test_windows_are_slices(arrays, name):
    want = ARRAYS[name][0]
    assert (arrays.read(name) == want).all()
    for start, count in WINDOWS(len(want)):
        got = arrays.rows(name, start, count)
        assert got.dtype == want.dtype and (got == want[start : start + count]).all()


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize("layout", ["compact", "contiguous", "chunked"])
def test_regions_of_every_type(kind, layout):
    for shape, start, count in (((4, 5), (1, 1), (2, 3)), ((4, 5, 6), (1, 1, 2), (2, 3, 3))):
        x = np.arange(np.prod(shape)).astype(kind).reshape(shape)
        b = FileBuilder()
        b.create_dataset("v", x, compact=layout == "compact", chunks=tuple(2 for _ in shape) if layout == "chunked" else None)
        f = File(b.finish())
        assert (f.read("v", start, count) == x[tuple(slice(s, s + n) for s, n in zip(start, count, strict=True))]).all()
        for bad in (((0,), (1,)), ((0,) * len(shape), (9,) * len(shape)), ((-1,) * len(shape), (1,) * len(shape))):
            with pytest.raises(SelectionError):
                f.read("v", *bad)


def test_types_there_and_back():
    b = FileBuilder()
    record = Compound.packed(a=Fixed(4), b=Float(8), s=String(3))
    rows = [{"a": 1, "b": 2.5, "s": "xy"}, {"a": -7, "b": 0.0, "s": ""}]
    b.create_dataset("rec", rows, kind=record)
    b.create_dataset("en", ["hi", "lo"], kind=Enum(Fixed(2), (("lo", -3), ("hi", 4))))
    for pad in ("nullterm", "nullpad", "spacepad"):
        b.create_dataset(pad, ["ab", "", "é"], kind=String(5, pad))
    b.create_dataset("var", ["one", "", "ü" * 3000, "z" * 2_000_000], kind=VarString())
    b.create_dataset("seq", [[1, 2], [], [3]], kind=Vlen(Float(4)))
    b.create_dataset("opaque", [b"ab", b"cd"], kind=Opaque(2, "tag"))
    b.create_dataset("big", np.arange(5), kind=Fixed(8, big=True))
    b.create_dataset("scalar", 4.5)
    b.create_dataset("null", kind=Float(8))
    b.create_dataset("hole", shape=(5, 2), kind=Fixed(4), chunks=(2, 2), fill=9)
    b.create_dataset("refs", [b.members["rec"], None], kind=Reference())
    f = File(b.finish())
    assert f.read("rec") == rows and f.resolve("rec").kind == record
    assert f.read("en").tolist() == [4, -3]
    for pad in ("nullterm", "nullpad", "spacepad"):
        assert f.read(pad) == ["ab", "", "é"]
    assert f.read("var") == ["one", "", "ü" * 3000, "z" * 2_000_000]
    assert f.read("seq") == [[1.0, 2.0], [], [3.0]]
    assert f.read("opaque") == [b"ab", b"cd"] and f.resolve("opaque").kind.tag == "tag"
    assert f.read("big").tolist() == [0, 1, 2, 3, 4]
    assert f.read("scalar") == 4.5 and len(f.read("null")) == 0
    assert (f.read("hole") == 9).all() and f.read("hole").shape == (5, 2)
    assert f.read("refs").tolist() == [f.resolve("rec").address, -1]


def test_part_of_a_word():
    kind = Fixed(4, True, False, 4, 12)
    raw = np.array([0x7FF << 4, 0x800 << 4, 0xFFF << 4], "<u4").view("<i4")
    assert kind.decode(raw).tolist() == [2047, -2048, -1]


def test_links_groups_and_attributes():
    b = FileBuilder()
    g = b.create_group("a").create_group("b")
    g.create_dataset("x", np.arange(3)).set_attr("unit", "m").set_attr("v", np.arange(2, dtype="u2")).set_attr("names", ["p", "qq"]).set_attr("none", None)
    b.link("hop", "a/b")
    b.link("two", "/hop/x")
    b.link("lost", "/nowhere")
    b.link("round", "/again")
    b.link("again", "/round")
    b.set_attr("title", "täst")
    f = File(b.finish())
    assert f.read("two").tolist() == [0, 1, 2]
    assert f.attributes(f.resolve("/")) == {"title": "täst"}
    found = f.attributes(f.resolve("hop/x"))
    assert found["unit"] == "m" and found["v"].tolist() == [0, 1] and found["names"] == ["p", "qq"] and found["none"] is None
    assert [r[0] for r in f.walk()] == ["/a", "/a/b", "/a/b/x", "/hop", "/two", "/lost", "/round", "/again"]
    with pytest.raises(NotFoundError):
        f.resolve("lost")
    with pytest.raises(LinkError):
        f.resolve("round")
    with pytest.raises(NotFoundError):
        f.resolve("a/c")


def test_many_chunks_need_levels():
    x = np.arange(30_000, dtype="u2")
    b = FileBuilder()
    b.create_dataset("v", x, chunks=(5,), maximum=(None,))
    f = File(b.finish())
    assert (f.read("v") == x).all() and len(list(f.chunks(f.resolve("v")))) == 6000 and f.resolve("v").maximum == (None,)


@pytest.mark.parametrize("index", ["btree1", "fixed", None])
@pytest.mark.parametrize("filters", [[], [("deflate", 1)]])
def test_chunk_indexes(index, filters):
    x = np.arange(5000, dtype="i2").reshape(50, 100)
    b = FileBuilder()
    b.create_dataset("few", x, chunks=(7, 30), filters=filters, index=index)
    b.create_dataset("many", x, chunks=(2, 3), filters=filters, index=index)
    b.create_dataset("one", x, chunks=(50, 100), filters=filters, index=index)
    b.create_dataset("grows", x, chunks=(7, 30), filters=filters, maximum=(None, 100))
    b.create_dataset("hole", shape=(50, 100), kind=Fixed(2), chunks=(7, 30), fill=3, filters=filters, index=index)
    f = File(b.finish())
    for name in ("few", "many", "one", "grows"):
        assert (f.read(name) == x).all() and (f.read(name, (13, 50), (20, 31)) == x[13:33, 50:81]).all()
    assert (f.read("hole") == 3).all() and not list(f.chunks(f.resolve("hole")))
    assert f.layout(f.resolve("many"))[1]["index"] == (index or "fixed") and f.layout(f.resolve("grows"))[1]["index"] == "extensible"
    assert f.layout(f.resolve("one"))[1]["index"] == (index or "single")


@pytest.mark.parametrize("n", [0, 1, 4, 5, 20, 21, 100, 3000, 40_000])
@pytest.mark.parametrize("filters", [[], [("shuffle", None)]])
def test_extensible_arrays_of_every_size(n, filters):
    x = np.arange(n, dtype="u2")
    b = FileBuilder()
    b.create_dataset("v", x, chunks=(1,), maximum=(None,), filters=filters)
    b.create_dataset("tree", x, chunks=(1,), maximum=(None,), filters=filters, index="btree1")
    f = File(b.finish())
    assert (f.read("v") == x).all() and len(list(f.chunks(f.resolve("v")))) == n
    if n == 3000:
        assert [c.start for c in f.chunks(f.resolve("v"))] == [c.start for c in f.chunks(f.resolve("tree"))]


def test_signature_and_userblock(tmp_path):
    b = FileBuilder(1024, b"hello")
    b.create_dataset("v", np.arange(4))
    data = b.finish()
    assert data.startswith(b"hello") and is_h5_bytes(data) and not is_h5_bytes(b"no" * 4000)
    (tmp_path / "f").write_bytes(data)
    assert is_h5(str(tmp_path / "f")) and File(data).read("v").tolist() == [0, 1, 2, 3]
    with pytest.raises(TypeMismatchError):
        FileBuilder(100)


def test_damage_is_found():
    b = FileBuilder()
    b.create_dataset("v", np.arange(400, dtype="i4"), chunks=(100,), filters=[("fletcher32", None)])
    data = bytearray(b.finish())
    f = File(bytes(data))
    chunk = next(iter(f.chunks(f.resolve("v"))))
    data[chunk.address + 8] ^= 1
    with pytest.raises(ChecksumError):
        File(bytes(data)).read("v")
    data[20] ^= 1
    with pytest.raises(ChecksumError):
        File(bytes(data))
    with pytest.raises(FormatError):
        File(b"not a file" * 100)


@given(st.binary(max_size=3000), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_bytes_there_and_back(data, width):
    assert codecs.unshuffle(codecs.shuffle(data, width), width) == data
    assert codecs.lzf_decompress(codecs.lzf_compress(data), len(data)) == data
    for filters in ([("deflate", 3)], [("shuffle", None), ("lzf", None)], [("fletcher32", None)], [("shuffle", None), ("deflate", 9), ("fletcher32", None)]):
        packed, mask = codecs.encode(data, filters, np.dtype("<i4"))
        assert codecs.decode(packed, filters, np.dtype("<i4"), len(data), mask) == data


@given(st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=200), st.booleans())
@settings(max_examples=60, deadline=None)
def test_scale_offset_of_integers_is_exact(values, filled):
    x = np.array(values, "<i4")
    fill = values[0] if filled else None
    packed = codecs.scaleoffset_compress(x.tobytes(), x.dtype, "integer", 0, fill)
    assert codecs.scaleoffset_decompress(packed, x.dtype, "integer", 0, len(x), fill) == x.tobytes()


def test_scale_offset_of_decimals():
    x = np.array([1.26, -0.5, 3.14159, 100.05])
    packed = codecs.scaleoffset_compress(x.tobytes(), x.dtype, "float", 2)
    y = np.frombuffer(codecs.scaleoffset_decompress(packed, x.dtype, "float", 2, 4))
    assert abs(x - y).max() <= 0.005 + 1e-9


def test_fletcher_folds():
    def slow(data):
        one = two = 0
        words = [data[i] << 8 | (data[i + 1] if i + 1 < len(data) else 0) for i in range(0, len(data), 2)]
        for at in range(0, len(words), 360):
            for w in words[at : at + 360]:
                one, two = one + w, two + one + w
            one, two = (one & 0xFFFF) + (one >> 16), (two & 0xFFFF) + (two >> 16)
            one, two = (one & 0xFFFF) + (one >> 16), (two & 0xFFFF) + (two >> 16)
        return two << 16 | one

    for n in (0, 1, 2, 719, 720, 721, 5001):
        for data in (bytes(n), b"\xff" * n, np.random.default_rng(n).bytes(n)):
            assert codecs.fletcher32(data) == slow(data)


def test_filters_that_clash():
    with pytest.raises(UnsupportedError):
        codecs.check_pipeline([("scaleoffset", ("integer", 0)), ("shuffle", None)])
    with pytest.raises(UnsupportedError):
        codecs.check_pipeline([("lzf", None), ("deflate", 1)])
    assert codecs.is_lossless([("deflate", 1)]) and not codecs.is_lossless([("scaleoffset", ("float", 2))])


@pytest.mark.parametrize("n", [9, 200, 3000])
def test_dense_links_and_attributes(n):
    """Groups and objects past eight links or attributes; heaps of one and of many blocks, trees of several levels."""
    builder = FileBuilder()
    group = builder.create_group("many")
    for i in range(n):
        group.create_dataset(f"name{i:05d}" * (1 + i % 5), np.arange(i % 4), attrs={})
    group.members["soft"] = Soft("/many/name00001name00001")
    for i in range(n):
        group.set_attr(f"attr{i}", np.arange(i % 50, dtype="<f8"))
    group.set_attr("wide", np.arange(20_000.0))
    with File(builder.finish()) as f:
        found = f.resolve("/many")
        assert set(f.links(found)) == {*(f"name{i:05d}" * (1 + i % 5) for i in range(n)), "soft"}
        assert all(f.read(f"/many/{'name%05d' % i * (1 + i % 5)}").tolist() == list(range(i % 4)) for i in range(0, n, 7))
        attrs = f.attributes(found)
        assert len(attrs) == n + 1 and all(attrs[f"attr{i}"].tolist() == list(range(i % 50)) for i in range(n))
        assert attrs["wide"].tolist() == list(range(20_000))
        assert f.read("/many/soft").tolist() == [0]


@pytest.mark.parametrize("filters", [[], [("deflate", 1)]])
@pytest.mark.parametrize("chunks", [(50, 40), (3, 2)])
def test_chunks_in_a_version_2_tree(filters, chunks):
    x = np.arange(200 * 90).reshape(200, 90)
    builder = FileBuilder()
    builder.create_dataset("x", x, chunks=chunks, filters=filters, maximum=(None, None), index="btree2")
    with File(builder.finish()) as f:
        found = f.resolve("/x")
        assert f.layout(found)[1]["index"] == "btree2"
        assert (f.read("/x") == x).all() and (f.read("/x", (7, 11), (100, 3)) == x[7:107, 11:14]).all()
        assert [c.start for c in f.chunks(found)] == [(i, j) for i in range(0, 200, chunks[0]) for j in range(0, 90, chunks[1])]


def test_trees_of_records():
    """Trees of any depth hold what they were given, in order; a damaged node is noticed."""
    from arrayloom.sources.h5 import dense

    for n, node in ((0, 128), (1, 128), (9, 128), (10, 128), (500, 128), (5000, 160)):
        out = bytearray(64)

        def put(data, out=out):
            out.extend(data.ljust(-(-len(data) // 8) * 8, b"\0"))
            return len(out) - -(-len(data) // 8) * 8

        records = [i.to_bytes(12, "big") for i in range(n)]
        head = dense.put_tree(put, lookup3, 5, records, 12, node)
        file = File.__new__(File)
        file.metadata_config = MetadataCache()
        file.stream, file.base, file.length, file.offset_size, file.length_size = io.BytesIO(bytes(out)), 0, len(out), 8, 8
        assert list(dense.tree_records(file, head, 5)) == records
        if n == 500:
            out[80] ^= 1
            file.stream = io.BytesIO(bytes(out))
            with pytest.raises(ChecksumError):
                list(dense.tree_records(file, head, 5))


def test_a_heap_with_indirect_rows():
    """Rows past the largest direct block are tables of their own: built here by hand, as the writer makes none."""
    from arrayloom.sources.h5 import dense

    table = dense.Table(4, 512, 1024)
    assert table.direct_rows == 3 and [table.offset(r) for r in range(5)] == [0, 2048, 4096, 8192, 16384] and table.rows_of(2048) == 1
    heap = dense.Heap.__new__(dense.Heap)
    heap.table, heap.root, heap.rows, heap.checked, heap.prefix, heap.blocks = table, 1, 4, 0, 21, {}
    fake = type("F", (), {"offset_size": 8, "_address": staticmethod(lambda data, at: int.from_bytes(data[at : at + 8], "little"))})()
    heap.file = fake
    # A root of four rows, the last of indirect blocks; each of those has one row of 512-byte blocks.
    heap.blocks[1] = b"".join((100 + i).to_bytes(8, "little") for i in range(16))
    heap.blocks[112] = b"".join((200 + i).to_bytes(8, "little") for i in range(4))
    for place in (*range(100, 112), *range(200, 204)):
        heap.blocks[place] = place.to_bytes(2, "little") * 512
    assert heap._managed(0, 2) == (100).to_bytes(2, "little") and heap._managed(2048 + 512, 2) == (105).to_bytes(2, "little")
    assert heap._managed(4096 + 1024 * 3, 2) == (111).to_bytes(2, "little")
    assert heap._managed(8192 + 512 * 2, 4) == (202).to_bytes(2, "little") * 2
    with pytest.raises(FormatError):
        heap._managed(500, 20)


def test_an_array_that_grows_along_another_dimension():
    x = np.arange(6 * 50).reshape(6, 50)
    builder = FileBuilder()
    builder.create_dataset("x", x, chunks=(2, 5), maximum=(8, None), index="extensible")
    with File(builder.finish()) as f:
        assert f.layout(f.resolve("/x"))[1]["index"] == "extensible" and (f.read("/x") == x).all()


def test_scale_offset_keeps_the_fill_value():
    x = np.arange(100, 140, dtype="<i4")
    x[[3, 17]] = -7
    builder = FileBuilder()
    builder.create_dataset("x", x, chunks=(16,), filters=[("scaleoffset", ("integer", 0))], fill=-7)
    with File(builder.finish()) as f:
        found = f.resolve("/x")
        assert f.filters(found)[0].fill(np.dtype("<i4")) == -7 and f.read("/x").tolist() == x.tolist()
        assert max(c.size for c in f.chunks(found)) < 21 + 16


@pytest.mark.parametrize("index, maximum", [("fixed", None), ("extensible", (None, 40)), ("extensible", (60, None)), ("btree1", (None, None)), ("btree2", (None, None))])
def test_regions_look_at_their_places_only(index, maximum):
    x = np.arange(60 * 33).reshape(60, 33)
    builder = FileBuilder()
    builder.create_dataset("x", x, chunks=(4, 5), filters=[("deflate", 1)], maximum=maximum, index=index)
    with File(builder.finish()) as f:
        found = f.resolve("/x")
        assert len(list(f.chunks(found))) == 15 * 7 and (f.read("/x") == x).all()
        for start, count in (((0, 0), (1, 1)), ((59, 32), (1, 1)), ((7, 9), (20, 12)), ((3, 0), (0, 5))):
            met = [c.start for c in f.chunks(found, start, count)]
            assert sorted(met) == sorted((a, b) for a in range(0, 60, 4) for b in range(0, 33, 5) if all(count) and a < start[0] + count[0] and a + 4 > start[0] and b < start[1] + count[1] and b + 5 > start[1])
            assert (f.read("/x", start, count) == x[start[0] : start[0] + count[0], start[1] : start[1] + count[1]]).all()
