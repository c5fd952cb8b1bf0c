"""Growing datasets where they stand."""

import numpy as np
import pytest

from arrayloom.errors import TypeMismatchError, UnsupportedError
from arrayloom.sources.h5 import File, FileBuilder
from arrayloom.sources.inplace import append, can_append, grow
from arrayloom.sources.session import Appender, Session


def new(path, data, **how):
    builder = FileBuilder()
    builder.create_dataset("other", np.arange(7.0))
    builder.create_dataset("x", data, **({"maximum": (None, *data.shape[1:])} | how)).set_attr("unit", "m")
    builder.write(str(path))
    return str(path)


@pytest.mark.parametrize("filters", [[], [("shuffle", None), ("deflate", 1), ("fletcher32", None)]])
@pytest.mark.parametrize("shape, chunks", [((0,), (4,)), ((10,), (4,)), ((5, 7), (2, 3))])
def test_many_appends(tmp_path, filters, shape, chunks):
    rng = np.random.default_rng(3)
    want = rng.integers(0, 1000, shape)
    path = new(tmp_path / "f.h5", want if shape[0] else want.astype("i8"), chunks=chunks, filters=filters, fill=-1)
    if not shape[0]:
        with Session(path) as s:
            s.append("x", np.array([5]))
        want = np.array([5])
    for n in (1, 2, 4, 9, 40, 300, 0, 3):
        more = rng.integers(0, 1000, (n, *shape[1:]))
        assert append(path, "/x", more) == len(want) + n
        want = np.concatenate((want, more))
        with File(path) as f:
            found = f.resolve("/x")
            assert found.shape == want.shape and (f.read("/x") == want).all()
            assert f.read("/other").tolist() == list(range(7)) and f.attributes(found)["unit"] == "m"
    with Session(path) as s:  # what was grown can be edited and written anew
        s.append("x", want[:3])
    with File(path) as f:
        assert (f.read("/x") == np.concatenate((want, want[:3]))).all()


def test_into_blocks_of_pages(tmp_path):
    """Past the blocks that the index lists, into blocks of blocks and their pages."""
    path, want = new(tmp_path / "f.h5", np.arange(3), chunks=(1,)), list(range(3))
    for n in (20, 500, 9000, 1, 12_000, 7):
        append(path, "x", np.arange(len(want), len(want) + n))
        want += range(len(want), len(want) + n)
    with File(path) as f:
        assert f.read("/x").tolist() == want and len(list(f.chunks(f.resolve("/x")))) == len(want)
        assert f.read("/x", (15_000,), (5,)).tolist() == want[15_000:15_005]


def test_only_the_end_and_the_records_change(tmp_path):
    path = new(tmp_path / "f.h5", np.arange(100_000.0), chunks=(1000,), filters=[("deflate", 1)])
    before = open(path, "rb").read()
    append(path, "x", np.arange(512.0))
    after = open(path, "rb").read()
    changed = np.flatnonzero(np.frombuffer(before, "u1") != np.frombuffer(after[: len(before)], "u1"))
    assert len(changed) < 200 and len(after) - len(before) < 8000


def test_refusals(tmp_path):
    path = new(tmp_path / "f.h5", np.arange(10), chunks=(4,), maximum=None)
    with File(path) as f:
        assert not can_append(f, "/x") and not can_append(f, "/other")
    with pytest.raises(UnsupportedError):
        append(path, "x", np.arange(3))
    tree = new(tmp_path / "t.h5", np.arange(10), chunks=(4,), index="btree1")
    assert grow(tree, "x", np.arange(3)) == 13
    lossy = new(tmp_path / "l.h5", np.arange(10.0), chunks=(4,), filters=[("scaleoffset", ("float", 2))])
    with pytest.raises(TypeMismatchError):
        append(lossy, "x", np.arange(3.0))
    assert append(lossy, "x", np.arange(3.0), lossy_tail="allow") == 13
    whole = new(tmp_path / "w.h5", np.arange(8), chunks=(4,))
    for bad in (np.arange(3.0), np.arange(4).reshape(2, 2)):
        with pytest.raises(TypeMismatchError):
            append(whole, "x", bad)
    assert append(whole, "x", np.arange(0)) == 8


def test_buffered(tmp_path):
    path = new(tmp_path / "f.h5", np.arange(5), chunks=(4,))
    a = Appender(path, "/x")
    for i in range(5, 30):
        a.append(np.array([i]))
    a.flush()
    with File(path) as f:
        assert f.read("/x").tolist() == list(range(30))


def test_facade(tmp_path):
    from arrayloom.api import ArrayFile
    from arrayloom.errors import ArrayError
    from arrayloom.options import Access, Append, ChunkCache, LibVer, MetadataCache
    from arrayloom.sources.h5 import FillTime, Fixed, PhysicalAddress, StoredAddress

    path = new(tmp_path / "f.h5", np.arange(10), chunks=(4,), filters=[("deflate", 1)])
    with ArrayFile(path, Access(metadata_cache=MetadataCache(1 << 16), chunk_cache=ChunkCache(1 << 20, 2))) as f, ArrayFile(path) as late:
        x = f.dataset("/x")
        assert x.supports_inplace_append() and x.fill_time is FillTime.IF_SET and list(x.attr_datatypes) == ["unit"] and x.chunk_cache_config.max_slots == 2
        x.append(np.arange(10, 13))
        x.append_raw(np.arange(13, 16).tobytes(), Append("allow"))
        assert x.shape == (16,) and x.read().tolist() == list(range(16)) and x.chunk_cache_stats.lookups > 0
        x.reset_chunk_cache_stats()
        assert x.chunk_cache_stats.lookups == 0
        a = x.buffered_appender()
        a.append(np.arange(16, 23))
        a.finish()
        assert late.dataset("/x").shape == (10,)
        late.refresh()
        assert late.dataset("/x").read().tolist() == list(range(23))
        with pytest.raises(TypeMismatchError):
            x.append_raw(b"123")
        assert f.metadata_cache_stats.lookups > 0 and late.metadata_cache_stats is None
        f.reset_metadata_cache_stats()
        f.refresh()
        assert f.file_size == late.file_size and f.libver_bound is LibVer.V110
        assert f.superblock.version == 3 and f.file_space_info() is None and f.persisted_free_sections() == [] and f.link_phase_change == (8, 6) and f.attr_datatypes == {}
        assert f.resolve_address(StoredAddress(9)) == PhysicalAddress(9) and f.relative_address(PhysicalAddress(9)) == StoredAddress(9)
        own = f.dataset_with_options("x", ChunkCache.disabled())
        assert own.chunk_cache_config.max_slots == 0 and own.read((3,), (2,)).tolist() == [3, 4] and isinstance(own.datatype, Fixed)
        assert f.as_bytes() == b""
    data = open(path, "rb").read()
    with ArrayFile(data) as f:
        assert f.as_bytes() == data
        with pytest.raises(TypeMismatchError):
            f.dataset("x").append(np.arange(2))
    with pytest.raises(UnsupportedError):
        ArrayFile(path, Access(libver=(LibVer.EARLIEST, LibVer.V18)))
    import fcntl

    with open(path, "r+b") as held:
        fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        with pytest.raises(ArrayError):
            ArrayFile(path)


def test_new_files_and_staged_edits(tmp_path):
    from arrayloom.api import ArrayFile
    from arrayloom.options import Access, SyncPolicy

    path = str(tmp_path / "new.h5")
    with ArrayFile.create(path, Access(sync=SyncPolicy.CLOSE), userblock=512) as f:
        assert f.datasets() == [] and f.userblock_size == 512
    session = Session(path)
    assert not session.has_staged_edits
    session.create_dataset("x", np.arange(3), chunks=(2,), maximum=(None,))
    assert session.has_staged_edits
    session.rollback()
    assert not session.has_staged_edits and "x" not in session.tree.members
    session.create_dataset("x", np.arange(3), chunks=(2,), maximum=(None,))
    session.commit()
    assert not session.has_staged_edits
    a = Appender(path, "x")
    a.append_raw(np.arange(3, 8).tobytes())
    assert a.unwritten.tolist() == []
    a.append_raw(np.arange(8, 9).tobytes())
    assert a.unwritten.tolist() == [8] and a.buffered_elements == 1
    with pytest.raises(TypeMismatchError):
        a.append_raw(b"123")
    a.finish()
    with ArrayFile(path) as f:
        assert f.dataset("x").read().tolist() == list(range(9))
    assert not Session.create(str(tmp_path / "other.h5")).tree.members
