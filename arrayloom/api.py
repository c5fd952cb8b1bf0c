"""Files, groups and datasets by name, with typed reads. Thin: selections and decoding are in sources.h5, Spark scans in sources.datasource."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .errors import ArrayError, NotFoundError, SelectionError, TypeMismatchError, UnsupportedError
from .functions.convert import ELEMENTS, limits
from .options import Access, Append, CacheStats, ChunkCache, LibVer, Locking, SyncPolicy
from .sources import datasource
from .sources.codecs import NUMPY
from .sources.h5 import File as Bytes
from .sources.h5 import (
    FileBuilder, FileSpaceInfo, FillTime, Fixed, Float, PhysicalAddress, Reference, StoredAddress, String, Superblock, VarString, file_space_info, is_h5, is_h5_bytes,
    persisted_free_sections,
)
from .sources.h5.reader import Filter, Object
from .sources.inplace import can_append, grow
from .sources.session import Appender, Session


def _lock(stream, locking: Locking) -> None:
    """Keeps writers that lock the file from it while it is open."""
    import fcntl

    try:
        fcntl.flock(stream, fcntl.LOCK_SH | fcntl.LOCK_NB)
    except OSError as e:
        if locking is Locking.ENABLED:
            stream.close()
            raise ArrayError(f"the file is locked: {e}") from None


@dataclass(frozen=True)
class StringLimits:
    """What a read of variable-length strings may take."""

    max_elements: int | None = None
    max_payload_bytes: int | None = None


def convert_array(x: np.ndarray, element: str) -> np.ndarray:
    """numpy's counterpart of functions.convert: saturates, cuts towards zero, and takes NaN as 0."""
    to = np.dtype(NUMPY[element]).newbyteorder("=")
    if x.dtype == to or element[0] == "f":
        with np.errstate(over="ignore"):
            return x.astype(to)
    low, high = limits(element)
    if x.dtype.kind == "f":
        with np.errstate(invalid="ignore"):
            whole = np.trunc(np.where(np.isnan(x), 0, x).astype(np.float64))
            inside = np.clip(whole, float(low), np.nextafter(float(high + 1), 0) if high >= 1 << 53 else float(high))
            out = inside.astype(to)
        out[whole >= float(high + 1)] = high
        return out
    have = np.iinfo(x.dtype)
    return np.clip(x, max(low, have.min), min(high, have.max)).astype(to)


class Dataset:
    def __init__(self, file: Bytes, found: Object, path: str):
        if not found.is_dataset:
            raise TypeMismatchError(f"{path} is no dataset")
        self._file, self._found, self.path = file, found, path

    @property
    def shape(self) -> tuple[int, ...]:
        return self._found.shape or ()

    @property
    def maxshape(self) -> tuple[int | None, ...] | None:
        return self._found.maximum

    @property
    def datatype(self):
        return self._found.kind

    @property
    def element_size(self) -> int:
        return self._found.kind.size

    @property
    def layout(self) -> str:
        return self._file.layout(self._found)[0]

    @property
    def is_chunked(self) -> bool:
        return self.layout == "chunked"

    @property
    def chunk_shape(self) -> tuple[int, ...] | None:
        return self._file.layout(self._found)[1].get("chunks")

    @property
    def chunk_index(self) -> str | None:
        return self._file.layout(self._found)[1].get("index")

    def chunks(self) -> list:
        return list(self._file.chunks(self._found))

    @property
    def filter_pipeline(self) -> list[Filter]:
        return self._file.filters(self._found)

    @property
    def filters(self) -> list[int]:
        return [f.id for f in self.filter_pipeline]

    def fill_value(self):
        return self._file.fill(self._found)

    @property
    def attrs(self) -> dict:
        return self._file.attributes(self._found)

    def _region(self, start=None, count=None):
        return self._file.read(self.path, start, count)

    def read(self, start=None, count=None):
        """Elements as stored, whole or a region that must lie within."""
        return self._region(start, count)

    def read_as(self, element: str, start=None, count=None) -> np.ndarray:
        values = self._region(start, count)
        if not isinstance(values, np.ndarray) or isinstance(self._found.kind, Reference):
            raise TypeMismatchError("these values don't convert")
        return convert_array(values, element)

    def read_rows(self, start: int, count: int, element: str | None = None):
        """A window of leading rows, cut at the extent."""
        if not self.shape:
            raise SelectionError("a scalar has no rows")
        values = self._file.rows(self.path, start, count)
        return convert_array(values, element) if element else values

    def read_raw(self, start=None, count=None) -> bytes:
        shape = self.shape
        start = start or (0,) * len(shape)
        count = count or tuple(n - s for n, s in zip(shape, start, strict=True))
        return np.ascontiguousarray(self._file.stored(self._found, start, count)).tobytes()

    def read_string(self, start=None, count=None) -> list[str]:
        if not isinstance(self._found.kind, String | VarString):
            raise TypeMismatchError("no strings")
        return self._region(start, count)

    def read_vlen_strings(self, limits_: StringLimits = StringLimits()) -> list[str]:
        n = int(np.prod(self.shape)) if self.shape else 1
        if limits_.max_elements is not None and n > limits_.max_elements:
            raise SelectionError(f"{n} elements are more than {limits_.max_elements}")
        if limits_.max_payload_bytes is not None and self.vlen_payload_size() > limits_.max_payload_bytes:
            raise SelectionError("the payload is over its limit")
        return self.read_string()

    def visit_vlen_strings(self, visit: Callable[[int, str], None], rows: int = 1024) -> None:
        """visit(position, text), some rows at a time."""
        for at in range(0, self.shape[0], rows):
            for i, text in enumerate(self._file.rows(self.path, at, rows)):
                visit(at + i, text)

    def vlen_payload_size(self) -> int:
        """Bytes of all strings, from their stored lengths alone."""
        if not isinstance(self._found.kind, VarString):
            raise TypeMismatchError("no variable-length strings")
        return int(self._file.stored(self._found, (0,) * len(self.shape), self.shape)["n"].astype(np.int64).sum())

    def read_compound(self) -> list[dict]:
        return self._region()

    def dereference(self) -> list[Group | Dataset | None]:
        """The object of each reference, in stored order."""
        if not isinstance(self._found.kind, Reference):
            raise TypeMismatchError("no references")
        paths = {address: path for path, _, _, _, address, _ in self._file.walk() if address is not None}
        out = []
        for address in self._region().reshape(-1).tolist():
            if address in (-1, 0):
                out.append(None)
                continue
            found = self._file.object(address)
            where = paths.get(address, "")
            out.append(Dataset(self._file, found, where) if found.is_dataset else Group(self._file, found, where))
        return out

    @property
    def attr_datatypes(self) -> dict:
        """The stored type of each attribute."""
        return self._file.attribute_types(self._found)

    @property
    def fill_time(self) -> FillTime:
        return self._file.fill_time(self._found)

    @property
    def chunk_cache_config(self) -> ChunkCache:
        return self._file.cache_config

    @property
    def chunk_cache_stats(self) -> CacheStats:
        return replace(self._file.cache_stats)

    def reset_chunk_cache_stats(self) -> None:
        self._file.cache_stats.reset()

    def supports_inplace_append(self) -> bool:
        """Whether append() leaves the file's other bytes where they are."""
        return can_append(self._file, self.path)

    def append(self, values: np.ndarray, options: Append = Append()) -> None:
        """Rows after the last, where the dataset stands if its index allows, else with the file written anew."""
        grow(self._owner_path(), self.path, np.asarray(values), options.lossy_tail, getattr(self._file, "sync", False))
        self._file.reload()
        self._found = self._file.resolve(self.path)

    def append_raw(self, data: bytes, options: Append = Append()) -> None:
        """Stored bytes of whole rows, as append()."""
        dtype, row = self._found.kind.dtype(), self.shape[1:]
        size = dtype.itemsize * int(np.prod(row, dtype=np.int64))
        if not size or len(data) % size:
            raise TypeMismatchError(f"{len(data)} bytes are no whole rows of {size}")
        self.append(np.frombuffer(data, dtype).reshape(-1, *row), options)

    def buffered_appender(self, options: Append = Append()) -> Appender:
        """Appends whole chunks as they fill; what is left waits for flush() or finish()."""
        return Appender(self._owner_path(), self.path, options.lossy_tail)

    def _owner_path(self) -> str:
        name = getattr(self._file.stream, "name", None)
        if not isinstance(name, str):
            raise TypeMismatchError("only files with a path grow")
        return name

    def sha256(self) -> str:
        return hashlib.sha256(self.read_raw()).hexdigest()

    def verify_provenance(self) -> bool | None:
        """Whether the stated digest is that of the values; None where none is stated."""
        stated = self.attrs.get("provenance_sha256")
        return None if stated is None else stated == self.sha256()


def _typed(element: str):
    def read(self, start=None, count=None):
        return self.read_as(element, start, count)

    def rows(self, start: int, count: int):
        return self.read_rows(start, count, element)

    setattr(Dataset, f"read_{element}", read)
    setattr(Dataset, f"read_{element}_region", lambda self, start, count: self.read_as(element, start, count))
    setattr(Dataset, f"read_{element}_rows", rows)


for _element in ELEMENTS:
    _typed(_element)


class Group:
    def __init__(self, file: Bytes, found: Object, path: str):
        self._file, self._found, self.path = file, found, path

    def _named(self, keep) -> list[str]:
        out = []
        for name, target in self._file.links(self._found).items():
            found = self._file.object(target) if isinstance(target, int) else None
            if found is not None and keep(found):
                out.append(name)
        return out

    def datasets(self) -> list[str]:
        return self._named(lambda o: o.is_dataset)

    def groups(self) -> list[str]:
        return self._named(lambda o: o.is_group and not o.is_dataset)

    def named_datatypes(self) -> list[str]:
        return self._named(lambda o: not o.is_dataset and not o.is_group)

    def named_datatype(self, path: str):
        found = self._file.resolve(self._join(path))
        if found.is_dataset or found.is_group:
            raise NotFoundError(f"{path} is no named type")
        return found.kind

    def named_datatype_references(self, path: str) -> int:
        return self._file.type_references(self._join(path))

    def _join(self, path: str) -> str:
        return path if path.startswith("/") else f"{self.path.rstrip('/')}/{path}"

    def dataset(self, path: str) -> Dataset:
        where, found = self._file._resolve(self._join(path), 0)
        return Dataset(self._file, found, where)

    def group(self, path: str) -> Group:
        where, found = self._file._resolve(self._join(path), 0)
        if not found.is_group or found.is_dataset:
            raise NotFoundError(f"{path} is no group")
        return Group(self._file, found, where)

    def iter_datasets(self) -> Iterator[tuple[str, Dataset]]:
        return ((n, self.dataset(n)) for n in self.datasets())

    def iter_groups(self) -> Iterator[tuple[str, Group]]:
        return ((n, self.group(n)) for n in self.groups())

    @property
    def attrs(self) -> dict:
        return self._file.attributes(self._found)

    @property
    def attr_datatypes(self) -> dict:
        return self._file.attribute_types(self._found)

    @property
    def link_phase_change(self) -> tuple[int, int]:
        """Up to how many links stand in the group's header, and below how many they return to it."""
        return self._file.link_phase_change(self._found)

    def dataset_with_options(self, path: str, chunk_cache: ChunkCache) -> Dataset:
        """A dataset with a chunk cache of its own."""
        where, _ = self._file._resolve(self._join(path), 0)
        name = getattr(self._file.stream, "name", None)
        own = Bytes(name if isinstance(name, str) else self._file._at(0, self._file.length), chunk_cache)
        return Dataset(own, own.resolve(where), where)


class ArrayFile(Group):
    """An open file: its root group, and Spark's view of it. access: how it is opened."""

    def __init__(self, source, access: Access = Access()):
        file = Bytes(source, access.chunk_cache, access.metadata_cache)
        if access.libver and LibVer.from_superblock_version(file.version).value > access.libver[1].value:
            file.stream.close()
            raise UnsupportedError(f"a superblock of version {file.version} is over the bound")
        if access.locking is not Locking.DISABLED and isinstance(source, str):
            _lock(file.stream, access.locking)
        super().__init__(file, file.object(file.root), "/")
        self._source, self.access_properties = source, access
        file.sync = access.sync is SyncPolicy.ALWAYS

    @classmethod
    def create(cls, path: str, access: Access = Access(), **properties) -> ArrayFile:
        """A new, empty file, open; properties are those of FileBuilder."""
        FileBuilder(**properties).write(path)
        return cls(path, access)

    def refresh(self) -> None:
        """Sees what has been appended since."""
        self._file.reload()
        self._found = self._file.object(self._file.root)

    @property
    def superblock(self) -> Superblock:
        return Superblock.of(self._file)

    @property
    def file_size(self) -> int:
        return self._file.file_size

    @property
    def libver_bound(self) -> LibVer:
        """The least generation that reads the file."""
        return LibVer.from_superblock_version(self._file.version)

    def as_bytes(self) -> bytes:
        """All of a file that was given as bytes, else nothing."""
        return bytes(self._source) if isinstance(self._source, bytes | bytearray) else b""

    def resolve_address(self, address: StoredAddress) -> PhysicalAddress:
        return self._file.physical(address)

    def relative_address(self, address: PhysicalAddress) -> StoredAddress:
        return self._file.stored_address(address)

    def file_space_info(self) -> FileSpaceInfo | None:
        return file_space_info(self._file)

    def persisted_free_sections(self) -> list:
        return persisted_free_sections(self._file)

    @property
    def metadata_cache_stats(self) -> CacheStats | None:
        """What the metadata cache did; None without one."""
        return replace(self._file.metadata_stats) if self.access_properties.metadata_cache.is_enabled else None

    def reset_metadata_cache_stats(self) -> None:
        self._file.metadata_stats.reset()

    def __enter__(self) -> ArrayFile:
        return self

    def __exit__(self, *_exc) -> None:
        self._file.stream.close()

    @property
    def superblock_version(self) -> int:
        return self._file.version

    @property
    def userblock_size(self) -> int:
        return self._file.base

    def userblock(self) -> bytes:
        return self._file._at(0, self._file.base)

    def catalog(self, spark: SparkSession) -> DataFrame:
        return datasource.catalog(spark, self._source)

    def frame(self, spark: SparkSession, path: str, **options):
        return datasource.read_frame(spark, self._source, path, **options)

    @staticmethod
    def edit(path: str) -> Session:
        return Session(path)


__all__ = ["ArrayFile", "Dataset", "FileBuilder", "Fixed", "Float", "Group", "StringLimits", "convert_array", "is_h5", "is_h5_bytes"]
