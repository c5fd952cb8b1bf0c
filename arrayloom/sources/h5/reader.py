"""Bytes to objects: superblocks 0 to 3, object headers 1 and 2, links, attributes, layouts and chunk indexes.

Only headers and indexes are read here; elements are fetched chunk by chunk, for the part that is asked for.
"""

from __future__ import annotations

import io
import os
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from math import prod

import numpy as np

from ...errors import ChecksumError, FormatError, LinkError, NotFoundError, SelectionError, TypeMismatchError, UnsupportedError
from ...options import CacheStats, ChunkCache, MetadataCache
from ..codecs import IDS, NAMES, decode
from .checksum import lookup3
from .dense import ATTRIBUTE_NAME, CHUNK, FILTERED_CHUNK, LINK_NAME, Heap, tree_records
from .extensible import Geometry
from ..zfp import from_client_data
from .space import FillTime, PhysicalAddress, StoredAddress
from .types import SIGNATURE, UNDEFINED, BitField, Compound, Enum, Fixed, Float, Opaque, String, VarString, Vlen, parse

MAX_HOPS = 64
#: Chunks from which several threads decode; bytes between stored chunks that are read along, and bytes read at once.
THREADED, READ_GAP, READ_RUN = 8, 4096, 8 << 20


def signature_at(read) -> int | None:
    """Where the signature is: at 0 or a power of two from 512 on."""
    at = 0
    while True:
        head = read(at, 8)
        if head == SIGNATURE:
            return at
        if len(head) < 8:
            return None
        at = at * 2 or 512


def is_h5(path: str) -> bool:
    with open(path, "rb") as f:
        return signature_at(lambda at, n: (f.seek(at), f.read(n))[1]) is not None


def is_h5_bytes(data: bytes) -> bool:
    return signature_at(lambda at, n: data[at : at + n]) is not None


@dataclass(frozen=True)
class Filter:
    id: int
    name: str
    flags: int
    client_data: tuple[int, ...]

    @property
    def is_optional(self) -> bool:
        return bool(self.flags & 1)

    def stage(self, kind) -> tuple[str, object]:
        """As a stage of a codec pipeline."""
        name = NAMES.get(self.id, str(self.id))
        if name == "deflate":
            return name, self.client_data[0] if self.client_data else 6
        if name == "zfp":
            return name, from_client_data(self.client_data)
        if name == "scaleoffset":
            return name, ("integer" if self.client_data[0] == 2 else "float", self.client_data[1])
        return name, None


    def fill(self, dtype: np.dtype):
        """The value that a scale-offset filter keeps a code for, None without one."""
        if self.id != IDS["scaleoffset"] or len(self.client_data) < 9 or not self.client_data[7]:
            return None
        stored = b"".join(w.to_bytes(4, "little") for w in self.client_data[8:])
        return np.frombuffer(stored, dtype, 1)[0]


@dataclass(frozen=True)
class Chunk:
    """start: the coordinates of its first element; address and size: its stored bytes; mask: filters left out."""

    start: tuple[int, ...]
    address: int
    size: int
    mask: int = 0


@dataclass
class Object:
    """What an object header says."""

    address: int
    messages: list[tuple[int, bytes]]
    shape: tuple[int, ...] | None = None
    maximum: tuple[int | None, ...] | None = None
    kind: object = None
    links: dict = field(default_factory=dict)

    @property
    def is_dataset(self) -> bool:
        return any(k == 8 for k, _ in self.messages)

    @property
    def is_group(self) -> bool:
        return any(k in (2, 6, 17) for k, _ in self.messages) or not (self.is_dataset or any(k == 3 for k, _ in self.messages))


class File:
    """An open file. source is a path, bytes, or a seekable binary stream."""

    def __init__(self, source, chunk_cache: ChunkCache | None = None, metadata_cache: MetadataCache | None = None):
        self.metadata_config, self.metadata, self.metadata_stats = metadata_cache or MetadataCache(), OrderedDict(), CacheStats()
        self.cache_config = chunk_cache or ChunkCache()
        self.cache: OrderedDict[int, np.ndarray] = OrderedDict()
        self.cache_stats = CacheStats()
        self.stream = io.BytesIO(source) if isinstance(source, bytes | bytearray) else open(source, "rb") if isinstance(source, str | os.PathLike) else source  # noqa: SIM115
        self.reload()

    def reload(self) -> None:
        """Reads the file's beginning again and forgets what was read before, as after an append."""
        if isinstance(name := getattr(self.stream, "name", None), str) and not self.stream.closed and os.fstat(self.stream.fileno()).st_ino != os.stat(name).st_ino:
            self.stream.close()
            self.stream = open(name, "rb")  # noqa: SIM115  the file was written anew under its name
        self.stream.seek(0, 2)
        self.length = self.stream.tell()
        base = signature_at(self._at)
        if base is None:
            raise FormatError("no signature")
        self.base = base
        self._superblock()
        self.cache.clear()
        self.cache_stats.cached = self.cache_stats.cached_bytes = 0
        self.metadata.clear()
        self.metadata_stats.cached = self.metadata_stats.cached_bytes = 0
        self.objects: dict[int, Object] = {}
        self.named: dict[int, int] = {}  # the named type that an object's type message points to
        self.heaps: dict[int, dict[int, bytes]] = {}

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_exc) -> None:
        self.stream.close()

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def bytes_at(self, address: int, n: int) -> bytes:
        if address == UNDEFINED or address + n > self.length - self.base or n < 0:
            raise FormatError(f"{n} bytes at {address} are beyond the file's end")
        if n > self.metadata_config.max_entry_bytes or not self.metadata_config.max_bytes:
            return self._at(self.base + address, n)
        stats, key = self.metadata_stats, (address, n)
        if (kept := self.metadata.get(key)) is not None:
            stats.hits += 1
            self.metadata.move_to_end(key)
            return kept
        stats.misses += 1
        self.metadata[key] = data = self._at(self.base + address, n)
        stats.cached_bytes += n
        while stats.cached_bytes > self.metadata_config.max_bytes:
            _, old = self.metadata.popitem(last=False)
            stats.cached_bytes -= len(old)
            stats.evictions += 1
        stats.cached = len(self.metadata)
        return data

    def _superblock(self) -> None:
        head = self._at(self.base, 128)
        self.version = head[8]
        if self.version in (0, 1):
            self.offset_size, self.length_size = head[13], head[14]
            self.leaf_k, self.internal_k = int.from_bytes(head[16:18], "little"), int.from_bytes(head[18:20], "little")
            at = 24 + 4 * (self.version == 1) + 4 * self.offset_size
            self.root = int.from_bytes(head[at + self.offset_size : at + 2 * self.offset_size], "little")
        elif self.version in (2, 3):
            self.offset_size, self.length_size = head[9], head[10]
            end = 12 + 4 * self.offset_size
            self.root = int.from_bytes(head[end - self.offset_size : end], "little")
            if lookup3(head[:end]) != int.from_bytes(head[end : end + 4], "little"):
                raise ChecksumError("superblock")
            self.flags = head[11]
        else:
            raise UnsupportedError(f"superblock version {self.version}")

    def _address(self, data: bytes, at: int) -> int:
        value = int.from_bytes(data[at : at + self.offset_size], "little")
        return UNDEFINED if value == (1 << 8 * self.offset_size) - 1 else value

    # ---- object headers

    def object(self, address: int) -> Object:
        if address not in self.objects:
            messages = self._messages2(address) if self.bytes_at(address, 4) == b"OHDR" else self._messages1(address)
            found = Object(address, messages)
            for kind, data in messages:
                if kind == 1:
                    found.shape, found.maximum = self._space(data)
                elif kind == 3:
                    found.kind = parse(data)[0]
            self.objects[address] = found
        return self.objects[address]

    def _messages2(self, address: int) -> list[tuple[int, bytes]]:
        head = self.bytes_at(address, min(64, self.length - self.base - address))
        flags = head[5]
        at = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
        width = 1 << (flags & 3)
        size = int.from_bytes(head[at : at + width], "little")
        whole = self.bytes_at(address, at + width + size + 4)
        if lookup3(whole[:-4]) != int.from_bytes(whole[-4:], "little"):
            raise ChecksumError(f"object header at {address}")
        blocks, out = [whole[at + width : -4]], []
        while blocks:
            block = blocks.pop(0)
            step = 4 + 2 * bool(flags & 4)
            at = 0
            while at + step <= len(block):
                kind, n, shared = block[at], int.from_bytes(block[at + 1 : at + 3], "little"), block[at + 3]
                data = block[at + step : at + step + n]
                at += step + n
                if kind == 16:
                    place, length = self._address(data, 0), int.from_bytes(data[self.offset_size :][: self.length_size], "little")
                    more = self.bytes_at(place, length)
                    if more[:4] != b"OCHK" or lookup3(more[:-4]) != int.from_bytes(more[-4:], "little"):
                        raise ChecksumError(f"header continuation at {place}")
                    blocks.append(more[4:-4])
                elif kind:
                    if kind == 3 and shared & 2:
                        self.named[address] = self._address(data, 8 if data[0] == 1 else 2)
                    out.append((kind, self._shared(kind, data) if shared & 2 else data))
        return out

    def type_references(self, path: str) -> int:
        """How many datasets point to a named type."""
        wanted = self.resolve(path).address
        seen = {a for _, _, _, kind, a, _ in self.walk() if kind == "dataset"}
        return sum(self.named.get(a) == wanted for a in seen)

    def _messages1(self, address: int) -> list[tuple[int, bytes]]:
        head = self.bytes_at(address, 16)
        if head[0] != 1:
            raise FormatError(f"no object header at {address}")
        blocks, out = [self.bytes_at(address + 16, int.from_bytes(head[8:12], "little"))], []
        while blocks:
            block, at = blocks.pop(0), 0
            while at + 8 <= len(block):
                kind, n, shared = int.from_bytes(block[at : at + 2], "little"), int.from_bytes(block[at + 2 : at + 4], "little"), block[at + 4]
                data = block[at + 8 : at + 8 + n]
                at += 8 + n
                if kind == 16:
                    blocks.append(self.bytes_at(self._address(data, 0), int.from_bytes(data[self.offset_size :][: self.length_size], "little")))
                elif kind:
                    out.append((kind, self._shared(kind, data) if shared & 2 else data))
        return out

    def _shared(self, kind: int, data: bytes) -> bytes:
        if data[0] == 3 and data[1] == 1:
            raise UnsupportedError("messages in a shared heap")
        place = self._address(data, 8 if data[0] == 1 else 2)
        return next(d for k, d in self.object(place).messages if k == kind)

    def _space(self, data: bytes) -> tuple[tuple[int, ...] | None, tuple[int | None, ...] | None]:
        version, rank, flags = data[0], data[1], data[2]
        if version == 2 and data[3] == 2:
            return None, None
        at, n = (4, self.length_size) if version == 2 else (8, self.length_size)
        dims = tuple(int.from_bytes(data[at + i * n : at + i * n + n], "little") for i in range(rank))
        if not flags & 1:
            return dims, None
        at += rank * n
        most = (int.from_bytes(data[at + i * n : at + i * n + n], "little") for i in range(rank))
        return dims, tuple(None if m == (1 << 8 * n) - 1 else m for m in most)

    # ---- links

    def links(self, group: Object) -> dict[str, int | str]:
        """Names in stored order: an address, or the path of a soft link."""
        if group.links:
            return group.links
        out: dict[str, int | str] = {}
        for kind, data in group.messages:
            if kind == 6:
                name, target = self._link(data)
                out[name] = target
            elif kind == 2:
                at = 2 + 8 * bool(data[1] & 1)
                if self._address(data, at) != UNDEFINED:
                    heap = Heap(self, self._address(data, at))
                    stored = [heap.get(record[4:]) for record in tree_records(self, self._address(data, at + self.offset_size), LINK_NAME)]
                    out |= dict(map(self._link, sorted(stored, key=self._created)))
            elif kind == 17:
                tree, heap = self._address(data, 0), self._address(data, self.offset_size)
                head = self.bytes_at(heap, 8 + 2 * self.length_size + self.offset_size)
                size = int.from_bytes(head[8 : 8 + self.length_size], "little")
                names = self.bytes_at(self._address(head, 8 + 2 * self.length_size), size)
                for entry in self._symbols(tree):
                    at = self._address(entry, 0)
                    name = names[at : names.index(b"\0", at)].decode()
                    if int.from_bytes(entry[2 * self.offset_size :][:4], "little") == 2:
                        place = int.from_bytes(entry[2 * self.offset_size + 8 :][:4], "little")
                        out[name] = names[place : names.index(b"\0", place)].decode()
                    else:
                        out[name] = self._address(entry, self.offset_size)
        group.links = out
        return out

    def _created(self, data: bytes) -> int:
        """A link's place in the order of creation, where it is kept."""
        at = 2 + bool(data[1] & 8)
        return int.from_bytes(data[at : at + 8], "little") if data[1] & 4 else 0

    def _link(self, data: bytes) -> tuple[str, int | str]:
        flags, at, kind = data[1], 2, 0
        if flags & 8:
            kind, at = data[at], at + 1
        at += 8 * bool(flags & 4) + bool(flags & 16)
        width = 1 << (flags & 3)
        n = int.from_bytes(data[at : at + width], "little")
        name, at = data[at + width : at + width + n].decode(), at + width + n
        if kind == 0:
            return name, self._address(data, at)
        if kind == 1:
            n = int.from_bytes(data[at : at + 2], "little")
            return name, data[at + 2 : at + 2 + n].decode()
        raise LinkError(f"{name} is an external link")

    def _symbols(self, tree: int) -> Iterator[bytes]:
        head = self.bytes_at(tree, 8 + 2 * self.offset_size)
        if head[:4] != b"TREE":
            raise FormatError("no group B-tree")
        used, step = int.from_bytes(head[6:8], "little"), self.length_size + self.offset_size
        body = self.bytes_at(tree + len(head), used * step + self.length_size)
        for i in range(used):
            child = self._address(body, i * step + self.length_size)
            if head[5]:
                yield from self._symbols(child)
                continue
            node = self.bytes_at(child, 8)
            size = 2 * self.offset_size + 24
            entries = self.bytes_at(child + 8, int.from_bytes(node[6:8], "little") * size)
            for k in range(0, len(entries), size):
                yield entries[k : k + size]

    def resolve(self, path: str) -> Object:
        """The object at a path, through soft links."""
        return self._resolve(path, 0)[1]

    def _resolve(self, path: str, hops: int, start: str = "/") -> tuple[str, Object]:
        where, here = "/", self.object(self.root)
        parts = [p for p in (path if path.startswith("/") else f"{start}/{path}").split("/") if p and p != "."]
        while parts:
            name = parts.pop(0)
            target = self.links(here).get(name)
            if target is None:
                raise NotFoundError(path)
            if isinstance(target, str):
                if hops >= MAX_HOPS:
                    raise LinkError(f"{path} has more than {MAX_HOPS} hops")
                where, here = self._resolve("/".join([target, *parts]), hops + 1, where)
                return where, here
            where, here = f"{where.rstrip('/')}/{name}", self.object(target)
        return where, here

    def walk(self) -> Iterator[tuple[str, str, str, str, int | None, str | None]]:
        """path, parent, name, kind, address and target of each link, depth first; an object is entered once."""
        seen = {self.root}

        def below(path: str, group: Object):
            for name, target in self.links(group).items():
                here = f"{path.rstrip('/')}/{name}"
                if isinstance(target, str):
                    yield here, path, name, "soft", None, target
                    continue
                found = self.object(target)
                kind = "dataset" if found.is_dataset else "group" if found.is_group else "named_type"
                yield here, path, name, kind, target, None
                if kind == "group" and target not in seen:
                    seen.add(target)
                    yield from below(here, found)

        yield from below("/", self.object(self.root))

    # ---- attributes

    def attributes(self, found: Object) -> dict[str, object]:
        return dict(map(self._attribute, self._attribute_messages(found)))

    def attribute_types(self, found: Object) -> dict[str, object]:
        """The stored type of each attribute."""
        return {name: kind for name, kind, _, _ in map(self._attribute_parts, self._attribute_messages(found))}

    def attribute_type(self, address: int, name: str) -> str:
        """The element type of a numeric attribute, else the name of its stored type."""
        kind = self.attribute_types(self.object(address))[name]
        return element_of(kind) or type(kind).__name__.lower()

    def _attribute_messages(self, found: Object) -> Iterator[bytes]:
        for kind, data in found.messages:
            if kind == 12:
                yield data
            elif kind == 21 and self._address(data, at := 2 + 2 * bool(data[1] & 1)) != UNDEFINED:
                heap = Heap(self, self._address(data, at))
                order = lambda r: int.from_bytes(r[heap.id_length + 1 : heap.id_length + 5], "little")
                for record in sorted(tree_records(self, self._address(data, at + self.offset_size), ATTRIBUTE_NAME), key=order):
                    stored = heap.get(record[: heap.id_length])
                    if record[heap.id_length] & 2:
                        stored = self._shared(12, stored)
                    yield stored

    def _attribute(self, data: bytes) -> tuple[str, object]:
        name, kind, shape, stored = self._attribute_parts(data)
        if shape is None:
            return name, None
        raw = np.frombuffer(stored, kind.dtype(), prod(shape))
        values = self.values(kind, raw)
        if not shape:
            return name, values[0].item() if hasattr(values[0], "item") else values[0]
        return name, values.reshape(shape) if isinstance(values, np.ndarray) else values

    def _attribute_parts(self, data: bytes) -> tuple[str, object, tuple[int, ...] | None, bytes]:
        """Name, type, shape and stored elements."""
        version, flags = data[0], data[1]
        n, t, s = (int.from_bytes(data[i : i + 2], "little") for i in (2, 4, 6))
        at = 8 + (version == 3)
        pad = (lambda x: (x + 7) // 8 * 8) if version == 1 else (lambda x: x)
        name, at = data[at : at + n].split(b"\0")[0].decode(), at + pad(n)
        kind_bytes, at = data[at : at + t], at + pad(t)
        kind = parse(self._shared(3, kind_bytes) if version > 1 and flags & 1 else kind_bytes)[0]
        shape, at = self._space(data[at : at + s])[0], at + pad(s)
        return name, kind, shape, data[at:]

    # ---- elements

    def _heap(self, address: int) -> dict[int, bytes]:
        if address not in self.heaps:
            head = self.bytes_at(address, 8 + self.length_size)
            if head[:4] != b"GCOL":
                raise FormatError(f"no heap at {address}")
            body = self.bytes_at(address, int.from_bytes(head[8:], "little"))
            found, at, n = {}, 8 + self.length_size, self.length_size
            while at + 8 + n <= len(body):
                index, size = int.from_bytes(body[at : at + 2], "little"), int.from_bytes(body[at + 8 : at + 8 + n], "little")
                if not index:
                    break
                found[index] = body[at + 8 + n : at + 8 + n + size]
                at += 8 + n + (size + 7) // 8 * 8
            if len(self.heaps) > 64:
                self.heaps.clear()
            self.heaps[address] = found
        return self.heaps[address]

    def values(self, kind, raw: np.ndarray):
        """Decoded elements of stored ones, in order."""
        raw = raw.reshape(-1)
        if isinstance(kind, VarString | Vlen):
            out = []
            for n, heap, index in zip(raw["n"].tolist(), raw["heap"].tolist(), raw["index"].tolist(), strict=True):
                data = self._heap(heap)[index] if index and heap not in (0, UNDEFINED) else b""
                if isinstance(kind, VarString):
                    out.append(data[:n].split(b"\0")[0].decode(errors="replace"))
                else:
                    out.append(kind.base.decode(np.frombuffer(data, kind.base.dtype(), n)).tolist())
            return out
        return kind.decode(raw)

    def filters(self, found: Object) -> list[Filter]:
        data = next((d for k, d in found.messages if k == 11), None)
        if data is None:
            return []
        version, n, at, out = data[0], data[1], 2 if data[0] == 2 else 8, []
        for _ in range(n):
            number, at = int.from_bytes(data[at : at + 2], "little"), at + 2
            named = 0
            if version == 1 or number >= 256:
                named, at = int.from_bytes(data[at : at + 2], "little"), at + 2
            flags, count, at = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 4], "little"), at + 4
            size = (named + 7) // 8 * 8 if version == 1 else named
            name, at = data[at : at + named].split(b"\0")[0].decode(), at + size
            values = tuple(int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little") for i in range(count))
            at += 4 * count + 4 * (version == 1 and count % 2)
            out.append(Filter(number, name or NAMES.get(number, ""), flags, values))
        return out

    def fill_time(self, found: Object) -> FillTime:
        """When the fill value is written."""
        data = next((d for k, d in found.messages if k == 5), None)
        if data is None:
            return FillTime.IF_SET
        return FillTime(data[1] >> 2 & 3 if data[0] == 3 else data[2])

    def link_phase_change(self, group: Object) -> tuple[int, int]:
        """Up to how many links stand in a group's header, and below how many they return to it."""
        data = next((d for k, d in group.messages if k == 10), b"\0\0")
        return (int.from_bytes(data[2:4], "little"), int.from_bytes(data[4:6], "little")) if data[1] & 1 else (8, 6)

    @property
    def file_size(self) -> int:
        return self.length

    def physical(self, address: StoredAddress) -> PhysicalAddress:
        """Where a stored address is in the file."""
        return PhysicalAddress(self.base).checked_add(address.fits(self.offset_size).value)

    def stored_address(self, address: PhysicalAddress) -> StoredAddress:
        """How a place in the file is written down."""
        below = address.checked_sub(self.base)
        if below is None:
            raise FormatError(f"{address.value} is before the base")
        return StoredAddress(below.value).fits(self.offset_size)

    def fill(self, found: Object):
        """The fill value as a stored element, None for zeros."""
        data = next((d for k, d in found.messages if k == 5), None)
        if data is None:
            return None
        if data[0] == 3:
            if not data[1] & 0x20 or data[1] >> 2 & 3 == 1:
                return None
            size, at = int.from_bytes(data[2:6], "little"), 6
        else:
            if data[0] == 2 and not data[3]:
                return None
            size, at = int.from_bytes(data[4:8], "little"), 8
        return np.frombuffer(data, found.kind.dtype(), 1, at)[0] if size == found.kind.size else None

    def layout(self, found: Object) -> tuple[str, dict]:
        """compact, contiguous or chunked, with where and how."""
        data = next((d for k, d in found.messages if k == 8), None)
        if data is None:
            raise TypeMismatchError("no dataset")
        version, kind = data[0], data[1]
        if version not in (3, 4):
            raise UnsupportedError(f"layout version {version}")
        if kind == 0:
            n = int.from_bytes(data[2:4], "little")
            return "compact", {"data": data[4 : 4 + n]}
        if kind == 1:
            return "contiguous", {"address": self._address(data, 2), "size": int.from_bytes(data[2 + self.offset_size :][: self.length_size], "little")}
        if kind == 3:
            raise UnsupportedError("virtual datasets")
        if version == 3:
            rank = data[2] - 1
            at = 3 + self.offset_size
            return "chunked", {"index": "btree1", "address": self._address(data, 3), "chunks": tuple(int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little") for i in range(rank)), "flags": 0}
        flags, rank, width = data[2], data[3] - 1, data[4]
        chunks = tuple(int.from_bytes(data[5 + width * i : 5 + width * i + width], "little") for i in range(rank))
        at = 5 + width * (rank + 1)
        number, at = data[at], at + 1
        how = {"chunks": chunks, "flags": flags, "index": {1: "single", 2: "implicit", 3: "fixed", 4: "extensible", 5: "btree2"}.get(number, "?")}
        if number == 1 and flags & 2:
            how |= {"size": int.from_bytes(data[at : at + self.length_size], "little"), "mask": int.from_bytes(data[at + self.length_size :][:4], "little")}
            at += self.length_size + 4
        at += {3: 1, 4: 5, 5: 6}.get(number, 0)
        return "chunked", how | {"address": self._address(data, at)}

    def chunks(self, found: Object, start: tuple[int, ...] | None = None, count: tuple[int, ...] | None = None) -> Iterator[Chunk]:
        """The chunks that are stored, all or those that meet a region, in the order of their index."""
        name, how = self.layout(found)
        if name != "chunked":
            raise TypeMismatchError("not chunked")
        if how["address"] == UNDEFINED:
            return
        low = start or (0,) * len(found.shape)
        high = tuple(s + n for s, n in zip(low, count, strict=True)) if count else found.shape
        if any(a >= b for a, b in zip(low, high, strict=True)):
            return
        for c in self._indexed(found, how, low, high):
            if all(x < b and x + k > a for x, k, a, b in zip(c.start, how["chunks"], low, high, strict=True)):
                yield c

    def _indexed(self, found: Object, how: dict, low: tuple[int, ...], high: tuple[int, ...]) -> Iterator[Chunk]:
        """The chunks of an index; where they stand by their place, only the places of a region are looked at."""
        whole, rank, chunks = prod(how["chunks"]) * found.kind.size, len(found.shape), how["chunks"]
        # Places are counted over the grid of the largest extent; a dimension without one comes first.
        most = [m if m is not None else n for m, n in zip(found.maximum or found.shape, found.shape, strict=True)]
        grows = [d for d, m in enumerate(found.maximum or ()) if m is None]
        order = [*grows, *(d for d in range(rank) if d not in grows)] if len(grows) == 1 else list(range(rank))
        grid = [-(-most[d] // chunks[d]) for d in order]
        spans = [range(low[d] // chunks[d], -(-high[d] // chunks[d])) for d in order]
        strides = [prod(grid[i + 1 :]) for i in range(rank)]

        def places() -> Iterator[tuple[int, tuple[int, ...]]]:
            for index in product(*spans):
                at = dict(zip(order, index, strict=True))
                yield sum(i * s for i, s in zip(index, strides, strict=True)), tuple(at[d] * c for d, c in enumerate(chunks))

        if how["index"] == "btree1":
            yield from self._tree(how["address"], rank)
        elif how["index"] == "single":
            yield Chunk((0,) * rank, how["address"], how.get("size", whole), how.get("mask", 0))
        elif how["index"] == "implicit":
            for place, start in places():
                yield Chunk(start, how["address"] + place * whole, whole)
        elif how["index"] == "fixed":
            yield from self._fixed(how["address"], places(), whole)
        elif how["index"] == "extensible":
            if len(grows) != 1:
                raise FormatError("an extensible array of a dataset that doesn't grow along one dimension")
            yield from self._extensible(how["address"], places(), whole)
        elif how["index"] == "btree2":
            yield from self._tree2(how, whole, rank)
        else:
            raise UnsupportedError(f"chunk index {how['index']}")

    def _tree(self, address: int, rank: int) -> Iterator[Chunk]:
        head = self.bytes_at(address, 8 + 2 * self.offset_size)
        if head[:4] != b"TREE" or head[4] != 1:
            raise FormatError(f"no chunk B-tree at {address}")
        used, key = int.from_bytes(head[6:8], "little"), 8 + 8 * (rank + 1)
        body = self.bytes_at(address + len(head), used * (key + self.offset_size))
        for i in range(used):
            at = i * (key + self.offset_size)
            child = self._address(body, at + key)
            if head[5]:
                yield from self._tree(child, rank)
            else:
                start = tuple(int.from_bytes(body[at + 8 + 8 * d : at + 16 + 8 * d], "little") for d in range(rank))
                yield Chunk(start, child, int.from_bytes(body[at : at + 4], "little"), int.from_bytes(body[at + 4 : at + 8], "little"))

    def _tree2(self, how: dict, whole: int, rank: int) -> Iterator[Chunk]:
        kind, o = self.bytes_at(how["address"], 6)[5], self.offset_size
        for record in tree_records(self, how["address"], FILTERED_CHUNK if kind == FILTERED_CHUNK else CHUNK):
            places = record[len(record) - 8 * rank :]
            start = tuple(int.from_bytes(places[8 * d : 8 * d + 8], "little") * c for d, c in enumerate(how["chunks"]))
            if kind == CHUNK:
                yield Chunk(start, self._address(record, 0), whole)
            else:
                size, mask = record[o : len(record) - 8 * rank - 4], record[len(record) - 8 * rank - 4 : len(record) - 8 * rank]
                yield Chunk(start, self._address(record, 0), int.from_bytes(size, "little"), int.from_bytes(mask, "little"))

    def verify(self, data: bytes, stored: bytes, what: str) -> None:
        if lookup3(data) != int.from_bytes(stored, "little"):
            raise ChecksumError(what)

    def _fixed(self, address: int, places: Iterator, whole: int) -> Iterator[Chunk]:
        head = self.bytes_at(address, 8 + self.length_size + self.offset_size)
        client, entry, page_bits = head[5], head[6], head[7]
        count, data = int.from_bytes(head[8 : 8 + self.length_size], "little"), self._address(head, 8 + self.length_size)
        if lookup3(head) != int.from_bytes(self.bytes_at(address + len(head), 4), "little"):
            raise ChecksumError("fixed array header")
        if data == UNDEFINED:
            return
        at, page = data + 6 + self.offset_size, 1 << page_bits
        pages = -(-count // page) if count > page else 0
        bitmap = self.bytes_at(at, (pages + 7) // 8)
        at += len(bitmap) + 4 * bool(pages)
        together, loaded, records = page if pages else count, None, b""
        for i, start in places:
            if i >= count:
                continue
            if i // together != loaded:  # the records of a page, or all
                loaded = i // together
                there = not pages or bitmap[loaded // 8] >> (7 - loaded % 8) & 1
                records = self.bytes_at(at + loaded * (together * entry + 4), min(together, count - loaded * together) * entry) if there else b""
            if not records:
                continue
            raw = records[i % together * entry :][:entry]
            place = self._address(raw, 0)
            if place != UNDEFINED:
                size = int.from_bytes(raw[self.offset_size : entry - 4], "little") if client else whole
                yield Chunk(start, place, size, int.from_bytes(raw[-4:], "little") if client else 0)

    def _checked(self, address: int, n: int, signature: bytes) -> bytes:
        """n bytes of a block and its checksum after them."""
        data = self.bytes_at(address, n + 4)
        if data[:4] != signature:
            raise FormatError(f"no {signature.decode()} at {address}")
        if lookup3(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ChecksumError(f"{signature.decode()} at {address}")
        return data[:-4]

    def _extensible(self, address: int, places: Iterator, whole: int) -> Iterator[Chunk]:
        o, n = self.offset_size, self.length_size
        head = self._checked(address, 12 + 6 * n + o, b"EAHD")
        client, entry = head[5], head[6]
        g = Geometry(head[7], head[8], head[9], head[10], head[11])
        index = self._address(head, 12 + 6 * n)
        if index == UNDEFINED:
            return
        inside = g.blocks_before(g.levels_inside)
        top = self._checked(index, 6 + o + g.head * entry + (inside + g.levels - g.levels_inside) * o, b"EAIB")
        pointers = 6 + o + g.head * entry
        supers: dict[int, bytes] = {}
        blocks: dict[tuple[int, int], bytes | None] = {}

        def block(level: int, k: int) -> bytes | None:
            """The records of a data block, pages joined; None where it was never made."""
            pages, size = g.pages(level), g.block_places(level) * entry
            present = None
            if level < g.levels_inside:
                at = self._address(top, pointers + (g.blocks_before(level) + k) * o)
            else:
                each = (pages + 7) // 8
                if level not in supers:
                    place = self._address(top, pointers + (inside + level - g.levels_inside) * o)
                    supers[level] = b"" if place == UNDEFINED else self._checked(place, 6 + o + g.offset_size + g.blocks(level) * (each + o), b"EASB")
                if not supers[level]:
                    return None
                bitmaps = 6 + o + g.offset_size
                present = supers[level][bitmaps + k * each : bitmaps + (k + 1) * each]
                at = self._address(supers[level], bitmaps + g.blocks(level) * each + k * o)
            if at == UNDEFINED:
                return None
            prefix = 6 + o + g.offset_size
            if not pages:
                return self._checked(at, prefix + size, b"EADB")[prefix:]
            self._checked(at, prefix, b"EADB")
            page, out = size // pages, []
            for i in range(pages):
                data = self.bytes_at(at + prefix + 4 + i * (page + 4), page + 4)
                there = present[i // 8] >> (7 - i % 8) & 1 if present else 1
                if there and lookup3(data[:-4]) != int.from_bytes(data[-4:], "little"):
                    raise ChecksumError(f"page of a data block at {at}")
                out.append(data[:-4] if there else b"\xff" * page)
            return b"".join(out)

        for place, start in places:
            if place < g.head:
                raw = top[6 + o + place * entry :][:entry]
            else:
                level, k, inner = g.where(place - g.head)
                if (level, k) not in blocks:
                    blocks.clear()  # places come in order, so one block at a time is enough
                    blocks[level, k] = block(level, k)
                if blocks[level, k] is None:
                    continue
                raw = blocks[level, k][inner * entry : (inner + 1) * entry]
            at = self._address(raw, 0)
            if at != UNDEFINED:
                size = int.from_bytes(raw[o : entry - 4], "little") if client else whole
                yield Chunk(start, at, size, int.from_bytes(raw[-4:], "little") if client else 0)

    def decoded(self, found: Object, chunk: Chunk) -> np.ndarray:
        """A chunk's stored elements, in the chunk's shape; recently used ones are kept."""
        kept = self.cache.get(chunk.address)
        if kept is not None:
            self.cache_stats.hits += 1
            self.cache.move_to_end(chunk.address)
            return kept
        self.cache_stats.misses += 1
        block = self._decoded(found, chunk)
        self._keep(chunk, block)
        return block

    def _keep(self, chunk: Chunk, block: np.ndarray) -> None:
        stats, config = self.cache_stats, self.cache_config
        if block.nbytes > config.max_bytes or not config.max_slots:
            stats.oversize += 1
            return
        self.cache[chunk.address] = block
        stats.cached_bytes += block.nbytes
        while len(self.cache) > config.max_slots or stats.cached_bytes > config.max_bytes:
            _, old = self.cache.popitem(last=False)
            stats.cached_bytes -= old.nbytes
            stats.evictions += 1
        stats.cached = len(self.cache)

    def _decoded(self, found: Object, chunk: Chunk) -> np.ndarray:
        return self._decoder(found)(chunk, self.bytes_at(chunk.address, chunk.size))

    def _decoder(self, found: Object):
        """What makes elements of a chunk and its stored bytes; the header is read once for all chunks."""
        _, how = self.layout(found)
        dtype, filters = found.kind.dtype(), self.filters(found)
        size, stages = prod(how["chunks"]) * found.kind.size, [f.stage(found.kind) for f in filters]
        fill = next((x for f in filters if (x := f.fill(dtype)) is not None), None)

        def decoder(chunk: Chunk, stored: bytes) -> np.ndarray:
            edge = how["flags"] & 1 and any(s + c > n for s, c, n in zip(chunk.start, how["chunks"], found.shape, strict=True))
            return np.frombuffer(decode(stored, [] if edge else stages, dtype, size, chunk.mask, fill), dtype).reshape(how["chunks"])

        return decoder

    def _blocks(self, found: Object, chunks: list[Chunk]) -> Iterator[tuple[Chunk, np.ndarray]]:
        """Chunks with their elements. Neighbours in the file are read at once; many are decoded on several threads, a run at a time."""
        if len(chunks) < THREADED or self.cache_config.max_slots and any(c.address in self.cache for c in chunks):
            for chunk in chunks:
                yield chunk, self.decoded(found, chunk)
            return
        decoder, runs, plain = self._decoder(found), [], not self.filters(found)
        for chunk in sorted(chunks, key=lambda c: c.address):
            last = runs[-1] if runs else None
            if last and chunk.address - last[1] <= READ_GAP and chunk.address + chunk.size - last[0] <= READ_RUN:
                last[1] = max(last[1], chunk.address + chunk.size)
                last[2].append(chunk)
            else:
                runs.append([chunk.address, chunk.address + chunk.size, [chunk]])
        keep = len(chunks) <= self.cache_config.max_slots
        if plain and not keep:  # stored as they are: nothing to share out
            dtype, shape = found.kind.dtype(), self.layout(found)[1]["chunks"]
            n = prod(shape)
            for begin, end, members in runs:
                whole = self.bytes_at(begin, end - begin)
                for chunk in members:
                    if chunk.size != n * dtype.itemsize:
                        raise FormatError(f"a chunk has {chunk.size} bytes, not {n * dtype.itemsize}")
                    self.cache_stats.misses += 1
                    self.cache_stats.oversize += 1
                    yield chunk, np.frombuffer(whole, dtype, n, chunk.address - begin).reshape(shape)
            return
        with ThreadPoolExecutor(min(8, os.cpu_count() or 1)) as pool:
            for begin, end, members in runs:
                whole = memoryview(self.bytes_at(begin, end - begin))
                made = pool.map(lambda c, w=whole, b=begin: decoder(c, bytes(w[c.address - b : c.address - b + c.size])), members)
                for chunk, block in zip(members, made, strict=True):
                    self.cache_stats.misses += 1
                    if keep:
                        self._keep(chunk, block)
                    else:
                        self.cache_stats.oversize += 1
                    yield chunk, block

    def stored(self, found: Object, start: tuple[int, ...], count: tuple[int, ...]) -> np.ndarray:
        """The stored elements of a hyper-rectangle; only chunks that meet it are read."""
        rank = len(found.shape)
        if len(start) != rank or len(count) != rank or any(s < 0 or n < 0 or s + n > m for s, n, m in zip(start, count, found.shape, strict=True)):
            raise SelectionError(f"{start}, {count} in {found.shape}")
        name, how = self.layout(found)
        dtype, fill = found.kind.dtype(), self.fill(found)
        out = np.zeros(count, dtype)
        if fill is not None:
            out[...] = fill
        if name == "chunked":
            steps, ends = how["chunks"], tuple(s + n for s, n in zip(start, count, strict=True))
            for chunk, block in self._blocks(found, list(self.chunks(found, tuple(start), tuple(count)))):
                low, high = [max(s, c) for s, c in zip(start, chunk.start, strict=True)], [min(e, c + k) for e, c, k in zip(ends, chunk.start, steps, strict=True)]
                to = tuple(slice(a - s, b - s) for a, b, s in zip(low, high, start, strict=True))
                out[to] = block[tuple(slice(a - c, b - c) for a, b, c in zip(low, high, chunk.start, strict=True))]
            return out
        if name == "compact":
            return np.frombuffer(how["data"], dtype, prod(found.shape)).reshape(found.shape)[tuple(slice(s, s + n) for s, n in zip(start, count, strict=True))]
        if how["address"] == UNDEFINED or not prod(count):
            return out
        if not rank:
            return np.frombuffer(self.bytes_at(how["address"], found.kind.size), dtype).reshape(())
        along = next((d for d in range(rank - 1) if count[d] != 1), rank - 1)  # up to here one place of each dimension is meant
        row = prod(found.shape[along + 1 :])
        first = sum(s * prod(found.shape[d + 1 :]) for d, s in enumerate(start[: along + 1]))
        raw = np.frombuffer(self.bytes_at(how["address"] + first * found.kind.size, count[along] * row * found.kind.size), dtype)
        inner = tuple(slice(s, s + n) for s, n in zip(start[along + 1 :], count[along + 1 :], strict=True))
        return raw.reshape(count[along], *found.shape[along + 1 :])[(slice(None), *inner)].reshape(count)

    def read(self, path: str, start: tuple[int, ...] | None = None, count: tuple[int, ...] | None = None):
        """Decoded elements of a dataset or a region of it: an array, or a list for strings, structs and sequences."""
        found = self.resolve(path)
        if not found.is_dataset:
            raise TypeMismatchError(f"{path} is no dataset")
        if found.shape is None:
            return np.zeros(0, found.kind.dtype())
        start = (0,) * len(found.shape) if start is None else start
        count = tuple(n - s for n, s in zip(found.shape, start, strict=True)) if count is None else count
        values = self.values(found.kind, np.ascontiguousarray(self.stored(found, start, count)))
        return values.reshape(count) if isinstance(values, np.ndarray) else values

    def rows(self, path: str, start: int, count: int):
        """A window of leading rows, cut at the extent."""
        shape = self.resolve(path).shape
        start = min(start, shape[0])
        return self.read(path, (start, *[0] * (len(shape) - 1)), (max(0, min(count, shape[0] - start)), *shape[1:]))


def element_of(kind) -> str | None:
    """The element type of numeric values, None for others."""
    return kind.element if isinstance(kind, Fixed | Float | BitField) else kind.base.element if isinstance(kind, Enum) else None


__all__ = ["Chunk", "Compound", "File", "Filter", "Object", "Opaque", "String", "element_of", "is_h5", "is_h5_bytes"]
