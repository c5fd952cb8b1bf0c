"""Objects to bytes: newest superblock, checksummed object headers, compact links, chunks indexed by a B-tree.

A file is laid out children first, so every address is known when it is written down, and the root last.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import islice
from math import prod

import numpy as np

from ...errors import FormatError, TypeMismatchError, UnsupportedError
from .. import zfp
from ..codecs import IDS, check_pipeline, encode, placed
from .checksum import lookup3
from .dense import ATTRIBUTE_NAME, CHUNK, FILTERED_CHUNK, LINK_NAME, NODE, put_heap, put_tree
from .extensible import Geometry
from .space import FileSpaceInfo, FillTime
from .spooled import Spool
from .types import SIGNATURE, UNDEFINED, Compound, Enum, Opaque, Reference, String, VarString, Vlen, of_element

SPACE, LINK_INFO, TYPE, FILL, LINK, LAYOUT, GROUP_INFO, FILTERS, ATTRIBUTE, ATTRIBUTE_INFO, FILE_SPACE = 1, 2, 3, 5, 6, 8, 10, 11, 12, 21, 23
#: Links of a group, or attributes of an object, up to so many stand in its header, more in dense storage.
MAX_COMPACT = 8
TREE_ENTRIES = 64
#: Chunks that are encoded, on several threads, before they are written.
ENCODED = 64
INF = 0xFFFFFFFF


def u(value: int, size: int = 8) -> bytes:
    return int(value).to_bytes(size, "little")


def dataspace(shape: tuple[int, ...] | None, maximum: tuple[int | None, ...] | None = None) -> bytes:
    """None is a null space, () a scalar; None in maximum is unlimited."""
    if shape is None:
        return bytes([2, 0, 0, 2])
    body = bytes([2, len(shape), int(maximum is not None), int(bool(shape))]) + b"".join(u(n) for n in shape)
    return body + b"".join(u(UNDEFINED if n is None else n) for n in maximum or ())


def pipeline(filters: list, kind, chunks: tuple[int, ...], fill: bytes = b"") -> bytes:
    out, elements = bytes([2, len(filters)]), prod(chunks)
    words = [int.from_bytes(fill[i : i + 4], "little") for i in range(0, len(fill), 4)]
    for name, parameter in filters:
        data = {
            "deflate": lambda: [6 if parameter is None else parameter],
            "shuffle": lambda: [kind.size],
            "fletcher32": lambda: [],
            "lzf": lambda: [4, 0x0105, elements * kind.size],
            "scaleoffset": lambda: [2 if parameter[0] == "integer" else 0, parameter[1], elements, int(parameter[0] == "float"), kind.size, int(getattr(kind, "signed", True)), 0, int(bool(fill)), *words] + [0] * (12 - len(words)),
            "zfp": lambda: zfp.client_data(kind.dtype(), parameter[1], parameter[0]),
        }[name]()
        number = IDS[name]
        label = name.encode() + b"\0" if number >= 256 else b""
        out += u(number, 2) + (u(len(label), 2) if number >= 256 else b"") + u(int(name in ("lzf", "shuffle", "deflate")), 2) + u(len(data), 2) + label + b"".join(u(x, 4) for x in data)
    return out


@dataclass
class Attribute:
    """data: stored bytes; of variable types the values themselves, which go to a heap."""

    kind: object
    shape: tuple[int, ...] | None
    data: object
    named: object = None


def attribute(value: object, kind=None, named=None) -> Attribute:
    """An attribute from a Python or numpy value; strings are fixed UTF-8, null-padded."""
    if named is not None:
        return replace(attribute(value, kind), named=named)
    if value is None:
        return Attribute(kind or of_element("i32"), None, b"")
    if isinstance(kind, VarString | Vlen):
        single = isinstance(value, str) or isinstance(kind, Vlen) and not (len(value) and isinstance(value[0], list | tuple | np.ndarray))
        return Attribute(kind, () if single else (len(value),), [value] if single else list(value))
    if isinstance(value, str):
        kind = kind or String(max(1, len(value.encode())))
        return Attribute(kind, (), kind.pack(value))
    if isinstance(value, list | tuple) and value and isinstance(value[0], str):
        kind = kind or String(max(1, *(len(v.encode()) for v in value)))
        return Attribute(kind, (len(value),), b"".join(map(kind.pack, value)))
    if isinstance(value, bool):
        value = np.uint8(value)
    x = np.asarray(value)
    if kind is None:
        if x.dtype.kind not in "iuf" or x.dtype.itemsize > 8:
            raise TypeMismatchError(f"no attribute from {x.dtype}")
        kind = of_element(f"{x.dtype.kind}{x.dtype.itemsize * 8}")
    return Attribute(kind, x.shape, np.ascontiguousarray(x, kind.dtype()).tobytes())


@dataclass
class Named:
    kind: object


@dataclass
class Dataset:
    """data: an array, a list of strings or sequences for variable types, or spooled elements, which are stored in one piece;
    encoded: chunks [(start, payload, mask)]."""

    kind: object
    shape: tuple[int, ...] | None
    data: object = None
    chunks: tuple[int, ...] | None = None
    maximum: tuple[int | None, ...] | None = None
    filters: list = field(default_factory=list)
    fill: object = None
    fill_time: FillTime = FillTime.IF_SET
    compact: bool = False
    encoded: Iterable | None = None
    named: Named | None = None
    index: str | None = None  # of chunks: single, fixed, extensible, btree1 or btree2; by default the plainest that holds them
    attrs: dict = field(default_factory=dict)

    def set_attr(self, name: str, value: object, kind=None) -> Dataset:
        self.attrs[name] = value if isinstance(value, Attribute) else attribute(value, kind)
        return self


@dataclass
class Soft:
    target: str


@dataclass
class Group:
    """link_phase_change: up to how many links stand in the header, and below how many they return to it."""

    members: dict = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)
    link_phase_change: tuple[int, int] | None = None

    def __post_init__(self):
        if self.link_phase_change and not 0 <= self.link_phase_change[1] <= self.link_phase_change[0] + 1 <= 0x10000:
            raise TypeMismatchError(f"links {self.link_phase_change}")

    def create_group_with(self, name: str, configure, **how) -> Group:
        """A subgroup that configure(group) fills; if that fails, none is made."""
        made = Group(**how)
        configure(made)
        return self._add(name, made)

    def add_group(self, name: str, group: Group) -> Group:
        return self._add(name, group)

    def set_attr_committed(self, name: str, value: object, named: Named) -> Group:
        """An attribute whose type is a named one, pointed to."""
        self.attrs[name] = attribute(value, named.kind, named)
        return self

    def _add(self, name: str, member):
        if not name or "/" in name or name == "." or name in self.members:
            raise TypeMismatchError(f"{name!r} is taken or no name")
        self.members[name] = member
        return member

    def create_group(self, name: str) -> Group:
        return self._add(name, Group())

    def create_dataset(self, name: str, data=None, *, shape=None, kind=None, **how) -> Dataset:
        """From an array, or a shape and type alone (then nothing is allocated). A named type as kind is pointed to, not copied."""
        named = kind if isinstance(kind, Named) else None
        kind = named.kind if named else kind
        data = np.asarray(data) if isinstance(data, np.generic | int | float) else data
        if isinstance(data, np.ndarray) and kind is None:
            kind = of_element(f"{data.dtype.kind}{data.dtype.itemsize * 8}")
        if isinstance(data, list) and kind is None:
            kind = VarString()
        if shape is None and data is not None:
            shape = data.shape if isinstance(data, np.ndarray) else (len(data),)
        if how.get("maximum") is not None and how.get("chunks") is None:
            raise TypeMismatchError("only chunked datasets grow")
        if how.get("filters"):
            check_pipeline(how["filters"])
            how.setdefault("chunks", shape)
        return self._add(name, Dataset(kind, None if shape is None else tuple(shape), data, named=named, **how))

    def link(self, name: str, target: str) -> Soft:
        return self._add(name, Soft(target))

    def commit_datatype(self, name: str, kind) -> Named:
        return self._add(name, Named(kind))

    def set_attr(self, name: str, value: object, kind=None) -> Group:
        self.attrs[name] = attribute(value, kind)
        return self


class FileBuilder(Group):
    """The root group of a file to be. space: the settings of free space that it records."""

    def __init__(self, userblock: int = 0, userblock_content: bytes = b"", link_phase_change: tuple[int, int] | None = None, space: FileSpaceInfo | None = None):
        super().__init__(link_phase_change=link_phase_change)
        if space and space.persist:
            raise UnsupportedError("free space is not kept, as files are written whole")
        self.space = space
        if userblock and (userblock < 512 or userblock & (userblock - 1)) or len(userblock_content) > userblock:
            raise TypeMismatchError("a userblock is 0 or a power of two from 512 that holds its content")
        self.userblock, self.content = userblock, userblock_content

    def finish(self) -> bytes:
        with tempfile.TemporaryFile() as out:
            self.finish_to(out)
            out.seek(0)
            return out.read()

    def write(self, path: str) -> None:
        """All or nothing: a temporary file beside path takes its name once it is whole."""
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
        try:
            with os.fdopen(handle, "w+b") as out:
                self.finish_to(out)
                out.flush()
                os.fsync(out.fileno())
            os.replace(temporary, path)
        except BaseException:
            os.unlink(temporary)
            raise

    def finish_to(self, out) -> None:
        _Layout(out, self.userblock).file(self, self.content)


class _Layout:
    def __init__(self, out, base: int):
        self.out, self.base, self.at = out, base, 48
        self.placed: dict[int, int] = {}

    def put(self, data: bytes, address: int | None = None) -> int:
        """Writes at the next multiple of 8, or where a place was kept; its address."""
        if address is None:
            address = self.reserve(len(data))
        self.out.seek(self.base + address)
        self.out.write(data)
        return address

    def reserve(self, n: int) -> int:
        address, self.at = self.at, (self.at + n + 7) // 8 * 8
        return address

    def dense(self, kind: int, objects: list[tuple[str, bytes]], id_length: int, record) -> bytes:
        """Objects by name in a heap, and a tree that finds them; the addresses of both. record(id, hash, place) is a tree's record."""
        heap, ids = put_heap(self.put, self.reserve, lookup3, [data for _, data in objects], id_length)
        found = sorted((lookup3(name.encode()), name, record(i, u(lookup3(name.encode()), 4), place)) for place, (i, (name, _)) in enumerate(zip(ids, objects, strict=True)))
        return u(heap) + u(put_tree(self.put, lookup3, kind, [r for _, _, r in found], len(found[0][2])))

    def file(self, root: FileBuilder, content: bytes) -> None:
        address = self.group(root)
        extension = UNDEFINED if root.space is None else self.header([(FILE_SPACE, root.space.encoded())])
        head = SIGNATURE + bytes([3, 8, 8, 0]) + u(self.base) + u(extension) + u(self.base + self.at) + u(address)
        self.out.seek(0)
        self.out.write(content.ljust(self.base, b"\0"))
        self.out.write(head + u(lookup3(head), 4))
        self.out.truncate(self.base + self.at)

    def header(self, messages: list[tuple]) -> int:
        body = b""
        for kind, data, *shared in messages:
            if len(data) > 0xFFFF:
                raise UnsupportedError("a header message over 64 KiB")
            body += bytes([kind]) + u(len(data), 2) + bytes([2 if shared else 0]) + data
        head = b"OHDR" + bytes([2, 2]) + u(len(body), 4) + body
        return self.put(head + u(lookup3(head), 4))

    def attributes(self, attrs: dict) -> list[tuple[int, bytes]]:
        out = []
        for name, a in attrs.items():
            kind = a.kind.encoded() if a.named is None else bytes([3, 2]) + u(self.object(a.named))
            space, label = dataspace(a.shape), name.encode() + b"\0"
            data = self.variable(a.kind, a.data).tobytes() if isinstance(a.kind, VarString | Vlen) and a.shape is not None else a.data
            out.append((ATTRIBUTE, bytes([3, int(a.named is not None)]) + u(len(label), 2) + u(len(kind), 2) + u(len(space), 2) + b"\1" + label + kind + space + data))
        if len(out) <= MAX_COMPACT and all(len(data) <= 0xFFFF for _, data in out):
            return out
        objects = [(name, data) for name, (_, data) in zip(attrs, out, strict=True)]
        return [(ATTRIBUTE_INFO, bytes([0, 1]) + u(len(objects) & 0xFFFF, 2) + self.dense(ATTRIBUTE_NAME, objects, 8, lambda i, h, place: i + b"\0" + u(place, 4) + h))]

    def group(self, group: Group) -> int:
        links, info, many = [], bytes(2) + u(UNDEFINED) * 2, len(group.members) > (group.link_phase_change or (MAX_COMPACT,))[0]  # many: kept apart, so with their order
        for name, member in group.members.items():
            label = name.encode()
            size = 1 if len(label) < 256 else 2
            head = bytes([1, (size - 1) | 0x10 | 0x08 | 4 * many, int(isinstance(member, Soft))]) + (u(len(links)) if many else b"") + b"\1" + u(len(label), size) + label
            if isinstance(member, Soft):
                target = member.target.encode()
                links.append((LINK, head + u(len(target), 2) + target))
            else:
                links.append((LINK, head + u(self.object(member))))
        if many:
            objects = [(name, data) for name, (_, data) in zip(group.members, links, strict=True)]
            links, info = [], bytes([0, 1]) + u(len(objects)) + self.dense(LINK_NAME, objects, 7, lambda i, h, _: h + i)
        return self.header([(LINK_INFO, info), (GROUP_INFO, bytes([0, 1]) + u(group.link_phase_change[0], 2) + u(group.link_phase_change[1], 2) if group.link_phase_change else bytes(2)), *links, *self.attributes(group.attrs)])

    def object(self, member) -> int:
        if id(member) not in self.placed:
            if isinstance(member, Group):
                self.placed[id(member)] = self.group(member)
            elif isinstance(member, Named):
                self.placed[id(member)] = self.header([(TYPE, member.kind.encoded())])
            else:
                self.placed[id(member)] = self.dataset(member)
        return self.placed[id(member)]

    def heap(self, values: list[bytes]) -> np.ndarray:
        """Variable-length values in heap collections; what their dataset stores of each."""
        out = np.zeros(len(values), VarString().dtype())
        at = 0
        while at < len(values):
            body, index = b"", 0
            first = at
            while at < len(values) and index < 0xFFFE and (len(body) + len(values[at]) < 1 << 20 or at == first):
                index += 1
                body += u(index, 2) + u(1, 2) + bytes(4) + u(len(values[at])) + values[at] + bytes(-len(values[at]) % 8)
                at += 1
            size = max(4096, (16 + len(body) + 16 + 7) // 8 * 8)
            free = size - 16 - len(body)
            address = self.put(b"GCOL\1\0\0\0" + u(size) + body + (bytes(8) + u(free)).ljust(free, b"\0"))
            out["heap"][first:at] = address
            out["index"][first:at] = np.arange(1, at - first + 1)
        return out

    def variable(self, kind, values) -> np.ndarray:
        """What is stored of values of a variable type, which themselves go to heaps."""
        coded = [x.encode() if isinstance(kind, VarString) else np.asarray(x, kind.base.dtype()).tobytes() for x in values]
        out = self.heap(coded)
        out["n"] = [len(v) // (1 if isinstance(kind, VarString) else kind.base.size) for v in coded]
        return out

    def raw(self, d: Dataset) -> np.ndarray | None:
        """The stored elements of a dataset."""
        if d.data is None or d.shape is None:
            return None
        if isinstance(d.kind, VarString | Vlen):
            return self.variable(d.kind, d.data).reshape(d.shape)
        if isinstance(d.kind, String):
            return np.frombuffer(b"".join(map(d.kind.pack, d.data)), d.kind.dtype()).reshape(d.shape)
        if isinstance(d.kind, Opaque):
            return np.frombuffer(b"".join(d.data), d.kind.dtype()).reshape(d.shape)
        if isinstance(d.kind, Reference):
            return np.array([UNDEFINED if x is None else self.object(x) for x in d.data], "<u8").reshape(d.shape)
        if isinstance(d.kind, Compound) and not isinstance(d.data, np.ndarray):
            out = np.zeros(len(d.data), d.kind.dtype())
            for name, _, kind in d.kind.fields:
                out[name] = [np.void(kind.pack(r[name])) if isinstance(kind, String) else r[name] for r in d.data]
            return out.reshape(d.shape)
        return np.ascontiguousarray(d.data, d.kind.dtype()).reshape(d.shape)

    def dataset(self, d: Dataset) -> int:
        if isinstance(d.kind, Enum) and d.data is not None and not isinstance(d.data, np.ndarray):
            codes = d.kind.labels()
            d.data = np.array([codes[x] if isinstance(x, str) else x for x in d.data], d.kind.dtype())
        spooled = isinstance(d.data, Spool)
        if spooled and (d.chunks is not None or len(d.data) != prod(d.shape)):
            raise TypeMismatchError("spooled elements fill a dataset without chunks")
        raw = None if spooled else self.raw(d)
        fill = b"" if d.fill is None else np.asarray(d.fill, d.kind.dtype()).tobytes()
        chunked = d.chunks is not None and d.shape is not None
        messages = [
            (SPACE, dataspace(d.shape, d.maximum)),
            (TYPE, bytes([3, 2]) + u(self.object(d.named)), True) if d.named else (TYPE, d.kind.encoded()),
            (FILL, bytes([3, (3 if chunked else 2) | d.fill_time.value << 2 | (0x20 if fill else 0)]) + (u(len(fill), 4) + fill if fill else b"")),
        ]
        if chunked:
            if len(d.chunks) != len(d.shape) or min(d.chunks) < 1:
                raise TypeMismatchError(f"chunks {d.chunks} don't fit {d.shape}")
            if d.filters:
                messages.append((FILTERS, pipeline(placed(d.filters, d.chunks), d.kind, d.chunks, fill)))
            messages.append((LAYOUT, self.chunked(d, self.encoded(d, raw))))
        elif d.compact and raw is not None:
            messages.append((LAYOUT, bytes([3, 0]) + u(raw.nbytes, 2) + raw.tobytes()))
        else:
            size = 0 if d.shape is None else prod(d.shape) * d.kind.size
            place = self.copied(d.data) if spooled and size else self.put(raw.tobytes()) if raw is not None and raw.nbytes else UNDEFINED
            messages.append((LAYOUT, bytes([3, 1]) + u(place) + u(size)))
        return self.header(messages + self.attributes(d.attrs))

    def copied(self, data: Spool) -> int:
        """Writes spooled elements, some at a time; their address."""
        address = self.reserve(data.nbytes)
        self.out.seek(self.base + address)
        for run in data.runs():
            self.out.write(run)
        return address

    def encoded(self, d: Dataset, raw: np.ndarray | None):
        """(start, stored size, mask, address) of each chunk, in row-major order."""
        if d.encoded is not None:
            for start, payload, mask in d.encoded:
                yield tuple(start), len(payload), mask, self.put(payload)
            return
        if raw is None:
            return
        filters = placed(d.filters, d.chunks)

        def made(index: tuple[int, ...]) -> tuple[tuple[int, ...], bytes, int]:
            start = tuple(i * c for i, c in zip(index, d.chunks, strict=True))
            part = raw[tuple(slice(s, s + c) for s, c in zip(start, d.chunks, strict=True))]
            block = np.zeros(d.chunks, raw.dtype)
            if d.fill is not None:
                block[...] = d.fill
            block[tuple(slice(0, n) for n in part.shape)] = part
            return start, *encode(block.tobytes(), filters, raw.dtype, d.fill)

        grid = np.ndindex(*[-(-n // c) for n, c in zip(d.shape, d.chunks, strict=True)])
        with ThreadPoolExecutor(min(8, os.cpu_count() or 1)) as pool:
            while some := list(islice(grid, ENCODED)):
                for start, payload, mask in pool.map(made, some) if filters else map(made, some):
                    yield start, len(payload), mask, self.put(payload)

    def tree2(self, d: Dataset, chunks: Iterable) -> bytes:
        whole, width = prod(d.chunks) * d.kind.size, max((int(c).bit_length() + 7) // 8 for c in (*d.chunks, d.kind.size))
        size = min(8, 1 + (whole.bit_length() + 7) // 8)
        found = sorted((tuple(s // c for s, c in zip(start, d.chunks, strict=True)), place, n, mask) for start, n, mask, place in chunks)
        records = [u(place) + (u(n, size) + u(mask, 4) if d.filters else b"") + b"".join(map(u, at)) for at, place, n, mask in found]
        length = 8 + (size + 4 if d.filters else 0) + 8 * len(d.chunks)
        tree = put_tree(self.put, lookup3, FILTERED_CHUNK if d.filters else CHUNK, records, length)
        dims = b"".join(u(c, width) for c in (*d.chunks, d.kind.size))
        return bytes([4, 2, 0, len(d.chunks) + 1, width]) + dims + bytes([5]) + u(NODE, 4) + bytes([100, 40]) + u(tree)

    def chunked(self, d: Dataset, chunks: Iterable) -> bytes:
        """The layout message of stored chunks, after their index. A grid that can't grow needs no tree: one chunk is pointed
        to, more stand in an array by their place."""
        grid = [-(-n // c) for n, c in zip(d.shape, d.chunks, strict=True)]
        grows = d.maximum is not None and any(m is None or m > n for m, n in zip(d.maximum, d.shape, strict=True))
        unlimited = [i for i, m in enumerate(d.maximum or ()) if m is None]
        index = d.index or ("extensible" if len(unlimited) == 1 else "btree2" if unlimited else "btree1" if grows or not prod(grid) else "single" if prod(grid) == 1 else "fixed")
        if index == "btree2":
            return self.tree2(d, chunks)
        if index == "btree1":
            tree = self.tree(d, chunks)
            return bytes([3, 2, len(d.chunks) + 1]) + u(tree) + b"".join(u(c, 4) for c in (*d.chunks, d.kind.size))
        width = max((int(c).bit_length() + 7) // 8 for c in (*d.chunks, d.kind.size))
        dims = b"".join(u(c, width) for c in (*d.chunks, d.kind.size))
        head = lambda flags: bytes([4, 2, flags, len(d.chunks) + 1, width]) + dims
        whole = prod(d.chunks) * d.kind.size
        if index == "single":
            if prod(grid) != 1:
                raise TypeMismatchError("more than one chunk")
            size, mask, address = next(((size, mask, at) for _, size, mask, at in chunks), (whole, 0, UNDEFINED))
            return head(2) + b"\1" + u(size) + u(mask, 4) + u(address) if d.filters else head(0) + b"\1" + u(address)
        if index not in ("fixed", "extensible"):
            raise UnsupportedError(f"no writer of index {index}")
        places = {tuple(s): (size, mask, at) for s, size, mask, at in chunks}
        n, bits = (whole.bit_length() + 7) // 8 + 1, 10
        entries = []
        # Places are counted over the grid of the largest extent; a dimension without one comes first.
        most = [m if m is not None else n for m, n in zip(d.maximum or d.shape, d.shape, strict=True)]
        order = [*unlimited, *(i for i in range(len(d.shape)) if i not in unlimited)]
        for i in np.ndindex(*[-(-most[k] // d.chunks[k]) for k in order]):
            size, mask, at = places.get(tuple(int(i[order.index(k)]) * c for k, c in enumerate(d.chunks)), (0, 0, UNDEFINED))
            entries.append(u(at) + (u(size, n) + u(mask, 4) if d.filters else b""))
        client, entry, page = int(bool(d.filters)), 8 + (n + 4 if d.filters else 0), 1 << bits
        if index == "extensible":
            if len(unlimited) != 1:
                raise UnsupportedError("extensible arrays grow along one dimension alone")
            g = Geometry()
            address = self.extensible(g, entries, client, entry)
            return head(0) + b"\4" + bytes([g.place_bits, g.head, g.pointers, g.min_block, g.page_bits]) + u(address)
        header = self.at
        block = b"FADB" + bytes([0, client]) + u(header)
        if len(entries) > page:
            pages = [b"".join(entries[i : i + page]) for i in range(0, len(entries), page)]
            bitmap = bytearray((len(pages) + 7) // 8)
            for i in range(len(pages)):
                bitmap[i // 8] |= 128 >> i % 8
            block += bytes(bitmap)
            block += u(lookup3(block), 4) + b"".join(p + u(lookup3(p), 4) for p in pages)
        else:
            block += b"".join(entries)
            block += u(lookup3(block), 4)
        size = 4 + 4 + 8 + 8 + 4
        top = b"FAHD" + bytes([0, client, entry, bits]) + u(len(entries)) + u((header + size + 7) // 8 * 8)
        self.put(top + u(lookup3(top), 4))
        self.put(block)
        return head(0) + b"\3" + bytes([bits]) + u(header)

    def extensible(self, g: Geometry, entries: list[bytes], client: int, entry: int) -> int:
        """Blocks from the last to the header, whose place is known first as its size is fixed."""
        none = b"\xff" * 8 + bytes(entry - 8)
        header = self.at
        self.at += (12 + 48 + 8 + 4 + 7) // 8 * 8
        seal = lambda data: data + u(lookup3(data), 4)
        own, rest = entries[: g.head], entries[g.head :]
        own = own + [none] * (g.head - len(own))
        inside, supers, stats = [UNDEFINED] * g.blocks_before(g.levels_inside), [UNDEFINED] * (g.levels - g.levels_inside), [0, 0, 0, 0]
        for level in range(g.levels):
            first, size, pages = g.start(level), g.block_places(level), g.pages(level)
            if first >= len(rest):
                break
            places, bitmaps = [], b""
            for k in range(g.blocks(level)):
                part = rest[first + k * size : first + (k + 1) * size]
                bitmap = bytearray((pages + 7) // 8)
                if part:
                    data = b"".join(part + [none] * (size - len(part)))
                    prefix = b"EADB" + bytes([0, client]) + u(header) + u(first + k * size, g.offset_size)
                    if pages:
                        page = size * entry // pages
                        for i in range(pages):
                            bitmap[i // 8] |= 128 >> i % 8
                        block = seal(prefix) + b"".join(seal(data[i * page : (i + 1) * page]) for i in range(pages))
                    else:
                        block = seal(prefix + data)
                    places.append(self.put(block))
                    stats[2], stats[3] = stats[2] + 1, stats[3] + len(block)
                else:
                    places.append(UNDEFINED)
                bitmaps += bytes(bitmap)
            if level < g.levels_inside:
                inside[g.blocks_before(level) : g.blocks_before(level) + len(places)] = places
            else:
                block = seal(b"EASB" + bytes([0, client]) + u(header) + u(first, g.offset_size) + bitmaps + b"".join(map(u, places)))
                supers[level - g.levels_inside] = self.put(block)
                stats[0], stats[1] = stats[0] + 1, stats[1] + len(block)
        index = self.put(seal(b"EAIB" + bytes([0, client]) + u(header) + b"".join(own) + b"".join(map(u, inside + supers))))
        after = self.at
        self.at = header
        top = b"EAHD" + bytes([0, client, entry, g.place_bits, g.head, g.min_block, g.pointers, g.page_bits])
        self.put(seal(top + b"".join(u(x) for x in (*stats, len(entries), max(len(entries), g.head))) + u(index)))
        self.at = after
        return header

    def tree(self, d: Dataset, chunks: Iterable) -> int:
        """A B-tree over chunks by their start, built from the leaves up."""
        rank = len(d.shape)

        def key(size: int, mask: int, start: tuple[int, ...]) -> bytes:
            return u(size, 4) + u(mask, 4) + b"".join(map(u, start)) + u(0)

        end = key(0, 0, tuple(-(-n // c) * c for n, c in zip(d.shape, d.chunks, strict=True)))
        level, entries = 0, [(key(size, mask, start), address) for start, size, mask, address in chunks]
        if any(len(k) != 16 + 8 * rank for k, _ in entries):
            raise FormatError("a chunk of another rank")
        if not entries:
            return UNDEFINED
        size = 24 + (TREE_ENTRIES + 1) * len(end) + TREE_ENTRIES * 8
        while True:
            runs = [entries[i : i + TREE_ENTRIES] for i in range(0, len(entries), TREE_ENTRIES)]
            first = self.at
            step = (size + 7) // 8 * 8
            above = []
            for i, run in enumerate(runs):
                left = first + (i - 1) * step if i else UNDEFINED
                right = first + (i + 1) * step if i + 1 < len(runs) else UNDEFINED
                after = runs[i + 1][0][0] if i + 1 < len(runs) else end
                node = b"TREE" + bytes([1, level]) + u(len(run), 2) + u(left) + u(right)
                node += b"".join(k + u(a) for k, a in run) + after
                above.append((run[0][0], self.put(node.ljust(size, b"\0"))))
            if len(above) == 1:
                return above[0][1]
            level, entries = level + 1, above
