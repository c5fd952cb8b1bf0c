"""Growing a dataset where it stands: new chunks go after the file's last byte, and only the records of its index, its
extent and the superblock's end are written over.

For datasets whose leading dimension is unlimited and whose chunks stand in an extensible array, in files of
the newest superblock. Rows that begin in the last, partial band of chunks are written with that band anew;
its old bytes stay unused until the file is repacked. Chunks and blocks are written first, then the records
that point to them, and the extent last, so that a reader sees what was there before or all of it.
"""

from __future__ import annotations

import os
from itertools import product
from math import prod

import numpy as np

from ..errors import TypeMismatchError, UnsupportedError
from .codecs import encode, is_lossless
from .h5.checksum import lookup3
from .h5.extensible import Geometry
from .h5.reader import File
from .h5.types import UNDEFINED


def u(value: int, size: int = 8) -> bytes:
    return int(value).to_bytes(size, "little")


def sealed(data: bytes | bytearray) -> bytes:
    return bytes(data) + u(lookup3(bytes(data)), 4)


def can_append(file: File, path: str) -> bool:
    """Whether append() can grow a dataset where it stands."""
    found = file.resolve(path)
    if not found.is_dataset or file.version < 3 or (file.offset_size, file.length_size) != (8, 8) or not found.maximum or found.maximum[0] is not None or None in found.maximum[1:]:
        return False
    name, how = file.layout(found)
    return name == "chunked" and how["index"] == "extensible" and how["address"] != UNDEFINED and _space(file, found.address) is not None


def _space(file: File, address: int) -> tuple[int, int, int] | None:
    """Where an object header begins, where its dataspace's first length stands, and where its checksum does; None in a continuation."""
    head = file.bytes_at(address, min(64, file.length - file.base - address))
    if head[:4] != b"OHDR":
        return None
    flags = head[5]
    at = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
    width = 1 << (flags & 3)
    size = int.from_bytes(head[at : at + width], "little")
    at += width
    body, step, i = file.bytes_at(address + at, size), 4 + 2 * bool(flags & 4), 0
    while i + step <= size:
        n = int.from_bytes(body[i + 1 : i + 3], "little")
        if body[i] == 1:
            return address, address + at + i + step + (4 if body[i + step] == 2 else 8), address + at + size
        i += step + n
    return None


class _Index:
    """An extensible array whose records are changed."""

    def __init__(self, file: File, out, address: int, end: int):
        self.file, self.out, self.end = file, out, end
        self.address, o = address, 8
        self.head = bytearray(file._checked(address, 12 + 6 * 8 + o, b"EAHD"))
        self.client, self.entry = self.head[5], self.head[6]
        self.g = g = Geometry(*self.head[7:12])
        self.none = b"\xff" * o + bytes(self.entry - o)
        self.place = file._address(self.head, 60)
        inside = g.blocks_before(g.levels_inside)
        self.pointers = 6 + o + g.head * self.entry
        self.top = bytearray(file._checked(self.place, self.pointers + (inside + g.levels - g.levels_inside) * o, b"EAIB"))
        self.supers: dict[int, tuple[int, bytearray]] = {}
        self.parts: dict[int, bytearray] = {}  # blocks and pages that change, by where they stand, without their checksums

    def put(self, data: bytes) -> int:
        """After the file's last byte."""
        address, self.end = self.end, (self.end + len(data) + 7) // 8 * 8
        self.out.seek(self.file.base + address)
        self.out.write(data)
        return address

    def _count(self, i: int, by: int) -> None:
        at = 12 + 8 * i
        self.head[at : at + 8] = u(int.from_bytes(self.head[at : at + 8], "little") + by)

    def _super(self, level: int) -> bytearray:
        if level not in self.supers:
            g, slot = self.g, self.pointers + (self.g.blocks_before(self.g.levels_inside) + level - self.g.levels_inside) * 8
            each, place = (g.pages(level) + 7) // 8, self.file._address(self.top, slot)
            size = 14 + g.offset_size + g.blocks(level) * (each + 8)
            if place == UNDEFINED:
                body = bytearray(b"EASB" + bytes([0, self.client]) + u(self.address) + u(g.start(level), g.offset_size) + bytes(g.blocks(level) * each) + b"\xff" * 8 * g.blocks(level))
                place = self.put(sealed(body))
                self.top[slot : slot + 8] = u(place)
                self._count(0, 1)
                self._count(1, size + 4)
            else:
                body = bytearray(self.file._checked(place, size, b"EASB"))
            self.supers[level] = place, body
        return self.supers[level][1]

    def record(self, number: int) -> tuple[bytearray, int]:
        """The bytes that hold a record, and where in them."""
        g, o = self.g, 8
        if number < g.head:
            return self.top, 6 + o + number * self.entry
        level, k, inner = g.where(number - g.head)
        pages, places, prefix = g.pages(level), g.block_places(level), 14 + g.offset_size
        each = (pages + 7) // 8
        holder, slot = (self.top, self.pointers + (g.blocks_before(level) + k) * o) if level < g.levels_inside else (self._super(level), prefix + g.blocks(level) * each + k * o)
        at = self.file._address(holder, slot)
        if at == UNDEFINED:
            start = b"EADB" + bytes([0, self.client]) + u(self.address) + u(g.start(level) + k * places, g.offset_size)
            page = self.none * (places // pages) if pages else b""
            at = self.put(sealed(start) + sealed(page) * pages if pages else sealed(start + self.none * places))
            holder[slot : slot + 8] = u(at)
            self._count(2, 1)
            self._count(3, prefix + 4 + pages * (len(page) + 4) if pages else prefix + places * self.entry + 4)
        if not pages:
            if at not in self.parts:
                self.parts[at] = bytearray(self._read(at, prefix + places * self.entry))
            return self.parts[at], prefix + inner * self.entry
        number_of_page, within = divmod(inner, places // pages)
        size = places // pages * self.entry
        here = at + prefix + 4 + number_of_page * (size + 4)
        if here not in self.parts:
            bit = prefix + k * each + number_of_page // 8
            made = holder[bit] >> (7 - number_of_page % 8) & 1
            self.parts[here] = bytearray(self._read(here, size) if made else self.none * (places // pages))
            holder[bit] |= 128 >> number_of_page % 8
        return self.parts[here], within * self.entry

    def _read(self, at: int, n: int) -> bytes:
        self.out.seek(self.file.base + at)
        return self.out.read(n)

    def write(self, most: int) -> None:
        """What changed, and that so many records are set."""
        for at, data in (*self.parts.items(), *self.supers.values(), (self.place, self.top)):
            self.out.seek(self.file.base + at)
            self.out.write(sealed(data))
        for i, value in ((4, most), (5, max(most, self.g.head))):
            at = 12 + 8 * i
            self.head[at : at + 8] = u(max(value, int.from_bytes(self.head[at : at + 8], "little")))
        self.out.seek(self.file.base + self.address)
        self.out.write(sealed(self.head))


def append(path: str, dataset: str, values: np.ndarray, lossy_tail: str = "reject", sync: bool = False) -> int:
    """Rows after the dataset's last; its new leading extent. sync: what came before is on the disk before the extent changes."""
    with File(path) as file:
        if not can_append(file, dataset):
            raise UnsupportedError(f"{dataset} does not grow where it stands")
        found = file.resolve(dataset)
        _, how = file.layout(found)
        kind, chunks, rank, extent = found.kind.dtype(), how["chunks"], len(found.shape), found.shape[0]
        values = np.asarray(values)
        if values.dtype.newbyteorder("=") != kind.newbyteorder("=") or values.shape[1:] != found.shape[1:]:
            raise TypeMismatchError(f"{values.dtype} {values.shape} onto {found.shape}")
        if not len(values):
            return extent
        filters, fill = [f.stage(found.kind) for f in file.filters(found)], file.fill(found)
        if how["flags"] & 1:
            raise UnsupportedError("chunks whose edges are not filtered")
        first = extent - extent % chunks[0]
        if first != extent:
            if not is_lossless(filters) and lossy_tail != "allow":
                raise TypeMismatchError("the partial last chunk would lose again")
            values = np.concatenate((file.stored(found, (first, *[0] * (rank - 1)), (extent - first, *found.shape[1:])), values.astype(kind)))
        most = [m if m is not None else n for m, n in zip(found.maximum, found.shape, strict=True)]
        grid = [-(-n // c) for n, c in zip(most, chunks, strict=True)]
        across = prod(grid[1:])
        header = _space(file, found.address)
        with open(path, "r+b") as out:
            index = _Index(file, out, how["address"], file.length - file.base)
            size_bytes = index.entry - 12 if index.client else 0
            last = 0
            for place in product(range(-(-len(values) // chunks[0])), *[range(-(-n // c)) for n, c in zip(found.shape[1:], chunks[1:], strict=True)]):
                part = values[tuple(slice(p * c, p * c + c) for p, c in zip(place, chunks, strict=True))]
                block = np.zeros(chunks, kind)
                if fill is not None:
                    block[...] = fill
                block[tuple(slice(0, n) for n in part.shape)] = part
                payload, mask = encode(block.tobytes(), filters, kind, None if fill is None else fill) if filters else (block.tobytes(), 0)
                number = first // chunks[0] * across + place[0] * across
                for d, p in enumerate(place[1:], 1):
                    number += p * prod(grid[d + 1 :])
                at = index.put(payload)
                data, offset = index.record(number)
                data[offset : offset + index.entry] = u(at) + (u(len(payload), size_bytes) + u(mask, 4) if index.client else b"")
                last = max(last, number + 1)
            index.write(last)
            _finish(file, out, header, first + len(values), index.end, sync)
        return first + len(values)


def _finish(file: File, out, header: tuple[int, int, int], extent: int, end: int, sync: bool) -> None:
    """The superblock's end of the file, then the extent, whose checksum makes it count."""
    out.seek(0, os.SEEK_END)
    if (short := file.base + end - out.tell()) > 0:
        out.write(bytes(short))
    out.seek(file.base)
    top = bytearray(out.read(44))
    top[28:36] = u(file.base + end)
    out.seek(file.base)
    out.write(sealed(top))
    if sync:
        out.flush()
        os.fsync(out.fileno())
    begin, place, close = header
    out.seek(file.base + begin)
    whole = bytearray(out.read(close - begin))
    whole[place - begin : place - begin + 8] = u(extent)
    out.seek(file.base + begin)
    out.write(sealed(whole))


def grow(path: str, dataset: str, values: np.ndarray, lossy_tail: str = "reject", sync: bool = False) -> int:
    """append() where it can, else by a session that writes the file anew (which is always on the disk then)."""
    try:
        return append(path, dataset, values, lossy_tail, sync)
    except UnsupportedError:
        from .session import Session

        with Session(path) as session:
            session.append(dataset, np.asarray(values), lossy_tail=lossy_tail)
        with File(path) as file:
            return file.resolve(dataset).shape[0]
