"""Dense storage: fractal heaps, which hold many small objects in blocks that double in size, and version-2
B-trees, which find them (or chunks) by fixed-size records kept in order.

A heap's objects are named by an id: for managed ones the offset in the heap's address space and a length;
that space is dealt out to direct blocks row by row of a table, width blocks a row, each row from the third
on with blocks twice as large as the row before; where blocks would grow over the largest, rows of indirect
blocks follow, each a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from ...errors import FormatError, UnsupportedError
from .types import UNDEFINED

#: Record types (fixed values).
HUGE, LINK_NAME, ATTRIBUTE_NAME, CHUNK, FILTERED_CHUNK = 1, 5, 8, 10, 11
#: Creation parameters (fixed values): blocks a row, the least size of blocks, bits of heap offsets, bytes of a node.
WIDTH, LEAST_BLOCK, HEAP_BITS, NODE = 4, 512, 32, 2048
#: Bytes of an object that still stands in a block.
MANAGED = 65_000
#: Bytes of a node around its records: signature, version, type, checksum.
NODE_OVERHEAD = 10
MAX_DEPTH = 32


def needed(n: int) -> int:
    """Bytes that hold n."""
    return max(1, (int(n).bit_length() + 7) // 8)


def within(n: int) -> int:
    """Bytes that hold offsets in n bytes, as heaps count them."""
    return (int(n).bit_length() + 6) // 8


# ---- B-trees


def capacities(node: int, record: int, depth: int, offset_size: int) -> list[tuple[int, int, int]]:
    """For each depth from the leaves: records a node can hold, records of a whole subtree, bytes of a pointer to a node of it."""
    out = []
    for d in range(depth + 1):
        if not d:
            most = (node - NODE_OVERHEAD) // record
            out.append((most, most, offset_size + needed(most)))
            continue
        _, below, pointer = out[-1]  # a child's count takes as many bytes at any depth
        most = (node - NODE_OVERHEAD - pointer) // (record + pointer)
        total = (most + 1) * below + most
        out.append((most, total, offset_size + needed(out[0][0]) + needed(total)))
    return out


def tree_records(file, address: int, kind: int) -> Iterator[bytes]:
    """The records of a tree in order. file gives checked(address, n, signature), and the sizes of its offsets and lengths."""
    o, n = file.offset_size, file.length_size
    head = file._checked(address, 16 + o + 2 + n, b"BTHD")
    if head[5] != kind:
        raise FormatError(f"records of type {head[5]}, not {kind}")
    node, record, depth = (int.from_bytes(head[a:b], "little") for a, b in ((6, 10), (10, 12), (12, 14)))
    if depth > MAX_DEPTH or not record or node <= NODE_OVERHEAD:
        raise FormatError("no tree of records")
    room = capacities(node, record, depth, o)

    def below(at: int, used: int, d: int) -> Iterator[bytes]:
        if used > room[d][0]:
            raise FormatError("more records than a node holds")
        pointer = room[d - 1][2] if d else 0
        data = file._checked(at, 6 + used * record + (used + 1) * pointer, b"BTIN" if d else b"BTLF")
        for i in range(used + 1):
            if d:
                child = data[6 + used * record + i * pointer :][:pointer]
                counted = needed(room[0][0])
                yield from below(file._address(child, 0), int.from_bytes(child[o : o + counted], "little"), d - 1)
            if i < used:
                yield data[6 + i * record : 6 + (i + 1) * record]

    root, used = file._address(head, 16), int.from_bytes(head[16 + o : 18 + o], "little")
    if root != UNDEFINED and used:
        yield from below(root, used, depth)


def put_tree(put, checksum, kind: int, records: list[bytes], size: int, node: int = NODE) -> int:
    """Writes a tree of sorted records of a size and returns its header's address. put(data) writes and returns where."""
    depth = 0
    while capacities(node, size, depth, 8)[-1][1] < len(records):
        depth += 1
    room = capacities(node, size, depth, 8)

    def sealed(data: bytes, whole: int) -> int:
        return put((data + checksum(data).to_bytes(4, "little")).ljust(whole, b"\0"))

    def below(some: list[bytes], d: int) -> tuple[int, int]:
        """The address of a node over some records, and its own records."""
        if not d:
            return sealed(b"BTLF" + bytes([0, kind]) + b"".join(some), node), len(some)
        children = max(2, -(-(len(some) + 1) // (room[d - 1][1] + 1)))
        own, pointers, at = [], b"", 0
        for i in range(children):
            end = (len(some) - (children - 1)) * (i + 1) // children + i
            place, used = below(some[at:end], d - 1)
            pointers += place.to_bytes(8, "little") + used.to_bytes(needed(room[0][0]), "little")
            if d > 1:
                pointers += (end - at).to_bytes(needed(room[d - 1][1]), "little")
            if i < children - 1:
                own.append(some[end])
            at = end + 1
        return sealed(b"BTIN" + bytes([0, kind]) + b"".join(own) + pointers, node), len(own)

    root, used = below(records, depth) if records else (UNDEFINED, 0)
    head = b"BTHD" + bytes([0, kind]) + node.to_bytes(4, "little") + size.to_bytes(2, "little") + depth.to_bytes(2, "little") + bytes([100, 40])
    head += root.to_bytes(8, "little") + used.to_bytes(2, "little") + len(records).to_bytes(8, "little")
    return sealed(head, len(head) + 4)


# ---- heaps


@dataclass(frozen=True)
class Table:
    """How a heap's address space is dealt out."""

    width: int
    start: int
    largest: int

    @property
    def direct_rows(self) -> int:
        return self.largest.bit_length() - self.start.bit_length() + 2

    def size(self, row: int) -> int:
        """Bytes of address space of a block of a row."""
        return self.start << max(0, row - 1)

    def offset(self, row: int) -> int:
        return self.width * (self.start * row if row < 2 else self.size(row))

    def rows_of(self, size: int) -> int:
        """Rows of an indirect block that covers so much."""
        return (size // (self.start * self.width)).bit_length()


class Heap:
    """Objects of a heap by their ids."""

    def __init__(self, file, address: int):
        o, n = file.offset_size, file.length_size
        self.file, size = file, 22 + 12 * n + 3 * o
        head = file.bytes_at(address, size)
        if head[:4] != b"FRHP":
            raise FormatError(f"no heap at {address}")
        if int.from_bytes(head[7:9], "little"):
            raise UnsupportedError("filtered heaps")
        head = file._checked(address, size, b"FRHP")
        self.id_length, self.checked = int.from_bytes(head[5:7], "little"), head[9] & 2
        managed = int.from_bytes(head[10:14], "little")
        self.huge_tree = file._address(head, 14 + n)
        at = 14 + 10 * n + 2 * o
        width, start, largest = (int.from_bytes(x, "little") for x in (head[at : at + 2], head[at + 2 : at + 2 + n], head[at + 2 + n : at + 2 + 2 * n]))
        at += 2 + 2 * n
        bits = int.from_bytes(head[at : at + 2], "little")
        self.root, self.rows = file._address(head, at + 4), int.from_bytes(head[at + 4 + o : at + 6 + o], "little")
        if not width or not start or start & (start - 1) or largest & (largest - 1) or largest < start:
            raise FormatError("a heap's table")
        self.table, self.offset_bytes = Table(width, start, largest), (bits + 7) // 8
        self.length_bytes = min(within(largest), within(managed))
        self.prefix = 5 + o + self.offset_bytes
        self.blocks: dict[int, bytes] = {}
        self.huge: dict[int, tuple[int, int]] | None = None

    def get(self, name: bytes) -> bytes:
        kind = name[0] >> 4 & 3
        if kind == 0:
            offset = int.from_bytes(name[1 : 1 + self.offset_bytes], "little")
            return self._managed(offset, int.from_bytes(name[1 + self.offset_bytes :][: self.length_bytes], "little"))
        if kind == 2:
            if self.id_length <= 17:
                return name[1 : 2 + (name[0] & 15)]
            return name[2 : 3 + ((name[0] & 15) << 8 | name[1])]
        if kind != 1:
            raise FormatError("an id of no known kind")
        o, n = self.file.offset_size, self.file.length_size
        if self.id_length > o + n:
            return self.file.bytes_at(self.file._address(name, 1), int.from_bytes(name[1 + o : 1 + o + n], "little"))
        if self.huge is None:
            records = tree_records(self.file, self.huge_tree, HUGE)
            self.huge = {int.from_bytes(r[o + n :], "little"): (self.file._address(r, 0), int.from_bytes(r[o : o + n], "little")) for r in records}
        place = self.huge.get(int.from_bytes(name[1:9], "little"))
        if place is None:
            raise FormatError("a huge object that is not listed")
        return self.file.bytes_at(*place)

    def _managed(self, offset: int, length: int) -> bytes:
        at, first, rows, t = self.root, 0, self.rows, self.table
        size = t.start
        while rows:  # from the root's table down to a direct block
            inside = offset - first
            row = 0 if inside < t.offset(1) else (inside // (t.width * t.start)).bit_length()
            if row >= rows:
                raise FormatError("an object beyond its heap")
            column = (inside - t.offset(row)) // t.size(row)
            at = self.file._address(self._indirect(at, rows), (row * t.width + column) * self.file.offset_size)
            first, size = first + t.offset(row) + column * t.size(row), t.size(row)
            rows = 0 if row < t.direct_rows else t.rows_of(size)
            if at == UNDEFINED:
                raise FormatError("an object in a block that was never made")
        if offset - first + length > size:
            raise FormatError("an object beyond its block")
        if at not in self.blocks:
            whole = self.file.bytes_at(at, size)
            if whole[:4] != b"FHDB":
                raise FormatError(f"no block of a heap at {at}")
            if self.checked:
                self.file.verify(whole[: self.prefix] + bytes(4) + whole[self.prefix + 4 :], whole[self.prefix : self.prefix + 4], "a heap's block")
            self.blocks[at] = whole
        return self.blocks[at][offset - first : offset - first + length]

    def _indirect(self, address: int, rows: int) -> bytes:
        """The addresses of an indirect block's children."""
        if address not in self.blocks:
            self.blocks[address] = self.file._checked(address, self.prefix + rows * self.table.width * self.file.offset_size, b"FHIB")[self.prefix :]
        return self.blocks[address]


def put_heap(put, reserve, checksum, objects: list[bytes], id_length: int) -> tuple[int, list[bytes]]:
    """Writes a heap; its header's address and the objects' ids. Objects over MANAGED bytes stand alone, listed in a tree.

    reserve(n) is where the next n bytes will stand.
    """
    words = lambda *xs: b"".join(x.to_bytes(8, "little") for x in xs)
    huge = {i: put(data) for i, data in enumerate(objects) if len(data) > MANAGED}
    listed = [words(place, len(objects[i]), number) for number, (i, place) in enumerate(huge.items(), 1)]
    huge_tree = put_tree(put, checksum, HUGE, listed, 24) if huge else UNDEFINED
    numbers = {i: number for number, i in enumerate(huge, 1)}
    small = [data for i, data in enumerate(objects) if i not in huge]
    prefix = 5 + 8 + HEAP_BITS // 8 + 4
    longest = max(map(len, small), default=1)
    start = max(LEAST_BLOCK, 1 << (longest + prefix - 1).bit_length())
    while 16 * WIDTH * start < 2 * (sum(map(len, small)) + prefix):
        start *= 2
    table = Table(WIDTH, start, 16 * start)
    head_size = 22 + 12 * 8 + 3 * 8 + 4
    head = reserve(head_size)
    blocks, places = [], []  # (offset, size, data), and each object's offset
    for data in small:
        if not blocks or len(blocks[-1][2]) + len(data) > blocks[-1][1]:
            row, column = divmod(len(blocks), WIDTH)
            if row >= table.direct_rows:
                raise UnsupportedError("more objects than a heap's direct blocks hold")
            offset = table.offset(row) + column * table.size(row)
            blocks.append((offset, table.size(row), bytearray(b"FHDB\0" + head.to_bytes(8, "little") + offset.to_bytes(HEAP_BITS // 8, "little") + bytes(4))))
        places.append(blocks[-1][0] + len(blocks[-1][2]))
        blocks[-1][2].extend(data)
    addresses, free = [], 0
    for _, size, data in blocks:
        free += size - len(data)
        data.extend(bytes(size - len(data)))
        data[prefix - 4 : prefix] = checksum(bytes(data)).to_bytes(4, "little")
        addresses.append(put(bytes(data)))
    if len(blocks) < 2:
        root, rows = addresses[0] if blocks else UNDEFINED, 0
    else:
        rows = -(-len(blocks) // WIDTH)
        body = b"FHIB\0" + head.to_bytes(8, "little") + bytes(HEAP_BITS // 8) + b"".join(a.to_bytes(8, "little") for a in addresses) + b"\xff" * 8 * (rows * WIDTH - len(blocks))
        root = put(body + checksum(body).to_bytes(4, "little"))
    offset_bytes = HEAP_BITS // 8
    managed = min(table.largest, MANAGED)
    length_bytes = min(within(table.largest), within(managed))
    space = sum(size for _, size, _ in blocks)
    end = blocks[-1][0] + blocks[-1][1] if blocks else 0
    body = b"FRHP\0" + id_length.to_bytes(2, "little") + bytes(2) + bytes([2]) + managed.to_bytes(4, "little")
    body += words(len(huge), huge_tree, free, UNDEFINED, table.offset(rows) if rows else space, space, end, len(small), sum(len(objects[i]) for i in huge), len(huge), 0, 0)
    body += WIDTH.to_bytes(2, "little") + words(start, table.largest) + HEAP_BITS.to_bytes(2, "little") + (1).to_bytes(2, "little") + words(root) + rows.to_bytes(2, "little")
    put(body + checksum(body).to_bytes(4, "little"), head)
    left = iter(places)
    ids = [b"\x10" + numbers[i].to_bytes(id_length - 1, "little") if i in huge else b"\0" + next(left).to_bytes(offset_bytes, "little") + len(data).to_bytes(length_bytes, "little") for i, data in enumerate(objects)]
    return head, [i.ljust(id_length, b"\0") for i in ids]
