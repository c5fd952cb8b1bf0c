"""Where things stand in a file: addresses, ranges of them, the superblock's marks, and the free space that a file remembers."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntFlag

from ...errors import FormatError, UnsupportedError
from .checksum import lookup3
from .types import SIGNATURE, UNDEFINED

#: The largest position (fixed value).
MOST = (1 << 64) - 1


@dataclass(frozen=True, order=True)
class _Position:
    value: int

    def __post_init__(self):
        if not 0 <= self.value <= MOST:
            raise FormatError(f"no position {self.value}")

    def get(self) -> int:
        return self.value

    def checked_add(self, length: int):
        return type(self)(self.value + length)

    def checked_sub(self, length: int):
        """So many bytes before, None below zero."""
        return type(self)(self.value - length) if length <= self.value else None

    def checked_distance_from(self, earlier) -> int | None:
        return self.value - earlier.value if earlier.value <= self.value else None


class PhysicalAddress(_Position):
    """A byte of the file, counted from its first."""


class StoredAddress(_Position):
    """A byte of the file as it is written down: counted from the base."""

    @classmethod
    def undefined(cls, width: int = 8) -> StoredAddress:
        return cls((1 << 8 * width) - 1)

    def is_undefined(self, width: int = 8) -> bool:
        return self.value == (1 << 8 * width) - 1

    def fits(self, width: int) -> StoredAddress:
        """Itself, if a field of width bytes holds it and doesn't mean none."""
        if self.value >= (1 << 8 * width) - 1:
            raise FormatError(f"{self.value} in {width} bytes")
        return self


@dataclass(frozen=True)
class AddressRange:
    """From start up to and without end, both of one kind of address."""

    start: _Position
    length: int

    def __post_init__(self):
        if self.length < 0:
            raise FormatError("a range of negative length")
        self.start.checked_add(self.length)

    @property
    def end(self) -> _Position:
        return self.start.checked_add(self.length)

    @property
    def is_empty(self) -> bool:
        return not self.length

    def contains(self, other: AddressRange) -> bool:
        return self.start <= other.start and other.end <= self.end

    def overlaps(self, other: AddressRange) -> bool:
        return max(self.start, other.start) < min(self.end, other.end)

    def intersection(self, other: AddressRange) -> AddressRange | None:
        if not self.overlaps(other):
            return None
        start = max(self.start, other.start)
        return AddressRange(start, min(self.end, other.end).value - start.value)

    def adjoins(self, other: AddressRange) -> bool:
        return self.end == other.start or other.end == self.start

    def precedes(self, other: AddressRange) -> bool:
        return self.end <= other.start


class FillTime(Enum):
    """When the fill value is written (fixed values)."""

    ALLOC = 0
    NEVER = 1
    IF_SET = 2


class MessageType:
    """What a message of an object header is; numbers that are not known are kept."""

    #: Numbers of known messages (fixed values).
    KNOWN = {
        "nil": 0, "dataspace": 1, "link_info": 2, "datatype": 3, "fill_value_old": 4, "fill_value": 5, "link": 6, "external_files": 7, "data_layout": 8,
        "bogus": 9, "group_info": 10, "filter_pipeline": 11, "attribute": 12, "comment": 13, "modification_time_old": 14, "shared_message_table": 15,
        "continuation": 16, "symbol_table": 17, "modification_time": 18, "btree_k": 19, "driver_info": 20, "attribute_info": 21, "reference_count": 22, "file_space_info": 23,
    }

    def __init__(self, number: int):
        if not 0 <= number <= 0xFFFF:
            raise FormatError(f"no message type {number}")
        self.number = number

    @property
    def name(self) -> str | None:
        return next((n for n, v in self.KNOWN.items() if v == self.number), None)

    @property
    def is_known(self) -> bool:
        return self.name is not None

    @property
    def unknown_id(self) -> int | None:
        return None if self.is_known else self.number

    def __eq__(self, other) -> bool:
        return isinstance(other, MessageType) and other.number == self.number

    def __hash__(self) -> int:
        return hash(self.number)

    def __repr__(self) -> str:
        return f"MessageType({self.name or self.number})"


class StatusFlags(IntFlag):
    """Marks that a writer sets while it has a file open (fixed values)."""

    WRITE = 1
    SWMR_WRITE = 4

    @property
    def is_inconsistent(self) -> bool:
        """Marked for a single writer with readers, but not for a writer."""
        return bool(self & StatusFlags.SWMR_WRITE) and not self & StatusFlags.WRITE

    @property
    def unknown_bits(self) -> int:
        return int(self) & ~5


@dataclass(frozen=True)
class Superblock:
    version: int
    offset_width: int
    length_width: int
    base: int
    end: int
    root: int
    extension: int | None
    flags: StatusFlags

    @classmethod
    def of(cls, file) -> Superblock:
        """What an open file's first bytes say."""
        head = file._at(file.base, 128)
        o = file.offset_size
        at = 24 + 4 * (file.version == 1) if file.version < 2 else 12
        word = lambda i: int.from_bytes(head[at + i * o : at + (i + 1) * o], "little")
        none = (1 << 8 * o) - 1
        if file.version < 2:
            return cls(file.version, o, file.length_size, word(0), word(2), file.root, None, StatusFlags(0))
        return cls(file.version, o, file.length_size, word(0), word(2), file.root, None if word(1) == none else word(1), StatusFlags(head[11] if file.version > 2 else 0))


def clear_status_flags(path: str) -> StatusFlags:
    """Takes the marks of a writer that went away from a file; what they were. The superblock is written at once, with its checksum."""
    from .reader import File

    with File(path) as file:
        before, base, o = Superblock.of(file), file.base, file.offset_size
    if before.version < 3 or not before.flags:
        return before.flags
    with open(path, "r+b") as f:
        f.seek(base)
        head = bytearray(f.read(12 + 4 * o))
        if bytes(head[:8]) != SIGNATURE:
            raise FormatError("no superblock")
        head[11] = 0
        f.seek(base)
        f.write(bytes(head) + lookup3(bytes(head)).to_bytes(4, "little"))
    return before.flags


#: How a file deals out space, by the number in its message (fixed values).
STRATEGIES = ("fsm_aggr", "page", "aggr", "none")


@dataclass(frozen=True)
class FileSpaceInfo:
    """A file's space settings, and where its managers of free space stand, by their number."""

    strategy: str = "fsm_aggr"
    persist: bool = False
    threshold: int = 1
    page_size: int = 4096
    managers: tuple[int | None, ...] = ()

    def encoded(self) -> bytes:
        head = bytes([1, STRATEGIES.index(self.strategy), int(self.persist)]) + self.threshold.to_bytes(8, "little") + self.page_size.to_bytes(8, "little") + bytes(2) + UNDEFINED.to_bytes(8, "little")
        return head + (b"".join((UNDEFINED if m is None else m).to_bytes(8, "little") for m in self.managers) if self.persist else b"")

    @classmethod
    def parse(cls, data: bytes, offset_width: int, length_width: int) -> FileSpaceInfo:
        o, n = offset_width, length_width
        if data[0] != 1:
            raise UnsupportedError(f"file space info of version {data[0]}")
        if data[1] >= len(STRATEGIES):
            raise FormatError(f"no strategy {data[1]}")
        at = 3 + 2 * n + 2 + o
        none = (1 << 8 * o) - 1
        places = [int.from_bytes(data[i : i + o], "little") for i in range(at, at + 12 * o, o)] if data[2] else []
        if data[2] and len(data) < at + 12 * o:
            raise FormatError("managers that end early")
        return cls(STRATEGIES[data[1]], bool(data[2]), int.from_bytes(data[3 : 3 + n], "little"), int.from_bytes(data[3 + n : 3 + 2 * n], "little"), tuple(None if p == none else p for p in places))


@dataclass(frozen=True)
class FreeSection:
    """Bytes that nothing uses."""

    address: int
    length: int
    manager: int = 0

    @property
    def end_address(self) -> int:
        return self.address + self.length

    @property
    def range(self) -> AddressRange:
        return AddressRange(StoredAddress(self.address), self.length)


@dataclass(frozen=True)
class FreeSections:
    sections: tuple[FreeSection, ...]

    @property
    def section_count(self) -> int:
        return len(self.sections)

    @property
    def free_bytes(self) -> int:
        return sum(s.length for s in self.sections)


def file_space_info(file) -> FileSpaceInfo | None:
    """The settings that a file records, None without any."""
    extension = Superblock.of(file).extension
    if extension is None:
        return None
    data = next((d for k, d in file.object(extension).messages if k == MessageType.KNOWN["file_space_info"]), None)
    return None if data is None else FileSpaceInfo.parse(data, file.offset_size, file.length_size)


def free_sections(file, address: int, manager: int = 0) -> FreeSections:
    """The sections of one manager, as its header and list have them."""
    o, n = file.offset_size, file.length_size
    head = file._checked(address, 14 + 7 * n + o, b"FSHD")
    at = 6 + 4 * n
    bits = int.from_bytes(head[at + 6 : at + 8], "little")
    longest = int.from_bytes(head[at + 8 : at + 8 + n], "little")
    place = file._address(head, at + 8 + n)
    used = int.from_bytes(head[at + 8 + n + o : at + 8 + 2 * n + o], "little")
    if place == UNDEFINED or not used:
        return FreeSections(())
    body = file._checked(place, used - 4, b"FSSE")
    count_bytes, place_bytes = _bytes_of(int.from_bytes(head[6 + n + n : 6 + 3 * n], "little")), (bits + 7) // 8
    length_bytes, at, out = _bytes_of(longest), 5 + o, []
    while at + count_bytes + length_bytes <= len(body):
        count, length = int.from_bytes(body[at : at + count_bytes], "little"), int.from_bytes(body[at + count_bytes :][:length_bytes], "little")
        at += count_bytes + length_bytes
        if not count:
            break
        for _ in range(count):
            start = int.from_bytes(body[at : at + place_bytes], "little")
            at += place_bytes + 1  # a type follows
            out.append(FreeSection(start, length, manager))
    return FreeSections(tuple(sorted(out, key=lambda s: s.address)))


def _bytes_of(n: int) -> int:
    return max(1, (n.bit_length() + 7) // 8)


def persisted_free_sections(file) -> list[FreeSections]:
    """The sections of every manager that a file keeps."""
    info = file_space_info(file)
    return [] if info is None else [free_sections(file, m, i) for i, m in enumerate(info.managers) if m is not None]
