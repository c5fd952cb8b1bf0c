"""Stored data types: their bytes in a file, the numpy type of a decoded element, and the Spark type of a column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import types as T

from ...errors import FormatError, TypeMismatchError, UnsupportedError
from ...functions.convert import ELEMENTS

PADDING = {"nullterm": 0, "nullpad": 1, "spacepad": 2}
CHARSETS = {"ascii": 0, "utf8": 1}
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1


def _head(kind: int, bits: int, size: int, version: int = 1) -> bytes:
    return bytes([version << 4 | kind]) + bits.to_bytes(3, "little") + size.to_bytes(4, "little")


def _words(raw: np.ndarray, size: int, big: bool) -> np.ndarray:
    """Elements of one to eight bytes as unsigned 64-bit integers."""
    if not 1 <= size <= 8:
        raise UnsupportedError(f"numbers of {size} bytes")
    data = np.frombuffer(np.ascontiguousarray(raw).tobytes(), np.uint8).reshape(-1, size)
    whole = np.zeros((len(data), 8), np.uint8)
    whole[:, :size] = data[:, ::-1] if big else data
    return whole.view("<u8").reshape(-1)


def _field(words: np.ndarray, place: int, bits: int) -> np.ndarray:
    return words >> np.uint64(place) & np.uint64((1 << bits) - 1)


class Builder:
    """A type by its properties, set one by one and checked by build(). needed: those that have no default."""

    def __init__(self, kind, needed: tuple[str, ...]):
        self._kind, self._needed, self._set = kind, needed, {}

    def __getattr__(self, name: str):
        if name not in self._kind.PROPERTIES:
            raise AttributeError(name)

        def put(value) -> Builder:
            self._set[name] = value
            return self

        return put

    def build(self):
        if missing := [n for n in self._needed if n not in self._set]:
            raise TypeMismatchError(f"{', '.join(missing)} not given")
        return self._kind(**{self._kind.PROPERTIES[n]: (v == "big" if n == "byte_order" else v) for n, v in self._set.items()})


class _Number:
    """What numbers with significant bits among others have in common."""

    def _check(self) -> None:
        if not 1 <= self.size or not 1 <= self.bit_precision or self.offset < 0 or self.offset + self.bit_precision > 8 * self.size:
            raise TypeMismatchError(f"bits {self.offset} to {self.offset + self.bit_precision} of {self.size} bytes")

    @property
    def byte_order(self) -> str:
        return "big" if self.big else "little"

    @property
    def bit_offset(self) -> int:
        return self.offset

    @property
    def bit_precision(self) -> int:
        return self.precision or self.size * 8

    def with_padding(self, low: bool, high: bool):
        return replace(self, low_padding=low, high_padding=high)

    def _flags(self) -> int:
        return self.big | self.low_padding << 1 | self.high_padding << 2

    def _range(self) -> bytes:
        return self.offset.to_bytes(2, "little") + self.bit_precision.to_bytes(2, "little")


@dataclass(frozen=True)
class Fixed(_Number):
    """An integer, whose value may occupy only precision bits from offset on; padding is what the bits below and above hold."""

    size: int
    signed: bool = True
    big: bool = False
    offset: int = 0
    precision: int | None = None
    low_padding: bool = False
    high_padding: bool = False

    PROPERTIES = {"size": "size", "byte_order": "big", "signed": "signed", "bit_offset": "offset", "bit_precision": "precision", "low_padding": "low_padding", "high_padding": "high_padding"}

    def __post_init__(self):
        self._check()

    @staticmethod
    def builder() -> Builder:
        return Builder(Fixed, ("size", "byte_order", "signed", "bit_precision"))

    @property
    def layout(self) -> tuple[bool, int, int, bool, bool]:
        """signed, bit_offset, bit_precision, low_padding, high_padding."""
        return self.signed, self.offset, self.bit_precision, self.low_padding, self.high_padding

    @classmethod
    def from_layout(cls, size: int, byte_order: str, layout: tuple[bool, int, int, bool, bool]) -> Fixed:
        return cls(size, layout[0], byte_order == "big", *layout[1:])

    @property
    def element(self) -> str:
        return f"{'i' if self.signed else 'u'}{8 * next((n for n in (1, 2, 4, 8) if n >= self.size), 8)}"

    def encoded(self) -> bytes:
        return _head(0, self._flags() | self.signed << 3, self.size) + self._range()

    def dtype(self) -> np.dtype:
        return np.dtype(f"{'>' if self.big else '<'}{'i' if self.signed else 'u'}{self.size}" if self.size in (1, 2, 4, 8) else f"V{self.size}")

    def decode(self, raw: np.ndarray) -> np.ndarray:
        bits = self.bit_precision
        if bits == self.size * 8 and not self.offset and self.size in (1, 2, 4, 8):
            return raw.astype(raw.dtype.newbyteorder("="))
        word, size = _field(_words(raw, self.size, self.big), self.offset, bits), int(self.element[1:]) // 8
        if self.signed and bits < 64:
            word = np.where(word >> np.uint64(bits - 1) & np.uint64(1), word | ~np.uint64((1 << bits) - 1), word)
        return word.astype(np.uint64).view(np.int64).astype(f"i{size}") if self.signed else word.astype(f"u{size}")

    def spark(self) -> T.DataType:
        return ELEMENTS[self.element]


@dataclass(frozen=True)
class BitField(_Number):
    """Bits that are no number, read as an unsigned integer of those from offset on."""

    size: int
    big: bool = False
    offset: int = 0
    precision: int | None = None
    low_padding: bool = False
    high_padding: bool = False

    PROPERTIES = {k: v for k, v in Fixed.PROPERTIES.items() if k != "signed"}

    def __post_init__(self):
        self._check()

    @staticmethod
    def builder() -> Builder:
        return Builder(BitField, ("size", "byte_order", "bit_precision"))

    @property
    def element(self) -> str:
        return f"u{8 * next((n for n in (1, 2, 4, 8) if n >= self.size), 8)}"

    def encoded(self) -> bytes:
        return _head(4, self._flags(), self.size) + self._range()

    def dtype(self) -> np.dtype:
        return Fixed(self.size, False, self.big).dtype()

    def decode(self, raw: np.ndarray) -> np.ndarray:
        return Fixed(self.size, False, self.big, self.offset, self.precision).decode(raw)

    def spark(self) -> T.DataType:
        return ELEMENTS[self.element]


@dataclass(frozen=True)
class Time(_Number):
    """A time as an integer, of precision bits."""

    size: int
    big: bool = False
    precision: int | None = None
    offset: int = field(default=0, init=False)

    def __post_init__(self):
        self._check()

    def encoded(self) -> bytes:
        return _head(2, int(self.big), self.size) + self.bit_precision.to_bytes(2, "little")

    def dtype(self) -> np.dtype:
        return Fixed(self.size, True, self.big).dtype()

    def decode(self, raw: np.ndarray) -> np.ndarray:
        return Fixed(self.size, True, self.big, 0, self.precision).decode(raw)

    def spark(self) -> T.DataType:
        return ELEMENTS[Fixed(self.size).element]


#: Sign, exponent and mantissa (place, bits) and bias of IEEE 754 numbers by their bytes (fixed values).
IEEE = {2: (15, 10, 5, 0, 10, 15), 4: (31, 23, 8, 0, 23, 127), 8: (63, 52, 11, 0, 52, 1023)}
#: Of a mantissa's highest bit: as stored, always set, set but not stored (fixed values).
NORMALIZATION = {"none": 0, "always_set": 1, "implied": 2}


@dataclass(frozen=True)
class Float(_Number):
    """A floating-point number; by default of IEEE 754, else with a sign, an exponent and a mantissa where fields says:
    sign_location, exponent_location, exponent_size, mantissa_location, mantissa_size, exponent_bias."""

    size: int
    big: bool = False
    fields: tuple[int, ...] | None = None
    mantissa_normalization: str = "implied"
    offset: int = 0
    precision: int | None = None
    low_padding: bool = False
    high_padding: bool = False
    internal_padding: bool = False

    FIELDS = ("sign_location", "exponent_location", "exponent_size", "mantissa_location", "mantissa_size", "exponent_bias")

    def __post_init__(self):
        self._check()
        if self.fields is None and self.size not in IEEE:
            raise TypeMismatchError(f"no floating-point number of {self.size} bytes without fields")
        if self.mantissa_normalization not in NORMALIZATION:
            raise TypeMismatchError(f"no normalization {self.mantissa_normalization}")
        sign, e, n_e, m, n_m, _ = self.parts
        spans = sorted([(sign, sign + 1), (e, e + n_e), (m, m + n_m)])
        if n_e < 1 or n_m < 1 or spans[0][0] < self.offset or spans[-1][1] > self.offset + self.bit_precision or any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
            raise TypeMismatchError(f"fields {spans} of {self.size} bytes")

    @staticmethod
    def builder() -> FloatBuilder:
        return FloatBuilder()

    @classmethod
    def ieee(cls, size: int, byte_order: str = "little") -> Float:
        return cls(size, byte_order == "big")

    @property
    def parts(self) -> tuple[int, ...]:
        return self.fields or IEEE[self.size]

    def __getattr__(self, name: str):
        if name in Float.FIELDS:
            return self.parts[Float.FIELDS.index(name)]
        raise AttributeError(name)

    @property
    def layout(self) -> dict:
        """The fields, the normalization, the significant bits and the padding."""
        return dict(zip(self.FIELDS, self.parts, strict=True)) | {"mantissa_normalization": self.mantissa_normalization, "bit_offset": self.offset, "bit_precision": self.bit_precision, "low_padding": self.low_padding, "high_padding": self.high_padding, "internal_padding": self.internal_padding}

    @classmethod
    def from_layout(cls, size: int, byte_order: str, layout: dict) -> Float:
        out = cls(size, byte_order == "big", tuple(layout[f] for f in cls.FIELDS), layout["mantissa_normalization"], layout["bit_offset"], layout["bit_precision"], layout["low_padding"], layout["high_padding"], layout["internal_padding"])
        return out.plain()

    def plain(self) -> Float:
        """Without fields where they are those of IEEE 754, so that equal types are equal."""
        whole = self.bit_precision == 8 * self.size
        usual = whole and not self.offset and self.size in IEEE and self.parts == IEEE[self.size]
        return replace(self, fields=None if usual else self.fields, precision=None if whole else self.precision)

    def with_padding(self, low: bool, high: bool, internal: bool = False) -> Float:
        return replace(self, low_padding=low, high_padding=high, internal_padding=internal)

    @property
    def is_ieee(self) -> bool:
        return self.plain().fields is None and self.size in IEEE and self.mantissa_normalization == "implied"

    @property
    def element(self) -> str:
        return f"f{max(self.size, 4) * 8}" if self.is_ieee else "f64"

    def encoded(self) -> bytes:
        sign, e, n_e, m, n_m, bias = self.parts
        bits = self._flags() | self.internal_padding << 3 | NORMALIZATION[self.mantissa_normalization] << 4 | sign << 8
        return _head(1, bits, self.size) + self._range() + bytes([e, n_e, m, n_m]) + bias.to_bytes(4, "little")

    def dtype(self) -> np.dtype:
        return np.dtype(f"{'>' if self.big else '<'}f{self.size}" if self.is_ieee else f"V{self.size}")

    def decode(self, raw: np.ndarray) -> np.ndarray:
        if self.is_ieee:
            return raw.astype("f4" if self.size == 2 else raw.dtype.newbyteorder("="))
        words = _words(raw, self.size, self.big)
        sign, e, n_e, m, n_m, bias = self.parts
        exponent, mantissa = _field(words, e, n_e).astype(np.int64), _field(words, m, n_m).astype(np.float64)
        top = (1 << n_e) - 1
        if self.mantissa_normalization == "implied":
            value = np.ldexp(np.where(exponent > 0, 1.0, 0.0) + mantissa / 2.0**n_m, np.maximum(exponent, 1) - bias)
            value = np.where(exponent == top, np.where(mantissa > 0, np.nan, np.inf), value)
        else:  # all of the mantissa is stored, its highest bit before the point
            value = np.ldexp(mantissa / 2.0 ** (n_m - 1), exponent - bias)
        return np.where(_field(words, sign, 1) != 0, -value, value)

    def spark(self) -> T.DataType:
        return ELEMENTS[self.element]


class FloatBuilder(Builder):
    """As Builder, for the fields of a floating-point number; which are all needed."""

    def __init__(self):
        super().__init__(Float, ())

    def __getattr__(self, name: str):
        if name not in (*Float.FIELDS, "size", "byte_order", "mantissa_normalization", "bit_offset", "bit_precision", "low_padding", "high_padding", "internal_padding"):
            raise AttributeError(name)

        def put(value) -> FloatBuilder:
            self._set[name] = value
            return self

        return put

    def build(self) -> Float:
        needed = (*Float.FIELDS, "size", "byte_order", "mantissa_normalization", "bit_precision")
        if missing := [n for n in needed if n not in self._set]:
            raise TypeMismatchError(f"{', '.join(missing)} not given")
        layout = {"bit_offset": 0, "low_padding": False, "high_padding": False, "internal_padding": False} | self._set
        return Float.from_layout(layout["size"], layout["byte_order"], layout)


@dataclass(frozen=True)
class String:
    size: int
    padding: str = "nullpad"
    charset: str = "utf8"

    def encoded(self) -> bytes:
        return _head(3, PADDING[self.padding] | CHARSETS[self.charset] << 4, self.size)

    def dtype(self) -> np.dtype:
        return np.dtype(f"V{self.size}")

    def pack(self, text: str) -> bytes:
        data = text.encode()
        if len(data) + (self.padding == "nullterm") > self.size:
            raise TypeMismatchError(f"{text!r} is longer than {self.size} bytes")
        return data.ljust(self.size, b" " if self.padding == "spacepad" else b"\0")

    def decode(self, raw: np.ndarray) -> list[str]:
        def one(b: bytes) -> str:
            if self.padding == "nullterm":
                b = b.split(b"\0", 1)[0]
            return b.rstrip(b"\0" if self.padding == "nullpad" else b" " if self.padding == "spacepad" else b"").decode(errors="replace") if self.padding != "nullterm" else b.decode(errors="replace")

        return [one(bytes(x)) for x in raw]

    def spark(self) -> T.DataType:
        return T.StringType()


@dataclass(frozen=True)
class Opaque:
    size: int
    tag: str = ""

    def encoded(self) -> bytes:
        tag = self.tag.encode() + b"\0"
        tag += bytes(-len(tag) % 8)
        return _head(5, len(tag), self.size) + tag

    def dtype(self) -> np.dtype:
        return np.dtype(f"V{self.size}")

    def decode(self, raw: np.ndarray) -> list[bytes]:
        return [bytes(x) for x in raw]

    def spark(self) -> T.DataType:
        return T.BinaryType()


@dataclass(frozen=True)
class Reference:
    """The address of an object in the same file."""

    size: int = 8

    def encoded(self) -> bytes:
        return _head(7, 0, 8)

    def dtype(self) -> np.dtype:
        return np.dtype("<u8")

    def decode(self, raw: np.ndarray) -> np.ndarray:
        return raw.astype(np.int64)

    def spark(self) -> T.DataType:
        return T.LongType()


@dataclass(frozen=True)
class Enum:
    base: Fixed
    members: tuple[tuple[str, int], ...]

    @property
    def size(self) -> int:
        return self.base.size

    def encoded(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n, _ in self.members)
        values = np.array([v for _, v in self.members], self.base.dtype()).tobytes()
        return _head(8, len(self.members), self.size, 3) + self.base.encoded() + names + values

    def dtype(self) -> np.dtype:
        return self.base.dtype()

    def decode(self, raw: np.ndarray) -> np.ndarray:
        return self.base.decode(raw)

    def labels(self) -> dict[str, int]:
        return dict(self.members)

    def spark(self) -> T.DataType:
        return self.base.spark()


@dataclass(frozen=True)
class Compound:
    fields: tuple[tuple[str, int, object], ...]  # name, byte offset, type
    size: int

    @classmethod
    def packed(cls, **fields) -> Compound:
        out, at = [], 0
        for name, kind in fields.items():
            out.append((name, at, kind))
            at += kind.size
        return cls(tuple(out), at)

    def __post_init__(self):
        names, ends = set(), []
        for name, at, kind in self.fields:
            if name in names or at + kind.size > self.size:
                raise TypeMismatchError(f"field {name} repeats or overruns")
            names.add(name)
            ends.append((at, at + kind.size))
        ends.sort()
        if any(a[1] > b[0] for a, b in zip(ends, ends[1:], strict=False)):
            raise TypeMismatchError("fields overlap")

    def encoded(self) -> bytes:
        width = max(1, (self.size.bit_length() + 7) // 8)
        body = b"".join(n.encode() + b"\0" + at.to_bytes(width, "little") + kind.encoded() for n, at, kind in self.fields)
        return _head(6, len(self.fields), self.size, 3) + body

    def dtype(self) -> np.dtype:
        return np.dtype({"names": [f[0] for f in self.fields], "formats": [f[2].dtype() for f in self.fields], "offsets": [f[1] for f in self.fields], "itemsize": self.size})

    def decode(self, raw: np.ndarray) -> list[dict]:
        columns = {n: kind.decode(np.ascontiguousarray(raw[n])) for n, _, kind in self.fields}
        return [{n: (c[i].item() if hasattr(c[i], "item") else c[i]) for n, c in columns.items()} for i in range(len(raw))]

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(n, kind.spark()) for n, _, kind in self.fields])


@dataclass(frozen=True)
class VarString:
    """A string of any length, kept in a heap of the file."""

    charset: str = "utf8"
    size: int = field(default=16, init=False)

    def encoded(self) -> bytes:
        return _head(9, 1 | CHARSETS[self.charset] << 8, 16) + String(1, "nullterm", self.charset).encoded()

    def dtype(self) -> np.dtype:
        return np.dtype([("n", "<u4"), ("heap", "<u8"), ("index", "<u4")])

    def spark(self) -> T.DataType:
        return T.StringType()


@dataclass(frozen=True)
class Vlen:
    """A sequence of any length of one type."""

    base: object
    size: int = field(default=16, init=False)

    def encoded(self) -> bytes:
        return _head(9, 0, 16) + self.base.encoded()

    def dtype(self) -> np.dtype:
        return np.dtype([("n", "<u4"), ("heap", "<u8"), ("index", "<u4")])

    def spark(self) -> T.DataType:
        return T.ArrayType(self.base.spark())


def of_element(element: str):
    """The stored type of an element type."""
    if element not in ELEMENTS:
        raise TypeMismatchError(f"no element type {element}")
    size = int(element[1:]) // 8
    return Float(size) if element[0] == "f" else Fixed(size, element[0] == "i")


def parse(data: bytes, at: int = 0) -> tuple[object, int]:
    """A stored type and the place after it."""
    try:
        kind, version = data[at] & 15, data[at] >> 4
        bits, size = int.from_bytes(data[at + 1 : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        if kind == 0:
            offset, precision = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 4], "little")
            return Fixed(size, bool(bits >> 3 & 1), bool(bits & 1), offset, None if precision == size * 8 else precision, bool(bits >> 1 & 1), bool(bits >> 2 & 1)), at + 4
        if kind == 1:
            if bits >> 6 & 1:
                raise UnsupportedError("numbers in VAX order")
            offset, precision = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 4], "little")
            e, n_e, m, n_m = data[at + 4 : at + 8]
            fields = (bits >> 8 & 255, e, n_e, m, n_m, int.from_bytes(data[at + 8 : at + 12], "little"))
            kept = {v: k for k, v in NORMALIZATION.items()}[bits >> 4 & 3]
            return Float(size, bool(bits & 1), fields, kept, offset, precision, *(bool(bits >> i & 1) for i in (1, 2, 3))).plain(), at + 12
        if kind == 2:
            return Time(size, bool(bits & 1), int.from_bytes(data[at : at + 2], "little")), at + 2
        if kind == 3:
            return String(size, {v: k for k, v in PADDING.items()}[bits & 15], "utf8" if bits >> 4 & 15 else "ascii"), at
        if kind == 4:
            offset, precision = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 4], "little")
            return BitField(size, bool(bits & 1), offset, None if precision == size * 8 else precision, bool(bits >> 1 & 1), bool(bits >> 2 & 1)), at + 4
        if kind == 5:
            return Opaque(size, data[at : at + (bits & 255)].split(b"\0")[0].decode()), at + (bits & 255)
        if kind == 7:
            if bits & 15:
                raise UnsupportedError("region references")
            return Reference(), at
        if kind == 6:
            fields, width = [], max(1, (size.bit_length() + 7) // 8)
            for _ in range(bits & 0xFFFF):
                end = data.index(b"\0", at)
                name = data[at:end].decode()
                at = end + 1 if version >= 3 else at + (end - at) // 8 * 8 + 8
                n = width if version >= 3 else 4
                place, at = int.from_bytes(data[at : at + n], "little"), at + n
                if version == 1:
                    at += 28
                inner, at = parse(data, at)
                fields.append((name, place, inner))
            return Compound(tuple(fields), size), at
        if kind == 8:
            base, at = parse(data, at)
            names = []
            for _ in range(bits & 0xFFFF):
                end = data.index(b"\0", at)
                names.append(data[at:end].decode())
                at = end + 1 if version >= 3 else at + (end - at) // 8 * 8 + 8
            values = base.decode(np.frombuffer(data, base.dtype(), len(names), at)).tolist()
            return Enum(base, tuple(zip(names, values, strict=True))), at + len(names) * base.size
        if kind == 9:
            base, at = parse(data, at)
            return (VarString("utf8" if bits >> 8 & 15 else "ascii") if bits & 15 == 1 else Vlen(base)), at
    except (IndexError, ValueError, KeyError, TypeMismatchError) as e:
        raise FormatError(f"datatype message: {e}") from None
    raise UnsupportedError(f"datatype class {kind}")
