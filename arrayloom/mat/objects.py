"""MATLAB's objects: string arrays, datetimes, durations, categoricals, tables, timetables, maps, enumerations.

An object's variable holds a mark, its dimensions, the numbers of its objects and of its class; what the
objects hold is kept for all of a file in #subsystem#/MCOS: a block of bytes that lists names, classes,
objects and their properties, an empty cell, and the properties' values. Classes that are not known here
come as Opaque, with all their properties.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError, TypeMismatchError
from ..sources.h5.types import of_element
from ..sources.spool import Spool, spool, stored

#: The first word of an object's variable, the attribute's value that marks objects, the layouts' versions, the length of a missing
#: string, the cells before the values, the words of a class, an object and a property, and the kinds of a property (fixed values).
MARK, OPAQUE, WRAPPER_VERSION, STRING_VERSION, MISSING = 0xDD000000, 3, 4, 1, (1 << 64) - 1
RESERVED, CLASS_WORDS, OBJECT_WORDS, PROPERTY_WORDS, OFFSETS = 2, 4, 6, 3, 8
NAMED, STORED, INLINE = 0, 1, 2


def flat(value) -> np.ndarray:
    """Elements in MATLAB's order, down the columns."""
    return np.asarray(value).reshape(-1, order="F")


def floats(value):
    """Numbers as an array of doubles; spooled ones stay where they are."""
    return value if isinstance(value, Spool) else np.asarray(value, float)


def texts(value) -> list[str]:
    """The strings of a property, which may come as one text, a list of them, or nothing."""
    if isinstance(value, Strings):
        return [v or "" for v in value.values]
    return [value] if isinstance(value, str) and value else [str(v) for v in value] if isinstance(value, list | tuple) else []


@dataclass
class Strings:
    """A string array; None is a missing string."""

    values: list[str | None]
    dims: tuple[int, ...] | None = None

    matlab_class = "string"

    def words(self) -> np.ndarray:
        coded = [b"" if v is None else v.encode("utf-16-le", errors="surrogatepass") for v in self.values]
        dims = self.dims or (len(self.values), 1)
        head = [STRING_VERSION, len(dims), *dims, *(MISSING if v is None else len(c) // 2 for v, c in zip(self.values, coded, strict=True))]
        body = b"".join(coded)
        return np.concatenate((np.array(head, "<u8"), np.frombuffer(body + bytes(-len(body) % 8), "<u8")))

    @classmethod
    def of_words(cls, words: np.ndarray) -> Strings:
        words = flat(words).astype("<u8")
        if len(words) < 2 or words[0] != STRING_VERSION:
            raise FormatError("not a string array's words")
        rank = int(words[1])
        dims = tuple(int(x) for x in words[2 : 2 + rank])
        n = prod(dims)
        lengths = words[2 + rank : 2 + rank + n].tolist()
        if len(lengths) != n:
            raise FormatError("a string array that ends early")
        body, at, out = words[2 + rank + n :].tobytes(), 0, []
        for length in lengths:
            if length == MISSING:
                out.append(None)
                continue
            if at + 2 * length > len(body):
                raise FormatError("a string array that ends early")
            out.append(body[at : at + 2 * length].decode("utf-16-le", errors="surrogatepass"))
            at += 2 * length
        return cls(out, dims)

    def properties(self) -> dict:
        return {"any": self.words()}


class SpooledStrings(Strings):
    """A column of strings to write: their lengths in words, MISSING for those that are, and their words, both spooled."""

    def __init__(self, lengths: Spool, body: Spool):
        super().__init__([], (len(lengths), 1))
        self.lengths, self.body = lengths, body

    def drop(self) -> None:
        self.lengths.drop()
        self.body.drop()

    def words(self) -> Spool:
        head = np.array([STRING_VERSION, 2, *self.dims], "<u8").tobytes()
        return Spool(of_element("u64"), [head, *self.lengths.sources, *self.body.sources, bytes(-self.body.nbytes % 8)])


def spooled(df: DataFrame, key: str, folder: str, texts: str, /, **columns) -> dict:
    """Columns as spool_elements takes them, and strings, in the order of key."""
    kinds, word = {n: kind for n, (kind, _) in columns.items()}, of_element("u8")

    def pack(batch: pa.RecordBatch) -> dict[str, bytes]:
        out = {n: stored(c, kind).tobytes() for (n, kind), c in zip(kinds.items(), batch.columns[2:], strict=True)}
        return out | dict(zip((" lengths", " body"), coded(batch.column(1)), strict=True))

    chosen = [F.col(key).alias("key"), F.col(texts).alias("text"), *[c.alias(f"v{i}") for i, (_, c) in enumerate(columns.values())]]
    found = spool(df.select(*chosen), "key", folder, pack, kinds | {" lengths": of_element("u64"), " body": word})
    return {n: found[n] for n in columns} | {texts: SpooledStrings(found[" lengths"], found[" body"])}


def coded(column: pa.Array) -> tuple[bytes, bytes]:
    """The lengths and the words of strings, as they are stored."""
    made = [None if v is None else v.encode("utf-16-le", errors="surrogatepass") for v in column.to_pylist()]
    return np.array([MISSING if v is None else len(v) // 2 for v in made], "<u8").tobytes(), b"".join(v or b"" for v in made)


@dataclass
class Datetime:
    """Times as milliseconds since 1970 UTC and the rest below them; spooled, as records of both."""

    millis: np.ndarray
    sub_ms: np.ndarray | None = None
    tz: str = ""
    fmt: str = ""

    matlab_class = "datetime"

    def nanoseconds(self) -> np.ndarray:
        millis = np.asarray(self.millis, float)
        return (millis + (0 if self.sub_ms is None else np.asarray(self.sub_ms, float))) * 1e6

    def properties(self) -> dict:
        if isinstance(self.millis, Spool):
            return {"data": self.millis, "tz": self.tz, "fmt": self.fmt}
        millis = np.asarray(self.millis, float)
        return {"data": millis + 1j * (np.zeros_like(millis) if self.sub_ms is None else np.asarray(self.sub_ms, float)), "tz": self.tz, "fmt": self.fmt}


@dataclass
class Duration:
    millis: np.ndarray
    fmt: str = ""

    matlab_class = "duration"

    def seconds(self) -> np.ndarray:
        return np.asarray(self.millis, float) / 1000

    def properties(self) -> dict:
        return {"millis": floats(self.millis), "fmt": self.fmt}


@dataclass
class Categorical:
    """1-based codes into categories; 0 is undefined."""

    codes: np.ndarray
    categories: list[str]
    is_ordinal: bool = False
    is_protected: bool = False

    matlab_class = "categorical"

    def labels(self) -> list[str | None]:
        out = []
        for code in flat(self.codes).tolist():
            if not 0 <= code <= len(self.categories):
                raise FormatError(f"no category {code}")
            out.append(self.categories[int(code) - 1] if code else None)
        return out

    def properties(self) -> dict:
        width = "u1" if len(self.categories) < 256 else "u4"
        if isinstance(self.codes, Spool) and self.codes.kind.dtype() != np.dtype(width):
            raise TypeMismatchError(f"codes of {len(self.categories)} categories are {width}")
        return {"codes": self.codes if isinstance(self.codes, Spool) else np.asarray(self.codes).astype(width), "categoryNames": list(self.categories), "isOrdinal": bool(self.is_ordinal), "isProtected": bool(self.is_protected)}


@dataclass
class Table:
    """Variables of equal length by name."""

    data: dict[str, object]
    row_names: list[str] = field(default_factory=list)
    num_rows: int | None = None

    matlab_class = "table"

    def __post_init__(self):
        if self.num_rows is None:
            self.num_rows = max(map(_length, self.data.values()), default=0)
        for name, column in self.data.items():
            if _length(column) != self.num_rows:
                raise TypeMismatchError(f"{name} has {_length(column)} rows, not {self.num_rows}")

    @property
    def num_variables(self) -> int:
        return len(self.data)

    @property
    def variable_names(self) -> list[str]:
        return list(self.data)

    def columns(self):
        return self.data.items()

    def column(self, name: str):
        return self.data[name]

    def properties(self) -> dict:
        names = list(self.data)
        return {"data": list(self.data.values()), "ndims": 2.0, "nrows": float(self.num_rows), "rownames": list(self.row_names), "nvars": float(len(names)), "varnames": names, "props": {}}

    def arrow(self) -> pa.Table:
        rows = {"row_number": pa.array(range(self.num_rows), pa.int64())}
        if self.row_names:
            rows["row_name"] = pa.array(self.row_names, pa.string())
        return pa.table(rows | {name: _arrow(column) for name, column in self.data.items()})

    def frame(self, spark: SparkSession) -> DataFrame:
        """row_number, row_name if there are any, and the variables: times as nanoseconds, durations as seconds, categoricals as labels."""
        return spark.createDataFrame(self.arrow())


@dataclass
class Timetable(Table):
    """A table with a time for each row: a Datetime or Duration, or origin and step or rate of a regular one."""

    row_times: object = None

    matlab_class = "timetable"

    def times(self) -> Datetime | Duration:
        return expanded(self.row_times, self.num_rows)

    def properties(self) -> dict:
        names = list(self.data)
        return {"any": {"data": list(self.data.values()), "numDims": 2.0, "numRows": float(self.num_rows), "numVars": float(len(names)), "varNames": names, "rowTimes": self.row_times}}

    def arrow(self) -> pa.Table:
        times, whole = self.times(), super().arrow()
        name, values = ("row_time_ns", times.nanoseconds()) if isinstance(times, Datetime) else ("row_time_ms", np.asarray(times.millis, float))
        return whole.add_column(1, name, pa.array(flat(values)))


@dataclass
class Enumeration:
    class_name: str
    names: list[str]

    def __len__(self) -> int:
        return len(self.names)


@dataclass
class Opaque:
    """An object of a class not known here."""

    class_name: str
    values: dict[str, object]

    @property
    def matlab_class(self) -> str:
        return self.class_name

    def properties(self) -> dict:
        return self.values


@dataclass
class Map:
    """containers.Map: a dict with keys of text or numbers."""

    items: dict

    matlab_class = "containers.Map"

    def properties(self) -> dict:
        keys, values = list(self.items), list(self.items.values())
        number = all(isinstance(v, int | float) and not isinstance(v, bool) for v in values)
        kind = "char" if all(isinstance(k, str) for k in keys) else "double"
        return {"serialization": {"keys": keys, "values": [float(v) for v in values] if number else values, "uniformity": float(number), "keyType": kind, "valueType": "double" if number else "any"}}


KNOWN = (Strings, Datetime, Duration, Categorical, Table, Timetable, Map, Opaque)


def _length(column) -> int:
    if isinstance(column, Spool):
        return len(column)
    if isinstance(column, Strings):
        return (column.dims or (len(column.values),))[0]
    if isinstance(column, Datetime | Duration):
        return _length(column.millis)
    if isinstance(column, Categorical):
        return _length(column.codes)
    if isinstance(column, list | tuple):
        return len(column)
    x = np.asarray(column)
    return x.shape[0] if x.ndim else 1


def _arrow(column) -> pa.Array:
    if isinstance(column, Strings):
        return pa.array(column.values, pa.string())
    if isinstance(column, Datetime):
        return pa.array(flat(column.nanoseconds()))
    if isinstance(column, Duration):
        return pa.array(flat(column.seconds()))
    if isinstance(column, Categorical):
        return pa.array(column.labels(), pa.string())
    if isinstance(column, list):
        return pa.array(column)
    x = np.asarray(column)
    return pa.array(x.tolist()) if x.ndim == 2 and x.shape[1] > 1 else pa.array(flat(x))


def expanded(times, n: int, first: int = 0) -> Datetime | Duration:
    """A time for each of n rows from the first on, of a regular timetable from where it begins and its rate or step."""
    if isinstance(times, Datetime | Duration):
        return times
    if not isinstance(times, dict) or "origin" not in times:
        raise FormatError("row times of no known form")
    if times.get("specifiedAsRate"):
        offsets = np.arange(first, first + n) * 1000 / float(flat(times["sampleRate"])[0])
    elif isinstance(times.get("stepSize"), Duration):
        offsets = np.arange(first, first + n) * float(flat(times["stepSize"].millis)[0])
    else:
        raise FormatError("a step that is no duration")
    origin = times["origin"]
    start = float(flat(origin.millis)[0])
    if isinstance(origin, Duration):
        return Duration(start + offsets, origin.fmt)
    low = 0.0 if origin.sub_ms is None else float(flat(origin.sub_ms)[0])
    whole = start + offsets
    # What the sum's rounding lost goes below the milliseconds.
    lost = (start - (whole - (whole - start))) + (offsets - (whole - start))
    return Datetime(whole, lost + low, origin.tz, origin.fmt)


def made(name: str, values: dict) -> object:
    """An object of a class from its properties."""
    if name == "string":
        words = values.get("any", next(iter(values.values()), None))
        return Strings([], (0, 0)) if words is None else Strings.of_words(words)
    if name == "datetime" and "data" in values:
        data = np.asarray(values["data"])
        return Datetime(data.real, data.imag if data.dtype.kind == "c" else np.zeros(data.shape), _text(values.get("tz", values.get("tmz"))), _text(values.get("fmt")))
    if name == "duration" and "millis" in values:
        return Duration(np.asarray(values["millis"], float), _text(values.get("fmt")))
    if name == "categorical" and "codes" in values:
        return Categorical(np.asarray(values["codes"]), texts(values.get("categoryNames", values.get("categories"))), bool(values.get("isOrdinal", False)), bool(values.get("isProtected", False)))
    if name in ("table", "timetable"):
        inside = values["any"] if isinstance(values.get("any"), dict) else values
        columns = inside.get("data", [])
        columns = columns if isinstance(columns, list) else [columns]
        names = texts(inside.get("varNames", inside.get("varnames")))
        if len(names) != len(columns):
            raise FormatError("a table's names and variables differ in number")
        n = inside.get("numRows", inside.get("nrows"))
        n = int(flat(n)[0]) if n is not None and np.size(n) else None
        data = dict(zip(names, columns, strict=True))
        return Table(data, texts(inside.get("rownames")), n) if name == "table" else Timetable(data, [], n, inside.get("rowTimes"))
    if name == "containers.Map" and isinstance(values.get("serialization"), dict):
        inside = values["serialization"]
        keys, held = inside.get("keys", []), inside.get("values", [])
        keys = [keys] if isinstance(keys, str) else keys if isinstance(keys, list) else flat(keys).tolist()
        held = held if isinstance(held, list) else [held] if isinstance(held, str) else flat(held).tolist()
        keys = [k if isinstance(k, str) else int(k) if float(k).is_integer() else float(k) for k in keys]
        if len(keys) == len(held) and len(set(map(str, keys))) == len(keys):
            return dict(zip(map(str, keys), held, strict=True))
    return Opaque(name, values)


def _text(value) -> str:
    return value if isinstance(value, str) else ""


# ---- reading


class Store:
    """What a file keeps of its objects."""

    def __init__(self, cells: list[int], blob: bytes):
        self.cells = cells
        words = np.frombuffer(blob, "<u4", len(blob) // 4)
        if len(words) < 2 + OFFSETS or not 2 <= words[0] <= WRAPPER_VERSION:
            raise FormatError("no list of objects")
        ends = words[2 : 2 + OFFSETS].tolist()
        edges = [4 * (2 + OFFSETS), *ends[:5], max(ends[4], ends[5])]
        if any(a > b for a, b in zip(edges, edges[1:], strict=False)) or edges[-1] > len(blob):
            raise FormatError("a list of objects whose parts overlap")
        region = [blob[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        self.names = region[0].split(b"\0")[: int(words[1])]
        if len(self.names) < words[1]:
            raise FormatError("names that end early")
        self.classes, self.objects = self._records(region[1], CLASS_WORDS), self._records(region[3], OBJECT_WORDS)
        self.saved, self.normal = self._blocks(region[2]), self._blocks(region[4])

    @staticmethod
    def _records(data: bytes, n: int) -> list[list[int]]:
        return np.frombuffer(data, "<u4", len(data) // (4 * n) * n).reshape(-1, n).tolist()

    def _blocks(self, data: bytes) -> list[list[list[int]]]:
        words, at, out = np.frombuffer(data, "<u4", len(data) // 4).tolist(), 0, []
        while at < len(words):
            n = words[at]
            end = at + 1 + PROPERTY_WORDS * n
            if end > len(words):
                raise FormatError("properties that end early")
            out.append([words[i : i + PROPERTY_WORDS] for i in range(at + 1, end, PROPERTY_WORDS)])
            at = end + end % 2
        return out

    def name(self, number: int) -> str:
        if number > len(self.names):
            raise FormatError(f"no name {number}")
        return self.names[number - 1].decode() if number else ""

    def class_name(self, number: int) -> str:
        if not 0 < number < len(self.classes):
            raise FormatError(f"no class {number}")
        space, own = self.classes[number][:2]
        return ".".join(x for x in (self.name(space), self.name(own)) if x)

    def object(self, number: int, decode, make=None) -> object:
        if not 0 < number < len(self.objects):
            raise FormatError(f"no object {number}")
        kind, _, _, saved, normal, _ = self.objects[number]
        blocks, at = (self.normal, normal) if normal else (self.saved, saved)
        if at >= len(blocks) and at:
            raise FormatError(f"no properties {at}")
        values = {}
        for name, how, value in blocks[at] if at else []:
            if how == STORED:
                if RESERVED + value >= len(self.cells):
                    raise FormatError(f"no value {value}")
                values[self.name(name)] = decode(self.cells[RESERVED + value])
            elif how in (NAMED, INLINE):
                values[self.name(name)] = self.name(value) if how == NAMED else bool(value) if value < 2 else value
            else:
                raise FormatError(f"a property of kind {how}")
        return (make or made)(self.class_name(kind), values)

    def of(self, words: np.ndarray, decode, make=None) -> object:
        """The object, or list of them, that a variable's words name."""
        words = words.reshape(-1).tolist()
        if len(words) < 3 or words[0] != MARK:
            raise FormatError("no object")
        rank = words[1]
        n = prod(words[2 : 2 + rank])
        ids = words[2 + rank : 2 + rank + n]
        if len(words) < 3 + rank + n:
            raise FormatError("an object's words end early")
        found = [self.object(i, decode, make) for i in ids]
        return found[0] if n == 1 else found

    def enumeration(self, number: int, value_names: list[int], indices: list[int]) -> Enumeration:
        pool = [self.name(i) for i in value_names]
        if any(i >= len(pool) for i in indices):
            raise FormatError("no such member of an enumeration")
        return Enumeration(self.class_name(number), [pool[i] for i in indices])


# ---- writing


class Interned:
    """The objects of a file to be. put(value) writes a property's value and returns what refers to it."""

    def __init__(self, put):
        self.put, self.names, self.classes, self.objects, self.blocks, self.cells = put, [], [], [], [[], []], []

    def _name(self, name: str) -> int:
        if name not in self.names:
            self.names.append(name)
        return self.names.index(name) + 1

    def add(self, value) -> np.ndarray:
        """The words of a variable that holds value."""
        name = value.matlab_class
        space, _, own = name.rpartition(".")
        entry = (self._name(space) if space else 0, self._name(own))
        if entry not in self.classes:
            self.classes.append(entry)
        kind = self.classes.index(entry) + 1
        self.objects.append([])
        number, saved = len(self.objects), isinstance(value, Strings)
        properties = []
        for key, held in value.properties().items():
            if isinstance(held, bool):
                properties.append((self._name(key), INLINE, int(held)))
                continue
            at = len(self.cells)
            self.cells.append(None)
            self.cells[at] = self.put(held)
            properties.append((self._name(key), STORED, at))
        side = self.blocks[not saved]
        side.append(properties)
        self.objects[number - 1] = [kind, 0, 0, len(side) if saved else 0, 0 if saved else len(side), number]
        return np.array([MARK, 2, 1, 1, number, kind], "<u4")

    def blob(self) -> bytes:
        u4 = lambda xs: np.array(xs, "<u4").tobytes()
        block = lambda ps: u4([len(ps), *(x for p in ps for x in p)]) + bytes(4 * ((1 + PROPERTY_WORDS * len(ps)) % 2))
        names = b"".join(n.encode() + b"\0" for n in self.names)
        parts = [
            names + bytes(-len(names) % 8),
            u4([0] * CLASS_WORDS + [x for space, own in self.classes for x in (space, own, 0, 0)]),
            bytes(8) + b"".join(map(block, self.blocks[0])),
            u4([0] * OBJECT_WORDS + [x for o in self.objects for x in o]),
            bytes(8) + b"".join(map(block, self.blocks[1])),
            bytes(8 * (len(self.objects) + 1)),
        ]
        ends = np.cumsum([4 * (2 + OFFSETS), *map(len, parts)]).tolist()[1:]
        return u4([WRAPPER_VERSION, len(self.names), *ends, ends[-1], ends[-1]]) + b"".join(parts)
