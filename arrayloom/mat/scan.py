"""Tables of MATLAB files in parallel: their columns' datasets are read in runs of rows where the DataFrame is used.

The driver reads headers, names and other small values, and of string arrays the lengths, a run at a time, to know where
each task's text begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from ..sources.h5 import Compound, File
from . import objects as mo
from . import values as mv

#: Rows of a task, of which it reads so many at once.
TASK_ROWS, RUN_ROWS = 1 << 19, 1 << 16


@dataclass(frozen=True)
class Later:
    """A dataset whose rows are its last dimension."""

    address: int
    shape: tuple[int, ...]
    logical: bool

    def __len__(self) -> int:
        return self.shape[-1]

    def rows(self, file: File, first: int, count: int) -> np.ndarray:
        found = file.object(self.address)
        stored = file.stored(found, (0, first), (self.shape[0], count))
        if isinstance(found.kind, Compound):
            return np.ascontiguousarray((stored["real"] + 1j * stored["imag"]).T)
        values = np.asarray(file.values(found.kind, np.ascontiguousarray(stored))).reshape(stored.shape).T
        return values.astype(bool) if self.logical else np.ascontiguousarray(values)


@dataclass(frozen=True)
class Object:
    """An object of a class, one of whose properties has its rows."""

    name: str
    values: dict
    key: str

    def __len__(self) -> int:
        return len(self.values[self.key])

    def rows(self, file: File, first: int, count: int) -> object:
        return mo.made(self.name, self.values | {self.key: self.values[self.key].rows(file, first, count)})


@dataclass(frozen=True)
class Text:
    """A column of strings: words that begin with dimensions and lengths. starts: where the text of each task's rows begins, in units."""

    words: Later
    n: int
    starts: tuple[int, ...] = ()

    HEAD = 4

    def __len__(self) -> int:
        return self.n

    def lengths(self, file: File, first: int, count: int) -> np.ndarray:
        return self.words.rows(file, self.HEAD + first, count).reshape(-1)

    @staticmethod
    def units(lengths: np.ndarray) -> int:
        return int(lengths[lengths != mo.MISSING].sum())

    def placed(self, file: File, task_rows: int, run_rows: int) -> Text:
        """With starts, for which all lengths are read."""
        starts, at = [], 0
        for first in range(0, self.n, run_rows):
            if first % task_rows == 0:
                starts.append(at)
            at += self.units(self.lengths(file, first, min(run_rows, self.n - first)))
        return Text(self.words, self.n, tuple(starts))

    def text(self, file: File, lengths: np.ndarray, at: int) -> mo.Strings:
        """Strings of lengths whose text begins at a unit."""
        base, n = 8 * (self.HEAD + self.n), self.units(lengths)
        low, high = (base + 2 * at) // 8, -(-(base + 2 * (at + n)) // 8)
        body = self.words.rows(file, low, high - low).tobytes()[base + 2 * at - 8 * low :] if n else b""
        out, place = [], 0
        for length in lengths.tolist():
            if length == mo.MISSING:
                out.append(None)
                continue
            out.append(body[place : place + 2 * length].decode("utf-16-le", errors="surrogatepass"))
            place += 2 * length
        return mo.Strings(out, (len(out), 1))



#: Of the classes whose rows are those of a property, which one.
KEYS = {"datetime": "data", "duration": "millis", "categorical": "codes"}


def _outline(file: File, address: int):
    """A value as mv._decode gives it, but for datasets of elements, which are left where they are."""
    found = file.object(address)
    attrs = file.attributes(found)
    if attrs.get("MATLAB_object_decode") == mo.OPAQUE and found.is_dataset:
        return mv._store(file).of(file.stored(found, (0,) * len(found.shape), found.shape), lambda a: _outline(file, a), lambda name, values: _object(file, name, values))
    kind = mv._class_of(attrs, found)
    if found.is_dataset and kind == "cell" and not attrs.get("MATLAB_empty"):
        return [_outline(file, a) for a in mv._references(file, found)]
    if found.is_group and kind == "struct":
        links = file.links(found)
        if not any(isinstance(t, str) or file.object(t).is_dataset and "MATLAB_class" not in file.attributes(file.object(t)) for t in links.values()):
            return {n: _outline(file, links[n]) for n in links}
    if found.is_dataset and len(found.shape) == 2 and not attrs.get("MATLAB_empty") and (kind in mv.CLASSES or kind == "logical") and not (isinstance(found.kind, Compound) and found.kind.dtype()["real"].kind != "f"):
        return Later(address, tuple(found.shape), kind == "logical")
    return mv._decode(file, address)


def _forced(file: File, value):
    if isinstance(value, Later):
        return mv._decode(file, value.address)
    if isinstance(value, Object):
        return mo.made(value.name, {k: _forced(file, v) for k, v in value.values.items()})
    if isinstance(value, Text):
        return mo.Strings.of_words(mv._decode(file, value.words.address))
    if isinstance(value, dict):
        return {k: _forced(file, v) for k, v in value.items()}
    return [_forced(file, v) for v in value] if isinstance(value, list) else value


def _object(file: File, name: str, values: dict):
    key = KEYS.get(name)
    if isinstance(values.get(key), Later):
        return Object(name, {k: v if k == key else _forced(file, v) for k, v in values.items()}, key)
    words = values.get("any")
    if name == "string" and isinstance(words, Later) and words.shape[0] == 1 and len(words) >= Text.HEAD:
        version, rank, n, wide = (int(x) for x in words.rows(file, 0, Text.HEAD).reshape(-1))
        if version == mo.STRING_VERSION and rank == 2 and wide == 1 and n + Text.HEAD <= len(words):
            return Text(words, n)
    if name in ("table", "timetable"):
        return name, values["any"] if isinstance(values.get("any"), dict) else values
    return mo.made(name, {k: _forced(file, v) for k, v in values.items()})


@dataclass(frozen=True)
class Plan:
    """A table whose columns, and row times, are Later, Object or Text; times of a regular timetable are its own."""

    path: str
    columns: dict
    n: int
    timed: bool = False
    times: object = None
    task_rows: int = TASK_ROWS
    run_rows: int = RUN_ROWS

    def run(self, file: File, first: int, count: int, at: dict) -> pa.Table:
        """Rows from first on. at: where the text of string columns stands, which is moved on."""
        part = {}
        for name, column in self.columns.items():
            if isinstance(column, Text):
                lengths = column.lengths(file, first, count)
                part[name] = column.text(file, lengths, at[name])
                at[name] += column.units(lengths)
            else:
                part[name] = column.rows(file, first, count)
        if self.timed:
            times = self.times.rows(file, first, count) if isinstance(self.times, Object) else mo.expanded(self.times, count, first)
            made = mo.Timetable(part, [], count, times).arrow()
        else:
            made = mo.Table(part, [], count).arrow()
        return made.set_column(0, "row_number", pa.array(np.arange(first, first + count)))

    def task(self, number: int) -> Iterator[pa.RecordBatch]:
        at = {name: c.starts[number] for name, c in self.columns.items() if isinstance(c, Text)}
        with File(self.path) as file:
            for first in range(number * self.task_rows, min(self.n, (number + 1) * self.task_rows), self.run_rows):
                yield from self.run(file, first, min(self.run_rows, self.n - first), at).combine_chunks().to_batches()


def _plan(path: str, name: str, task_rows: int, run_rows: int) -> Plan | None:
    with File(path) as file:
        address = file.links(file.object(file.root))[name]
        found = _outline(file, address) if file.object(address).is_dataset else None
        if not isinstance(found, tuple):
            return None
        kind, inside = found
        columns = inside.get("data", [])
        columns = columns if isinstance(columns, list) else [columns]
        names = mo.texts(_forced(file, inside.get("varNames", inside.get("varnames"))))
        n = _forced(file, inside.get("numRows", inside.get("nrows")))
        n = int(mo.flat(n)[0]) if n is not None and np.size(n) else None
        times = inside.get("rowTimes") if kind == "timetable" else None
        if isinstance(times, dict):
            times = _forced(file, times)
        if not n or not columns or len(names) != len(columns) or mo.texts(_forced(file, inside.get("rownames"))):
            return None
        if kind == "timetable" and not isinstance(times, Object | dict) or isinstance(times, Object) and len(times) != n:
            return None
        if any(not isinstance(c, Later | Object | Text) or len(c) != n for c in columns):
            return None
        columns = {k: c.placed(file, task_rows, run_rows) if isinstance(c, Text) else c for k, c in zip(names, columns, strict=True)}
        return Plan(path, columns, n, kind == "timetable", times, task_rows, run_rows)


def table(spark: SparkSession, path: str, name: str, task_rows: int = TASK_ROWS, run_rows: int = RUN_ROWS) -> DataFrame | None:
    """The rows of a table or timetable of vectors; None of what else there is, and of tables without rows. task_rows is a multiple of run_rows."""
    plan = _plan(path, name, task_rows, run_rows)
    if plan is None:
        return None
    with File(path) as file:
        first = plan.run(file, 0, 1, {k: 0 for k in plan.columns})
    schema = from_arrow_schema(first.schema)
    tasks = -(-plan.n // task_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from plan.task(number)

    return spark.range(0, tasks, 1, tasks).mapInArrow(read, schema)
