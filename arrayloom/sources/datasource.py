"""Spark data sources over array files: batch scan, chunk scan, catalog, stream and writer.

register(spark) makes format("h5") known. Options of a scan:

    path       the file (a local or mounted path that executors share)
    dataset    the dataset's path in it; without it the scan lists the file's objects
    mode       "elements" (i0, i1, ..., value), "chunks" (chunk, payload, mask) or "catalog"
    rowStart, rowCount   a window of leading rows, cut at the extent
    start, count         a region, comma-separated; must lie within the dataset
    partitions           how many tasks to plan at most

Filters on i0, i1, ... that compare with literals prune chunks before anything is read (pushFilters).
A partition is a band of chunks, so no chunk is decoded twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..errors import NotFoundError, SelectionError, TypeMismatchError
from ..operators.frame import ArrayFrame
from .codecs import check_pipeline, encode, placed, to_chunks
from .h5.reader import File, Object, element_of
from .h5.types import of_element, parse
from .h5.writer import Dataset, FileBuilder, Group
from .spool import RUN_BYTES, Spool

CATALOG = "path string, parent string, name string, kind string, address long, target string"
CHUNKS = "chunk array<long>, payload binary, mask int"

#: Bytes of elements that a task reads, where they are more than 64 tasks' worth.
PARTITION_BYTES = 64 << 20


@dataclass
class Band(InputPartition):
    """Chunks (start, address, size, mask) to decode, or rows first to last of an unchunked dataset."""

    chunks: list
    first: int = 0
    last: int = 0


def _arrow(values, kind, spark_type: T.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    if isinstance(values, np.ndarray) and isinstance(spark_type, T.DecimalType):
        return pa.array([None if v is None else int(v) for v in values.reshape(-1).tolist()], pa.int64() if not len(values) else pa.decimal128(20, 0)).cast(pa.decimal128(20, 0))
    if isinstance(values, np.ndarray):
        return pa.array(np.ascontiguousarray(values.reshape(-1))).cast(to_arrow_type(spark_type))
    return pa.array(values, to_arrow_type(spark_type))


def _lower(options) -> dict[str, str]:
    """Options by lower-case name, as Spark takes them in any case."""
    return {k.lower(): v for k, v in options.items()}


class H5Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "h5"

    def _open(self) -> tuple[File, Object | None]:
        file = File(self.options["path"])
        return file, file.resolve(self.options["dataset"]) if self.options.get("dataset") else None

    def schema(self):
        mode = self.options.get("mode", "elements" if self.options.get("dataset") else "catalog")
        if mode == "catalog":
            return CATALOG
        if mode == "chunks":
            return CHUNKS
        file, found = self._open()
        with file:
            if found is None or not found.is_dataset:
                raise NotFoundError("option dataset names no dataset")
            return T.StructType([*[T.StructField(f"i{d}", T.LongType()) for d in range(len(found.shape or ()))], T.StructField("value", found.kind.spark())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return H5Reader(_lower(self.options), schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return H5Stream(_lower(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return H5Writer(_lower(self.options), overwrite)


class H5Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.output = options, schema
        self.mode = options.get("mode", "elements" if options.get("dataset") else "catalog")
        self.low: dict[int, int] = {}
        self.high: dict[int, int] = {}  # inclusive

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the coordinates to read. Spark still checks every row, as chunks are read whole."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 and f.attribute[0][:1] == "i" and f.attribute[0][1:].isdigit() and isinstance(f.value, int):
                d = int(f.attribute[0][1:])
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[d] = max(self.low.get(d, 0), f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[d] = min(self.high.get(d, f.value), f.value - isinstance(f, LessThan))
            yield f

    def _bounds(self, shape: tuple[int, ...]) -> tuple[list[int], list[int]]:
        low, high = [0] * len(shape), list(shape)
        if "start" in self.options or "count" in self.options:
            start, count = ([int(x) for x in self.options[k].split(",")] for k in ("start", "count"))
            if len(start) != len(shape) or len(count) != len(shape) or any(s < 0 or c < 0 or s + c > n for s, c, n in zip(start, count, shape, strict=True)):
                raise SelectionError(f"{start}, {count} in {shape}")
            low, high = start, [s + c for s, c in zip(start, count, strict=True)]
        if shape and ("rowstart" in self.options or "rowcount" in self.options):
            first = int(self.options.get("rowstart", 0))
            low[0], high[0] = max(low[0], first), min(high[0], first + int(self.options.get("rowcount", shape[0])))
        for d in range(len(shape)):
            low[d], high[d] = max(low[d], self.low.get(d, 0)), min(high[d], self.high.get(d, shape[d]) + 1)
        return low, high

    def partitions(self) -> list[InputPartition]:
        if self.mode == "catalog":
            return [Band([])]
        with File(self.options["path"]) as file:
            found = file.resolve(self.options["dataset"])
            if found.shape is None:
                return []
            stored = found.kind.size * int(np.prod(found.shape, dtype=np.int64))
            most = int(self.options.get("partitions", max(64, -(-stored // PARTITION_BYTES))))
            low, high = self._bounds(found.shape)
            if any(a >= b for a, b in zip(low, high, strict=True)):
                return []
            name, how = file.layout(found)
            if self.mode == "chunks" and name != "chunked":
                raise TypeMismatchError("not chunked")
            if name == "chunked":
                stored = list(file.chunks(found, tuple(low), tuple(b - a for a, b in zip(low, high, strict=True))))
                if self.mode == "elements":  # chunks that were never stored read as the fill value
                    at = {c.start: c for c in stored}
                    grid = [range(a // n, -(-b // n)) for a, b, n in zip(low, high, how["chunks"], strict=True)]
                    starts = (tuple((g[i]) * n for g, i, n in zip(grid, index, how["chunks"], strict=True)) for index in np.ndindex(*map(len, grid)))
                    bands = [(s, at[s].address, at[s].size, at[s].mask) if s in at else (s, None, 0, 0) for s in starts]
                else:
                    bands = [(c.start, c.address, c.size, c.mask) for c in stored]
                step = max(1, -(-len(bands) // most))
                return [Band(bands[i : i + step]) for i in range(0, len(bands), step)]
            rows = (low[0], high[0]) if found.shape else (0, 1)
            step = max(1, -(-(rows[1] - rows[0]) // most))
            return [Band([], r, min(r + step, rows[1])) for r in range(rows[0], rows[1], step)]

    def read(self, partition: Band | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none to read
            return
        with File(self.options["path"]) as file:
            if self.mode == "catalog":
                rows = list(zip(*file.walk(), strict=True)) or [()] * 6
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(rows, kinds, strict=True)], names=self.output.names)
                return
            found = file.resolve(self.options["dataset"])
            if self.mode == "chunks":
                for start, address, size, mask in partition.chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([list(start)], pa.list_(pa.int64())), pa.array([file.bytes_at(address, size)], pa.binary()), pa.array([mask], pa.int32())], names=self.output.names)
                return
            low, high = self._bounds(found.shape)
            if not partition.chunks:
                if not found.shape:
                    yield self._batch(file, found, file.stored(found, (), ()), ())
                    return
                for first in range(partition.first, partition.last, 65_536):
                    start = (first, *low[1:])
                    count = (min(partition.last, first + 65_536) - first, *[b - a for a, b in zip(low[1:], high[1:], strict=True)])
                    yield self._batch(file, found, file.stored(found, start, count), start)
                return
            _, how = file.layout(found)
            fill = file.fill(found)
            from .h5.reader import Chunk

            for start, address, size, mask in partition.chunks:
                a = tuple(max(x, s) for x, s in zip(low, start, strict=True))
                b = tuple(min(x, s + n) for x, s, n in zip(high, start, how["chunks"], strict=True))
                if address is None:
                    block = np.zeros([y - x for x, y in zip(a, b, strict=True)], found.kind.dtype())
                    if fill is not None:
                        block[...] = fill
                else:
                    block = file.decoded(found, Chunk(tuple(start), address, size, mask))[tuple(slice(x - s, y - s) for x, y, s in zip(a, b, start, strict=True))]
                yield self._batch(file, found, block, a)

    def _batch(self, file: File, found: Object, block: np.ndarray, start: tuple[int, ...]) -> pa.RecordBatch:
        at = np.indices(block.shape).reshape(block.ndim, -1) + np.array(start, np.int64).reshape(-1, 1) if block.ndim else []
        values = file.values(found.kind, np.ascontiguousarray(block))
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in at], _arrow(values, found.kind, self.output["value"].dataType)], names=self.output.names)


class H5Stream(DataSourceStreamReader):
    """Follows a growing leading dimension. The offset is the extent, so a batch is the rows between two extents: always a prefix."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.output = options, schema

    def initialOffset(self) -> dict:
        return {"extent": int(self.options.get("rowstart", 0))}

    def latestOffset(self) -> dict:
        with File(self.options["path"]) as file:
            return {"extent": file.resolve(self.options["dataset"]).shape[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["extent"], end["extent"]
        step = int(self.options.get("rowsperpartition", 1 << 20))
        return [Band([], r, min(r + step, last)) for r in range(first, last, step)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        options = self.options | {"rowstart": str(partition.first), "rowcount": str(partition.last - partition.first)}
        reader = H5Reader(options, self.output)
        for band in reader.partitions():
            yield from reader.read(band)


@dataclass
class Part(WriterCommitMessage):
    path: str
    index: list


class H5Writer(DataSourceWriter):
    """Writes encoded chunks (chunk, payload, mask) as one dataset. Tasks store payloads beside the file; the commit joins
    them and publishes the file by one rename, so readers see all of it or nothing. Options: path, dataset, shape, chunks,
    element (or kind, the bytes of a type in hexadecimal), filters (JSON), maximum, fill, and append=true to keep the other
    objects of the file."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.token = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        path, index, at = f"{self.options['path']}.{self.token}.{uuid.uuid4().hex}.payload", [], 0
        with open(path, "wb") as out:
            for row in rows:
                payload = bytes(row["payload"])
                out.write(payload)
                index.append((tuple(row["chunk"]), at, len(payload), row["mask"]))
                at += len(payload)
        return Part(path, index)

    def commit(self, messages: list) -> None:
        o = self.options
        parts = [m for m in messages if m is not None]
        try:
            numbers = lambda k: tuple(None if x in ("", "null", "None") else int(x) for x in o[k].split(",")) if o.get(k) else None
            where = sorted((start, p.path, at, size, mask) for p in parts for start, at, size, mask in p.index)
            if len({w[0] for w in where}) != len(where):
                raise TypeMismatchError("a chunk is written twice")
            filters = [tuple(f) if not isinstance(f[1], list) else (f[0], tuple(f[1])) for f in json.loads(o.get("filters", "[]"))]

            def payloads():
                handle, name = None, None
                for start, path, at, size, mask in where:
                    if path != name:
                        if handle:
                            handle.close()
                        handle, name = open(path, "rb"), path  # noqa: SIM115
                    handle.seek(at)
                    yield start, handle.read(size), mask
                if handle:
                    handle.close()

            if os.path.exists(o["path"]) and not self.overwrite and o.get("append") != "true":
                raise TypeMismatchError(f"{o['path']} exists")
            builder = FileBuilder()
            if o.get("append") == "true" and os.path.exists(o["path"]):
                from .session import load

                builder = load(o["path"])
            kind = parse(bytes.fromhex(o["kind"]))[0] if o.get("kind") else of_element(o["element"])
            dataset = Dataset(kind, numbers("shape"), None, numbers("chunks"), numbers("maximum"), filters, json.loads(o.get("fill", "null")), encoded=payloads())
            *groups, name = [p for p in o["dataset"].split("/") if p]
            at: Group = builder
            for g in groups:
                at = at.members[g] if g in at.members else at.create_group(g)
            at.members[name] = dataset
            builder.write(o["path"])
        finally:
            for p in parts:
                if os.path.exists(p.path):
                    os.unlink(p.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.unlink(m.path)


def register(spark: SparkSession) -> None:
    """Makes format("h5") known, and lets Spark hand filters to Python sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(H5Source)


def read_frame(spark: SparkSession, path: str, dataset: str, **options) -> ArrayFrame:
    """A dataset of a file as an ArrayFrame."""
    register(spark)
    with File(path) as file:
        found = file.resolve(dataset)
        name, how = file.layout(found)
        chunks, fill = how.get("chunks"), file.fill(found)
    df = spark.read.format("h5").options(path=path, dataset=dataset, **options).load()
    return ArrayFrame(df, found.shape or (), element_of(found.kind), chunks, None if fill is None or fill.dtype.kind == "V" else fill.item())


def write_frame(frame: ArrayFrame, path: str, dataset: str, filters: list | None = None, maximum: tuple | None = None, mode: str = "overwrite", append: bool = False) -> None:
    """Encodes chunks where their elements meet and writes them as a dataset."""
    filters = filters or []
    check_pipeline(filters)
    if frame.element is None:
        raise TypeMismatchError("only numeric frames are written by chunks")
    register(frame.df.sparkSession)
    join = lambda x: ",".join("null" if v is None else str(v) for v in x)
    options = {"path": path, "dataset": dataset, "shape": join(frame.shape), "chunks": join(frame._grid_chunks()), "element": frame.element, "filters": json.dumps(filters), "fill": json.dumps(frame.fill)}
    if maximum is not None:
        options["maximum"] = join(maximum)
    if append:
        options["append"] = "true"
    to_chunks(frame, filters).write.format("h5").mode(mode).options(**options).save()


def write_spool(spark: SparkSession, elements: Spool, path: str, dataset: str, chunk: int, filters: list | None = None, maximum: tuple | None = None, rows: int | None = None) -> None:
    """Spooled elements, or the first rows of them, as a dataset of one dimension whose chunks are encoded in parallel."""
    filters, kind, n = filters or [], elements.kind, len(elements) if rows is None else min(rows, len(elements))
    check_pipeline(filters)
    register(spark)
    stages, dtype, many = placed(filters, (chunk,)), kind.dtype(), max(1, RUN_BYTES // (chunk * kind.size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()  # one after the other
            for i in range(0, len(numbers), many):
                run, made = numbers[i : i + many], []
                part = elements.read(run[0] * chunk, min(n - run[0] * chunk, len(run) * chunk))
                for k in range(len(run)):
                    block = np.zeros(chunk, dtype)
                    own = part[k * chunk : (k + 1) * chunk]
                    block[: len(own)] = own
                    made.append(encode(block.tobytes(), stages, dtype))
                yield pa.RecordBatch.from_arrays([pa.array([[r * chunk] for r in run], pa.list_(pa.int64())), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int32())], names=["chunk", "payload", "mask"])

    count = -(-n // chunk)
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-n * kind.size // PARTITION_BYTES))))
    options = {"path": path, "dataset": dataset, "shape": str(n), "chunks": str(chunk), "kind": kind.encoded().hex(), "filters": json.dumps(filters)}
    if maximum is not None:
        options["maximum"] = ",".join("null" if v is None else str(v) for v in maximum)
    spark.range(0, count, 1, tasks).mapInArrow(pack, CHUNKS).write.format("h5").mode("overwrite").options(**options).save()


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, parent, name, kind, address, target of each link of a file."""
    register(spark)
    return spark.read.format("h5").options(path=path, mode="catalog").load()


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """owner, name, type_name, is_scalar, number, text of each attribute of a file's objects; only headers are read."""
    rows = []
    with File(path) as file:
        owners = {file.root: "/"}
        for where, _, _, _, address, _ in file.walk():
            if address is not None:
                owners.setdefault(address, where)
        for address, owner in owners.items():
            for name, value in file.attributes(file.object(address)).items():
                x = np.asarray(value)
                number = float(value) if x.ndim == 0 and x.dtype.kind in "iufb" else None
                kind = file.attribute_type(address, name)
                rows.append((owner, name, kind, value is not None and x.ndim == 0, number, value if isinstance(value, str) else None))
    return spark.createDataFrame(rows, "owner string, name string, type_name string, is_scalar boolean, number double, text string")
