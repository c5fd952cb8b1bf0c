"""An N-dimensional dataset as a DataFrame of coordinates i0, i1, ... and a value.

Order is never implied: coordinates say where an element is. Selections are ranges of coordinates, which
Catalyst pushes to the scan; nothing here sorts or collects. A selection keeps the coordinates of its
dataset and remembers where it begins (origin), so selections compose: starts count from there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SelectionError, TypeMismatchError, UnsupportedError
from ..functions.convert import ELEMENTS, convert


#: A patch of up to so many elements is broadcast.
PATCH_ROWS = 100_000


@dataclass(frozen=True)
class ArrayFrame:
    df: DataFrame
    shape: tuple[int, ...]
    element: str | None = None  # None: strings, structs and other values that don't convert
    chunks: tuple[int, ...] | None = None
    fill: object = None
    value: str = "value"
    origin: tuple[int, ...] | None = None  # the coordinates of the first place; zeros where not given

    def __post_init__(self):
        if self.origin is None:
            object.__setattr__(self, "origin", (0,) * len(self.shape))
        missing = {*self.coords, self.value} - set(self.df.columns)
        if missing:
            raise TypeMismatchError(f"columns {sorted(missing)} are missing")
        if self.chunks is not None and (len(self.chunks) != self.rank or min(self.chunks, default=1) < 1):
            raise TypeMismatchError(f"chunks {self.chunks} don't fit {self.shape}")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def coords(self) -> list[str]:
        return [f"i{d}" for d in range(self.rank)]

    @property
    def n_elements(self) -> int:
        return prod(self.shape)

    def _with(self, df: DataFrame, **changed) -> ArrayFrame:
        return replace(self, df=df, **changed)

    # ---- selections

    def rows(self, start: int, count: int) -> ArrayFrame:
        """A window of leading rows; beyond the extent it is cut, and may be empty. Coordinates stay those of the dataset."""
        if not self.rank:
            raise SelectionError("a scalar has no rows")
        if start < 0 or count < 0:
            raise SelectionError(f"rows {start}, {count}")
        count, first = max(0, min(count, self.shape[0] - start)), self.origin[0] + start
        return self._with(self.df.filter((F.col("i0") >= first) & (F.col("i0") < first + count)), shape=(count, *self.shape[1:]), origin=(first, *self.origin[1:]))

    def region(self, start: tuple[int, ...], count: tuple[int, ...]) -> ArrayFrame:
        """A hyper-rectangle, which must lie within the dataset."""
        if len(start) != self.rank or len(count) != self.rank:
            raise SelectionError(f"rank {self.rank} needs as many starts and counts")
        for d, (s, n) in enumerate(zip(start, count, strict=True)):
            if s < 0 or n < 0 or s + n > self.shape[d]:
                raise SelectionError(f"dimension {d}: {s}, {n} is outside {self.shape[d]}")
        cut = self._with(self.df, shape=tuple(count), origin=tuple(o + s for o, s in zip(self.origin, start, strict=True)))
        return cut._with(self.df.filter(cut.inside()))

    def inside(self) -> Column:
        """Whether a row's coordinates are places of this frame."""
        within = F.lit(True)
        for c, o, n in zip(self.coords, self.origin, self.shape, strict=True):
            within &= (F.col(c) >= o) & (F.col(c) < o + n)
        return within

    def rebased(self) -> ArrayFrame:
        """With coordinates that count from 0."""
        if not any(self.origin):
            return self
        moved = {c: (F.col(c) - o).cast(self.df.schema[c].dataType) for c, o in zip(self.coords, self.origin, strict=True) if o}
        return self._with(self.df.withColumns(moved), origin=(0,) * self.rank)

    def strided(self, *_args, **_kwargs) -> ArrayFrame:
        raise UnsupportedError("only unit strides are read")

    # ---- values

    def as_(self, element: str) -> ArrayFrame:
        """Converted by the exact saturating rules."""
        if self.element is None:
            raise TypeMismatchError("these values don't convert")
        return self._with(self.df.withColumn(self.value, convert(F.col(self.value), self.element, element)), element=element)

    def transpose(self) -> ArrayFrame:
        """Dimensions reversed, as between row-major and column-major."""
        back = self.df.select(*[F.col(f"i{self.rank - 1 - d}").alias(f"i{d}") for d in range(self.rank)], *[c for c in self.df.columns if c not in self.coords])
        return self._with(back, shape=self.shape[::-1], chunks=self.chunks[::-1] if self.chunks else None, origin=self.origin[::-1])

    def nested(self) -> DataFrame:
        """One row for each place of all but the last dimension that has an element: an array along the last, with null where one is absent."""
        keys, last, n, first = self.coords[:-1], self.coords[-1], self.shape[-1], self.origin[-1]
        pairs = F.sort_array(F.collect_list(F.struct(last, self.value)))
        listed = self.df.groupBy(*keys).agg(pairs.alias("pairs"))
        at = F.transform("pairs", lambda x: x[last])
        holes = F.transform(F.sequence(F.lit(first), F.lit(first + max(n, 1) - 1)), lambda i: F.get("pairs", F.array_position(at, i.cast(self.df.schema[last].dataType)).cast("int") - 1)[self.value])
        return listed.select(*keys, F.when(F.size("pairs") == n, F.transform("pairs", lambda x: x[self.value])).otherwise(holes).alias("values"))

    def ordinal(self) -> Column:
        """The row-major position of an element."""
        at = F.lit(0).cast("long")
        for d in range(self.rank):
            at = at * self.shape[d] + F.col(f"i{d}") - self.origin[d]
        return at

    def is_dense(self) -> DataFrame:
        """n_elements, n_missing, n_repeated, n_outside: whether every place is filled once, and elements that are at none."""
        each = self.df.groupBy(*self.coords, self.inside().alias("in")).agg(F.count("*").alias("n"))
        total = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("long")
        seen = each.agg(total(F.col("in").cast("int")).alias("places"), total((F.col("in") & (F.col("n") > 1)).cast("int")).alias("n_repeated"), total(F.when(~F.col("in"), F.col("n"))).alias("n_outside"))
        return seen.select(F.lit(self.n_elements).cast("long").alias("n_elements"), (F.lit(self.n_elements) - F.col("places")).cast("long").alias("n_missing"), "n_repeated", "n_outside")

    def grid(self) -> DataFrame:
        """Every place of the dataset, made in parallel from positions."""
        at = self.df.sparkSession.range(self.n_elements)
        left, out = F.col("id"), []
        for d in reversed(range(self.rank)):
            out.append((left % self.shape[d] + self.origin[d]).alias(f"i{d}"))
            left = F.expr(f"id div {prod(self.shape[d:])}")
        return at.select(*reversed(out))

    def densify(self, fill: object = None, never: bool = False) -> ArrayFrame:
        """Places without an element read as the fill value; as zero where there is none or it is never written."""
        value = self.fill if fill is None else fill
        value = 0 if never or value is None else value
        kind = self.df.schema[self.value].dataType
        full = self.grid().join(self.df.select(*self.coords, self.value), self.coords, "left")
        return self._with(full.withColumn(self.value, F.coalesce(F.col(self.value), F.lit(value).cast(kind))))

    # ---- chunks

    def _grid_chunks(self) -> tuple[int, ...]:
        return self.chunks or self.shape

    def with_chunk(self) -> DataFrame:
        """df with chunk: the coordinates of the chunk's first element."""
        return self.df.withColumn("chunk", F.array(*[((F.col(f"i{d}") - F.col(f"i{d}") % c)).cast("long") for d, c in enumerate(self._grid_chunks())]))

    def chunk_index(self) -> DataFrame:
        """chunk, n_elements (present), n_stored (chunks are stored whole), is_partial (over the dataset's edge)."""
        chunks = self._grid_chunks()
        whole = prod(chunks)
        edge = F.lit(False)
        for d, c in enumerate(chunks):
            edge |= F.col("chunk")[d] + c > self.origin[d] + self.shape[d]
        counted = self.with_chunk().groupBy("chunk").agg(F.count("*").alias("n_elements"))
        return counted.select("chunk", "n_elements", F.lit(whole).cast("long").alias("n_stored"), edge.alias("is_partial"))

    def chunk_grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self._grid_chunks(), strict=True))

    # ---- changes

    def _alike(self, other: ArrayFrame, shape: bool) -> None:
        if other.element != self.element or other.df.schema[other.value].dataType != self.df.schema[self.value].dataType:
            raise TypeMismatchError(f"{other.element} can't go into {self.element}")
        if other.shape != self.shape if shape else other.shape[1:] != self.shape[1:] or other.rank != self.rank:
            raise TypeMismatchError(f"{other.shape} can't go into {self.shape}")

    def append(self, *others: ArrayFrame) -> ArrayFrame:
        """Others after this one along the leading dimension, in order; a selection brings its rows, wherever they were."""
        df, extent = self.df.select(*self.coords, self.value), self.shape[0]
        for other in others:
            self._alike(other, shape=False)
            to = (self.origin[0] + extent, *self.origin[1:])
            moved = [(F.col(c) - o + t).cast(self.df.schema[c].dataType).alias(c) for c, o, t in zip(self.coords, other.origin, to, strict=True)]
            df, extent = df.unionByName(other.df.select(*moved, F.col(other.value).alias(self.value))), extent + other.shape[0]
        return self._with(df, shape=(extent, *self.shape[1:]))

    def overwrite(self, other: ArrayFrame) -> ArrayFrame:
        """All values replaced; type and shape must be the same."""
        self._alike(other, shape=True)
        if other.origin == self.origin:
            return other
        other = other.rebased()
        return other._with(other.df.withColumns({c: (F.col(c) + o).cast(other.df.schema[c].dataType) for c, o in zip(self.coords, self.origin, strict=True)}), origin=self.origin)

    def patch(self, other: DataFrame) -> ArrayFrame:
        """Values at the coordinates of other, each named once, replaced or put where none was. A coordinate outside raises when the result is read.

        Up to PATCH_ROWS of them are broadcast, so that the dataset stays where it is.
        """
        outside = F.raise_error(F.concat(F.lit("no place "), F.concat_ws(", ", *self.coords)))
        new = other.select(*[F.when(self.inside(), F.col(c)).otherwise(outside).alias(c) for c in self.coords], F.col(self.value))
        few = other.limit(PATCH_ROWS + 1).count() <= PATCH_ROWS
        places = new.select(*self.coords)
        kept = self.df.select(*self.coords, self.value).join(F.broadcast(places) if few else places, self.coords, "left_anti")
        return self._with(kept.unionByName(new))

    def follow(self, extent: int) -> ArrayFrame:
        """What a reader sees that knows the leading extent as it was: always a prefix."""
        return self.rows(0, extent)

    def digest(self, text: Column, name: str = "sha256", block: int = 4096) -> DataFrame:
        """SHA-256 over the digests of runs of block elements, in storage order; a run's is that of its elements' canonical text, joined by commas."""
        parts = F.sort_array(F.collect_list(F.struct(F.col("at"), F.col("t"))))
        each = self.df.select(self.ordinal().alias("at"), text.alias("t")).withColumn("run", F.expr(f"at div {block}"))
        runs = each.groupBy("run").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), ","), 256).alias("d"))
        whole = F.sort_array(F.collect_list(F.struct("run", "d")))
        return runs.agg(F.sha2(F.array_join(F.transform(whole, lambda x: x["d"]), ","), 256).alias(name))


def from_arrays(df: DataFrame, key: str, values: str, shape: tuple[int, int], element: str, chunks: tuple[int, int] | None = None) -> ArrayFrame:
    """A matrix from rows that each hold an array."""
    rows = df.select(F.col(key).cast("long").alias("i0"), F.posexplode(values).alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), "value")
    return ArrayFrame(rows, shape, element, chunks)


def from_column(df: DataFrame, key: str, column: str | Column, n: int, element: str | None, chunk: int | None = None, fill: object = None) -> ArrayFrame:
    """A vector from rows that each hold an element at key."""
    value = F.col(column) if isinstance(column, str) else column
    return ArrayFrame(df.select(F.col(key).cast("long").alias("i0"), value.alias("value")), (n,), element, (chunk,) if chunk else None, fill)


__all__ = ["ELEMENTS", "ArrayFrame", "from_arrays", "from_column"]
