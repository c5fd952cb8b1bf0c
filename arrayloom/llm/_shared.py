"""What the operators of this subpackage share: paths, scratch tables and the definition of a word."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these (fixed values: space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's readers only, so that any store they know will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="arrayloom-"))
    return context.getCheckpointDir()


_WRITTEN: dict[str, list[str]] = {}


def cleanup(spark: SparkSession) -> int:
    """Deletes the scratch tables this application has written; results that read them must have been used. How many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return len(paths)


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a cut in the lineage that survives lost executors.

    by: a column whose values get folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: Column | str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text in order, without a regular expression."""
    spaced = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those asked for that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
