"""Growing datasets: following one as a stream, and appending a stream's rows to one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import TypeMismatchError
from ..sources.datasource import register
from ..sources.h5 import File
from ..sources.session import Session


def follow(spark: SparkSession, path: str, dataset: str, **options) -> DataFrame:
    """A stream of a dataset's rows as they are appended; each micro-batch is the rows between two extents, so what has
    been read is always a prefix, and a restart from a checkpoint neither repeats nor skips rows."""
    register(spark)
    return spark.readStream.format("h5").options(path=path, dataset=dataset, **options).load()


def appender(path: str, dataset: str, order: str, value: str = "value") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends value of each micro-batch in the order of a column. A batch goes to one file, so it passes
    the driver; bound it by the source's rate options. The batch's number is kept with the data, so a repeated batch is skipped."""

    def write(batch: DataFrame, number: int) -> None:
        with File(path) as file:
            found = file.resolve(dataset)
            done = file.attributes(found).get("last_batch")
            kind = found.kind
        if done is not None and number <= int(done):
            return
        rows = batch.select(order, value).toPandas().sort_values(order)
        values = rows[value].to_numpy()
        if values.dtype.kind != kind.dtype().kind and len(values):
            raise TypeMismatchError(f"{values.dtype} onto {kind.dtype()}")
        with Session(path) as session:
            if len(values):
                session.append(dataset, values.astype(kind.dtype()))
            session.set_attr(dataset, "last_batch", np.int64(number))

    return write
