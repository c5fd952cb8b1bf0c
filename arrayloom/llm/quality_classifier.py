"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two words, BUCKETS buckets): one of target text,
one of all raw text. A document's log weight is the sum of the log ratios of its n-grams; adding Gumbel
noise drawn from a hash of its id and keeping the k largest samples without replacement in proportion
to the weights.

The raw model counts every n-gram of every document. The target model counts documents labelled good, at
most TARGET_DOCS of them, chosen by hash. Each task sums its counts before they are shuffled. The k-th
largest key is found by narrowing histograms, so nothing is sorted as a whole or collected.

Defined results: a null or empty text has no n-grams and weight 0; a null id draws by its text; rows that
are alike draw alike and ties at the threshold are broken by id, among rows alike in that too by where they
are read, so that exactly k stay; without target rows all weights are 0;
other columns are kept, one named like a result replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialise, table, unused

BUCKETS, TARGET_DOCS = 10_000, 20_000
SEED = "resample-1"
BINS, FEW = 512, 20_000
_HASHES: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None) -> np.ndarray:
    """The buckets of a text's single words and pairs of words."""
    import xxhash

    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    known = list(map(_HASHES.get, words))
    if None in known:
        for i, h in enumerate(known):
            if h is None:
                known[i] = h = xxhash.xxh3_64_intdigest(words[i])
                if len(words[i]) < 64:
                    _HASHES[words[i]] = h
    h = np.array(known, np.uint64)
    both = np.concatenate([_mix(h), _mix(h[:-1] * np.uint64(3) + h[1:])])
    return (both % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """bucket, raw, target: n-grams of all documents, and of those whose id is in targets (at most TARGET_DOCS, so broadcast)."""
    marked = docs.select("doc_id", "text").join(F.broadcast(targets.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left").select("text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, mark in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
                found = np.bincount(ngrams(text.as_py()), minlength=BUCKETS)
                raw += found
                if mark:
                    good += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "target"])

    return marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counted: DataFrame) -> np.ndarray:
    """The log ratio of each bucket; at most BUCKETS rows come to the driver, whatever the corpus."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs without text, with n_ngrams, log_weight and key (log_weight plus Gumbel noise)."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    added = ("n_ngrams", "log_weight", "key", "kept")
    draw = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))))
    u = (F.conv(F.substring(F.md5(draw), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], u.alias("key"))
    kept = [f for f in own.schema.fields if f.name not in ("text", "key")]
    schema = T.StructType([*kept, T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("key", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            found = [ngrams(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            weights = np.array([ratio[x].sum() for x in found])
            noise = -np.log(-np.log(batch.column(batch.schema.get_field_index("key")).to_numpy()))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in found], pa.int64()), pa.array(weights, pa.float64()), pa.array(weights + noise, pa.float64())], names=schema.names)

    return own.mapInArrow(weigh, schema)


def kth(rows: DataFrame, k: int, by: Column) -> tuple[float | int, int, int]:
    """The k-th largest value of by, how many rows are larger and how many have it.

    Histograms close in on it; BINS counts a step come to the driver, and FEW rows at most are sorted.
    """
    values = rows.select(by.alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    above, halve = 0, False  # rows known to be larger than high
    while low < high:
        inside = values.filter(F.col("v").between(low, high))
        width = (float(high) - float(low)) / BINS
        if halve or width <= 0:
            middle = (low + high) // 2 if isinstance(low, int) else (low + high) / 2
            at = (F.col("v") > (middle if low <= middle < high else low)).cast("int")
        else:
            at = F.least(F.lit(BINS - 1), F.floor((F.col("v").cast("double") - float(low)) / width).cast("int"))
        found = {r["b"]: r for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
        if sum(r["n"] for r in found.values()) <= FEW:
            low = high = inside.orderBy(F.col("v").desc()).limit(k - above).agg(F.min("v")).first()[0]
            above += inside.filter(F.col("v") > low).count()
            break
        halve = len(found) == 1
        for b in sorted(found, reverse=True):  # into the bin that holds the k-th
            if above + found[b]["n"] >= k:
                break
            above += found[b]["n"]
        low, high = found[b]["low"], found[b]["high"]
    return low, above, values.filter(F.col("v") == F.lit(low)).count()


def top(rows: DataFrame, k: int, key: str = "key", tie: str = "doc_id") -> DataFrame:
    """rows with kept: true for the k with the largest keys, ties broken by the least tie, null last.

    The k-th row's key, and where others share it its tie, decide each row by itself. Rows alike in both are
    numbered if only some of them are kept.
    """
    if k <= 0 or k >= rows.count():
        return rows.withColumn("kept", F.lit(k > 0))
    order = F.bitwise_not(F.coalesce(F.col(tie).cast("long"), F.lit((1 << 63) - 1)))
    least, above, n = kth(rows, k, F.col(key))
    kept, k = F.col(key) > least, k - above
    if n == k:
        return rows.withColumn("kept", kept | (F.col(key) == least))
    last, above, n = kth(rows.filter(F.col(key) == least), k, order)
    kept, k = kept | ((F.col(key) == least) & (order > last)), k - above
    alike = (F.col(key) == least) & (order == last)
    if n == k:
        return rows.withColumn("kept", kept | alike)
    (number,) = unused(rows, "__number")
    rows = materialise(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
    end, _, _ = kth(rows.filter(alike), k, F.bitwise_not(number))
    return rows.withColumn("kept", kept | (alike & (F.bitwise_not(number) >= end))).drop(number)


def resample(docs: DataFrame, labels: DataFrame, label: str = "quality", k: int | None = None, target_docs: int = TARGET_DOCS) -> DataFrame:
    """docs without text, with n_ngrams, log_weight, key and kept. k defaults to the labels' share of good documents."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    order = F.md5(F.concat(F.lit(SEED), F.col("doc_id").cast("string")))
    targets = known.filter("y = 1").select("doc_id", order.alias("o")).orderBy("o").limit(target_docs)
    rows = materialise(weighed(docs, log_ratios(counts(docs, targets))), "weights")
    if k is None:
        share = known.agg(F.avg("y")).first()[0]
        k = rows.count() if share is None else round(share * rows.count())
    return top(rows, k)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_ngrams", "log_weight", "key", "kept")
