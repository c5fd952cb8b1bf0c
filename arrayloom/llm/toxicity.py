"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut into
windows of words, each is compressed with the ordinary dictionary and with the toxic one laid over it,
and the bytes saved by the toxic one are what a window gives away. A logistic curve over the savings of
all windows, fitted on labelled documents that the dictionaries have not seen and moved to the threshold
that decides those best, makes a score of 0 to 1.

For the toxic dictionary each toxic text is reduced to the words that toxic texts use far more often
than ordinary ones; else the trainer would fill it with what the two have in common.

Bounds: of each class 2 * SAMPLE_DOCS labelled documents at most, and as many of them, in the order of a
hash, as SAMPLE_BYTES of text allow, are learned from, each with its whole text; half of them train the
dictionaries, the others the curve. Every document is scored on its whole text.

Defined results: a null text counts as empty and scores as a text without windows; without training
rows of both labels every score is the share of toxic ones (0 without any); repeated rows score alike;
repeated labels of a document count once, the toxic one first; of repeated ids the least text is learned
from; other columns are kept, but that ones named like a result (score, features) are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialise, table

#: Two levels search their dictionaries differently and miss different matches; the curve weighs both.
WINDOW_WORDS, LEVELS = 16, (9, 12)
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 16_384
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 32 << 20
RATIO, LEAST_DOCS = 4.0, 5
_SCORERS: dict = {}


@dataclass(frozen=True)
class Model:
    """Raw contents of both dictionaries and the curve; a fixed size, whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]


def bare(word: bytes) -> bytes:
    return word.strip(b".,!?;:")


def _trained(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to choose from
        return b"".join(samples)[-size:]


def train_dictionaries(ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Dictionaries from samples of words, one list a document."""
    used = [Counter(w for doc in docs for w in {bare(x) for x in doc}) for docs in (ordinary, toxic)]
    n = [len(ordinary) + 1, len(toxic) + 1]
    least = min(LEAST_DOCS, max(1, len(toxic) // 20))
    typical = {w for w, c in used[1].items() if w and c >= least and (c + 0.5) / n[1] >= RATIO * (used[0][w] + 0.5) / n[0]}
    left = [b" ".join(bare(w) for w in doc if bare(w) in typical) for doc in toxic]
    return _trained(ORDINARY_BYTES, [w for doc in ordinary for w in windows_of(doc)]), _trained(TOXIC_BYTES, [b" %s " % x for x in left if x])


class Savings:
    """Bytes that the toxic dictionary saves, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def squeeze(content: bytes, level: int):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.pairs = [(squeeze(ordinary, n), squeeze(toxic + ordinary, n)) for n in LEVELS]

    def features(self, text: str | None) -> list[float]:
        windows = windows_of(words_of(text))
        if not windows:
            return [0.0] * (8 * len(LEVELS) + 1)
        out = [float(np.log1p(len(windows)))]
        for plain, over in self.pairs:
            saved = np.array([len(plain(w)) - len(over(w)) for w in windows], float)
            top = np.sort(saved)[::-1]
            out += [
                min(top[0], 12.0), min(top[:3].mean(), 12.0), top[:10].mean(), saved.mean(),
                (saved >= 2).mean(), (saved >= 3).mean(), np.log1p((saved >= 3).sum()), np.clip(saved, 0, 8).mean(),
            ]
        return out


def fit_curve(features: np.ndarray, labels: np.ndarray, share: float | None = None) -> tuple[float, ...]:
    """Weights of the standardised features, then the bias; 0.5 lies where F1 is best at the given share of toxic documents."""
    mean, sd = features.mean(0), features.std(0) + 1e-9
    x = np.c_[(features - mean) / sd, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.05
        w += np.linalg.solve(h, x.T @ (labels - p) - 0.05 * w)
    margin = x @ w
    order = np.argsort(-margin)
    n, toxic = len(labels), labels.sum()
    clean_weight = 1.0 if not share or share >= 1 else (1 - share) / share * toxic / (n - toxic)
    hits = np.cumsum(labels[order])
    alarms = np.cumsum(1 - labels[order]) * clean_weight
    f1 = 2 * hits / (hits + alarms + toxic)
    best = int(np.argmax(f1))
    following = margin[order[min(best + 1, len(order) - 1)]]
    w[-1] -= (margin[order[best]] + following) / 2
    flat = w[:-1] / sd
    return (*flat.tolist(), float(w[-1] - flat @ mean))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the labelled rows to learn from."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def sample_labels(labels: DataFrame, label: str, docs_a_class: int, seed: str) -> DataFrame:
    """At most 2 * docs_a_class labelled training rows a class: doc_id, y, k (their order), part (0: dictionaries, 1: curve)."""
    known = known_labels(labels, label)
    key = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    parts = [known.filter(F.col("y") == y).select("doc_id", "y", key.alias("k")).orderBy("k").limit(2 * docs_a_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "y", "k", (F.conv(F.substring("k", 32, 1), 16, 10).cast("int") % 2).alias("part"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", docs_a_class: int = SAMPLE_DOCS, seed: str = "tox-1") -> Model:
    chosen = sample_labels(labels, label, docs_a_class, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen is bounded by docs_a_class
    rows = materialise(rows.groupBy("doc_id", "y", "k", "part").agg(F.min("text").alias("text")), "toxicity-sample")
    left, kept = {}, []
    for r in sorted(rows.select("doc_id", "y", "k", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect(), key=lambda r: r["k"]):
        left[r["y"]] = left.get(r["y"], SAMPLE_BYTES) - r["n"]
        if left[r["y"]] >= 0:
            kept.append(r["doc_id"])
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")), "doc_id", "left_semi")
    first = sorted(rows.filter("part = 0").select("y", "k", "text").collect(), key=lambda r: (r["y"], r["k"]))
    words = [[words_of(r["text"]) for r in first if r["y"] == y] for y in (0, 1)]
    totals = {r["y"]: r["n"] for r in known_labels(labels, label).groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not words[0] or not words[1]:
        return Model(b"", b"", (), share)
    ordinary, toxic = train_dictionaries(*words)
    measured = with_features(rows.filter("part = 1"), Model(ordinary, toxic, (), share)).select("doc_id", "y", "features").collect()
    measured.sort(key=lambda r: (r["doc_id"], r["features"]))
    y = np.array([r["y"] for r in measured], float)
    if not len(y) or y.min() == y.max():
        return Model(ordinary, toxic, (), share)
    return Model(ordinary, toxic, fit_curve(np.array([r["features"] for r in measured]), y, share), share)


def with_features(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, its text replaced by features of the whole text."""
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "features"])
    fields = [f for f in own.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
    sent = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _SCORERS.get("of") != sent.value:
            _SCORERS.update({"of": sent.value, "scorer": Savings(*sent.value)})
        scorer = _SCORERS["scorer"]
        for batch in batches:
            found = [scorer.features(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in fields], pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return own.mapInArrow(measure, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without its text, with score."""
    if not model.weights:
        return docs.drop("text").withColumn("score", F.lit(float(model.prior)))
    margin = F.lit(model.weights[-1])
    for i, w in enumerate(model.weights[:-1]):
        margin = margin + F.col("features")[i] * F.lit(w)
    return with_features(docs, model).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))).drop("features")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
