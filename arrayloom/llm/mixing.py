"""Mixing sources to target weights.

Sizes are aggregated per source, the targets are levelled under each source's ceiling, and every
document is emitted floor(rate) times plus one copy that a hash of its id grants with the fraction's
probability. Only one row a source is ever shuffled.

Defined results: null is a source of its own, after all others; a null text has no words; a source
without words has target and rate 0; a null doc_id draws by its text; repeated rows draw alike;
other columns are kept aside meanwhile, so that their names can't clash; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, materialise, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
CEILING = 2
SEED = "mix-1"
#: The rates are broadcast only up to so many sources and bytes of their names; beyond it they are joined by salted shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES, SALTS = 50_000, 4 << 20, 64


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, ceiling=CEILING) -> DataFrame:
    """One row a source: source_size, target, rate. sizes has source and source_size, one row a source.

    Targets are min(ceiling * size, level * weight); the level follows in closed form once the sources
    are ordered by the level at which each stops. The windows run over sources, not documents.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    kinds = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("rank", order).withColumn("weight", F.element_at(kinds, (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * ceiling).withColumn("stop", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("stop", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(share[0]) / F.lit(share[1]))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a document's id, alike in every run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def join_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows with the columns of rates, matched null-safe on source; a third of all rows may share one source."""
    bound = rates.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("source")), F.lit(0)).alias("b")).first()
    mine = rates.withColumnRenamed("source", "of")
    if bound["n"] <= BROADCAST_SOURCES and 4 * bound["b"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(mine), F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
    salted = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.withColumn("salt", F.pmod(F.xxhash64("key", "text"), F.lit(SALTS)).cast("int"))
    same = F.col("source").eqNullSafe(F.col("of")) & (keyed["salt"] == salted["salt"])
    return keyed.join(salted, same, "inner").drop("of", "salt")


def source_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum(n_words(text_of())).cast("long").alias("source_size"))


def copies(docs: DataFrame, sized: bool = False, **how) -> DataFrame:
    """own (docs' columns), size (if sized), source_size, target and copies: how often the mix emits each document."""
    rates = targets(source_sizes(docs), **how)
    rates = materialise(rates, "mix-rates")  # a row a source, so that the texts are not counted again to check its bound
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(own, F.col("doc_id").alias("key"), "text", "source", *([n_words(text_of()).alias("size")] if sized else []))
    out = join_rates(rows, rates)
    whole = F.floor("rate")
    extra = F.when(draw(F.col("key"), F.col("text")) < F.col("rate") - whole, F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("copies", (whole + extra).cast("int")).drop("key", "text", "source", "rate")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, with the columns of docs."""
    return copies(docs).filter(F.col("copies") > 0).select("own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("own.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), sized=True)
    return out.select("own.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(r - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, cap::DOUBLE / weight AS stop, (SELECT sum(source_size)::DOUBLE * 3 / 2 FROM s) AS total FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER b, 0)::DOUBLE AS cap_before, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS weight_left
  FROM o WINDOW b AS (ORDER BY stop, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - cap_before) / weight_left::DOUBLE AS level FROM c WHERE (total - cap_before) / weight_left::DOUBLE <= stop ORDER BY stop, r LIMIT 1),
t AS (SELECT c.source, source_size, least(cap::DOUBLE, (SELECT level FROM l) * weight) AS target FROM c),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
e AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.rate,
  ('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
"""
