"""Every query over the test tables, with the SQL that must agree with it.

The SQL is written from the definition of an operator, not from its plan here.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert as cv
from ..mat import objects as mo
from ..mat import read_mat, register_table, variable_frame, write_mat
from ..operators import chunkmath, objects, tables
from ..operators.frame import ArrayFrame, from_arrays, from_column
from ..sources import codecs, datasource
from ..sources.h5 import Compound, FileBuilder, String, of_element
from ..sources.inplace import grow
from ..sources.spool import spool_elements
from ..streaming.follow import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WIDTH = 64
EMB = "SELECT vec_id AS i0, CAST(t.i - 1 AS BIGINT) AS i1, embedding[t.i] AS v FROM embeddings, range(1, 65) t(i)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str, chunks=(32, 16)) -> ArrayFrame:
    df = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return from_arrays(df, "vec_id", "embedding", (_extent(df, "vec_id"), WIDTH), "f32", chunks)


def events(spark: SparkSession, sf_dir: str, column="value", element="f64", chunk=1024, fill=None) -> ArrayFrame:
    df = read(spark, sf_dir, "events")
    return from_column(df, "event_id", column, _extent(df, "event_id"), element, chunk, fill)


def _extent(df: DataFrame, key: str) -> int:
    """The leading extent; Parquet answers it from its footers' statistics or one narrow column."""
    return (df.agg(F.max(key)).first()[0] or -1) + 1


# ---- reads and selections


@query(f"SELECT i0, i1, CAST(v AS DOUBLE) AS value FROM ({EMB})")
def read_f64(spark, sf_dir):
    return emb(spark, sf_dir).as_("f64").df


@query(f"SELECT i0, i1, v AS value FROM ({EMB})")
def read_f32(spark, sf_dir):
    return emb(spark, sf_dir).df


@query(f"SELECT i0, i1, CAST(v AS DOUBLE) AS value FROM ({EMB}) WHERE i0 BETWEEN 100 AND 199 AND i1 BETWEEN 8 AND 15")
def region_f64(spark, sf_dir):
    return emb(spark, sf_dir).region((100, 8), (100, 8)).as_("f64").df


@query(f"SELECT i0, i1, v AS value FROM ({EMB}) WHERE i0 >= (SELECT max(vec_id) FROM embeddings) - 9 AND i1 >= 60")
def region_edge(spark, sf_dir):
    a = emb(spark, sf_dir)
    return a.region((a.shape[0] - 10, 60), (10, 4)).df


@query("SELECT event_id AS i0, value FROM events WHERE event_id >= 500 AND event_id < 700")
def rows_f64(spark, sf_dir):
    return events(spark, sf_dir).rows(500, 200).df


@query("SELECT event_id AS i0, value FROM events WHERE event_id >= (SELECT max(event_id) FROM events) - 1")
def rows_clamped(spark, sf_dir):
    a = events(spark, sf_dir)
    return a.rows(a.shape[0] - 2, 5).df


@query("SELECT event_id AS i0, value FROM events WHERE false")
def rows_empty(spark, sf_dir):
    return events(spark, sf_dir).rows(3, 0).df


@query(f"SELECT i1 AS i0, i0 AS i1, v AS value FROM ({EMB})")
def transpose(spark, sf_dir):
    return emb(spark, sf_dir).transpose().df


@query("SELECT vec_id AS i0, embedding AS \"values\" FROM embeddings")
def read_array(spark, sf_dir):
    return emb(spark, sf_dir).nested()


# ---- numeric conversion

SCALED = "((l_extendedprice - 50000) * 1000)"


def _converted(target: str):
    low, high = cv.limits(target)
    kind = {"i8": "TINYINT", "i16": "SMALLINT", "i32": "INTEGER", "i64": "BIGINT", "u8": "SMALLINT", "u16": "INTEGER", "u32": "BIGINT", "u64": "DECIMAL(20,0)"}[target]
    top = f"{high}::DOUBLE" if target not in ("i64", "u64") else "9e18"
    sql = f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, CAST(least(greatest(trunc({SCALED}), {low}::DOUBLE), {top}) AS {kind}) AS value FROM lineitem"

    def run(spark, sf_dir):
        keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
        return read(spark, sf_dir, "lineitem").select(*keys, cv.convert(F.expr(SCALED), "f64", target).alias("value"))

    run.__name__ = f"read_{target}"
    query(sql)(run)


for _target in ("i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64"):
    _converted(_target)


@query("""SELECT event_id AS i0, CAST(least(greatest(user_id * 50 - 3000, -128), 127) AS TINYINT) AS narrowed,
 CAST(greatest(user_id * 50 - 3000, 0) AS DECIMAL(20,0)) AS to_unsigned, CAST(user_id * 50 - 3000 AS DOUBLE) AS to_double FROM events""")
def convert_integers(spark, sf_dir):
    x = F.expr("user_id * 50 - 3000")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("i0"), cv.convert(x, "i64", "i8").alias("narrowed"), cv.convert(x, "i64", "u64").alias("to_unsigned"), cv.convert(x, "i64", "f64").alias("to_double"))


# ---- chunks and fill values


@query(f"""SELECT [i0 - i0 % 32, i1 - i1 % 16] AS chunk, count(*) AS n_elements, CAST(512 AS BIGINT) AS n_stored,
 (i0 - i0 % 32) + 32 > (SELECT max(vec_id) + 1 FROM embeddings) AS is_partial FROM ({EMB}) GROUP BY i0 - i0 % 32, i1 - i1 % 16""")
def chunk_index(spark, sf_dir):
    return emb(spark, sf_dir).chunk_index()


@query(f"""SELECT [i0 - i0 % 96, i1 - i1 % 24] AS chunk, count(*) AS n_elements FROM ({EMB})
 WHERE (i0 - i0 % 96) + 96 > (SELECT max(vec_id) + 1 FROM embeddings) OR (i1 - i1 % 24) + 24 > 64 GROUP BY i0 - i0 % 96, i1 - i1 % 24""")
def chunk_partial_edges(spark, sf_dir):
    return emb(spark, sf_dir, (96, 24)).chunk_index().filter("is_partial").select("chunk", "n_elements")


def _holes(a: ArrayFrame) -> ArrayFrame:
    """Every third chunk was never allocated."""
    return a._with(a.df.filter((F.col("i0") / 1024).cast("long") % 3 != 1))


@query("SELECT r.i AS i0, CASE WHEN (r.i // 1024) % 3 = 1 THEN -1.5 ELSE value END AS value FROM (SELECT unnest(range(0, (SELECT max(event_id) + 1 FROM events))) AS i) r LEFT JOIN events ON event_id = r.i")
def fill_holes(spark, sf_dir):
    return _holes(events(spark, sf_dir, fill=-1.5)).densify().df


@query("SELECT event_id AS i0, CASE WHEN (event_id // 1024) % 3 = 1 THEN 0 ELSE value END AS value FROM events")
def fill_never(spark, sf_dir):
    return _holes(events(spark, sf_dir, fill=-1.5)).densify(never=True).df


@query("SELECT (SELECT count(*) * 64 FROM embeddings) AS n_elements, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_outside")
def dense_grid_check(spark, sf_dir):
    return emb(spark, sf_dir).is_dense()


# ---- compound, enumeration, strings


def _stored(df: DataFrame, key: str, name: str, kind, values, chunk: int, filters: list | None = None) -> str:
    """A new file with /x of a type: values in the order of a key, which don't come to the driver."""
    path = _file(df.sparkSession, name)
    elements = spool_elements(df, key, os.path.dirname(path), x=(kind, values))["x"]
    try:
        datasource.write_spool(df.sparkSession, elements, path, "/x", chunk, filters)
    finally:
        elements.drop()
    return path


def _elements(spark: SparkSession, path: str) -> DataFrame:
    return datasource.read_frame(spark, path, "/x").df


@query("SELECT o_orderkey AS i0, o_custkey AS custkey, o_totalprice AS total, o_orderstatus AS status FROM orders")
def compound_read(spark, sf_dir):
    kind = Compound.packed(custkey=of_element("i64"), total=of_element("f64"), status=String(1))
    fields = {"custkey": F.col("o_custkey"), "total": F.col("o_totalprice"), "status": F.col("o_orderstatus")}
    path = _stored(read(spark, sf_dir, "orders"), "o_orderkey", "records", kind, fields, 1000, [("shuffle", None), ("deflate", 1)])
    return _elements(spark, path).select("i0", "value.*")


@query("SELECT o_orderkey AS i0, o_totalprice AS total FROM orders")
def compound_project(spark, sf_dir):
    return compound_read(spark, sf_dir).select("i0", "total")


@query("SELECT event_id AS i0, value AS real, value * user_id AS imag FROM events")
def complex_read(spark, sf_dir):
    kind = Compound.packed(real=of_element("f64"), imag=of_element("f64"))
    fields = {"real": F.col("value"), "imag": F.col("value") * F.col("user_id")}
    return _elements(spark, _stored(read(spark, sf_dir, "events"), "event_id", "complex", kind, fields, 512)).select("i0", "value.*")


FLAGS = {"A": 0, "N": 1, "R": 2}


@query("SELECT l_returnflag AS label, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS code, count(*) AS n FROM lineitem GROUP BY 1")
def enum_codes(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), cv.enum_codes(F.col("l_returnflag"), FLAGS).alias("code")).groupBy("label", "code").agg(F.count("*").alias("n"))


@query("SELECT event_id AS i0, CASE user_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS label FROM events")
def enum_decode(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("i0"), cv.enum_labels(F.col("user_id") % 5, FLAGS).alias("label"))


def _fixed(spark, sf_dir, padding: str, size: int) -> DataFrame:
    return _elements(spark, _stored(read(spark, sf_dir, "orders"), "o_orderkey", padding, String(size, padding), F.col("o_orderpriority"), 700, [("deflate", 1)]))


@query("SELECT o_orderkey AS i0, o_orderpriority AS value FROM orders")
def fixed_string_nullpad(spark, sf_dir):
    return _fixed(spark, sf_dir, "nullpad", 20)


@query("SELECT o_orderkey AS i0, o_orderpriority AS value FROM orders")
def fixed_string_spacepad(spark, sf_dir):
    return _fixed(spark, sf_dir, "spacepad", 20)


@query("SELECT o_orderkey AS i0, o_orderpriority AS value FROM orders")
def fixed_string_nullterm(spark, sf_dir):
    return _fixed(spark, sf_dir, "nullterm", 21)


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS payload_bytes, CAST(max(strlen(text)) AS BIGINT) AS longest FROM documents")
def vlen_payload_size(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    return read(spark, sf_dir, "documents").agg(F.sum(n).alias("payload_bytes"), F.max(n).alias("longest"))


@query("SELECT doc_id AS i0, text AS value FROM documents WHERE doc_id >= 10 AND doc_id < 40")
def string_rows(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    return from_column(df, "doc_id", "text", _extent(df, "doc_id"), None).rows(10, 30).df


@query("SELECT doc_id AS i0, text AS value FROM documents WHERE doc_id >= 7 AND doc_id < 19")
def string_region(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    return from_column(df, "doc_id", "text", _extent(df, "doc_id"), None).region((7,), (12,)).df


# ---- catalog: groups, links, attributes, references, named types


def catalog(spark, sf_dir) -> DataFrame:
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    groups = regions.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit("/").alias("parent"), F.col("r_name").alias("name"), F.lit("group").alias("kind"), (F.col("r_regionkey") * 1000).cast("long").alias("address"), F.lit(None).cast("string").alias("target"))
    placed = nations.join(F.broadcast(regions), nations.n_regionkey == regions.r_regionkey)  # a region table has a handful of rows
    data = placed.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name"), F.concat(F.lit("/"), "r_name"), F.col("n_name"), F.lit("dataset"), (F.col("n_nationkey") + 1).cast("long"), F.lit(None).cast("string"))
    soft = placed.select(F.concat(F.lit("/link_"), "n_nationkey"), F.lit("/"), F.concat(F.lit("link_"), "n_nationkey"), F.lit("soft"), F.lit(None).cast("long"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name")).otherwise(F.concat(F.lit("/link_"), F.col("n_nationkey") - 1)))
    return groups.union(data).union(soft)


@query("SELECT r_name AS name, 'group' AS kind FROM region")
def list_groups(spark, sf_dir):
    return objects.children(catalog(spark, sf_dir), "/", "group")


@query("SELECT n_name AS name, 'dataset' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1")
def list_datasets(spark, sf_dir):
    name = read(spark, sf_dir, "region").filter("r_regionkey = 1").first()["r_name"]
    return objects.children(catalog(spark, sf_dir), f"/{name}", "dataset")


@query("""SELECT '/link_' || n.n_nationkey AS path, '/' || r.r_name || '/' || m.n_name AS final
 FROM nation n JOIN nation m ON m.n_nationkey = n.n_nationkey - n.n_nationkey % 2 JOIN region r ON m.n_regionkey = r.r_regionkey""")
def soft_link_resolve(spark, sf_dir):
    return objects.resolve_links(catalog(spark, sf_dir))


@query("SELECT n_nationkey AS i0, '/' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def dereference(spark, sf_dir):
    refs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i0"), (F.col("n_regionkey") * 1000).cast("long").alias("target_addr"))
    groups = catalog(spark, sf_dir).filter("kind = 'group'")
    return objects.dereference(refs, groups).select("i0", "path")


@query("SELECT r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_uses FROM region")
def named_type_refcount(spark, sf_dir):
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    uses = nations.join(F.broadcast(regions), nations.n_regionkey == regions.r_regionkey).select(F.col("r_name").alias("type"))
    return objects.type_uses(uses, regions.select(F.col("r_name").alias("name")))


@query("SELECT '/' || r_name AS owner, 'key' AS name, 'i32' AS type_name, true AS is_scalar, r_regionkey AS value FROM region")
def attrs_scan(spark, sf_dir):
    path, builder = _file(spark, "attributes"), FileBuilder()
    for r in read(spark, sf_dir, "region").collect():  # five rows
        builder.create_group(r["r_name"]).set_attr("key", np.int32(r["r_regionkey"]))
    builder.write(path)
    return datasource.attributes(spark, path).select("owner", "name", "type_name", "is_scalar", F.col("number").cast("int").alias("value"))


@query("SELECT 'key' AS name, CAST(sum(r_regionkey) AS DOUBLE) AS total, CAST(max(r_regionkey) AS SMALLINT) AS most FROM region")
def attr_numeric(spark, sf_dir):
    a = attrs_scan(spark, sf_dir).groupBy("name").agg(F.sum("value").alias("s"), F.max("value").alias("m"))
    return a.select("name", cv.convert(F.col("s"), "i64", "f64").alias("total"), cv.convert(F.col("m"), "i32", "u8").alias("most"))


# ---- changes

N_EVENTS = "(SELECT max(event_id) + 1 FROM events)"


@query(f"SELECT event_id AS i0, value FROM events UNION ALL SELECT event_id + {N_EVENTS}, -value FROM events")
def append(spark, sf_dir):
    a = events(spark, sf_dir)
    return a.append(a._with(a.df.withColumn("value", -F.col("value")))).df


@query(f"SELECT event_id AS i0, value FROM events UNION ALL SELECT event_id + {N_EVENTS}, value * 2 FROM events UNION ALL SELECT event_id + 2 * {N_EVENTS}, value * 4 FROM events")
def append_staged(spark, sf_dir):
    a = events(spark, sf_dir)
    twice = a._with(a.df.withColumn("value", F.col("value") * 2))
    return a.append(twice, twice._with(twice.df.withColumn("value", F.col("value") * 2))).df


@query(f"SELECT event_id AS i0, value FROM events UNION ALL SELECT event_id - {N_EVENTS} // 3 + {N_EVENTS}, value FROM events WHERE event_id >= {N_EVENTS} // 3")
def append_window(spark, sf_dir):
    """A selection's rows go after the last, wherever they were."""
    a = events(spark, sf_dir)
    return a.append(a.rows(a.shape[0] // 3, a.shape[0])).df


@query(f"SELECT i0, i1, v AS value FROM ({EMB}) WHERE i0 BETWEEN 110 AND 119 AND i1 BETWEEN 24 AND 27")
def region_then_rows(spark, sf_dir):
    """Selections compose: the second counts from where the first begins."""
    return emb(spark, sf_dir).region((100, 20), (60, 12)).rows(10, 10).region((0, 4), (10, 4)).df


@query("""SELECT r.i AS i0, CASE WHEN (r.i // 1024) % 3 = 1 THEN -1.5 ELSE value END AS value
 FROM (SELECT unnest(range(300, (SELECT max(event_id) + 1 FROM events) - 100)) AS i) r LEFT JOIN events ON event_id = r.i""")
def region_densify(spark, sf_dir):
    a = _holes(events(spark, sf_dir, fill=-1.5))
    return a.region((300,), (a.shape[0] - 400,)).densify().df


@query("SELECT event_id AS i0, value * 2 AS value FROM events")
def overwrite(spark, sf_dir):
    a = events(spark, sf_dir)
    return a.overwrite(a._with(a.df.withColumn("value", F.col("value") * 2))).df


@query("SELECT event_id AS i0, CASE WHEN event_id % 100 = 7 THEN -value ELSE value END AS value FROM events")
def patch_values(spark, sf_dir):
    a = events(spark, sf_dir)
    return a.patch(a.df.filter("i0 % 100 = 7").withColumn("value", -F.col("value"))).df


CATALOG_SQL = """SELECT '/' || r_name AS path, 'group' AS kind FROM region UNION ALL
 SELECT '/' || r_name || '/' || n_name, 'dataset' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '/link_' || n_nationkey, 'soft' FROM nation"""


@query(f"SELECT * FROM ({CATALOG_SQL}) WHERE path <> '/' || (SELECT r_name FROM region WHERE r_regionkey = 2) AND NOT starts_with(path, '/' || (SELECT r_name FROM region WHERE r_regionkey = 2) || '/')")
def delete_subtree(spark, sf_dir):
    name = read(spark, sf_dir, "region").filter("r_regionkey = 2").first()["r_name"]
    return objects.without(catalog(spark, sf_dir), f"/{name}").select("path", "kind")


@query(f"SELECT * FROM ({CATALOG_SQL}) WHERE kind <> 'soft' AND path NOT IN (SELECT '/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0)")
def repack_drop(spark, sf_dir):
    whole = catalog(spark, sf_dir).filter("kind <> 'soft'")
    drop = read(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 1).cast("long").alias("address"))
    return whole.join(drop, (whole.kind == "dataset") & (whole.address == drop.address), "left_anti").select("path", "kind")


@query("SELECT '/copy/' || n_name AS path, 'dataset' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 3 UNION ALL SELECT '/copy', 'group'")
def copy_within(spark, sf_dir):
    name = read(spark, sf_dir, "region").filter("r_regionkey = 3").first()["r_name"]
    return objects.subtree(catalog(spark, sf_dir), f"/{name}").select(F.concat(F.lit("/copy"), F.substring("path", len(name) + 2, 10_000)).alias("path"), "kind")


# ---- provenance and codecs


@query(f"""WITH e AS (SELECT i0 * 64 + i1 AS place, CAST(CAST(floor(CAST(v AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR) AS t FROM ({EMB})),
 runs AS (SELECT place // 4096 AS run, sha256(string_agg(t, ',' ORDER BY place)) AS d FROM e GROUP BY 1) SELECT sha256(string_agg(d, ',' ORDER BY run)) AS sha256 FROM runs""")
def provenance_sha256(spark, sf_dir):
    return emb(spark, sf_dir).digest(F.floor(F.col("value").cast("double") * 1000000).cast("string"))


@query("""WITH c AS (SELECT event_id, value, min(value) OVER (PARTITION BY event_id // 1024) AS m FROM events),
 o AS (SELECT event_id, m, value * 10.0 - m * 10.0 AS x FROM c)
 SELECT event_id AS i0, CASE WHEN abs(x) - floor(abs(x)) >= 0.5 THEN floor(abs(x)) + 1 ELSE floor(abs(x)) END * sign(x) / 10.0 + m AS value FROM o""")
def scaleoffset_dscale(spark, sf_dir):
    return chunkmath.decimal_scale(events(spark, sf_dir), 1).df


@query("""SELECT [event_id - event_id % 1024] AS chunk, min(user_id) AS min_value,
 CAST(ceil(log2(max(user_id) - min(user_id) + 1)) AS BIGINT) AS minbits FROM events GROUP BY event_id - event_id % 1024""")
def scaleoffset_minbits(spark, sf_dir):
    return chunkmath.min_bits(events(spark, sf_dir, "user_id", "i64"))


def _roundtrip(name: str, filters: list, column: str = "value", element: str = "f64"):
    def run(spark, sf_dir):
        return codecs.roundtrip(events(spark, sf_dir, column, element), filters).df

    run.__name__ = name
    query(f"SELECT event_id AS i0, {column} AS value FROM events")(run)


_roundtrip("deflate_roundtrip", [("deflate", 6)])
_roundtrip("shuffle_bytes", [("shuffle", None), ("deflate", 1)])
_roundtrip("fletcher32", [("fletcher32", None)])
_roundtrip("lzf_roundtrip", [("shuffle", None), ("lzf", None)])
_roundtrip("scaleoffset_roundtrip", [("scaleoffset", ("integer", 0))], "user_id", "i64")



@query("SELECT event_id AS i0, CAST(user_id * 64 AS INTEGER) AS value, true AS is_near FROM events")
def zfp_roundtrip(spark, sf_dir):
    """Integers at full rate: within 8 of what they were, so multiples of 64 come back once rounded to them."""
    a = events(spark, sf_dir, (F.col("user_id") * 64).cast("int"), "i32", 256)
    back = codecs.roundtrip(a, [("zfp", 32)]).df.withColumn("exact", (F.round(F.col("value") / 64) * 64).cast("int"))
    return back.select("i0", F.col("exact").alias("value"), (F.abs(F.col("value") - F.col("exact")) <= 8).alias("is_near"))


# ---- through files


def _file(spark: SparkSession, name: str) -> str:
    """A new file where driver and executors can both open it."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a mounted folder that executors share")
    if shared:
        os.makedirs(shared, exist_ok=True)
    return os.path.join(tempfile.mkdtemp(dir=shared or None, prefix="arrayloom-"), f"{name}.h5")


@query("SELECT event_id AS i0, value FROM events")
def h5_whole(spark, sf_dir):
    path = _file(spark, "whole")
    datasource.write_frame(events(spark, sf_dir), path, "/events/value", [("shuffle", None), ("deflate", 4), ("fletcher32", None)], maximum=(None,))
    return datasource.read_frame(spark, path, "/events/value").df


@query(f"SELECT i0, i1, v AS value FROM ({EMB}) WHERE i0 BETWEEN 30 AND 69 AND i1 BETWEEN 14 AND 17")
def h5_region(spark, sf_dir):
    """Four columns and forty rows over chunks of 32 x 16: four of the chunks are decoded."""
    path = _file(spark, "region")
    datasource.write_frame(emb(spark, sf_dir), path, "/emb", [("shuffle", None), ("deflate", 1)])
    return datasource.read_frame(spark, path, "/emb").region((30, 14), (40, 4)).df


@query("SELECT [event_id - event_id % 1024] AS chunk, 0 AS mask FROM events GROUP BY event_id - event_id % 1024")
def h5_chunks(spark, sf_dir):
    path = _file(spark, "chunks")
    datasource.write_frame(events(spark, sf_dir), path, "/v", [("deflate", 1)])
    return spark.read.format("h5").options(path=path, dataset="/v", mode="chunks").load().select("chunk", "mask")


@query("SELECT event_id AS i0, value, true AS is_near FROM events")
def h5_zfp(spark, sf_dir):
    """Fixed-rate blocks in a file: at 48 bits a value all are within a ten-millionth of the largest."""
    path, a = _file(spark, "blocks"), events(spark, sf_dir, chunk=512)
    datasource.write_frame(a, path, "/v", [("zfp", 48), ("fletcher32", None)])
    back = datasource.read_frame(spark, path, "/v").df.withColumnRenamed("value", "back")
    most = a.df.agg(F.max(F.abs("value")).alias("most"))
    near = F.abs(F.col("back") - F.col("value")) <= F.col("most") * 1e-7
    return a.df.join(back, "i0").join(F.broadcast(most)).select("i0", "value", near.alias("is_near"))  # most is one row


@query("SELECT event_id AS i0, user_id AS value FROM events")
def h5_scaleoffset_fill(spark, sf_dir):
    """Every third chunk was never written: its elements are the fill value, for which the filter keeps a code."""
    path, a = _file(spark, "filled"), events(spark, sf_dir, "user_id", "i64", 300, fill=-9)
    datasource.write_frame(a, path, "/v", [("scaleoffset", ("integer", 0))])
    return datasource.read_frame(spark, path, "/v").df


@query("SELECT '/many/' || n_name AS path, '/many' AS parent, n_name AS name, 'dataset' AS kind FROM nation UNION ALL SELECT '/many', '/', 'many', 'group'")
def h5_dense_catalog(spark, sf_dir):
    """More links than a header holds: they stand in a heap, found by a tree."""
    path, builder = _file(spark, "dense"), FileBuilder()
    group = builder.create_group("many")
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows
        group.create_dataset(r["n_name"], np.arange(r["n_nationkey"]))
    builder.write(path)
    return datasource.catalog(spark, path).select("path", "parent", "name", "kind")


@query("SELECT '/' AS owner, n_name AS name, 'f64' AS type_name, true AS is_scalar, CAST(n_nationkey AS DOUBLE) AS number FROM nation")
def h5_dense_attributes(spark, sf_dir):
    path, builder = _file(spark, "attributes"), FileBuilder()
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows
        builder.set_attr(r["n_name"], np.float64(r["n_nationkey"]))
    builder.write(path)
    return datasource.attributes(spark, path).select("owner", "name", "type_name", "is_scalar", "number")


@query(f"SELECT i0, i1, v AS value FROM ({EMB}) WHERE i0 BETWEEN 30 AND 99 AND i1 BETWEEN 10 AND 40")
def h5_tree2(spark, sf_dir):
    """Chunks of a matrix that grows both ways stand in a version-2 tree."""
    path = _file(spark, "tree")
    datasource.write_frame(emb(spark, sf_dir, (16, 16)), path, "/x", [("deflate", 1)], maximum=(None, None))
    return datasource.read_frame(spark, path, "/x").region((30, 10), (70, 31)).df


@query("SELECT '/' || r_name AS path, '/' AS parent, r_name AS name, 'group' AS kind FROM region UNION ALL SELECT '/' || r_name || '/' || n_name, '/' || r_name, n_name, 'dataset' FROM nation JOIN region ON n_regionkey = r_regionkey")
def h5_catalog(spark, sf_dir):
    path, builder = _file(spark, "catalog"), FileBuilder()
    for r in read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect():  # 25 rows
        group = builder.members.get(r["r_name"]) or builder.create_group(r["r_name"])
        group.create_dataset(r["n_name"], np.arange(r["n_nationkey"]))
    builder.write(path)
    return datasource.catalog(spark, path).select("path", "parent", "name", "kind")


# ---- MATLAB files, written and read


def _mat(spark: SparkSession, name: str, value: object) -> str:
    path = _file(spark, "mat")
    write_mat(path, {name: value})
    return path


def _spooled_mat(df: DataFrame, key: str, name: str, make: Callable, texts: str | None = None, /, **columns) -> str:
    """A file of what make returns for spooled columns, given by name, in the order of a key; texts names a column of strings."""
    path = _file(df.sparkSession, "mat")
    found = spool_elements(df, key, os.path.dirname(path), **columns) if texts is None else mo.spooled(df, key, os.path.dirname(path), texts, **columns)
    try:
        write_mat(path, {name: make(**found)})
    finally:
        for elements in found.values():
            elements.drop()
    return path


I64, F64 = of_element("i64"), of_element("f64")


@query("SELECT event_id AS row_number, CASE user_id % 4 WHEN 1 THEN 'low' WHEN 2 THEN 'mid' WHEN 3 THEN 'high' END AS label FROM events")
def categorical_labels(spark, sf_dir):
    made = lambda codes: mo.Table({"label": mo.Categorical(codes, ["low", "mid", "high"])})
    return register_table(spark, _spooled_mat(read(spark, sf_dir, "events"), "event_id", "t", made, codes=(of_element("u8"), F.col("user_id") % 4)), "t")


@query("SELECT event_id AS row_number, user_id, value, event_type FROM events")
def mat_table(spark, sf_dir):
    path = _spooled_mat(read(spark, sf_dir, "events"), "event_id", "t", lambda **c: mo.Table(c), "event_type", user_id=(I64, F.col("user_id")), value=(F64, F.col("value")))
    return register_table(spark, path, "t")


@query("SELECT event_id AS row_number, value, 1000.0::DOUBLE + event_id * 250.0::DOUBLE AS row_time_ms FROM events")
def mat_timetable_regular(spark, sf_dir):
    """Row times from where they begin and a step."""
    times = {"origin": mo.Duration(np.array([1000.0])), "specifiedAsRate": False, "sampleRate": 4.0, "stepSize": mo.Duration(np.array([250.0]))}
    path = _spooled_mat(read(spark, sf_dir, "events"), "event_id", "t", lambda value: mo.Timetable({"value": value}, row_times=times), value=(F64, F.col("value")))
    return register_table(spark, path, "t")


@query("SELECT event_id AS row_number, (CAST(epoch_us(ts) // 1000 AS DOUBLE) + 0.25) * 1000000.0 AS ts FROM events")
def mat_datetime_ns(spark, sf_dir):
    millis = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) DIV 1000").cast("double")
    kind = Compound.packed(real=F64, imag=F64)
    path = _spooled_mat(read(spark, sf_dir, "events"), "event_id", "t", lambda ts: mo.Table({"ts": mo.Datetime(ts, tz="UTC")}), ts=(kind, {"real": millis, "imag": F.lit(0.25)}))
    return register_table(spark, path, "t")


@query("SELECT event_id AS row_number, value / 1000 AS seconds FROM events")
def mat_duration_seconds(spark, sf_dir):
    path = _spooled_mat(read(spark, sf_dir, "events"), "event_id", "t", lambda value: mo.Table({"seconds": mo.Duration(value)}), value=(F64, F.col("value")))
    return register_table(spark, path, "t")


@query("SELECT r_name AS key, CAST(r_regionkey AS DOUBLE) AS value FROM region")
def mat_map(spark, sf_dir):
    rows = read(spark, sf_dir, "region").collect()  # five rows
    found = read_mat(_mat(spark, "m", mo.Map({r["r_name"]: float(r["r_regionkey"]) for r in rows})))["m"]
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "key string, value double")


@query("SELECT event_id AS i0, CAST(0 AS BIGINT) AS i1, value * 2 AS value FROM events")
def mat_matrix(spark, sf_dir):
    """A column of numbers, read in parallel."""
    return variable_frame(spark, _spooled_mat(read(spark, sf_dir, "events"), "event_id", "x", lambda value: value, value=(F64, F.col("value") * 2)), "x").df


@query("SELECT event_id AS i0, value, 1000.0::DOUBLE + event_id * 250.0::DOUBLE AS row_time_ms FROM events")
def timetable_arithmetic(spark, sf_dir):
    return tables.regular_times(events(spark, sf_dir).df, "i0", 1000, 250)


# ---- following a growing dataset

#: Rows appended at once, which is what the driver holds of them.
APPENDED = 1 << 18


@query("SELECT event_id AS i0, value FROM events")
def swmr_prefix(spark, sf_dir):
    """A stream follows a dataset that is appended to between two of its runs: every row arrives once."""
    path = _file(spark, "growing")
    values = spool_elements(read(spark, sf_dir, "events"), "event_id", os.path.dirname(path), value=(F64, F.col("value")))["value"]
    half = len(values) // 2
    datasource.write_spool(spark, values, path, "/x", 256, maximum=(None,), rows=half)
    out, state = f"{os.path.dirname(path)}/rows", f"{os.path.dirname(path)}/state"
    for more in (False, True):
        for first in range(half, len(values), APPENDED) if more else ():
            grow(path, "/x", values.read(first, APPENDED))
        stream = follow(spark, path, "/x").writeStream.format("parquet").option("checkpointLocation", state).start(out)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
    values.drop()
    return spark.read.parquet(out)


@query("SELECT chunk, sum(n) OVER (ORDER BY chunk) AS extent FROM (SELECT event_id // 1024 AS chunk, count(*) AS n FROM events GROUP BY 1)")
def swmr_extents(spark, sf_dir):
    """The leading extent after each commit of one chunk: sizes are per chunk, so the running sum is over few rows."""
    from pyspark.sql.window import Window

    sizes = events(spark, sf_dir).chunk_index().select((F.col("chunk")[0] / 1024).cast("long").alias("chunk"), "n_elements")
    return sizes.select("chunk", F.sum("n_elements").over(Window.orderBy("chunk")).alias("extent"))
