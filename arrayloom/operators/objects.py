"""Groups, links, attributes and named types as small tables: path, parent, name, kind, address, target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LinkError

MAX_HOPS = 64
CATALOG = "path string, parent string, name string, kind string, address long, target string"


def children(catalog: DataFrame, group: str, kind: str | None = None) -> DataFrame:
    """Names in a group, of one kind or all."""
    rows = catalog.filter(F.col("parent") == group)
    return (rows.filter(F.col("kind") == kind) if kind else rows).select("name", "kind")


def subtree(catalog: DataFrame, path: str) -> DataFrame:
    return catalog.filter((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))


def without(catalog: DataFrame, *paths: str) -> DataFrame:
    """What is left when paths, with all below them, are dropped."""
    keep = F.lit(True)
    for path in paths:
        keep &= ~((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    return catalog.filter(keep)


def resolve_links(catalog: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """path, final: where each soft link ends, null where it dangles. Raises where links go round.

    Hops are doubled by joining the map of links with itself, as long as any link ends at another: 64 hops take
    six joins, one hop none.
    """
    links = catalog.filter("kind = 'soft'").select("path", F.col("target").alias("final"))
    soft = links.select(F.col("path").alias("again"))
    ends = catalog.filter("kind <> 'soft'").select(F.col("path").alias("there"))
    hops = 1
    while links.join(soft, links.final == soft.again, "left_semi").limit(1).count():
        if hops >= max_hops:
            raise LinkError("soft links go round or exceed the limit of hops")
        onward = links.select(F.col("path").alias("p"), F.col("final").alias("f"))
        links = links.join(onward, links.final == onward.p, "left").select("path", F.coalesce("f", "final").alias("final"))
        hops *= 2
    return links.join(ends, links.final == ends.there, "left").select("path", F.col("there").alias("final"))


def dereference(references: DataFrame, catalog: DataFrame, address: str = "target_addr") -> DataFrame:
    """references with the path of the object at each address; inner, so dangling ones go."""
    return references.join(catalog.filter("kind <> 'soft'").select(F.col("address").alias(address), "path"), address)


def type_uses(datasets: DataFrame, types: DataFrame) -> DataFrame:
    """name, n_uses of each named type; types without users count 0."""
    used = datasets.groupBy("type").agg(F.count("*").alias("n"))
    return types.join(used, types.name == used.type, "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n_uses"))
