"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.session import cut, release


def _to_least(links: DataFrame) -> DataFrame:
    """Links (u, v) with the smallest v of each u as _m. A node with very many links is split by the adaptive join, since the other side has one row for each node."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("_m")), "u")


def _star(links: DataFrame) -> DataFrame:
    """One contraction round over links (u, v), u > v: each node's neighbours are tied to its smallest neighbour, larger ones first, then smaller ones."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.least("_m", "u").alias("v")).distinct()
    small = _to_least(large)
    ends = F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))
    return small.select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, comp) for every node of `links`, comp being the smallest node it is connected with.

    Links may be repeated, in either direction, or join a node with itself; null ends are ignored. Every round is written to
    the shared folder, in place of the one before; only two numbers a round come to the driver.
    """
    at = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    loops = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("comp"))
    seen = None
    for _ in range(rounds):
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen:
            break
        seen = now
        before, at = at, cut(_star(at), "links")
        release(before)
    else:
        raise RuntimeError("components did not settle")
    stars = at.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("comp").alias("comp"))
