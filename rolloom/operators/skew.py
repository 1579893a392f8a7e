"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows; there can be at most so many hot keys.
HOT_SHARE = 1000


def _split(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows with _block: 0, or for a key of `hot` (key, _parts) one of its blocks, from a hash of the row, so that a repeated task gives the same. Null keys are spread too."""
    hashed = F.xxhash64(*rows.columns)
    marked = rows.join(F.broadcast(hot), key, "left")
    return marked.withColumn("_block", F.when(F.col(key).isNull(), F.pmod(hashed, F.lit(HOT_SHARE))).when(F.col("_parts").isNotNull(), F.pmod(hashed, F.col("_parts"))).otherwise(0)).drop("_parts")


def lookup(rows: DataFrame, key: str, table: DataFrame, weight: str, how: str = "inner") -> DataFrame:
    """Join of `rows` with `table` (one row for each key) without gathering any key in one task; `how` is inner or left.

    `weight` is the column of `table` with the number of `rows` of the key. At most HOT_SHARE keys can hold more than 1/HOT_SHARE of all rows: their rows are spread over blocks of that
    share, and their row of the table is repeated for each block, fewer than 2 * HOT_SHARE rows in all, which bounds the broadcast of the hot keys. `rows` are read once. Rows with a null
    key have no match; a left join keeps them. `weight` is dropped.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).scalar()
    parts = F.ceil(F.col(weight) * HOT_SHARE / F.greatest(total, F.lit(1))).cast("int")
    hot = table.where(F.col(weight) * HOT_SHARE > total).select(key, parts.alias("_parts"))
    blocks = F.when(F.col(weight) * HOT_SHARE > total, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    spread = table.where(F.col(key).isNotNull()).withColumn("_block", F.explode(blocks)).drop(weight)
    left = rows.where(F.col(key).isNotNull()) if how == "inner" else rows
    return _split(left, key, hot).join(spread.withColumn("_block", F.col("_block").cast("bigint")), [key, "_block"], how).drop("_block")


def hot_keys(sizes: DataFrame, key: str, n: str, per: int) -> DataFrame:
    """(key, _parts) of the keys with more than `per` rows that also hold more than 1/HOT_SHARE of all, of (key, n); _parts is the number of blocks that part them."""
    wide = F.greatest(F.lit(per), F.ceil(sizes.agg(F.coalesce(F.sum(n), F.lit(0))).scalar() / HOT_SHARE))
    return sizes.withColumn("_wide", wide).where(F.col(n) > F.col("_wide")).select(key, F.ceil(F.col(n) / F.col("_wide")).cast("int").alias("_parts"))


def pairs_in_blocks(left: DataFrame, right: DataFrame, key: str, per: int = 2000) -> DataFrame:
    """Equi-join on `key` in which the left rows of a hot key are spread over blocks.

    Each left row lies in one block of its key, each right row meets every block of its key, so every pair comes out
    once and no task holds the whole of a hot key. A key is hot with more than `per` left rows that are also more than 1/HOT_SHARE
    of all left rows: there are at most HOT_SHARE of them, which bounds the broadcast. `left` and `right` must have no column
    in common but the key. Rows with a null key have no pair. The block comes from a hash of the left row, so a repeated task gives the same blocks.
    """
    hot = hot_keys(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "_n", per)
    a = _split(left.where(F.col(key).isNotNull()), key, hot)
    last = F.coalesce(F.col("_parts"), F.lit(1)).cast("bigint") - 1
    b = right.join(F.broadcast(hot), key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("_parts")
    return a.join(b, [key, "_block"]).drop("_block")
