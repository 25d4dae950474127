"""Joins whose keys may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is split if it has more than 1 / (SPREAD * shuffle partitions) of the rows.
SPREAD = 2


def hot_keys(counted: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, salts) of those of `counted` (keys, rows) that hold more than an even part of all rows; None if there are none.
    There are fewer of them than parts, so the table may be broadcast."""
    parts = SPREAD * int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = counted.agg(F.sum("rows"), F.max("rows")).first()
    if not total or most * parts <= total:
        return None
    return counted.where(F.col("rows") * parts > total).select(*keys, F.ceil(F.col("rows") * parts / total).cast("int").alias("__salts"))


def spread_join(rows: DataFrame, table: DataFrame, hot: DataFrame | None, keys: list[str], by: list[str]) -> DataFrame:
    """`rows` joined with `table`, which has few rows for each of `keys`, so that no hot key is one task's: its rows are dealt
    over as many parts as they fill, by the hash of `by`, and its rows of `table` are repeated for each."""
    if hot is None:
        return rows.join(table, keys)
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("__salts")
    repeated = table.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(repeated, [*keys, "__salt"]).drop("__salt")
