"""Shards by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.sources.tables import written

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
TWO_64 = 1 << 64
TWO_33 = 1 << 33
TWO_31 = 1 << 31

#: Equal rows that one task writes out at most.
PIECE = 1 << 16


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of an integer `key`; a null key goes to shard 0.

    The generator works modulo 2**64. Spark's longs raise on overflow, so its state is a decimal of
    38 digits, which holds the product of a 64-bit state and the multiplier exactly.
    The next place j exceeds the last, so `shards` steps are enough; after j >= shards nothing changes.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = F.coalesce(key.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    seed = F.when(whole < 0, whole + F.lit(str(TWO_64)).cast("decimal(20,0)")).otherwise(whole).cast("decimal(20,0)")

    def step(at: Column, _: Column) -> Column:
        state = ((at.state * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + 1) % F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(state / F.lit(str(TWO_33)).cast("decimal(20,0)")).cast("double")
        following = F.floor((at.j + 1).cast("double") * (F.lit(float(TWO_31)) / (high + 1.0))).cast("long")
        moved = F.struct(at.j.alias("b"), following.alias("j"), state.alias("state"))
        return F.when(at.j < shards, moved).otherwise(at)

    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), seed.alias("state"))
    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda at: at.b.cast("int"))


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    grow_to: int | None = None,
) -> DataFrame:
    """Every row of `docs` with its shard and its slot there: (id, size, text_crc32, law, shard, slot, grown_shard).

    `law` is `key`: the id and the number of shards alone decide. `grown_shard` is the shard with `grow_to`
    shards (one more, unless given); a row either stays or goes to a new shard.
    `slot` counts 0, 1, ... in each shard without gaps, in the order of (bucket, id, size, crc), bucket being
    the first two hex digits of the MD5 of id and crc. Each (shard, bucket) is numbered by itself and starts after the
    rows of the buckets before it, so no task sorts a whole shard, and the rows of one id are spread by their texts.
    Rows equal in id, size and crc are counted, not sorted, and get the slots that follow one another.

    A null or empty text has size 16 and CRC 0; a null id is hashed as 0. Rows that repeat an id
    share its shard and get slots of their own. An empty table gives no rows; other columns are left behind.
    """
    key = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, grow_to or shards + 1).alias("grown_shard"),
    ).withColumn("bucket", F.substring(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")).cast("binary")), 1, 2))
    equal = written(rows.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("rows")), "shard-rows")

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = equal.groupBy("shard", "bucket").agg(F.sum("rows").alias("rows"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("first", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / PIECE))))
    if (equal.agg(F.max("rows")).first()[0] or 0) > PIECE:
        # So many equal rows are more than one task's output.
        pieces = pieces.repartition("shard", "bucket", "doc_id", "text_crc32", "piece")
    ends = F.least(F.col("rows"), (F.col("piece") + 1) * PIECE) - 1
    return pieces.withColumn("n", F.explode(F.sequence(F.col("piece") * PIECE, ends))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("first") + F.col("n")).cast("long").alias("slot"),
        "grown_shard",
    )
