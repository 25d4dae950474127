"""Exact duplicates by 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolworks.llm.skew import hot_keys, spread_join
from spoolworks.sources.tables import written

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with the row that stays for its text: (id, keep_id, group_size, kept, text_sha256).

    Grouping by (hash, text) compares the bytes of all texts that share a hash, and adds up copies in each task
    before the shuffle, so a group of any size sends one row a task. What is left has no texts: a class is a hash
    with its smallest id and its size. Rows find their class by hash alone; only where two texts share a hash
    do they go by the text itself.

    Null and empty texts are one group. Of rows that repeat an id with one text all count as the row that stays.
    Null ids lose to any other; a group of null ids only keeps them (keep_id null). Other columns are left behind.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    hashed = rows.withColumn("hash", F.unhex(F.md5(F.col("norm").cast("binary"))))
    classes = written(
        hashed.groupBy("hash", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"),
        "exact-classes",
    )
    found = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    shared = classes.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash")
    if shared.isEmpty():
        # A class of very many copies is known by its size, and its rows are dealt over many tasks.
        hot = hot_keys(classes.select("hash", F.col("group_size").alias("rows")), ["hash"])
        # By the row's place, as copies may share an id or have none; where a row goes decides nothing in the result.
        placed = hashed.select("doc_id", "hash", F.monotonically_increasing_id().alias("__place"))
        return spread_join(placed, classes, hot, ["hash"], ["__place"]).select(*found)
    # A collision of MD5: these hashes are told apart by the SHA-256 of the texts, of which classes has one each.
    sided = hashed.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).drop("norm")
    return sided.join(classes, ["hash", "text_sha256"]).select(*found)
