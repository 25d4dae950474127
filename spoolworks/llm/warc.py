"""Fixity audit of WARC replicas by Merkle trees.

Records are hashed, and ordered ranges of a file's records are hashed level by level: a node covers `FANOUT` nodes of
the level below, in the order of their offsets. Two replicas are compared by the roots of their files; below a root
that differs only the children of differing nodes are looked at, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.sources.tables import written

FANOUT = 16
RECORDS_PER_FILE = 256
#: Equal records that one task writes out at most.
PIECE = 1 << 16
# The first byte of what is hashed tells records from ranges.
LEAF, RANGE = "00", "01"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 response record as text; a null url or body is written as empty, a null id as 0."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("0")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def record_hashes(pages: DataFrame, *more: Column) -> DataFrame:
    """(page_id, url, length, digest) of the records of `pages` (page_id, url, html), bytes and SHA-256, and `more`."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select("page_id", "url", F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"), *more)


def bucket_digits(rows: int, rows_of_a_bucket: int = 1 << 22) -> int:
    """Hex digits of a bucket's name, two at least, so that a bucket has about so many rows."""
    digits = 2
    while rows > rows_of_a_bucket * 16**digits:
        digits += 1
    return digits


def manifest(records: DataFrame, per_file: int = RECORDS_PER_FILE, digits: int = 2) -> DataFrame:
    """`records` placed into files: file, record (0, 1, ... in the file), offset and length besides what they have.

    A file holds `per_file` records at most, in the order of page_id (null first), url and digest, of one bucket: the first `digits`
    hex digits of the MD5 of the id (zeros for a null id). Hashes and lengths stand for the records here, so numbering moves no
    bodies. Equal records are counted and then numbered one after another. The others are put in order by ranges: a task
    numbers the records of its range, after those of the ranges before, so an id that very many records share, or none, is
    many tasks' work.
    """
    bucket = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, digits), F.lit("0" * digits))
    order = ["__bucket", "page_id", "url", "digest", *[c for c in records.columns if c not in ("page_id", "url", "digest")]]
    equal = written(records.withColumn("__bucket", bucket).groupBy(*order).agg(F.count("*").alias("__rows")), "records")
    ranged = written(equal.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "record-ranges")
    earlier = Window.partitionBy("__bucket").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__bucket", "__range").agg(F.sum("__rows").alias("__n")).select("__bucket", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__bucket", "__range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__first", F.coalesce(F.sum("__rows").over(inside), F.lit(0))).join(starts, ["__bucket", "__range"])
    pieces = placed.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("__rows") - 1) / PIECE))))
    if (equal.agg(F.max("__rows")).first()[0] or 0) > PIECE:
        pieces = pieces.repartition("__bucket", "digest", "__piece")
    ends = F.least(F.col("__rows"), (F.col("__piece") + 1) * PIECE) - 1
    numbered = pieces.withColumn("__n", F.explode(F.sequence(F.col("__piece") * PIECE, ends))).withColumn("__n", F.col("__start") + F.col("__first") + F.col("__n"))
    filed = numbered.select(*records.columns, F.concat_ws("-", "__bucket", F.floor(F.col("__n") / per_file).cast("string")).alias("file"), (F.col("__n") % per_file).cast("long").alias("record"))
    before = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(placed: DataFrame, fanout: int = FANOUT, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """The nodes (level, file, node, start, end, hash) of `placed` (file, record, offset, length, digest)."""
    leaf = F.sha2(F.unhex(F.concat(F.lit(LEAF), F.lpad(F.hex("offset"), 16, "0"), F.lpad(F.hex("length"), 16, "0"), F.col("digest"))), 256)
    level = placed.select(F.lit(0).alias("level"), "file", F.col("record").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), leaf.alias("hash"))
    nodes, depth, widest = level, 0, per_file
    while widest > 1:
        depth, widest = depth + 1, -(-widest // fanout)
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        joined = F.array_join(F.transform(children, lambda c: c["hash"]), "")
        level = (
            level.groupBy("file", F.floor(F.col("node") / fanout).alias("up"))
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(F.unhex(F.concat(F.lit(RANGE), joined)), 256).alias("hash"))
            .select(F.lit(depth).alias("level"), "file", F.col("up").alias("node"), "start", "end", "hash")
        )
        nodes = nodes.union(level)
    return nodes


def audit(one: DataFrame, two: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records in which two trees differ: (file, record, start, end, damage).

    `damage` is `changed`, `missing` (in the second tree) or `added` (not in the first). Trees without nodes differ in nothing.
    """
    top = one.union(two).agg(F.max("level")).first()[0] or 0
    suspects = None
    for level in range(top, -1, -1):
        a = one.where(F.col("level") == level).select("file", "node", "start", "end", F.col("hash").alias("ha"))
        b = two.where(F.col("level") == level).select("file", "node", F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("hash").alias("hb"))
        if suspects is not None:
            above = suspects.select("file", F.col("node").alias("parent"))
            a, b = ((side.withColumn("parent", F.floor(F.col("node") / fanout)).join(above, ["file", "parent"], "left_semi").drop("parent")) for side in (a, b))
        suspects = a.join(b, ["file", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
    return suspects.select(
        "file",
        F.col("node").alias("record"),
        F.coalesce("start", "start_b").alias("start"),
        F.coalesce("end", "end_b").alias("end"),
        F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "added").otherwise("changed").alias("damage"),
    )


def fixity(first: DataFrame, second: DataFrame) -> DataFrame:
    """`first`, a manifest, with the damage that its replica `second` shows in each record (null: intact).

    Records are compared place by place, so a replica keeps the file, record and offset of what it holds. Repeated
    rows are records of their own. Empty manifests give no rows.
    """
    damaged = audit(written(tree(first), "tree"), written(tree(second), "tree")).select("file", "record", "damage")
    return first.join(damaged, ["file", "record"], "left")
