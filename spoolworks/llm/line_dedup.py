"""Line dedup: a sharded minimal perfect hash over line hashes, probed by the documents.

1. Each text gives the 128-bit hashes of its distinct line keys. A hash held by two documents or more is repeated;
   its owner is the smallest id.
2. The repeated hashes are dealt into shards of bounded size. A shard is a minimal perfect hash with three arrays in
   its order: a 64-bit fingerprint (the half of the hash that the perfect hash does not see), a count and an owner.
   Lines that are not repeated need no place: their fingerprints don't match.
3. The line hashes of the documents stream past the arrays of their shard. A shard's arrays are sent to as many tasks
   as its share of all hashes asks for, and a document's hashes to one of them by its id, so a line that most documents
   hold is probed by many tasks while an ordinary shard's arrays are sent once.
4. The hits that the document does not own are the keys it loses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spoolworks.llm.perfect_hash import PerfectHash
from spoolworks.llm.words import slices
from spoolworks.sources.tables import Scratch, written

SPACES = b" \t\n\x0b\x0c\r"
SHORTEST = 10
KEYS_PER_SHARD = 1 << 14
#: No part of a shard gets more than a share of 1 / (SPREAD * shuffle partitions) of the hashes on average.
SPREAD = 2


def line_key(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """What makes lines equal: white space off both ends, A-Z lower-cased; None for keys that are too short."""
    key = line.strip(SPACES).lower()
    if len(key) < shortest or (not key.isascii() and len(key.decode()) < shortest):
        return None
    return key


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(hi, lo, doc_id) for each distinct line key of each row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                keys = {line_hash(k) for line in (text or b"").split(b"\n") if (k := line_key(line, shortest)) is not None}
                ids += [doc] * len(keys)
                found += keys
            halves = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    return docs.mapInArrow(run, "hi long, lo long, doc_id long")


def build_index(repeated: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """(shard, hash, fingerprints, counts, owners), a row a shard, of (hi, lo, n, owner); and the number of shards."""
    shards = max(1, -(-repeated.count() // keys_per_shard))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        hi, lo, n, owner = (group.column(c).to_numpy() for c in ("hi", "lo", "n", "owner"))
        index = PerfectHash.build(lo.view(np.uint64))
        order = np.argsort(index.numbers(lo.view(np.uint64)))
        columns = [index.dump(), hi[order].tobytes(), np.minimum(n[order], 2**32 - 1).astype(np.uint32).tobytes(), owner[order].tobytes()]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v], pa.binary()) for c, v in zip(("hash", "fingerprints", "counts", "owners"), columns, strict=True)}})

    dealt = repeated.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, hash binary, fingerprints binary, counts binary, owners binary"), shards


def salted(hashes: DataFrame, shards: int, parts: int) -> DataFrame:
    """(shard, salts) of the shards that hold more than 1 / `parts` of the hashes; so there are fewer than `parts` rows."""
    loads = hashes.groupBy(F.pmod("hi", F.lit(shards)).cast("int").alias("shard")).count()
    return loads.select("shard", F.ceil(F.col("count") * parts / max(1, hashes.count())).cast("int").alias("salts")).where("salts > 1")


def probe(hashes: DataFrame, index: DataFrame, shards: int, spread: int = SPREAD) -> DataFrame:
    """(doc_id, key, n) for each of `hashes` (hi, lo, doc_id) that the index holds under another owner."""
    parts = spread * int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(written(salted(hashes, shards, parts), "hot-shards"))
    salts = F.coalesce("salts", F.lit(1))
    arrays = index.join(hot, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"),
        *[F.lit(None).cast("long").alias(c) for c in ("hi", "lo", "doc_id")], "hash", "fingerprints", "counts", "owners",
    )
    placed = hashes.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).join(hot, "shard", "left")
    probes = placed.select(
        "shard", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"),
        "hi", "lo", "doc_id", *[F.lit(None).cast("binary").alias(c) for c in ("hash", "fingerprints", "counts", "owners")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, arrays = None, None, None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for first, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if first == end:
                    continue
                if kind[first] == 0:
                    # The arrays of a shard come once for each salt in this partition; any of them serves.
                    if at != shard[first]:
                        at, index = shard[first], PerfectHash.load(batch.column(6)[first].as_py())
                        arrays = [np.frombuffer(batch.column(c)[first].as_py(), t) for c, t in ((7, np.int64), (8, np.uint32), (9, np.int64))]
                elif at == shard[first]:
                    part = batch.slice(first, end - first)
                    hi, lo, doc = (part.column(c).to_numpy() for c in (3, 4, 5))
                    number = index.numbers(lo.view(np.uint64))
                    fingerprints, counts, owners = arrays
                    hit = (number >= 0) & (fingerprints[number] == hi) & (owners[number] != doc)
                    keys = np.stack([hi[hit], lo[hit]], axis=1).astype(">i8").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[hit]), pa.array([keys[i : i + 16] for i in range(0, len(keys), 16)], pa.binary()), pa.array(counts[number[hit]].astype(np.int64))],
                        ["doc_id", "key", "n"],
                    )

    together = arrays.union(probes).repartition("shard", "salt").sortWithinPartitions("shard", "kind")
    return together.mapInArrow(run, "doc_id long, key binary, n long")


def drop_repeated_lines(docs: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with the lines it keeps: (doc_id, n_lines, n_dropped, text).

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least `shortest` code points
    found in two documents or more lose all their lines except in the smallest id that holds them; a document keeps
    its own repeats. A null or empty text is one empty line. Rows that repeat an id are one document: what it loses is
    one set of 16 bytes a key, and each of its rows gets that set. Rows with a null id are no document: they keep all
    lines and take none from others. Other columns are left behind.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    hashes = scratch.written(line_hashes(plain.where("doc_id IS NOT NULL"), shortest), "line-hashes")
    counted = hashes.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"))
    repeated = scratch.written(counted.where("owner < top").drop("top"), "repeated-lines")
    index, shards = build_index(repeated)
    index = scratch.written(index, "line-index")
    scratch.remove("repeated-lines")
    lost = scratch.written(probe(hashes, index, shards).groupBy("doc_id").agg(F.collect_set("key").alias("lost")), "lost-lines")
    scratch.remove("line-hashes", "line-index")
    # Null ids lose nothing, so they stay out of the join, where they would be one key.
    both = plain.where("doc_id IS NOT NULL").join(lost, "doc_id", "left").select("doc_id", "text", "lost")
    both = both.union(plain.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("lost")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines, dropped, kept = [], [], []
            for text, lost in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                split = (text or b"").split(b"\n")
                left = split
                if lost:
                    lost = set(lost)
                    left = [x for x in split if (k := line_key(x, shortest)) is None or line_hash(k) not in lost]
                lines.append(len(split))
                dropped.append(len(split) - len(left))
                kept.append(b"\n".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    schema = StructType([plain.schema["doc_id"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType())])
    return both.mapInArrow(run, schema)
