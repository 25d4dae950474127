"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size class of their shingle set, [2^j, 2^(j+1)). An item of q shingles is contained in
a document when at least c = ceil(threshold * q) of them are there, so at least one of any q - c + 1 is. The sketch of
an item is therefore its q - c + 1 smallest MinHash values, the bottom of the same hash order for all texts: a
document that contains the item holds one of them, whatever its length and wherever the passage stands. A document
of n shingles is matched against a size class only if n reaches what the smallest item of the class needs.
Candidates are then counted on the shingles themselves, as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolworks.llm.skew import hot_keys, spread_join
from spoolworks.llm.words import WIDTH, shingle_hashes, slices, words
from spoolworks.sources.tables import written

#: A benchmark whose texts take up to so many bytes goes to the executors whole; a larger one goes by the join. Its
#: shingles are some 20 times as many bytes in each Python worker.
BROADCAST_BYTES = 8 << 20
FILTER_BITS = 20
#: Bits of the filter over sketch values that the join sends ahead: 16 MB, whatever the size of the benchmark.
JOIN_FILTER_BITS = 27
MATCHES = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def shingles_as_bytes(found: list[bytes], width: int = WIDTH) -> set[bytes]:
    """The distinct shingles themselves; no word holds a space, so joining by one keeps them apart."""
    if not found:
        return set()
    span = min(width, len(found))
    return {b" ".join(found[i : i + span]) for i in range(len(found) - span + 1)}


def required(size: int, percent: int) -> int:
    """The shared shingles an item of `size` needs."""
    return -(-size * percent // 100)


def bottom(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The MinHash sketch of an item that no document containing it misses: the q - c + 1 smallest values."""
    distinct = np.unique(hashes)
    return distinct[: len(distinct) - required(len(distinct), percent) + 1] if len(distinct) else distinct


@dataclass
class Index:
    """Sketches of items, by size class: sorted values, the item of each, and a bit filter over them."""

    ids: list
    shingles: list[set[bytes]]
    classes: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)
    bits: np.ndarray = field(default_factory=lambda: np.zeros(1 << FILTER_BITS, bool))


def build(items: list[tuple[int, bytes | None]], percent: int) -> Index:
    kept = [(i, w) for i, t in items if (w := words(t))]
    index = Index([i for i, _ in kept], [shingles_as_bytes(w) for _, w in kept])
    parts: dict[int, list[tuple[np.ndarray, int]]] = {}
    for at, (_, found) in enumerate(kept):
        size = len(index.shingles[at])
        parts.setdefault(size.bit_length(), []).append((bottom(shingle_hashes(found), percent), at))
    for members in parts.values():
        values = np.concatenate([v for v, _ in members])
        owners = np.concatenate([np.full(len(v), at) for v, at in members])
        order = np.argsort(values, kind="stable")
        least = min(required(len(index.shingles[at]), percent) for _, at in members)
        index.classes.append((least, values[order], owners[order]))
        index.bits[values & ((1 << FILTER_BITS) - 1)] = True
    return index


def candidates(index: Index, hashes: np.ndarray) -> set[int]:
    """The items of which a document with these shingle hashes holds a sketch value."""
    near = np.unique(hashes[index.bits[hashes & ((1 << FILTER_BITS) - 1)]])
    found: set[int] = set()
    if len(near):
        for least, values, owners in index.classes:
            if len(hashes) >= least:
                first, last = np.searchsorted(values, near, "left"), np.searchsorted(values, near, "right")
                for a, b in zip(first[first < last], last[first < last], strict=True):
                    found.update(owners[a:b].tolist())
    return found


def _match_rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, item, size, shared = zip(*rows, strict=True) if rows else ([], [], [], [])
    ratio = [s / n for s, n in zip(shared, size, strict=True)]
    kinds = [pa.int64()] * 4 + [pa.float64()]
    columns = [pa.array(list(c), t) for c, t in zip((doc, item, size, shared, ratio), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_item", "n_shared", "containment"])


def _by_broadcast(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    texts = [(r.item_id, r.text.encode() if r.text is not None else None) for r in items.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build(shared.value, percent)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                found = words(text)
                near = candidates(index, shingle_hashes(found))
                if near:
                    there = shingles_as_bytes(found)
                    for at in near:
                        item = index.shingles[at]
                        count = len(item & there)
                        if count >= required(len(item), percent):
                            rows.append((doc, index.ids[at], len(item), count))
            yield _match_rows(rows)

    return docs.mapInArrow(run, MATCHES)


def _filter_of(sketched: DataFrame, bits: int) -> np.ndarray:
    """A bitmap over the last `bits` bits of all sketch values, packed. Blocks of 2**15 bits are filled by the tasks, so
    the driver gets 2**bits / 8 bytes at most."""
    width = min(15, bits)

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        block = np.zeros(1 << width, bool)
        block[group.column("bit").to_numpy()] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([np.packbits(block).tobytes()], pa.binary())})

    place = F.col("value").bitwiseAND(F.lit((1 << bits) - 1))
    placed = sketched.select(F.shiftright(place, width).alias("block"), place.bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("bit")).distinct()
    packed = np.zeros((1 << bits) // 8, np.uint8)
    step = (1 << width) // 8
    for row in placed.groupBy("block").applyInArrow(fill, "block long, packed binary").collect():
        packed[row.block * step : (row.block + 1) * step] = np.frombuffer(row.packed, np.uint8)
    return packed


def _by_join(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The same for a benchmark of any size: sketch values and shingles meet in shuffled joins. Of a document only the
    shingles that a bit filter over the sketch values lets through are shuffled, once for all equal rows. The documents of a
    value that very many hold are dealt over tasks, with the items of that value repeated for each."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, values, least = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                found = bottom(shingle_hashes(words(text)), percent)
                ids += [item] * len(found)
                values += found.tolist()
                least += [required(len(shingles_as_bytes(words(text))), percent)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.int64()), pa.array(least, pa.int64())], ["item", "value", "least"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = passing.value
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                found = np.unique(shingle_hashes(words(text)))
                place = found & ((1 << JOIN_FILTER_BITS) - 1)
                near = found[(packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(near), pa.int64()), pa.array(near), pa.array([len(found)] * len(near), pa.int64())], ["doc", "value", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            columns += [batch.column(i).cast(pa.large_binary()).to_pylist() for i in (2, 3)]
            for doc, item, text, wanted in zip(*columns, strict=True):
                need = shingles_as_bytes(words(wanted))
                count = len(need & shingles_as_bytes(words(text)))
                if count >= required(len(need), percent):
                    rows.append((doc, item, len(need), count))
            yield _match_rows(rows)

    # Rows are told apart by the hash of all they hold, so null and repeated ids are no hot keys; verify() sees the texts.
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    items = items.withColumn("row", F.xxhash64("item_id", "text"))
    sketched = written(items.select("row", "text").mapInArrow(sketch, "item long, value long, least long"), "item-sketches")
    passing = docs.sparkSession.sparkContext.broadcast(_filter_of(sketched, JOIN_FILTER_BITS))
    held = written(docs.select("row", "text").mapInArrow(spread, "doc long, value long, n long").distinct(), "held-values")
    hot = hot_keys(held.join(sketched.select("value"), "value", "left_semi").groupBy("value").agg(F.count("*").alias("rows")), ["value"])
    pairs = spread_join(held, sketched.distinct(), hot, ["value"], ["doc"]).where("n >= least").select("doc", "item").distinct()
    texts = docs.select(F.col("row").alias("doc"), "doc_id", "text")
    wanted = items.select(F.col("row").alias("item"), "item_id", F.col("text").alias("wanted"))
    both = pairs.join(texts, "doc").join(wanted, "item")
    return both.select("doc_id", "item_id", "text", "wanted").mapInArrow(verify, MATCHES)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """A row for each document and item it contains: (doc_id, item_id, n_item, n_shared, containment).

    An item is contained when at least `percent` of its distinct five-word shingles are among the document's; with
    fewer words, its whole sequence is its one shingle, and a document counts as holding it only if the document is
    that sequence. Items and documents that are null, empty or without words match nothing. Null ids are ids. Rows that
    repeat an id are matched each by their own text; repeated items give repeated rows. Empty tables give no rows; other columns are left behind.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return (_by_broadcast if size <= broadcast_bytes else _by_join)(plain, items, percent)
