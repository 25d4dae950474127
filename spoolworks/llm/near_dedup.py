"""Near duplicates: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

1. One pass in Arrow batches takes each text to its distinct five-word shingles (64-bit hashes), keeps the k
   smallest as its sketch, and a 128-bit hash of the whole set. Rows with one set are one class.
2. The values of the classes' sketches are counted. Two sets that reach the threshold share at least
   `overlap(n)` retained values, so one of the rarest `size - overlap + 1` values of each is shared:
   only these go to the inverted lists. Values of one class only go to none.
3. Lists of at most `SHORT` classes give all their pairs. A longer list gives the pairs of each class with a
   hub, the class whose values the most others hold; linked classes are joined into components. What may still be
   linked across components of a long list is compared, in blocks, by parity bitmaps first: two bitmaps differ in at most
   as many bits as the sets in members, so a larger difference than the threshold allows excludes the pair exactly.
4. Pairs whose union sketch is too far below the threshold are dropped; the rest is verified on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.llm.components import components
from spoolworks.llm.skew import hot_keys, spread_join
from spoolworks.llm.words import shingle_set, slices
from spoolworks.sources.tables import Scratch

SKETCH = 64
SHORT = 16
PARITY_WORDS = 16
#: Classes of a block of a long list.
BLOCK = 512
DEVIATIONS = 6.0


def overlap(threshold: float, k: int) -> int:
    """Retained values that a pair at the threshold shares, less six standard deviations. With k of 64 a pair right at it holds
    fewer with a chance of 3.5e-8 at 0.85 (37) and 1.9e-8 at 0.80 (32), the exact binomial tail."""
    return max(1, math.floor(k * threshold - DEVIATIONS * math.sqrt(k * threshold * (1 - threshold))))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(ends, np.concatenate(arrays) if arrays else np.empty(0, np.int64))


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """(doc_id, row, hi, lo, n, sketch) of each row of `docs` (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hi, lo, size, low = [], [], [], []
            for text in batch.column(2).cast(pa.large_binary()).to_pylist():
                found = shingle_set(text)
                high, rest = digest(found)
                hi.append(high)
                lo.append(rest)
                size.append(len(found))
                low.append(found[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int64()), _lists(low)],
                ["doc_id", "row", "hi", "lo", "n", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, row long, hi long, lo long, n long, sketch array<long>")


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    value = xxhash.xxh3_128_intdigest(found.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def full_sets(docs: DataFrame, parity_words: int = PARITY_WORDS) -> DataFrame:
    """(cid, members, parity) of each row of `docs` (cid, hi, lo, text) whose text has the set of that digest: the shingles,
    and their parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, members, parity = [], [], []
            wanted = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(3).cast(pa.large_binary()).to_pylist(), strict=True)
            for cid, hi, lo, text in wanted:
                found = shingle_set(text)
                if digest(found) == (hi, lo):
                    odd = np.bincount(((found >> 5) & (64 * parity_words - 1)), minlength=64 * parity_words) & 1
                    kept.append(cid)
                    members.append(found)
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), _lists(members), _lists(parity)], ["cid", "members", "parity"])

    return docs.mapInArrow(run, "cid long, members array<long>, parity array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, k: int, least: int) -> DataFrame:
    """The written pairs (a, b) that reach the threshold: union sketches first, full sets for what is left. `b` may be one
    hub of very many pairs, so it is joined last and spread."""
    hot = hot_keys(pairs.groupBy("b").agg(F.count("*").alias("rows")), ["b"])
    drawn = spread_join(
        pairs.join(classes.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a"),
        classes.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), hot, ["b"], ["a"],
    )
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    drawn = drawn.withColumn("u", union).where(
        F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) * k >= F.size("u") * least
    )
    both = spread_join(
        drawn.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a"),
        sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), hot, ["b"], ["a"],
    )
    common = F.size(F.array_intersect("ma", "mb"))
    return both.where(common * 100 >= (F.size("ma") + F.size("mb") - common) * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    k: int = SKETCH,
    short: int = SHORT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row of `docs` with its component: (doc_id, n_shingles, component_id, kept).

    Two texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets. `component_id` is the
    smallest id reachable over links; `kept` says that it is the row's own. Texts with fewer than five words have
    one shingle, the whole sequence; null texts and texts without words have none and are linked with nothing.
    Rows are told apart by their sets, not their ids: each row of a repeated id is linked as its own text is, and rows of
    one text are one class. A null id is a component's id only if the component has no other: then component_id is null
    and its rows are all kept. Other columns are left behind.
    """
    scratch = Scratch(docs.sparkSession)
    least = overlap(percent / 100, k)
    # `row` finds a text again; full_sets() checks what it finds.
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    drawn = scratch.written(sketches(plain.select("doc_id", "row", "text"), k), "sketches")

    # Classes of equal sets, numbered. All rows of a class have one n and one sketch.
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("of")
    classes = scratch.written(
        drawn.where("n > 0")
        .groupBy("hi", "lo")
        .agg(first_row, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
        .select(F.monotonically_increasing_id().alias("cid"), "hi", "lo", F.col("of.doc_id").alias("id"), F.col("of.row").alias("row"), "n", "sketch", "rows"),
        "classes",
    )
    values = classes.select("cid", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = scratch.written(values.groupBy("value").agg(F.count("*").alias("rows")).where("rows > 1"), "shared")

    # Sets this small are compared whole with any that they may reach, so the bound holds without a margin.
    small = math.floor(k * percent / 100)
    need = F.when(F.col("n") <= small, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(least))
    by_rarity = Window.partitionBy("cid").orderBy("df", "value")
    ranked = (
        spread_join(values, shared.select("value", F.col("rows").alias("df")), hot_keys(shared, ["value"]), ["value"], ["cid"])
        .withColumn("need", need)
        .withColumn("place", F.row_number().over(by_rarity))
        .withColumn("found", F.count("*").over(Window.partitionBy("cid")))
        .withColumn("own", F.col("kept") - F.col("found"))
        .withColumn("apart", -F.sum("df").over(Window.partitionBy("cid")))
        .where("found >= need AND place + own <= kept - need + 1")
    )
    listed = scratch.written(ranked.select("value", "cid", "n", "apart"), "lists")
    scratch.remove("shared")
    lengths = scratch.written(listed.groupBy("value").agg(F.count("*").alias("rows"), F.min(F.struct("apart", "cid", "n")).alias("hub")).where("rows > 1"), "lengths")
    entries = scratch.written(
        spread_join(listed, lengths.select("value", F.col("rows").alias("length"), "hub"), hot_keys(lengths, ["value"]), ["value"], ["cid"]), "entries"
    )
    scratch.remove("lists", "lengths")

    # The full sets of all classes on any list, in one pass over their texts. Rows that repeat one may come more than once.
    wanted = entries.select("cid").distinct().join(classes.select("cid", "hi", "lo", "row"), "cid")
    texts = plain.select("row", "text").join(wanted, "row").select("cid", "hi", "lo", "text")
    sets = scratch.written(full_sets(texts).dropDuplicates(["cid"]), "sets")

    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    left = entries.where(F.col("length") <= short).select("value", F.col("cid").alias("a"), "n")
    right = left.select("value", F.col("a").alias("b"), F.col("n").alias("m"))
    short_pairs = left.join(right, "value").where((F.col("a") < F.col("b")) & near).select("a", "b")
    hub_pairs = (
        entries.where(F.col("length") > short)
        .select(F.col("cid").alias("a"), "n", F.col("hub.cid").alias("b"), F.col("hub.n").alias("m"))
        .where((F.col("a") != F.col("b")) & near)
        .select("a", "b")
    )
    pairs = scratch.written(short_pairs.union(hub_pairs).distinct(), "pairs")
    first = scratch.written(_verified(pairs, classes, sets, percent, k, least), "links-first")
    scratch.remove("pairs")
    joined = components(first)

    # What the hubs of long lists leave: classes of different components. All but the list's largest component
    # are compared with the others, so a large settled component costs one comparison for each outsider.
    long = (
        entries.where(F.col("length") > short)
        .select("value", "cid", "n")
        .join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    counted = long.groupBy("value", "component").agg(F.count("*").alias("members"))
    largest = counted.groupBy("value").agg(F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("parts"), F.sum("members").alias("rows"))
    open_lists = scratch.written(largest.where("parts > 1").select("value", F.col("top.component").alias("top"), "rows", (F.col("rows") - F.col("top.members")).alias("outside")), "open")
    if not open_lists.isEmpty():
        names = [f"p{i}" for i in range(PARITY_WORDS)]
        bits = sets.select("cid", *[F.col("parity")[i].alias(p) for i, p in enumerate(names)])
        left_over = scratch.written(spread_join(long, open_lists, hot_keys(open_lists, ["value"]), ["value"], ["cid"]).join(bits, "cid"), "left-over")
        pairs = scratch.written(across(left_over, names, percent), "pairs")
        second = scratch.written(_verified(pairs, classes, sets, percent, k, least), "links-second")
        scratch.remove("left-over", "pairs")
        if not second.isEmpty():
            joined = components(first.union(second))
    scratch.remove("entries", "sets", "open")

    named = classes.select("cid", "hi", "lo", "id", "rows").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    answers = named.join(ids, "component").select("hi", "lo", "component_id")
    linked = spread_join(drawn.where("n > 0").select("doc_id", "row", "hi", "lo", "n"), answers, hot_keys(classes.select("hi", "lo", "rows"), ["hi", "lo"]), ["hi", "lo"], ["doc_id", "row"])
    empty = drawn.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = linked.select("doc_id", "n", "component_id").union(empty).withColumnRenamed("n", "n_shingles")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def across(left_over: DataFrame, names: list[str], percent: int) -> DataFrame:
    """The pairs (a, b) of classes of one list and two components that sizes and parity bitmaps don't exclude, once each.

    left_over: (value, cid, n, component, top, rows, outside, parity columns `names`). A list is cut into blocks of `BLOCK`
    classes on both sides and each pair of blocks is a key of its own, so a list of any length is many tasks' work, and
    the rows that are shuffled are fewer than the comparisons by half of `BLOCK`. Only classes whose sizes may reach
    the threshold meet: their bands of log(n) are the same or next to each other.
    """
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-6)
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    ours, theirs = F.ceil(F.col("outside") / BLOCK).cast("int"), F.ceil(F.col("rows") / BLOCK).cast("int")
    key = ["value", "band", "i", "j"]

    def block(count: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("cid", F.lit(seed)), count).cast("int")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    one = (
        left_over.where("component <> top")
        .withColumn("i", block(ours, 1))
        .withColumn("j", every(theirs))
        .withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
        .select(*key, F.col("cid").alias("a"), "n", F.col("component").alias("ca"), *[F.col(p).alias(f"a{p}") for p in names])
    )
    two = (
        left_over.withColumn("i", every(ours))
        .withColumn("j", block(theirs, 2))
        .withColumn("band", band)
        .select(*key, F.col("cid").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"), F.col("top").alias("topb"), *[F.col(p).alias(f"b{p}") for p in names])
    )
    apart = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in names), F.lit(0))
    return (
        one.join(two, key)
        .where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("topb")) | (F.col("ca") < F.col("cb"))))
        .where((F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)))
        .select("a", "b")
        .distinct()
    )
