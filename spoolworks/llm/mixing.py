"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A source with target t and size s takes each of its documents t / s times: the whole part surely, the fraction p by
pivotal rounding. Two documents of sizes w1 and w2 with open probabilities p1 and p2 meet; words move from one to
the other until one probability is 0 or 1, so w1 * p1 + w2 * p2 stays and each probability keeps its mean. The other
goes on to the next meeting. Documents meet in blocks of `BLOCK`; what a block leaves meets what other blocks left,
level by level, until each source has one document open, which a last draw settles. So a source's words differ from its
target by less than one document. A reserve of about `RESERVE` documents of each source meets last of all, the larger
first, so that the one left open is a small one as a rule. All draws are hashes of ids, levels and the seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.sources.tables import written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 128
RESERVE = 512
#: A source is dealt into 16 ** n parts, two at least, so that a part of all rows has about so many: tasks number them.
ROWS_OF_A_PART = 1 << 22
#: Equal rows that one task writes out at most.
PIECE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, rows) of (source, source_size, rows): the sources share all words by weight.

    By code point, null last, sources weigh weights[0], weights[1], ... and again. A source never gets more than
    `most` times its size; what it can't take is reshared by weight among the rest. With sources in the order of
    size / weight the capped ones come first: source i is capped if the level left by those before it,
    (all - most * their sizes) / weight from i on, exceeds most * size / weight of i itself. There is one row
    a source, not a document, here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int"))
    ordered = sizes.withColumn("weight", weigh).withColumn("ratio", F.col("source_size") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = (
        ordered.withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("taken", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("all") - F.col("taken")) / F.sum("weight").over(after))
        .withColumn("capped", F.col("level") > F.col("ratio") * most)
    )
    # By the window's own place: a struct would put the null source first where it ties.
    rest = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)
    level = F.coalesce(rest["level"], F.lit(0.0))
    return levelled.select("source", "source_size", F.when(F.col("capped"), F.col("source_size") * float(most)).otherwise(level * F.col("weight")).alias("target"), "rows")


def _uniform(*cols: Column) -> Column:
    """A number in (0, 1) that hangs on the columns alone."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _meet(block: Column, level: Column, seed: int) -> Column:
    """Settles all but one of a block: struct(open, done), done an array of (part, place, up)."""
    blank = "array<struct<part:int,place:long,up:int>>"
    start = F.struct(F.element_at(block, 1).alias("open"), F.array().cast(blank).alias("done"))

    def settled(who: Column, up: int) -> Column:
        return F.struct(who.part.alias("part"), who.place.alias("place"), F.lit(up).alias("up"))

    def still(who: Column, p: Column) -> Column:
        return F.struct(who.order.alias("order"), who.part.alias("part"), who.place.alias("place"), who.w.alias("w"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def step(at: Column, b: Column) -> Column:
        a = at.open
        to_a = F.least(a.w * (1.0 - a.p), b.w * b.p)
        to_b = F.least(a.w * a.p, b.w * (1.0 - b.p))
        up = _uniform(F.lit(seed), level, a.part, a.place, b.part, b.place) * (to_a + to_b) < to_b
        # Mass goes to a: a is full or b is empty. Otherwise to b: b is full or a is empty.
        a_full, b_full = a.w * (1.0 - a.p) <= b.w * b.p, b.w * (1.0 - b.p) <= a.w * a.p
        following = (
            F.when(up & a_full, still(b, b.p - to_a / b.w))
            .when(up, still(a, a.p + to_a / a.w))
            .when(b_full, still(a, a.p - to_b / a.w))
            .otherwise(still(b, b.p + to_b / b.w))
        )
        done = F.when(up & a_full, settled(a, 1)).when(up, settled(b, 0)).when(b_full, settled(b, 1)).otherwise(settled(a, 0))
        return F.struct(following.alias("open"), F.array_append(at.done, done).alias("done"))

    return F.aggregate(F.slice(block, 2, F.size(block)), start, step)


def mix(
    docs: DataFrame,
    seed: int = 7,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """Every row of `docs` with what the mix takes of it: (doc_id, source, size, source_size, target, taken, copies).

    `size` counts the runs of characters other than white space (null: 0), `taken` is copies * size, and copies never
    exceed `most`. A source without words has target 0 and no copies; a document without words is taken as often as
    its source's whole part says. Rows that repeat an id are rounded each for themselves; a null source is a source,
    null ids are ids, equal rows are rows of their own, however many. An empty table gives no rows; other columns are left behind,
    but for `row_col`: a key of each row's own, which settles the order of rows that tie on size and id.
    """
    own = [row_col] if row_col else []
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col), *own).alias("dealt"),
        *own,
    )
    if not row_col:
        # Equal rows are counted, and each but the first is dealt by its number among them, so no part gets them all.
        counted = written(sized.groupBy("doc_id", "source", "size", "dealt").agg(F.count("*").alias("rows")), "sizes")
        pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / PIECE))))
        if (counted.agg(F.max("rows")).first()[0] or 0) > PIECE:
            pieces = pieces.repartition("doc_id", "dealt", "piece")
        sized = pieces.withColumn("nth", F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("rows"), (F.col("piece") + 1) * PIECE) - 1)))
        sized = sized.withColumn("dealt", F.when(F.col("nth") > 0, F.xxhash64("dealt", "nth")).otherwise(F.col("dealt"))).drop("rows", "piece", "nth")
    else:
        sized = written(sized, "sizes")
    shares = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most), "targets")
    # Documents are numbered in each part of a source, so no task sees a source whole. Parts go by id and text, so null and
    # repeated ids are no hot part.
    rounds, many = 2, sized.count()
    while many > ROWS_OF_A_PART * 16**rounds:
        rounds += 1
    inside = Window.partitionBy("source", "part").orderBy(F.desc("size"), "doc_id", "dealt", *own)
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    placed = written(
        sized.withColumn("part", F.pmod("dealt", F.lit(16**rounds)).cast("int"))
        .withColumn("place", F.row_number().over(inside).cast("long") - 1)
        .drop("dealt")
        .join(shares.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
        .drop("named")
        .withColumn("times", times)
        .withColumn("whole", F.floor("times").cast("long")),
        "placed",
    )
    fraction = F.col("times") - F.col("whole")
    reserved = _uniform(F.lit(seed), F.lit(-2), F.col("part"), F.col("place")) < F.lit(float(RESERVE)) / F.col("rows")
    level_rows = placed.where((F.col("size") > 0) & (fraction > 0)).select(
        reserved.alias("reserved"),
        "source", "part", "place", F.col("part").alias("of"), F.floor(F.col("place") / BLOCK).alias("block"),
        F.struct((-F.col("size")).alias("order"), "part", "place", F.col("size").cast("double").alias("w"), fraction.alias("p")).alias("doc"),
    )
    reserve = level_rows.where("reserved").select("source", F.lit(0).alias("of"), F.lit(0).cast("long").alias("block"), "doc")
    level_rows = level_rows.where("NOT reserved").drop("reserved")
    deepest = placed.agg(F.max("place")).first()[0] or 0
    settled, depth = [], 0
    # Blocks of BLOCK in a part, blocks of those blocks, ... until a part has one; then 16 parts at a time.
    spans = []
    while deepest >= BLOCK:
        spans.append("part")
        deepest //= BLOCK
    spans += ["part", *["parts"] * rounds, "reserve"]
    for span in spans:
        if span == "reserve":
            level_rows = level_rows.union(reserve)
        gathered = level_rows.groupBy("source", "of", "block").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
        met = written(gathered.select("source", "of", "block", _meet(F.col("docs"), F.lit(depth), seed).alias("met")), "met")
        settled.append(met.select("source", F.explode("met.done").alias("d")).select("source", "d.part", "d.place", "d.up"))
        if span == "part":
            level_rows = met.select("source", "of", F.floor(F.col("block") / BLOCK).alias("block"), F.col("met.open").alias("doc"))
        else:
            level_rows = met.select("source", F.floor(F.col("of") / 16).cast("int").alias("of"), F.lit(0).cast("long").alias("block"), F.col("met.open").alias("doc"))
        depth += 1
    last = level_rows.select("source", "doc.part", "doc.place", (_uniform(F.lit(seed), F.lit(-1), F.col("doc.part"), F.col("doc.place")) < F.col("doc.p")).cast("int").alias("up"))
    for part in settled:
        last = last.union(part)
    ups = last.where("up = 1").select(F.col("source").alias("s"), F.col("part").alias("q"), F.col("place").alias("n"), "up")
    rounded = placed.join(ups, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("q")) & (F.col("place") == F.col("n")), "left")
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    return rounded.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *own)
