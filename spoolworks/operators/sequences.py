"""Ordered rows: running values, islands, cuts, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from spoolworks.streaming.folds import fold


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest row of each key."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq))))
    return ranked.where("__n = 1").drop("__n")


def monotone(df: DataFrame, key: str, order: list[str], value: str, out: str = "progress") -> DataFrame:
    """The largest value so far, within 0 and 1; starts at 0."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max(value).over(so_far))))


def is_monotone(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, monotone): whether the value never falls."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__before", before).groupBy(key).agg(F.bool_and(F.coalesce(F.col(value) >= F.col("__before"), F.lit(True))).alias("monotone"))


def stream_end(df: DataFrame, key: str, at: str) -> DataFrame:
    """(key, end): the last time plus the step before it, as the last frame's duration; a single frame has none."""
    stepped = df.select(key, at, (F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at))).alias("__step"))
    return stepped.groupBy(key).agg((F.max(at) + F.coalesce(F.max_by("__step", F.struct(at, F.coalesce("__step", F.lit(0.0)))), F.lit(0.0))).alias("end"))


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows that have the value, with `island`: how many gaps came before."""
    gaps = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("island", gaps).where(F.col(value).isNotNull())


def cuts_to_scenes(frames: DataFrame, key: str, order: list[str], change: str, threshold: float, least: int) -> DataFrame:
    """(key, sequence_index, start_frame, end_frame): a scene for each run between accepted cuts.

    Frames are numbered from 0 in `order`. A cut is a frame whose change reaches the threshold; it is accepted if it is
    `least` frames or more after the last accepted one (the start counts as one). A clip without cuts is one scene. The
    fold streams a key's cuts past the last accepted one, so no key is gathered.
    """
    clip = F.to_json(F.struct(F.col(key).alias("k"))).alias("clip")  # a null key has a text too
    numbered = frames.withColumn("frame", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)
    cuts = numbered.where(F.col(change) >= threshold).select(clip, "frame", F.lit(False).alias("over"))
    ends = frames.groupBy(key).agg(F.count("*").alias("frame")).select(clip, "frame", F.lit(True).alias("over"))

    def step(state: dict | None, event: dict) -> tuple[dict, dict]:
        state = state or {"index": 0, "start": 0}
        answer = {"clip": event["clip"], "sequence_index": -1, "start_frame": state["start"], "end_frame": event["frame"]}
        if event["over"] or event["frame"] - state["start"] >= least:
            answer["sequence_index"] = state["index"]
            state = {"index": state["index"] + 1, "start": event["frame"]}
        return state, answer

    found = fold(cuts.union(ends), "clip", ["frame", "over"], step, "clip string, sequence_index int, start_frame long, end_frame long")
    back = F.from_json("clip", StructType([StructField("k", frames.schema[key].dataType)]))["k"].alias(key)
    return found.where("sequence_index >= 0").select(back, "sequence_index", "start_frame", "end_frame")


def folded_lines(lines: DataFrame, key: str, order: str, text: str, is_item: Column) -> DataFrame:
    """(key, item, text): lines that are no item are joined to the item before; those before the first item go."""
    marked = lines.withColumn("item", F.count_if(is_item).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gathered = marked.where("item > 0").groupBy(key, "item").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))).alias("parts"))
    return gathered.select(key, "item", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


def sections(df: DataFrame, key: str, start: str, length: str) -> DataFrame:
    """`df` with `end`: where the next section of the key starts, or the key's length."""
    return df.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)), F.col(length)))
