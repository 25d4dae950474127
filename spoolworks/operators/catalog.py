"""Reads of the catalog: the library, tags, artifacts, completeness, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolworks.operators.tagging import cached_tags


def current(artifacts: DataFrame, versions: dict[str, int], kind: str = "artifact_kind", version: str = "params_version") -> DataFrame:
    """Artifacts of the current recipe of their kind. Pairs are compared, so one kind never passes at another's version."""
    pairs = [(F.col(kind) == k) & (F.col(version) == v) for k, v in versions.items()]
    held = pairs[0]
    for p in pairs[1:]:
        held = held | p
    return artifacts.where(held)


def library(files: DataFrame, blobs: DataFrame, artifacts: DataFrame, versions: dict[str, int]) -> DataFrame:
    """Every file with its blob and a flag for each kind of current artifact: files (sha256, ...) joined with blobs
    (sha256, ...). Kinds are gathered before the join, one small set for each blob."""
    kinds = current(artifacts, versions).groupBy("sha256").agg(F.collect_set("artifact_kind").alias("kinds"))
    joined = files.join(blobs, "sha256").join(kinds, "sha256", "left")
    return joined.withColumns({f"has_{k}": F.coalesce(F.array_contains("kinds", k), F.lit(False)) for k in versions}).drop("kinds")


def tagged(scenes: DataFrame, cache: DataFrame, prompt_version: Column, fields: list[str], raw: str = "raw_response_json") -> DataFrame:
    """Scenes with their tags of one prompt version, null if there are none or the cached reply is null, no JSON or of another
    shape. The version stands in the join's condition: in a filter it would drop untagged scenes. `cache` has scene_id,
    prompt_version."""
    tags = F.when(cached_tags(F.col(raw)).isNotNull(), F.struct(*fields))
    return scenes.join(cache, (F.col("id") == F.col("scene_id")) & (F.col("prompt_version") == prompt_version), "left").withColumn("tags", tags).drop("scene_id", "prompt_version", raw, *fields)


def complete(artifacts: DataFrame, versions: dict[str, int]) -> DataFrame:
    """(sha256) of blobs that have every kind at its current version."""
    counted = current(artifacts, versions).groupBy("sha256").agg(F.count_distinct("artifact_kind").alias("n"))
    return counted.where(F.col("n") == len(versions)).select("sha256")


def percent(part: Column, whole: Column) -> Column:
    """One decimal; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(0.0)


def roll_up(items: DataFrame, group: list[str], status: str, passed: str, running: str, pending: str) -> DataFrame:
    """Items of each group by status, and how many percent have passed. No group: one row, of zeros if there are no items."""
    counts = [F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(n) for n, s in (("passed", passed), ("in_progress", running), ("pending", pending))]]
    return items.groupBy(*group).agg(*counts).withColumn("completion", percent(F.col("passed"), F.col("total")))


# What is said of a step whose files are both there, one of them, or neither.
EVIDENCE = [("PASSED", "Report present and gate script verified"), ("IN_PROGRESS", "Report or gate script in progress"), ("PENDING", "Pending execution")]


def evidence(plan: DataFrame, listing: DataFrame, report: str = "report", gate: str = "gate") -> DataFrame:
    """`plan` (report, gate, ...) with report_exists, gate_exists, status and notes. listing: (name) of the files there are; a null
    name has no file. Names are joined once each, so a listing may be of any size."""
    there = listing.select(F.col(listing.columns[0]).alias("__name")).where("__name IS NOT NULL").distinct()
    found = plan
    for column, flag in ((report, "report_exists"), (gate, "gate_exists")):
        side = there.withColumnRenamed("__name", "__there")
        found = found.join(side, F.col(column) == F.col("__there"), "left").withColumn(flag, F.col("__there").isNotNull()).drop("__there")
    both, some = F.col("report_exists") & F.col("gate_exists"), F.col("report_exists") | F.col("gate_exists")
    pick = lambda i: F.when(both, EVIDENCE[0][i]).when(some, EVIDENCE[1][i]).otherwise(EVIDENCE[2][i])
    return found.withColumns({"status": pick(0), "notes": pick(1)})
