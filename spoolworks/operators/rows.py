"""Row-level rules a warehouse needs and Spark's tables don't enforce: checks, references, upserts, idempotent appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def violations(df: DataFrame, checks: dict[str, str]) -> Column:
    """The names of the checks a row fails; a check that is null passes."""
    names = F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(name)) for name, c in checks.items()])
    return F.filter(names, lambda n: n.isNotNull())


def split_valid(df: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't with `failed_checks`)."""
    marked = df.withColumn("failed_checks", violations(df, checks))
    return marked.where(F.size("failed_checks") == 0).drop("failed_checks"), marked.where(F.size("failed_checks") > 0)


def first_per_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in `order`, which should end in something unique."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """`current` with the rows of `changes` in place of those with their key, and new ones added. The last of several
    changes to a key (by the column `change_seq`) wins."""
    latest = first_per_key(changes, key, [F.desc("change_seq")]).drop("change_seq")
    return current.join(latest.select(*key), key, "left_anti").unionByName(latest)


def updated(current: DataFrame, changes: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """`current` with `fields` of the rows that `changes` (key, fields, change_seq) names set to what the last change says, null
    included; other columns and rows stay. Of changes with one `change_seq` the greatest fields count. Keys that are not there and
    null keys change nothing. A key's changes are cut to one before the shuffle, however many there are."""
    latest = changes.groupBy(*key).agg(F.max(F.struct("change_seq", *fields)).alias("__new"))
    joined = current.join(latest, key, "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])


def append_new(current: DataFrame, rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The rows to append: those whose key is not there, one a key. A second run appends nothing. Null keys are distinct."""
    known = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    unknown = rows.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key]))
    return first_per_key(known, key, order).join(current.select(*key), key, "left_anti").select(*rows.columns).unionByName(unknown)


def adopt_open(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Each upload request with the session it gets: (request_id, session_id, created). An open session of the same
    project and digest is adopted; else the first request of the pair, by (created_at, request_id), opens one and the
    others adopt it. Requests without a digest always open their own."""
    pair = ["project_id", "declared_sha256"]
    open_ = first_per_key(sessions.where("status = 'in_progress' AND declared_sha256 IS NOT NULL"), pair, ["created_at", "id"]).select(*pair, F.col("id").alias("open_id"))
    first = F.first("request_id").over(Window.partitionBy(*pair).orderBy("created_at", "request_id"))
    named = requests.withColumn("leader", F.when(F.col("declared_sha256").isNull(), F.col("request_id")).otherwise(first))
    joined = named.join(open_, pair, "left")
    session = F.coalesce("open_id", "leader")
    return joined.select("request_id", session.alias("session_id"), (F.col("open_id").isNull() & (F.col("leader") == F.col("request_id"))).alias("created"))


def delete_cascading(parents: DataFrame, children: DataFrame, key: str, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents without `ids` (one column, `key`), and the children that still have one."""
    gone = ids.select(F.col(key).alias("__gone")).distinct()
    return parents.join(gone, F.col(key) == F.col("__gone"), "left_anti"), children.join(gone, F.col(column) == F.col("__gone"), "left_anti")


def delete_blocked(children: DataFrame, key: str, column: str, ids: DataFrame) -> DataFrame:
    """Those of `ids` that children still refer to, so a restricted delete must refuse them."""
    return ids.join(children.select(F.col(column).alias(key)), key, "left_semi")


def claim(jobs: DataFrame, wanted: DataFrame, start: str = "queued", to: str = "running") -> tuple[DataFrame, DataFrame]:
    """Compare and set: (jobs with those of `wanted` (id) that are in status `start` moved to `to`, the ids moved)."""
    asked = wanted.select("id").distinct().withColumn("__asked", F.lit(True))
    marked = jobs.join(asked, "id", "left").withColumn("__won", F.coalesce(F.col("__asked"), F.lit(False)) & (F.col("status") == start))
    moved = marked.withColumn("status", F.when(F.col("__won"), to).otherwise(F.col("status")))
    return moved.drop("__asked", "__won"), moved.where("__won").select("id")


def next_positions(existing: DataFrame, added: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """`added` with `position` going on from how many each parent has."""
    have = existing.groupBy(parent).agg(F.count("*").alias("__have"))
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1
    return added.withColumn("__n", place).join(have, parent, "left").withColumn("position", (F.coalesce("__have", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__have")
