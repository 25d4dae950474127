"""Lookups that a client makes over lists of jobs and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolworks.sources.tables import Scratch

# States that a job leaves again.
OPEN = ("queued", "running")


def first_match(rows: DataFrame, scope: str, order: str, wanted: Column) -> DataFrame:
    """The first row in each scope that is wanted, in one aggregation without a sort."""
    rest = [c for c in rows.columns if c not in (scope, order)]
    found = rows.where(wanted).groupBy(scope).agg(F.min_by(F.struct(order, *rest), order).alias("found"))
    return found.select(scope, "found.*")


def named_match(found: DataFrame, names: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """`found` with the name of the first of `names` with its key; null where there is none."""
    first = names.groupBy(key).agg(F.min_by(name, order).alias(name))
    return found.join(first, key, "left")


def finished_signature(jobs: DataFrame, scope: str, job: str, status: str, still_open: tuple[str, ...] = OPEN) -> DataFrame:
    """(scope, finished): `id:status` of the jobs that ended, sorted as text; a change says that the list must be read again.

    The text is as long as the scope's ended jobs together and is made in one row: for scopes of up to a million jobs.
    `finished_sum` says the same of scopes of any size.
    """
    ended = F.when(~F.col(status).isin(*still_open), F.concat_ws(":", F.col(job).cast("string"), status))
    return jobs.groupBy(scope).agg(F.array_join(F.sort_array(F.collect_list(ended)), ",").alias("finished"))


def finished_sum(jobs: DataFrame, scope: str, job: str, status: str, still_open: tuple[str, ...] = OPEN) -> DataFrame:
    """(scope, n, finished): how many jobs ended, and the sum of their hashes; it hangs on no order and gathers nothing."""
    ended = ~F.col(status).isin(*still_open)
    hashed = F.when(ended, F.xxhash64(F.col(job).cast("string"), status).cast("decimal(38,0)"))
    return jobs.groupBy(scope).agg(F.count_if(ended).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).cast("decimal(38,0)").alias("finished"))


def problem_fields(paths: Column) -> Column:
    """The fields of an array of paths (arrays of names) that failed, each once, in the order of their first failure."""
    return F.array_join(F.array_distinct(F.filter(F.transform(paths, lambda p: F.array_join(p, ".")), lambda f: F.length(f) > 0)), ", ")


def descendants(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(root, node, depth) of every node of a forest under its root, itself included, whatever the depth.

    Nodes with a null parent are roots. Each round doubles how far up every node sees, so a chain of n nodes takes about
    log2(n) rounds, each a join written to the shared folder. Nodes on a cycle or under a parent that isn't there have no
    root and are left out.
    """
    scratch = Scratch(nodes.sparkSession)
    is_root = F.col(parent).isNull()
    start = nodes.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("above"), F.when(is_root, 0).otherwise(1).alias("depth"), is_root.alias("done"))
    walked, turn = scratch.written(start, "walk-0"), 0
    left, before = walked.where("NOT done").count(), None
    while left and left != before:
        up = walked.select(F.col("node").alias("above"), F.col("above").alias("higher"), F.col("depth").alias("more"), F.col("done").alias("over"))
        moved = walked.where("NOT done").join(up, "above").select("node", F.col("higher").alias("above"), (F.col("depth") + F.col("more")).alias("depth"), F.col("over").alias("done"))
        turn += 1
        walked = scratch.written(walked.where("done").union(moved), f"walk-{turn}")
        scratch.remove(f"walk-{turn - 1}")
        left, before = walked.where("NOT done").count(), left
    return walked.where("done").select(F.col("above").alias("root"), "node", "depth")
