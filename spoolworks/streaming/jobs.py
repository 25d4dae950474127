"""The job state machine: queued, running, then succeeded, failed or cancelled."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.streaming.folds import fold, stream_fold

OPEN, OVER = ("queued", "running"), ("succeeded", "failed", "cancelled")
OUT = "job_id long, seq long, action string, accepted boolean, status string, progress double"
STATE = "status string, progress double, has_task boolean, cancel_requested boolean"
NEW = {"status": "queued", "progress": 0.0, "has_task": False, "cancel_requested": False}


def step(state: dict[str, Any] | None, event: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """One action: submit, start, task, report, finish, fail, cancel, recover.

    Only a queued job starts; its task comes into being a moment later, and only a task reports and finishes. A cancel has three
    cases: a queued job ends at once, and so does one whose task exists; a running job without a task yet remembers the
    request, and ends the moment the task exists. Reports raise progress within 0 and 1, never lower it. Success sets progress
    to 1, other ends keep the last report. After a crash, recover puts an open job back in the queue, from the start and without a
    request to cancel. States that are over stay.
    """
    now = dict(state or NEW)
    action, accepted = event["action"], False
    running = now["status"] == "running"
    if action == "submit":
        accepted = state is None
    elif action == "start" and now["status"] == "queued":
        now["status"], accepted = "running", True
    elif action == "task" and running and not now["has_task"]:
        now["has_task"], accepted = True, True
        if now["cancel_requested"]:
            now["status"] = "cancelled"
    elif action == "report" and running and now["has_task"]:
        value = event["value"]
        now["progress"] = max(now["progress"], min(1.0, max(0.0, float(value)))) if value == value else now["progress"]
        accepted = True
    elif action == "finish" and running and now["has_task"]:
        now["status"], now["progress"], accepted = "succeeded", 1.0, True
    elif action == "fail" and running:
        now["status"], accepted = "failed", True
    elif action == "cancel" and now["status"] in OPEN:
        accepted = True
        if running and not now["has_task"]:
            now["cancel_requested"] = True
        else:
            now["status"] = "cancelled"
    elif action == "recover" and now["status"] in OPEN:
        now, accepted = dict(NEW), True
    return now, {"job_id": event["job_id"], "seq": event["seq"], "action": action, "accepted": accepted, "status": now["status"], "progress": now["progress"]}


def run_batch(actions: DataFrame) -> DataFrame:
    """actions (job_id, seq, action, value), each answered in the order of seq."""
    return fold(actions.select("job_id", "seq", "action", "value"), "job_id", ["seq"], step, OUT)


def run_stream(actions: DataFrame) -> DataFrame:
    return stream_fold(actions.select("job_id", "seq", "action", "value"), "job_id", ["seq"], step, OUT, STATE)


def stepped(events: DataFrame) -> DataFrame:
    """`events` (job_id, seq, step, at, until, within) with `progress`, the step they belong to, and whether they are persisted.

    An event with a step enters it: the boundary is written and published. The others are ticks inside the step's span
    [at, until), which are published only. Progress never falls; before any step it is 0.
    """
    so_far = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.last(F.when(F.col("step").isNotNull(), F.struct("step", "at", "until")), ignorenulls=True).over(so_far)
    spanned = events.withColumn("__span", span)
    reached = F.when(F.col("step").isNotNull(), F.col("at")).otherwise(F.col("__span.at") + F.col("within") * (F.col("__span.until") - F.col("__span.at")))
    moved = spanned.withColumn("__to", F.coalesce(reached, F.lit(0.0)))
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("__to").over(so_far)))
    return moved.select("job_id", "seq", F.col("__span.step").alias("step"), F.col("step").isNotNull().alias("persisted"), progress.alias("progress"))


def ended(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """The terminal write of each job: (job_id, status, progress, step, error, finished_at).

    steps: what stepped() gives; ends (job_id, status, error, finished_at). Success has progress 1, other ends the last that
    was reported; only a failure has an error.
    """
    last = steps.groupBy("job_id").agg(F.max_by(F.struct("step", "progress"), "seq").alias("last"))
    done = F.col("status") == "succeeded"
    return ends.join(last, "job_id", "left").select(
        "job_id", "status", F.when(done, 1.0).otherwise(F.coalesce("last.progress", F.lit(0.0))).alias("progress"),
        F.col("last.step").alias("step"), F.when(F.col("status") == "failed", F.col("error")).alias("error"), "finished_at",
    )


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a crash: open ones are queued again from the start."""
    was_open = F.col("status").isin(*OPEN)
    return jobs.withColumns(
        {
            "status": F.when(was_open, "queued").otherwise(F.col("status")),
            "progress": F.when(was_open, 0.0).otherwise(F.col("progress")),
            "step": F.when(~was_open, F.col("step")),
            "started_at": F.when(~was_open, F.col("started_at")),
        }
    )
