"""Rules at the edges of the service: who may connect, what may be asked for, what a client shows and where it seeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SENDING_STEP = r"^sending scene (\d+) of (\d+) to Gemini for analysis$"
ASSUMED_FPS = 30.0
LIMITS = (1, 200)
STORE_CAUSE = "the media store could not be read or written"
UNKNOWN_CAUSE = "this job failed unexpectedly - the engine log has the details"
#: Faults that carry a message for the user, and faults of the store's disk.
NAMED_FAULTS = ("job_failed", "encoder", "probe", "scene_detection", "motion_read", "frame_scoring")
STORE_FAULTS = ("os_error", "file_missing", "permission", "disk_full")


def allowed_origin(origin: Column, allowed: list[str]) -> Column:
    """Listed origins pass, and a missing one, which no browser sends."""
    return origin.isNull() | origin.isin(*allowed)


def page_limit(limit: int, least: int = LIMITS[0], most: int = LIMITS[1]) -> int:
    """`limit` as it is, or an error: a limit out of bounds is refused, not moved."""
    if not least <= limit <= most:
        raise ValueError(f"limit must be {least} to {most}")
    return limit


def sending_step(step: Column) -> Column:
    """struct(index, total) of a job's step that sends a scene; null for other steps."""
    index, total = (F.regexp_extract(step, SENDING_STEP, i).cast("long") for i in (1, 2))
    return F.when(step.rlike(SENDING_STEP), F.struct(index.alias("index"), total.alias("total")))


def shown_tags(tags: dict[str, Column]) -> Column:
    """An array of struct(name, value) of the tags that have a value, in the order given."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in tags.items()])
    return F.filter(pairs, lambda t: t["value"].isNotNull())


def frame_step(normalized: Column, source: Column, assumed: float = ASSUMED_FPS) -> Column:
    """Seconds of one frame, by the first known rate; a rate of 0 or less counts as the assumed one."""
    rate = F.coalesce(normalized, source, F.lit(assumed))
    return F.lit(1.0) / F.when(rate > 0, rate).otherwise(assumed)


def seek(at: Column, delta: Column, duration: Column) -> Column:
    """Where a seek ends, inside the clip; a clip of unknown length stays at 0."""
    known = F.when(F.isnan(duration) | (F.abs(duration) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(duration, F.lit(0.0)))
    return F.least(F.greatest(F.lit(0.0), at + delta), known)


def finalize_outcome(fault: Column) -> Column:
    """struct(code, status) of an upload whose probe ended in `fault` (null: none): missing tools keep it open for a retry."""
    code = F.when(fault.isNull(), 200).when(fault == "tool_unavailable", 503).otherwise(415)
    status = F.when(fault.isNull(), "complete").when(fault == "tool_unavailable", "in_progress").otherwise("aborted")
    return F.struct(code.cast("int").alias("code"), status.alias("status"))


def failure_cause(kind: Column, message: Column) -> Column:
    """What the user is told of a fault: a named one's own message, one sentence for the store's, one for all others."""
    return F.when(kind.isin(*NAMED_FAULTS), message).when(kind.isin(*STORE_FAULTS), STORE_CAUSE).otherwise(UNKNOWN_CAUSE)


def scene_context(start: Column, end: Column) -> Column:
    """struct(duration, position) of a scene."""
    return F.struct((end - start).alias("duration"), start.alias("position"))
