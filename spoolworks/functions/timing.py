"""Times, frames and energies of scenes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MOTION_FULL, AUDIO_FULL, SILENCE_DB = 6.0, 0.5, -60.0
BUDGET_FLOOR, BUDGET_PER_SECOND, BUDGET_UNKNOWN = 120.0, 6.0, 900.0
BACKOFF_BASE, BACKOFF_MOST, BACKOFF_JITTER = 0.2, 2.0, 0.5


def linear_from_db(db: Column) -> Column:
    """Amplitude of a level; null, NaN and levels under -60 dB are silence."""
    return F.when((db >= SILENCE_DB) & ~F.isnan(db), F.pow(F.lit(10.0), db / 20)).otherwise(0.0)


def energy_score(motion: Column, audio: Column) -> Column:
    """0 to 100: half motion, half loudness, each up to its full mark, two decimals; null if either is."""
    return F.when(motion.isNotNull() & audio.isNotNull(), F.round(100 * (0.5 * F.least(F.lit(1.0), motion / MOTION_FULL) + 0.5 * F.least(F.lit(1.0), audio / AUDIO_FULL)), 2))


def frame_at(seconds: Column, fps: Column) -> Column:
    """The frame number, halves to even."""
    return F.bround(seconds * fps, 0).cast("long")


def least_scene_frames(seconds: Column, fps: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), frame_at(seconds, fps))


def candidate_times(start: Column, end: Column, count: int) -> Column:
    """`count` times evenly inside (start, end)."""
    if count < 1:
        raise ValueError("at least one candidate is needed")
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: start + (end - start) * i / (count + 1))


def sample_frames(start: Column, end: Column, fps: Column, count: int) -> Column:
    """At least two and at most `count` distinct frame numbers spread over [start, end), ascending."""
    first = frame_at(start, fps)
    last = F.greatest(first + 1, frame_at(end, fps))
    wanted = F.greatest(F.lit(2).cast("long"), F.least(F.lit(count).cast("long"), last - first + 1))
    picks = F.transform(F.sequence(F.lit(0).cast("long"), wanted - 1), lambda i: F.bround(first + (last - first) * i / (wanted - 1), 0).cast("long"))
    return F.array_sort(F.array_distinct(picks))


def proxy_height(height: Column) -> Column:
    """At most 720 and even."""
    return (F.floor(F.least(F.lit(720), height) / 2) * 2).cast("int")


def strip_cells(duration: Column) -> Column:
    """A thumbnail for every two seconds, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(duration / 2))


def render_budget(duration: Column) -> Column:
    return F.when(duration.isNull() | (duration <= 0), BUDGET_UNKNOWN).otherwise(F.greatest(F.lit(BUDGET_FLOOR), duration * BUDGET_PER_SECOND))


def backoff(attempt: Column, draw: Column) -> Column:
    """Seconds before a retry; `draw` is the jitter, 0 to 1."""
    return F.least(F.lit(BACKOFF_MOST), F.lit(BACKOFF_BASE) * F.pow(F.lit(2.0), attempt)) * (1 + BACKOFF_JITTER * draw)


def progress_fraction(line: Column, total_seconds: Column) -> Column:
    """The done part that a progress line tells, 0 to 1; null for other lines and for no number."""
    from spoolworks.functions.probe import number

    micros = number(F.regexp_extract(F.trim(line), r"^out_time_us=(.*)$", 1))
    return F.when(micros.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), micros / 1e6 / total_seconds)))


def utc_time(text: Column) -> Column:
    """struct(at, refused, unreadable): an ISO time with an offset (Z, UTC, +05, +0530, +05:30) as UTC wall clock text. One without an offset
    is refused, as its moment is unknown; what is no time at all is unreadable. Null is neither."""
    zoned = text.rlike(r":[0-9]{2}([.][0-9]+)? ?(Z|UTC|[+-][0-9]{2}(:?[0-9]{2})?)$")
    moment = F.when(zoned, text.try_cast("timestamp"))
    shown = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    naive = F.coalesce(~zoned & text.try_cast("timestamp_ntz").isNotNull(), F.lit(False))
    return F.struct(shown.alias("at"), naive.alias("refused"), (text.isNotNull() & moment.isNull() & ~naive).alias("unreadable"))


def span_progress(at: Column, until: Column, i: Column, n: Column) -> Column:
    """Progress after item i (from 0) of n within [at, until)."""
    return at + (until - at) * i / F.greatest(n, F.lit(1))


def overall_level(report: Column) -> Column:
    """The last RMS level of a loudness report in dB, null if it has none."""
    found = F.regexp_extract_all(report, F.lit(r"RMS level dB:\s*(-?inf|-?[\d.]+)"), 1)
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last == "-inf", F.lit(float("-inf"))).when(last == "inf", F.lit(float("inf"))).otherwise(last.try_cast("double"))
