"""Queries of rules for retries, steps, times, titles and uploads. Stand-ins: events for attempts, steps and frames, orders
for times, parts for file names and images, documents for plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.functions import requests, text, timing
from spoolworks.operators import sequences, tagging
from spoolworks.sources import files
from spoolworks.sources.tables import table
from spoolworks.streaming import jobs

# Inputs as SQL that Spark and DuckDB both read.
REPLIES = """SELECT CAST((event_id - event_id % 8) / 8 AS BIGINT) AS scene_id, event_id % 8 AS request, CAST((event_id - event_id % 8) / 8 * 11 AS BIGINT) AS due,
    CASE (event_id * 7 + user_id) % 11 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 400 WHEN 3 THEN 500 WHEN 4 THEN 302 WHEN 5 THEN NULL ELSE 200 END AS status, (event_id * 5 + user_id) % 3 = 0 AS usable, (event_id - event_id % 8) / 8 % 5 / 4.0 AS jitter
    FROM {events}"""
KEYS = "CAST(scene_id % 25 AS STRING)"
STEPS = """SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN concat('step ', event_id % 5) END AS step,
    (event_id % 5) / 5.0 AS begun, (event_id % 5 + 1) / 5.0 AS until, (event_id % 10) / 10.0 AS within FROM {events}"""
TIMES = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN concat({text}, '+05:30') WHEN 1 THEN concat({text}, 'Z') WHEN 2 THEN concat({text}, '-0800') WHEN 3 THEN {text}
    WHEN 4 THEN concat({text}, '+05') WHEN 5 THEN concat({text}, ' UTC') WHEN 6 THEN o_orderpriority WHEN 7 THEN substring({text}, 1, 10) END AS t FROM {orders}"""
PLAN_TEXT = """CASE doc_id % 4 WHEN 0 THEN concat('PROMPT ', doc_id % 90 + 10, ' - ', substring(coalesce(text, ''), 1, 30), chr(10), coalesce(text, ''))
    WHEN 1 THEN concat('| Wave ', doc_id % 7, ': *Titled ', doc_id, '* . | x', chr(10), 'Prompt 7 - Short', chr(10), coalesce(text, '')) ELSE text END"""
NAMES = """CASE p_partkey % 9 WHEN 0 THEN concat(p_name, '.MP4') WHEN 1 THEN concat(p_name, '.tar.mov') WHEN 2 THEN concat(p_name, '.txt') WHEN 3 THEN '.mkv'
    WHEN 4 THEN concat(p_name, '.webm.bak') WHEN 5 THEN p_name WHEN 6 THEN concat('a.avi/', p_name) WHEN 7 THEN concat('a/', p_name, '.m2ts') ELSE concat(p_name, '.') END"""
# Segments of an image in hex: what comes before, EXIF, XMP and a restart marker, the scan.
IMAGE = """concat('FFD8', 'FFE000044A46', CASE WHEN p_partkey % 2 = 0 THEN {exif} ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'FFE10008584D50002F2F' ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN 'FFD3' ELSE '' END, 'FFDA', lpad(CAST(p_partkey AS STRING), 12, '0'))"""
EXIF = "'FFE1000A457869660000ABCD'"


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of 25 keys, each with a bucket of 4 a minute and 60 a day; every event is what a request would be answered."""
    replies = spark.sql(REPLIES, events=table(spark, sf_dir, "events"))
    return tagging.requests_sent(replies.withColumnRenamed("due", "at").withColumn("key", F.expr(KEYS)), per_minute=4, per_day=60)


def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.call_outcomes(_sent(spark, sf_dir)).withColumn("waited", F.round("waited", 6))


def sent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request that these calls made, or that the bucket refused."""
    return _sent(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("at", "waited", "tokens")})


def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("job_failed", "os_error", "key_error", "probe", "disk_full")])
    events = table(spark, sf_dir, "events").withColumn("kind", F.get(kinds, (F.col("event_id") % 6).cast("int")))
    return events.groupBy(requests.failure_cause(F.col("kind"), F.col("event_type")).alias("cause")).agg(F.count("*").alias("n"))


def guide_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.plan_titles(F.expr(PLAN_TEXT)).alias("titles"))
    return found.select("doc_id", F.explode("titles").alias("title"))


def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = spark.sql(TIMES.format(text="date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')", orders="{orders}"), orders=table(spark, sf_dir, "orders"))
    at = timing.utc_time(F.col("t"))
    return times.select("o_orderkey", at["at"].alias("utc"), at["refused"].alias("refused"), at["unreadable"].alias("unreadable"))


def stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the last frame of each stream ends: its time and the step before it."""
    frames = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") / 10).alias("at"))
    return sequences.stream_end(frames, "user_id", "at").select("user_id", F.round("end", 6).alias("end"))


def video_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.has_video_suffix(F.expr(NAMES)).alias("video"))


def step_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of every event, and which of them are persisted."""
    found = jobs.stepped(spark.sql(STEPS, events=table(spark, sf_dir, "events")).selectExpr("job_id", "seq", "step", "double(begun) at", "double(until) until", "double(within) within"))
    return found.withColumn("progress", F.round("progress", 6))


def ended_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terminal write of each job."""
    ends = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"), F.get(F.array(F.lit("succeeded"), F.lit("failed"), F.lit("cancelled")), (F.col("c_custkey") % 3).cast("int")).alias("status"), F.col("c_name").alias("error"), F.col("c_acctbal").alias("finished_at"),
    )
    return jobs.ended(step_boundaries(spark, sf_dir), ends)


def stripped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.unhex(F.expr(IMAGE.format(exif=EXIF)))
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(files.without_exif(image)).alias("image"))


QUERIES = {f.__name__: f for f in (retried_calls, sent_requests, failure_causes, guide_titles, utc_times, stream_ends, video_names, step_boundaries, ended_jobs, stripped_images)}

_STEPPED = f"""
    WITH e AS ({STEPS.format(events="events")}),
    b AS (SELECT *, last_value(CASE WHEN step IS NOT NULL THEN {{'step': step, 'begun': begun, 'until': until}} END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq) AS span FROM e),
    r AS (SELECT job_id, seq, span.step AS step, step IS NOT NULL AS persisted, coalesce(CASE WHEN step IS NOT NULL THEN begun ELSE span.begun + within * (span.until - span.begun) END, 0)::DOUBLE AS reached FROM b)
    SELECT job_id, seq, step, persisted, round(least(1, max(reached) OVER (PARTITION BY job_id ORDER BY seq)), 6)::DOUBLE AS progress FROM r"""

#: A row a request, the next one of each key found from the last: `i` counts a key's scenes, `done` says that one is over.
_SENT = f"""
    WITH RECURSIVE r AS ({REPLIES.format(events="events")}),
    s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY due, scene_id) AS i FROM (SELECT DISTINCT {KEYS.replace("STRING", "VARCHAR")} AS key, scene_id, due::DOUBLE AS due, jitter::DOUBLE AS jitter FROM r)),
    g AS (
        SELECT key, 0::BIGINT AS i, NULL::BIGINT AS scene_id, 0::BIGINT AS request, 0 AS attempt, false AS again, NULL::DOUBLE AS at_s, false AS granted, NULL::INT AS status, 'start' AS verdict, 0::DOUBLE AS waited,
               4::DOUBLE AS tokens, NULL::DOUBLE AS last_s, NULL::DOUBLE AS day, 0::BIGINT AS day_count, 0::DOUBLE AS wait FROM (SELECT DISTINCT key FROM s)
        UNION ALL
        SELECT key, i, scene_id, request, attempt, again, clock, granted, CASE WHEN granted THEN status END,
               CASE WHEN NOT granted THEN 'refused' WHEN status < 400 AND usable THEN 'reply' WHEN status < 400 AND again THEN 'unusable' WHEN status < 400 THEN NULL
                    WHEN status < 500 AND status <> 429 THEN 'permanent' WHEN attempt = 2 THEN 'gave_up' END,
               waited + CASE WHEN granted AND coalesce(status >= 500 OR status = 429, true) AND attempt < 2 THEN pause ELSE 0 END,
               CASE WHEN granted THEN filled - 1 ELSE filled END, CASE WHEN spent < 60 THEN clock ELSE last_s END, today, spent + CASE WHEN granted THEN 1 ELSE 0 END,
               CASE WHEN granted AND coalesce(status >= 500 OR status = 429, true) AND attempt < 2 THEN pause ELSE 0 END
        FROM (SELECT *, spent < 60 AND filled >= 1 AS granted, least(2.0::DOUBLE, 0.2::DOUBLE * pow(2, attempt)) * (1 + 0.5::DOUBLE * jitter) AS pause FROM (
            SELECT *, CASE WHEN spent < 60 THEN least(4.0::DOUBLE, tokens + greatest(0.0::DOUBLE, clock - last_s) * 4 / 60.0::DOUBLE) ELSE tokens END AS filled FROM (
                SELECT n.*, r.status, coalesce(r.usable, false) AS usable, floor(clock / 86400) AS today, CASE WHEN floor(clock / 86400) = day THEN day_count ELSE 0 END AS spent FROM (
                    SELECT g.key, s.i, s.scene_id, s.jitter, CASE WHEN g.verdict IS NULL THEN g.request + 1 ELSE 0 END AS request, CASE WHEN g.verdict IS NOT NULL THEN 0 WHEN g.wait > 0 THEN g.attempt + 1 ELSE g.attempt END AS attempt,
                           g.verdict IS NULL AND g.wait = 0 AS again, CASE WHEN g.verdict IS NULL THEN g.at_s + g.wait ELSE greatest(coalesce(g.at_s, s.due), s.due) END AS clock, CASE WHEN g.verdict IS NULL THEN g.waited ELSE 0 END AS waited,
                           g.tokens, coalesce(g.last_s, s.due) AS last_s, g.day, g.day_count
                    FROM g JOIN s ON s.key = g.key AND s.i = g.i + CASE WHEN g.verdict IS NULL THEN 0 ELSE 1 END) AS n
                LEFT JOIN r ON r.scene_id = n.scene_id AND r.request = n.request)))),
    sent AS (SELECT * FROM g WHERE i > 0)"""

def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


ORACLE_SQL = {
    "sent_requests": f"""{_SENT}
        SELECT key, scene_id, request, attempt, again, round(at_s, 6) AS "at", granted, status, verdict, round(waited, 6) AS waited, round(tokens, 6) AS tokens, day_count FROM sent""",
    "retried_calls": f"""{_SENT}
        SELECT key, scene_id, CASE WHEN max(verdict) IN ('reply', 'unusable') THEN 'api' ELSE 'degraded' END AS source, max(verdict) IN ('reply', 'unusable') AS cached, max(attempt) + 1 AS tries,
               count(*) FILTER (granted) AS tokens, round(max(waited), 6) AS waited, max(verdict) AS verdict FROM sent GROUP BY key, scene_id""",
    "failure_causes": f"""
        WITH k AS (SELECT event_type, ['job_failed', 'os_error', 'key_error', 'probe', 'disk_full'][event_id % 6 + 1] AS kind FROM events)
        SELECT CASE WHEN kind IN ({_quoted(requests.NAMED_FAULTS)}) THEN event_type WHEN kind IN ({_quoted(requests.STORE_FAULTS)}) THEN '{requests.STORE_CAUSE}' ELSE '{requests.UNKNOWN_CAUSE}' END AS cause, count(*) AS n FROM k GROUP BY cause""",
    "guide_titles": rf"""
        WITH t AS (SELECT doc_id, {PLAN_TEXT} AS plan FROM documents),
        f AS (SELECT doc_id, unnest(regexp_extract_all(plan, '(?:PROMPT|Prompt)\s*\d{{1,2}}\s*[—–:\-]\s*([^\n|]{{4,80}})', 1) || regexp_extract_all(plan, '(?:WAVE|Wave)\s*\d\s*[—–:\-]\s*([^\n|]{{3,60}})', 1)) AS raw FROM t)
        SELECT DISTINCT doc_id, regexp_replace(trim(raw, chr(32) || chr(9) || chr(10) || chr(13)), '[.*_ ]+$', '') AS title FROM f
        WHERE length(regexp_replace(trim(raw, chr(32) || chr(9) || chr(10) || chr(13)), '[.*_ ]+$', '')) >= 8""",
    "utc_times": rf"""
        WITH t AS ({TIMES.format(text="strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", orders="orders")}),
        p AS (SELECT *, regexp_extract(t, ':[0-9]{{2}} ?(Z|UTC|[+-][0-9]{{2}}(?::?[0-9]{{2}})?)$', 1) AS zone, try_strptime(t[1:19], ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d']) AS wall FROM t),
        m AS (SELECT *, CASE WHEN zone IN ('Z', 'UTC') THEN 0 WHEN zone <> '' THEN CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END * (zone[2:3]::INT * 60 + coalesce(try_cast(right(regexp_replace(zone[4:], ':', ''), 2) AS INT), 0)) END AS minutes FROM p)
        SELECT o_orderkey, CASE WHEN zone <> '' THEN strftime(wall - to_minutes(minutes), '%Y-%m-%d %H:%M:%S') END AS utc, coalesce(zone = '' AND wall IS NOT NULL, false) AS refused, t IS NOT NULL AND wall IS NULL AS unreadable FROM m""",
    "stream_ends": """
        WITH f AS (SELECT user_id, event_id / 10 AS moment, event_id / 10 - lag(event_id / 10) OVER (PARTITION BY user_id ORDER BY event_id) AS step,
                          row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
        SELECT user_id, round(moment + coalesce(step, 0), 6) AS "end" FROM f WHERE back = 1""",
    "video_names": f"SELECT p_partkey, lower(regexp_extract({NAMES}, '[^/.][^/]*?(\\.[^./]*)$', 1)) IN ({', '.join(repr(x) for x in text.VIDEO_SUFFIXES)}) AS video FROM part",
    "step_boundaries": _STEPPED,
    "ended_jobs": f"""
        WITH s AS ({_STEPPED}),
        l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1)
        SELECT c_custkey AS job_id, CASE c_custkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'cancelled' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE coalesce(progress, 0.0::DOUBLE) END AS progress,
               step, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS error, c_acctbal AS finished_at FROM customer LEFT JOIN l ON job_id = c_custkey""",
    "stripped_images": f"""
        WITH RECURSIVE i AS (SELECT p_partkey, {IMAGE.format(exif=EXIF).replace('STRING', 'VARCHAR')} AS h FROM part),
        w AS (SELECT p_partkey, h[1:4] AS kept, h[5:] AS rest FROM i WHERE h[1:4] = 'FFD8'
              UNION ALL
              SELECT p_partkey, CASE WHEN rest[1:4] = 'FFE1' AND rest[9:size] LIKE '457869660000%' THEN kept ELSE kept || rest[1:size] END, rest[size + 1:]
              FROM (SELECT *, CASE WHEN rest[3:4] BETWEEN 'D0' AND 'D9' THEN 4 ELSE 4 + 2 * ('0x' || rest[5:8])::INT END AS size FROM w WHERE rest[1:2] = 'FF' AND rest[3:4] <> 'DA'))
        SELECT p_partkey, kept || rest AS image FROM w WHERE rest[1:2] <> 'FF' OR rest[3:4] = 'DA'
        UNION ALL SELECT p_partkey, h FROM i WHERE h[1:4] <> 'FFD8'""",
}
