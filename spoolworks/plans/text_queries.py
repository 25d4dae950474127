"""Text, plan, tagging and state queries. Stand-ins: documents and benchmark for a corpus and its titles, pages for
marked-up files, conversations for lists with wrapped lines, events for requests, jobs and uploads."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.functions import text
from spoolworks.operators import plan as plans
from spoolworks.operators import rows, scan, sequences, tagging
from spoolworks.sources import files
from spoolworks.sources.tables import shared_dir, table
from spoolworks.streaming import jobs, sinks, uploads

# Inputs by rule over whole tables, as SQL that Spark and DuckDB both read.
PLAN = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN lpad('' || (o_orderkey % 40), 2, '0') || '–' || lpad('' || (o_orderkey % 40 + o_custkey % 7), 2, '0') WHEN 1 THEN '' || (o_orderkey % 9)
    WHEN 2 THEN lpad('' || (o_orderkey % 90), 2, '0') WHEN 3 THEN lpad('' || (o_orderkey % 50 + 40), 2, '0') || ' - ' || lpad('' || (o_orderkey % 40), 2, '0') WHEN 4 THEN '' ELSE 'from ' || (o_orderkey % 80 + 10) END AS span,
    CASE o_orderkey % 5 WHEN 0 THEN '*yes* if ' || o_orderstatus WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN '`YES`' ELSE o_orderpriority END AS review,
    CASE o_orderkey % 4 WHEN 0 THEN 'Spark · ' || o_orderpriority || ' | Arrow' WHEN 1 THEN '' WHEN 2 THEN o_orderstatus ELSE ' · ' || o_orderstatus END AS tech,
    CASE o_orderkey % 3 WHEN 0 THEN '**bold_' || o_custkey || '**' WHEN 1 THEN '`' || o_orderpriority || '` ' ELSE '***' END AS cell FROM {orders}"""
GUIDES = """SELECT c_custkey, '| ' || (c_custkey % 6) || ' – Camp *' || c_name || '* | x | ' || lpad('' || (c_custkey % 60 + 10), 2, '0') || CASE WHEN c_custkey % 2 = 0 THEN '–' || (c_custkey % 60 + 12) ELSE '' END || ' |' || chr(10)
    || CASE WHEN c_custkey % 3 = 0 THEN '| Wave ' || (c_custkey % 6) || ' | 02 | `' || (c_custkey % 9 + 1) || ' weeks` |' || chr(10) ELSE '' END
    || '| ' || (c_custkey % 60 + 10) || ' | **' || c_name || '** | does a thing | ' || CASE WHEN c_custkey % 5 = 0 THEN '*yes*, late' ELSE 'no' END || ' | Spark · ' || c_mktsegment || ' |' || chr(10)
    || '| ' || (c_custkey % 60 + 12) || ' | Second | another | no | Arrow |' || chr(10) || '## PROMPT ' || (c_custkey % 60 + 10) || ' — First' || chr(10) || '### Deliverables' || chr(10)
    || '1. `' || c_mktsegment || '`' || chr(10) || '   goes on ' || c_custkey || chr(10) || '2. two' || chr(10) AS text FROM {customer}"""
# `^` stands for an escaped quote, as the two engines differ on backslashes in literals.
REPLIES = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'broken' || doc_id WHEN 1 THEN '{{"candidates":[]}}' ELSE '{{"candidates":[{{"content":{{"parts":[' || replace(CASE doc_id % 9
    WHEN 2 THEN '{{"text":"{{^content_type^:' || doc_id || '}}"}}' WHEN 3 THEN '{{"text":"{{}}"}}' WHEN 4 THEN '{{"text":"not json"}}' WHEN 5 THEN '{{"text":"[1]"}}'
    WHEN 6 THEN '{{"text":"{{^content_type^:^' || source || '^,^energy_level^:"}},{{"text":"null}}"}}' ELSE '{{"text":"{{^content_type^:^' || lang || '^,^energy_level^:"}},{{"text":"^' || source || '^}}"}}' END, '^', chr(92) || '"') || ']}}}}]}}' END AS reply FROM {documents}"""
JOB_ACTIONS = """SELECT (event_id - event_id % 12) / 12 AS job_id, event_id AS seq, CASE WHEN event_id % 12 < 2 THEN 'start' WHEN event_id % 12 = 4 THEN 'task' ELSE CASE (event_id * 5 + user_id * 3) % 16 WHEN 0 THEN 'submit' WHEN 1 THEN 'start'
    WHEN 2 THEN 'finish' WHEN 3 THEN 'cancel' WHEN 4 THEN 'fail' WHEN 5 THEN 'recover' WHEN 6 THEN 'task' ELSE 'report' END END AS action, value / 100 AS value FROM {events}"""
UPLOAD_ACTIONS = """SELECT (event_id - event_id % 20) / 20 AS upload_id, event_id AS seq, CASE WHEN event_id % 20 >= 17 THEN 'finalize' WHEN event_id % 20 = 16 AND event_id % 9 = 0 THEN 'abort' ELSE 'chunk' END AS action,
    event_id % 20 * 10 - CASE WHEN event_id % 9 = 4 THEN 10 ELSE 0 END AS offset, 10 AS length, 160 AS declared FROM {events}"""
# Pieces of 700 characters in requests: some are sent again, some never, and some uploads declare too little.
CHUNKS = """SELECT doc_id, i * 2 AS seq, begun AS start, size, whole - CASE WHEN doc_id % 11 = 0 THEN 5 ELSE 0 END AS declared, piece FROM {pieces} WHERE (doc_id * 7 + i) % 23 <> 0
    UNION ALL SELECT doc_id, i * 2 + 1, begun, size, whole, piece FROM {pieces} WHERE (doc_id + i) % 5 = 0"""
PLANTED = """concat_ws(chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Wave 1 - Solid Ground' || chr(10) || 'Wave 2 - Next Step' || chr(10) || 'Wave 3 - Last Mile' END,
    CASE WHEN doc_id % 5 = 0 THEN 'make verify-01 make verify-02 and make verify-02' END, CASE WHEN doc_id % 7 = 0 THEN 'docs/reports/prompt-01.md docs/reports/prompt-02.md' END,
    CASE WHEN doc_id % 4 = 0 THEN '2-3 weeks (Wave 1 total), 4 weeks for Prompt 2' END, CASE WHEN doc_id % 11 = 0 THEN 'id: "01", x name: "First of all" and ID = 02 then name="Second"' END,
    CASE WHEN doc_id % 13 = 0 THEN '| 01 | First one | a summary that is long enough | no | Spark |' || chr(10) || '| 02 | Second | short | no | Spark |' END, text)"""


def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("title_id"), "text")
    return scan.title_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), titles)


def leak_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals in documents to which lines of a plan were added by rule."""
    found = scan.leak_verdict(table(spark, sf_dir, "documents").select("doc_id", F.expr(PLANTED).alias("text")))
    return found.select("doc_id", "n_wave_titles", "n_prompt_entries", "n_prompt_rows", "n_gate_commands", "n_timelines", "n_report_paths", "strongest", "combined", "leak")


def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that begin at lines: where each starts, how long it is, and what it holds."""
    found = scan.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 1000, 100)
    return found.select("doc_id", "window", "start", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def leak_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the same plans from small windows that are scanned apart, their hits united."""
    planted = table(spark, sf_dir, "documents").select("doc_id", F.expr(PLANTED).alias("text"))
    return scan.leak_verdict_of_windows(scan.windows(planted, "doc_id", "text", 600, 200), "doc_id")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each list item of a page starts, and where it ends: at the next or at the page's end."""
    cuts = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"), F.posexplode(F.split("html", "<li>")).alias("i", "piece"))
    start = F.sum(F.length("piece") + 4).over(Window.partitionBy("page_id").orderBy("i")) - F.length("piece") - 4
    return sequences.sections(cuts.withColumn("start", start), "page_id", "start", "n").select("page_id", "i", "start", "end")


def folded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the assistant joined to the user's turn before them."""
    turns = table(spark, sf_dir, "conversations")
    found = sequences.folded_lines(turns, "conv_id", "turn", "text", F.col("role") == "user")
    return found.select("conv_id", "item", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def plan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.sql(PLAN, orders=table(spark, sf_dir, "orders"))
    note = text.review_note(F.col("review"))
    return plan.select("o_orderkey", F.array_join(text.expanded_range(F.col("span")), ",").alias("ids"), note["required"].alias("required"), note["note"].alias("note"), F.array_join(text.parts_of(F.col("tech")), ",").alias("tech"), text.without_emphasis(F.col("cell")).alias("cell"))


def plan_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    guides = spark.sql(GUIDES, customer=table(spark, sf_dir, "customer"))
    found = plans.prompts(guides.select(F.col("c_custkey").alias("path"), "text"))
    return found.select(F.col("path").alias("c_custkey"), "id", "name", "review_required", "wave", "wave_title", "timeline", F.array_join("tech", ",").alias("tech"), F.array_join("deliverables", ";").alias("deliverables"))


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, lengths and digests of all files of all tables."""
    return files.digests(spark, sf_dir).select("name", "length", "sha256")


def clip_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's frame handle looked up by position in its user's times; beyond them the error is endless."""
    events = table(spark, sf_dir, "events")
    asked = events.select("user_id", "event_id", (F.col("event_id") % 90).cast("int").alias("frame"))
    # Only positions that can be asked for are kept of a user, so a busy one is cut short before the shuffle.
    # Events without an id come last, as in the SQL, so they move no other event's position.
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("event_id")))
    times = events.select("user_id", F.col("event_id").alias("moment"), place.alias("place")).where("place <= 90").select("user_id", "moment", (F.col("place") - 1).alias("frame"))
    return asked.join(times, ["user_id", "frame"], "left").select("event_id", "frame", F.coalesce(F.abs(F.col("moment") - F.col("event_id")).cast("double"), F.lit(1e308)).alias("error"))


def plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary lookup with defaults: orders to their priority's wave, `Unassigned` and -1 without one."""
    waves = spark.sql("SELECT * FROM VALUES ('1-URGENT', 1, 'now'), ('2-HIGH', 2, 'soon') AS t(o_orderpriority, wave, title)")
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(waves, "o_orderpriority", "left")
    return joined.select("o_orderkey", F.coalesce("wave", F.lit(-1)).alias("wave"), F.coalesce("title", F.lit("Unassigned")).alias("title"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = spark.sql(REPLIES, documents=table(spark, sf_dir, "documents")).withColumn("tags", tagging.parsed_reply(F.col("reply")))
    return replies.select("doc_id", F.col("tags").isNotNull().alias("usable"), F.col("tags.content_type").alias("content_type"), F.col("tags.energy_level").alias("energy_level"))


def prompt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.metric(F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 4 + 0.001)).alias("metric"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") % 4).cast("string").alias("key"), F.col("event_id").alias("request_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.token_bucket(_requests(spark, sf_dir), per_minute=3, per_day=40).select("key", "request_id", "granted", F.round("tokens", 6).alias("tokens"), "day_count")


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as cache, a fake caller that fails on long texts, and a budget for the misses."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cache = labels.select(F.col("doc_id").alias("scene_id"), F.col("quality").cast("string").alias("tag"))
    scenes = docs.select(F.col("doc_id").alias("scene_id"), F.length("text").alias("length"))
    granted = scenes.where("scene_id % 3 <> 0").select("scene_id")

    def call(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda n: None if n > 5000 else f"tag-{n % 7}")

    return tagging.cache_first(scenes, cache, granted, call, "length")


def cached_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)[0]


def cache_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the tagging adds to the cache: of completed calls only."""
    return _tagged(spark, sf_dir)[1]


def _job_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOB_ACTIONS, events=table(spark, sf_dir, "events")).withColumn("job_id", F.col("job_id").cast("long"))


def job_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_batch(_job_actions(spark, sf_dir))


def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit(0.5).alias("progress"), F.lit("step").alias("step"), F.col("o_orderdate").alias("started_at"))
    return jobs.recovered(before)


def _upload_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(UPLOAD_ACTIONS, events=table(spark, sf_dir, "events"))
    return found.select("seq", "action", *[F.col(c).cast("long").alias(c) for c in ("upload_id", "offset", "length", "declared")])


def upload_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.run_batch(_upload_actions(spark, sf_dir))


def uploaded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of what each text's upload holds, of pieces that came twice, never, or beyond the declared size."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("whole"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,700}"), F.lit(0))).alias("i", "piece"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sized = cut.withColumn("size", F.octet_length("piece").cast("long"))
    chunks = spark.sql(CHUNKS, pieces=sized.withColumn("begun", F.coalesce(F.sum("size").over(before), F.lit(0))))
    return uploads.stored_digests(chunks.select(F.col("doc_id").alias("upload_id"), F.col("seq").cast("long"), F.col("start").alias("offset"), F.col("piece").cast("binary").alias("body"), F.col("declared").cast("long")))


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, from a stream of all events into a sink that may be replayed."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    changes = sinks.once(events.withColumn("at", F.col("ts").cast("timestamp")), ["event_id"], "at", "400 days").select("user_id", "event_id", "event_type", "value")
    place = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    sinks.write_changes(changes, f"{place}/table", f"{place}/marks").awaitTermination()
    return sinks.current(spark, f"{place}/table", ["user_id"], ["event_id"])


def adopted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    digest = F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("d"), (F.col("o_orderkey") % 5).cast("string")))
    every = orders.select((F.col("o_custkey") % 50).alias("project_id"), digest.alias("declared_sha256"), "o_orderkey", "o_orderdate", "o_orderstatus")
    sessions = every.where("o_orderkey % 2 = 0").select("project_id", "declared_sha256", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "in_progress").otherwise("completed").alias("status"))
    requests = every.where("o_orderkey % 2 = 1").select("project_id", "declared_sha256", F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"))
    return rows.adopt_open(sessions, requests)


def resume_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", uploads.resume_offset(F.col("p_size"), (F.col("p_partkey") % 40).cast("int")).alias("offset"))


QUERIES = {f.__name__: f for f in (
    title_matches, leak_verdict, leak_windows, text_windows, page_sections, folded_turns, plan_cells, plan_prompts, stored_files, clip_neighbours, plan_lookup, model_replies, prompt_metrics, token_bucket,
    cached_tagging, cache_additions, job_state_machine, job_recovery, upload_fold, uploaded_texts, streamed_states, adopted_uploads, resume_offsets,
)}

_FLAT = "replace(lower(regexp_replace({0}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), 'ß', 'ss')"

_JUDGED = f"""s AS (SELECT *, greatest({", ".join(f"n_{n}" for n in text.SIGNALS)}) AS strongest, {" + ".join(f"CASE WHEN n_{n} >= 2 THEN n_{n} ELSE 0 END" for n in text.SIGNALS)} AS combined FROM c)
        SELECT doc_id, {", ".join(f"n_{n}" for n in text.SIGNALS)}, strongest, combined, strongest >= 3 OR combined >= 6 AS leak FROM s"""


def _hits(name: str) -> str:
    """A signal's hits in `t`."""
    pattern, group = text.SIGNALS[name]
    return f"list_transform(regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}', {group}), lambda h: lower(trim(h)))"


def _windows(size: int, overlap: int, texts: str) -> str:
    """Windows of `texts` (doc_id, t): where the tail before a window has a line feed, it begins after the first one, and the one before
    ends with the last one."""
    return f"""texts AS ({texts}),
        cut AS (SELECT doc_id, t, unnest(range(greatest(1, ceil(length(t) / {size})::INT))) AS w FROM texts),
        tails AS (SELECT *, w * {size} - {overlap} + CASE WHEN w > 0 THEN instr(substring(t, w * {size} - {overlap} + 1, {overlap}), chr(10)) ELSE {overlap} END AS start,
                  (w + 1) * {size} - CASE WHEN (w + 1) * {size} >= length(t) THEN 0 ELSE greatest(0, instr(reverse(substring(t, (w + 1) * {size} - {overlap} + 1, {overlap})), chr(10)) - 1) END AS stop FROM cut),
        windows AS (SELECT doc_id, w, start, substring(t, start + 1, stop - start) AS piece FROM tails)"""


def _rows(pattern: str, *names: str) -> str:
    """The matches of a pattern in `text`, a row each: its groups by name, its place `i`."""
    found = [f"unnest(regexp_extract_all(text, '{pattern}', {n + 1})) AS {name}" for n, name in enumerate(names)]
    return ", ".join([*found, f"unnest(range(len(regexp_extract_all(text, '{pattern}', 1)))) AS i"])


def _plain(text_: str) -> str:
    return f"trim(regexp_replace({text_}, '[*`]+', '', 'g'))"


ORACLE_SQL = {
    "title_matches": f"SELECT doc_id, item_id AS title_id FROM documents d JOIN benchmark b ON contains({_FLAT.format('d.text')}, {_FLAT.format('trim(b.text)')}) WHERE length(b.text) >= 8",
    "leak_verdict": f"""
        WITH c AS (SELECT doc_id, {", ".join(f"len(list_distinct({_hits(n)})) AS n_{n}" for n in text.SIGNALS)} FROM (SELECT doc_id, {PLANTED} AS t FROM documents)),
        {_JUDGED}""",
    "leak_windows": f"""
        WITH {_windows(600, 200, f"SELECT doc_id, {PLANTED} AS t FROM documents")},
        h AS (SELECT doc_id, {", ".join(f"flatten(list({_hits(n)})) AS {n}" for n in text.SIGNALS)} FROM (SELECT doc_id, piece AS t FROM windows) GROUP BY doc_id),
        c AS (SELECT doc_id, {", ".join(f"len(list_distinct({n}))::INT AS n_{n}" for n in text.SIGNALS)} FROM h),
        {_JUDGED}""",
    "text_windows": f"""WITH {_windows(1000, 100, "SELECT doc_id, coalesce(text, '') AS t FROM documents")}
        SELECT doc_id, w::INT AS "window", start, length(piece) AS n, md5(piece) AS text_md5 FROM windows""",
    "page_sections": """
        WITH p AS (SELECT page_id, length(html) AS n, unnest(string_split(html, '<li>')) AS piece, unnest(range(len(string_split(html, '<li>'))))::INT AS i FROM pages),
        s AS (SELECT page_id, n, i, CAST(sum(length(piece) + 4) OVER (PARTITION BY page_id ORDER BY i) - length(piece) - 4 AS BIGINT) AS start FROM p)
        SELECT page_id, i, start, coalesce(lead(start) OVER (PARTITION BY page_id ORDER BY start), n) AS "end" FROM s""",
    "folded_turns": """
        WITH m AS (SELECT conv_id, turn, trim(text, ' ') AS t, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM conversations)
        SELECT conv_id, item, md5(string_agg(t, ' ' ORDER BY turn)) AS text_md5 FROM m WHERE item > 0 GROUP BY conv_id, item""",
    "plan_cells": rf"""
        WITH p AS (SELECT *, try_cast(nullif(regexp_extract(span, '([0-9]{{2}})(?:\s*[—–-]\s*([0-9]{{2}}))?', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(span, '([0-9]{{2}})(?:\s*[—–-]\s*([0-9]{{2}}))?', 2), '') AS INT) AS b FROM ({PLAN.format(orders="orders")}))
        SELECT o_orderkey, coalesce(array_to_string(list_transform(range(a, coalesce(b, a) + 1), lambda n: lpad(n::VARCHAR, 2, '0')), ','), '') AS ids, contains(lower(review), 'yes') AS required,
               nullif(trim(regexp_replace(review, '[*`]+', '', 'g')), '') AS note, array_to_string(list_filter(list_transform(regexp_split_to_array(tech, '\s*[·|]\s*'), lambda t: trim(t)), lambda t: t <> ''), ',') AS tech,
               trim(regexp_replace(cell, '[*`]+', '', 'g')) AS cell FROM p""",
    "plan_prompts": f"""
        WITH g AS ({GUIDES.format(customer="customer")}),
        p AS (SELECT c_custkey, {_rows(plans.PLAN_ROW, "id", "name", "summary", "review", "tech")} FROM g),
        w AS (SELECT * FROM (SELECT c_custkey, {_rows(plans.WAVE_ROW, "number", "title", "prompts")} FROM g) QUALIFY row_number() OVER (PARTITION BY c_custkey, number ORDER BY i) = 1),
        t AS (SELECT * FROM (SELECT c_custkey, {_rows(plans.TIMELINE_ROW, "number", "timeline")} FROM g) QUALIFY row_number() OVER (PARTITION BY c_custkey, number ORDER BY i DESC) = 1),
        r AS (SELECT *, try_cast(nullif(regexp_extract(prompts, '{text.NUMBER_RANGE}', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(prompts, '{text.NUMBER_RANGE}', 2), '') AS INT) AS b FROM w),
        m AS (SELECT c_custkey, number, title, lpad(unnest(range(a, coalesce(b, a) + 1))::VARCHAR, 2, '0') AS id FROM r),
        h AS (SELECT c_custkey, m.id, number::INT AS wave, {_plain("title")} AS wave_title, coalesce({_plain("timeline")}, 'not stated') AS timeline FROM m LEFT JOIN t USING (c_custkey, number) QUALIFY row_number() OVER (PARTITION BY c_custkey, m.id ORDER BY number) = 1),
        s AS (SELECT c_custkey, unnest(regexp_extract_all(text, '{plans.PROMPT_HEADING}', 1)) AS id, unnest(string_split_regex(text, '{plans.PROMPT_HEADING}')[2:]) AS piece FROM g),
        l AS (SELECT c_custkey, id, unnest(string_split(block, chr(10))) AS line, unnest(range(len(string_split(block, chr(10))))) AS i
              FROM (SELECT c_custkey, id, string_split_regex(string_split_regex(piece, '{plans.DELIVERABLES}')[2], '{plans.NEXT_HEADING}')[1] AS block FROM s WHERE regexp_matches(piece, '{plans.DELIVERABLES}'))),
        n AS (SELECT *, regexp_matches(line, '{plans.LIST_ITEM}') AS opens, count(*) FILTER (regexp_matches(line, '{plans.LIST_ITEM}')) OVER (PARTITION BY c_custkey, id ORDER BY i) AS item FROM l WHERE trim(line) <> ''),
        f AS (SELECT c_custkey, id, item, string_agg(CASE WHEN opens THEN {_plain(f"regexp_extract(line, '{plans.LIST_ITEM}', 1)")} ELSE trim(line) END, ' ' ORDER BY i) AS deliverable FROM n WHERE item > 0 AND (opens OR NOT starts_with(ltrim(line), '#')) GROUP BY ALL),
        d AS (SELECT c_custkey, id, string_agg(deliverable, ';' ORDER BY item) AS deliverables FROM f GROUP BY ALL)
        SELECT c_custkey, id, {_plain("name")} AS name, contains(lower(review), 'yes') AS review_required, coalesce(wave, -1) AS wave, coalesce(wave_title, 'Unassigned') AS wave_title, coalesce(timeline, 'not stated') AS timeline,
               array_to_string(list_filter(list_transform(regexp_split_to_array({_plain("tech")}, '{text.PARTS}'), lambda x: trim(x)), lambda x: x <> ''), ',') AS tech, coalesce(deliverables, '') AS deliverables
        FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey, id ORDER BY i) = 1) LEFT JOIN h USING (c_custkey, id) LEFT JOIN d USING (c_custkey, id)""",
    "token_bucket": """
        WITH RECURSIVE q AS (SELECT (user_id % 4)::VARCHAR AS key, event_id AS request_id, floor(epoch(ts)) AS at_s, ts::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY user_id % 4 ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
        f AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS request_id, false AS granted, 3.0::DOUBLE AS tokens, NULL::DOUBLE AS last_s, NULL::VARCHAR AS day, 0::BIGINT AS day_count FROM (SELECT DISTINCT key FROM q)
              UNION ALL
              SELECT key, i, request_id, ok AND filled >= 1, CASE WHEN ok AND filled >= 1 THEN filled - 1 ELSE filled END, CASE WHEN ok THEN at_s ELSE last_s END, day, spent + CASE WHEN ok AND filled >= 1 THEN 1 ELSE 0 END
              FROM (SELECT *, CASE WHEN ok THEN least(3.0::DOUBLE, tokens + greatest(0.0::DOUBLE, at_s - coalesce(last_s, at_s)) * 3 / 60.0::DOUBLE) ELSE tokens END AS filled
                    FROM (SELECT q.key, q.i, q.request_id, q.at_s, q.day, f.tokens, coalesce(f.last_s, q.at_s) AS last_s, CASE WHEN q.day = f.day THEN f.day_count ELSE 0 END AS spent, CASE WHEN q.day = f.day THEN f.day_count ELSE 0 END < 40 AS ok
                          FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)))
        SELECT key, request_id, granted, round(tokens, 6) AS tokens, day_count FROM f WHERE i > 0""",
    "job_state_machine": f"""
        WITH RECURSIVE q AS (SELECT CAST(job_id AS BIGINT) AS job_id, seq, action, value, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i FROM ({JOB_ACTIONS.format(events="events")})),
        f AS (SELECT job_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS action, false AS accepted, 'queued' AS status, 0.0::DOUBLE AS progress, false AS task, false AS asked FROM (SELECT DISTINCT job_id FROM q)
              UNION ALL
              SELECT job_id, i, seq, action, accepted,
                     CASE WHEN NOT accepted THEN status WHEN action = 'start' THEN 'running' WHEN action = 'recover' THEN 'queued' WHEN action = 'finish' THEN 'succeeded' WHEN action = 'fail' THEN 'failed'
                          WHEN action = 'task' AND asked OR action = 'cancel' AND (status = 'queued' OR task) THEN 'cancelled' ELSE status END,
                     CASE WHEN NOT accepted THEN progress WHEN action = 'report' THEN greatest(progress, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(value, progress)))) WHEN action = 'finish' THEN 1.0::DOUBLE WHEN action = 'recover' THEN 0.0::DOUBLE ELSE progress END,
                     CASE WHEN NOT accepted THEN task ELSE action = 'task' OR task AND action <> 'recover' END, CASE WHEN NOT accepted THEN asked ELSE (asked OR action = 'cancel' AND status = 'running' AND NOT task) AND action <> 'recover' END
              FROM (SELECT q.*, f.status, f.progress, f.task, f.asked,
                           CASE q.action WHEN 'submit' THEN f.i = 0 WHEN 'start' THEN f.status = 'queued' WHEN 'fail' THEN f.status = 'running' WHEN 'task' THEN f.status = 'running' AND NOT f.task
                                WHEN 'cancel' THEN f.status IN ('queued', 'running') WHEN 'recover' THEN f.status IN ('queued', 'running') ELSE f.status = 'running' AND f.task END AS accepted
                    FROM f JOIN q ON q.job_id = f.job_id AND q.i = f.i + 1))
        SELECT job_id, seq, action, accepted, status, progress FROM f WHERE i > 0""",
    "upload_fold": f"""
        WITH RECURSIVE q AS (SELECT CAST(upload_id AS BIGINT) AS upload_id, seq, action, "offset" AS start, length, declared, row_number() OVER (PARTITION BY upload_id ORDER BY seq) AS i FROM ({UPLOAD_ACTIONS.format(events="events").replace("AS offset", 'AS "offset"')})),
        f AS (SELECT upload_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome, 0::BIGINT AS received, 'in_progress' AS status FROM (SELECT DISTINCT upload_id FROM q)
              UNION ALL
              SELECT upload_id, i, seq, action, outcome, CASE WHEN outcome = 'accepted' THEN start + length ELSE received END, CASE WHEN outcome IN ('completed', 'aborted') THEN outcome ELSE status END
              FROM (SELECT q.*, f.received, f.status, CASE WHEN q.action = 'finalize' AND f.status = 'completed' THEN 'duplicate' WHEN f.status <> 'in_progress' THEN 'closed' WHEN q.action = 'abort' THEN 'aborted'
                           WHEN q.action = 'finalize' THEN CASE WHEN f.received = q.declared THEN 'completed' ELSE 'incomplete' END
                           WHEN q.start <> f.received THEN 'wrong_offset' WHEN q.start + q.length > q.declared THEN 'too_large' ELSE 'accepted' END AS outcome
                    FROM f JOIN q ON q.upload_id = f.upload_id AND q.i = f.i + 1))
        SELECT upload_id, seq, action, outcome, received, status FROM f WHERE i > 0""",
    "uploaded_texts": f"""
        WITH RECURSIVE c AS (SELECT doc_id, strlen(text) AS whole, unnest(regexp_extract_all(text, '(?s).{{1,700}}')) AS piece, unnest(range(len(regexp_extract_all(text, '(?s).{{1,700}}')))) AS i FROM documents),
        pieces AS (SELECT *, strlen(piece) AS size, CAST(coalesce(sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun FROM c),
        q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM ({CHUNKS.format(pieces="pieces")})),
        f AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, 0::BIGINT AS received, false AS accepted FROM q
              UNION ALL SELECT q.doc_id, q.n, CASE WHEN q.start = received AND q.start + size <= declared THEN q.start + size ELSE received END, q.start = received AND q.start + size <= declared FROM f JOIN q ON q.doc_id = f.doc_id AND q.n = f.n + 1)
        SELECT doc_id AS upload_id, CAST(sum(size) AS BIGINT) AS bytes, sha256(string_agg(piece, '' ORDER BY start)) AS sha256 FROM f JOIN q USING (doc_id, n) WHERE accepted GROUP BY doc_id""",
    "clip_neighbours": """WITH t AS (SELECT user_id, event_id AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events)
        SELECT event_id, (event_id % 90)::INT AS frame, coalesce(abs(moment - event_id)::DOUBLE, 1e308::DOUBLE) AS error FROM events e LEFT JOIN t ON t.user_id = e.user_id AND t.frame = event_id % 90""",
    "plan_lookup": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE -1 END AS wave, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' ELSE 'Unassigned' END AS title FROM orders""",
    "model_replies": f"""
        WITH r AS (SELECT doc_id, CASE WHEN json_valid(reply) THEN array_to_string(json_extract_string(reply, '$.candidates[0].content.parts[*].text'), '') END AS t FROM ({REPLIES.format(documents="documents")})),
        u AS (SELECT doc_id, t, coalesce(CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' AND coalesce(json_type(t, '$.content_type'), 'NULL') IN ('VARCHAR', 'NULL') AND coalesce(json_type(t, '$.energy_level'), 'NULL') IN ('VARCHAR', 'NULL') END, false) AS usable FROM r)
        SELECT doc_id, usable, CASE WHEN usable THEN json_extract_string(t, '$.content_type') END AS content_type, CASE WHEN usable THEN json_extract_string(t, '$.energy_level') END AS energy_level FROM u""",
    "prompt_metrics": "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN printf('%.2f', p_size / 4 + 0.001::DOUBLE) ELSE 'not measured' END AS metric FROM part",
    "cached_tagging": """SELECT d.doc_id AS scene_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::VARCHAR WHEN d.doc_id % 3 <> 0 AND length(text) <= 5000 THEN 'tag-' || length(text) % 7 END AS tag,
        CASE WHEN l.doc_id IS NOT NULL THEN 'cache' WHEN d.doc_id % 3 <> 0 AND length(text) <= 5000 THEN 'api' ELSE 'degraded' END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "cache_additions": """SELECT doc_id AS scene_id, 'tag-' || length(text) % 7 AS tag FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id % 3 <> 0 AND length(text) <= 5000""",
    "job_recovery": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'queued' ELSE 'succeeded' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS progress,
        CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN 'step' END AS step, CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN o_orderdate END AS started_at FROM orders""",
    "streamed_states": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "adopted_uploads": """
        WITH e AS (SELECT o_custkey % 50 AS p, CASE WHEN o_orderkey % 6 <> 0 THEN 'd' || o_orderkey % 5 END AS h, o_orderkey AS k, o_orderdate AS t, o_orderstatus AS s FROM orders),
        o AS (SELECT p, h, k FROM e WHERE k % 2 = 0 AND s = 'O' AND h IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p, h ORDER BY t, k) = 1),
        r AS (SELECT p, h, k, CASE WHEN h IS NULL THEN k ELSE first_value(k) OVER (PARTITION BY p, h ORDER BY t, k) END AS leader FROM e WHERE k % 2 = 1)
        SELECT r.k AS request_id, coalesce(o.k, leader) AS session_id, o.k IS NULL AND leader = r.k AS created FROM r LEFT JOIN o ON o.p = r.p AND o.h = r.h""",
    "resume_offsets": "SELECT p_partkey, least(p_size, p_partkey % 40)::INT AS \"offset\" FROM part",
}
