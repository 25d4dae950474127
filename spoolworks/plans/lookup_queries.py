"""Queries of the service's edges. Stand-ins: events for connections, jobs and uploads, customer for clips, line items
for scenes, nations under regions for mounted routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.functions import requests
from spoolworks.operators import lookups
from spoolworks.sources.tables import table

STATUS = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' ELSE event_type END"
STEP = "CASE WHEN event_id % 3 = 0 THEN concat('sending scene ', event_id % 7, ' of 7 to Gemini for analysis') WHEN event_id % 3 = 1 THEN 'sending scene 1 of 7' END"
FAULT = "CASE event_type WHEN 'error' THEN 'tool_unavailable' WHEN 'view' THEN 'not_video' WHEN 'click' THEN 'unreadable' END"


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").where(requests.allowed_origin(origin, ["click", "view"])).groupBy("event_type").agg(F.count("*").alias("n"))


def sending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first job of each user that sends a scene now, with its clip's name."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(STATUS).alias("status"), F.expr(STEP).alias("step"))
    sending = requests.sending_step(F.col("step"))
    found = lookups.first_match(events, "user_id", "event_id", (F.col("status") == "running") & sending.isNotNull())
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("at"), F.col("c_name").alias("clip"))
    named = lookups.named_match(found, clips, "user_id", "at", "clip")
    return named.select("user_id", "event_id", sending["index"].alias("scene"), sending["total"].alias("scenes"), "clip")


def finished_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(STATUS).alias("status"))
    return lookups.finished_signature(events, "user_id", "event_id", "status")


def scoped_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of every clip, numbered from 0, with their context; base64 of what is sent."""
    scenes = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")).cast("long") - 1
    context = requests.scene_context(F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber"))
    return scenes.select("l_orderkey", place.alias("scene"), "l_partkey", context["duration"].alias("duration"), context["position"].alias("position"), F.base64(F.col("l_returnflag").cast("binary")).alias("payload"))


def scene_of_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scene by its id and its clip: an id of another clip finds nothing."""
    return table(spark, sf_dir, "lineitem").where("l_linenumber = 3 AND l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_partkey")


def player_seeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity"))
    other = F.when(F.col("l_linenumber") % 3 == 1, F.lit(0.0))
    ends = requests.seek(F.col("l_quantity"), F.col("l_linenumber") * 10.0 - 30.0, F.when(F.col("l_linenumber") != 2, F.lit(40.0)))
    return table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", requests.frame_step(rate, other).alias("frame"), ends.alias("at")).distinct()


def finalized_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = requests.finalize_outcome(F.expr(FAULT))
    return table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), ended["code"].alias("code"), ended["status"].alias("status")).groupBy("day", "code", "status").agg(F.count("*").alias("n"))


def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tags = requests.shown_tags({"lang": F.col("lang"), "source": F.when(F.col("doc_id") % 2 == 0, F.col("source"))})
    fields = lookups.problem_fields(F.array(F.array(F.lit("waves"), F.col("lang")), F.array().cast("array<string>"), F.array(F.lit("waves"), F.col("lang")), F.array(F.lit("totals"))))
    return docs.select("doc_id", F.array_join(F.transform(tags, lambda t: F.concat_ws("=", t["name"], t["value"])), ",").alias("tags"), fields.alias("fields"))


def mounted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under regions under one root, walked to any depth."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.when(F.col("r_regionkey") > 0, F.lit("r0")).alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return lookups.descendants(regions.union(nations), "node", "parent")


QUERIES = {f.__name__: f for f in (connections, sending_jobs, finished_signatures, scoped_scenes, scene_of_clip, player_seeks, finalized_uploads, shown_labels, mounted_routes)}

ORACLE_SQL = {
    "connections": "SELECT event_type, count(*) AS n FROM events WHERE event_id % 4 = 0 OR event_type IN ('click', 'view') GROUP BY event_type",
    "sending_jobs": """
        WITH f AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' AND event_id % 3 = 0 GROUP BY user_id)
        SELECT user_id, event_id, event_id % 7 AS scene, 7::BIGINT AS scenes, c_name AS clip FROM f LEFT JOIN customer ON c_custkey = user_id""",
    "finished_signatures": f"""
        SELECT user_id, coalesce(string_agg(event_id || ':' || s, ',' ORDER BY event_id || ':' || s) FILTER (s NOT IN ('queued', 'running')), '') AS finished
        FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY user_id""",
    "scoped_scenes": """
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS scene,
               l_partkey, l_quantity + l_linenumber - l_quantity AS duration, l_quantity AS position, base64(encode(l_returnflag)) AS payload
        FROM lineitem""",
    "scene_of_clip": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 3 AND l_orderkey = 7",
    "player_seeks": """
        SELECT DISTINCT l_linenumber, l_quantity, 1.0::DOUBLE / CASE WHEN l_linenumber % 3 = 0 AND l_quantity > 0 THEN l_quantity ELSE 30 END AS frame,
               least(greatest(0.0::DOUBLE, l_quantity + l_linenumber * 10 - 30), CASE WHEN l_linenumber = 2 THEN 0 ELSE 40 END) AS at FROM lineitem""",
    "finalized_uploads": f"""
        WITH f AS (SELECT ts::DATE::VARCHAR AS day, {FAULT} AS fault FROM events)
        SELECT day, CASE WHEN fault IS NULL THEN 200 WHEN fault = 'tool_unavailable' THEN 503 ELSE 415 END AS code,
               CASE WHEN fault IS NULL THEN 'complete' WHEN fault = 'tool_unavailable' THEN 'in_progress' ELSE 'aborted' END AS status, count(*) AS n FROM f GROUP BY ALL""",
    "shown_labels": """
        SELECT doc_id, concat_ws(',', 'lang=' || lang, CASE WHEN doc_id % 2 = 0 THEN 'source=' || source END) AS tags,
               'waves' || coalesce('.' || lang, '') || ', totals' AS fields FROM documents""",
    "mounted_routes": """
        WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS node, CASE WHEN r_regionkey > 0 THEN 'r0' END AS parent FROM region
                                 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
        walk AS (SELECT node AS root, node, 0 AS depth FROM nodes WHERE parent IS NULL
                 UNION ALL SELECT root, n.node, depth + 1 FROM walk w JOIN nodes n ON n.parent = w.node)
        SELECT root, node, depth FROM walk""",
}
