"""Catalog queries. Stand-ins: customer for projects, orders for files, part for blobs, lineitem for artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.functions.requests import page_limit
from spoolworks.functions.text import is_digest
from spoolworks.operators import catalog, constraints, rows
from spoolworks.sources import files, schemas
from spoolworks.sources.tables import table

#: Artifact kind -> current version.
VERSIONS = {"A": 1, "N": 1, "R": 2}


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha256"), F.col("l_returnflag").alias("artifact_kind"), F.col("l_linenumber").alias("params_version"))


#: Cached replies by rule: none, broken, of another shape, one whose tag is a number, and usable ones.
CACHED = """CASE WHEN toxic = 1 THEN NULL WHEN doc_id % 7 = 0 THEN concat('{{"content_type":"a', doc_id) WHEN doc_id % 7 = 1 THEN '[1]' WHEN doc_id % 7 = 2 THEN concat('{{"energy_level":', doc_id, '}}')
    WHEN doc_id % 7 = 3 THEN '{{}}' ELSE concat('{{"content_type":"t', doc_id, '","energy_level":null}}') END"""


def media_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha256"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("display_name"), F.col("o_orderdate").alias("added_at"))
    blobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha256"), F.col("o_totalprice").alias("size"))
    listed = catalog.library(files, blobs, _artifacts(spark, sf_dir), VERSIONS)
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project"))
    return listed.join(projects, "project_id").select("project_id", "project", "sha256", "display_name", "added_at", "size", "has_A", "has_N", "has_R").orderBy("project_id", "added_at", "sha256")


def scene_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = table(spark, sf_dir, "documents").where("source = 'src3'").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("scene_id"), F.col("quality").alias("prompt_version"), "toxic", F.expr(CACHED.format()).alias("raw_response_json"))
    return catalog.tagged(scenes, cache, F.lit(1), ["toxic"]).select("id", "lang", "n_chars", F.col("tags").isNotNull().alias("has_tags"), F.coalesce("tags.toxic", F.lit(-1)).alias("toxic")).orderBy("id")


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(page_limit(50))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey = 7").select("p_partkey", "p_name", "p_brand").limit(1)


def open_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of one project or none, and open ones only, by list."""
    events = table(spark, sf_dir, "events").withColumn("project_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    kept = events.where(F.col("event_type").isin("click", "view", "purchase") & (F.col("project_id").isNull() | (F.col("project_id") == 7)))
    return kept.select("event_id", F.coalesce("project_id", F.lit(-1)).alias("project_id"), "event_type")


def wave_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roll_up(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "P", "O").orderBy("o_orderpriority")


def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roll_up(table(spark, sf_dir, "orders"), [], "o_orderstatus", "F", "P", "O")


def empty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roll_up(table(spark, sf_dir, "orders").where("o_orderkey < 0"), [], "o_orderstatus", "F", "P", "O")


def artifacts_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.complete(_artifacts(spark, sf_dir), VERSIONS)


def artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first artifact of each kind at its current version of one blob whose file is still listed."""
    one = catalog.current(_artifacts(spark, sf_dir), VERSIONS).where("sha256 = 7")
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha256"))
    return rows.first_per_key(one.join(listed, "sha256", "left_semi"), ["artifact_kind"], ["params_version"])


def analysis_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(done, "p_partkey", "left_anti").select("p_partkey", "p_name")


def analysis_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(done, "p_partkey", "left_semi").select("p_partkey", "p_name")


def restricted_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a negative balance that orders still refer to."""
    ids = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return rows.delete_blocked(table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ids)


def cascaded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of customers and orders, by table, when customers with a negative balance go."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    parents, children = rows.delete_cascading(customers, orders, "c_custkey", "o_custkey", customers.where("c_acctbal < 0"))
    left = parents.agg(F.count("*").alias("rows")).withColumn("kept", F.lit("customer"))
    return left.unionByName(children.agg(F.count("*").alias("rows")).withColumn("kept", F.lit("orders")))


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def next_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    old, new = orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 3 = 0")
    return rows.next_positions(old, new, "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey", "position")


#: Names of files: those of tables, and two that are nowhere.
STORED = ["orders", "part", "lost", "region", "gone", "events"]
#: The eight tables by rule, with violations of every kind among them. Digests are two MD5 sums, 64 hex digits.
FILLED = {
    "projects": "SELECT concat('p', CASE WHEN c_custkey % 40 = 1 THEN c_custkey - 1 ELSE c_custkey END) AS id, CASE WHEN c_custkey % 50 <> 0 THEN c_name END AS name FROM {customer}",
    "media_blobs": """SELECT CASE WHEN o_orderkey % 61 = 0 THEN concat('short', o_orderkey) ELSE concat(md5(concat('b', o_orderkey % 1200)), md5(concat('c', o_orderkey % 1200))) END AS sha256,
        o_orderkey % 1000 - 3 AS size_bytes, concat('media/', o_orderkey) AS stored_path FROM {orders}""",
    "media_files": """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS id, concat('p', l_suppkey * 20) AS project_id, concat(md5(concat('b', l_orderkey % 1250)), md5(concat('c', l_orderkey % 1250))) AS sha256,
        CASE WHEN l_linenumber < 7 THEN l_returnflag END AS display_name, l_linenumber AS position FROM {lineitem}""",
    "derived_artifacts": """SELECT concat('a', o_orderkey) AS id, concat(md5(concat('b', o_orderkey % 1210)), md5(concat('c', o_orderkey % 1210))) AS sha256, o_orderpriority AS artifact_kind,
        o_custkey % 4 AS params_version, CASE WHEN o_orderkey % 70 > 0 THEN 'derived' END AS stored_path FROM {orders}""",
    "scenes": """SELECT concat('s', event_id) AS id, concat(md5(concat('b', user_id % 1300)), md5(concat('c', user_id % 1300))) AS sha256, event_id % 5 AS detector_params_version, event_id % 30 - 1 AS sequence_index,
        value AS start_seconds, CASE WHEN event_id % 90 > 0 THEN value + event_id % 4 - 1 END AS end_seconds, value * 2 - 20 AS energy_score FROM {events}""",
    "scene_tag_cache": "SELECT concat('t', doc_id % 5000) AS id, concat('s', doc_id * 3) AS scene_id, quality AS prompt_version FROM {labels}",
    "upload_sessions": """SELECT concat('u', p_partkey) AS id, concat('p', p_partkey) AS project_id, p_name AS display_name, p_size * 100 - 200 AS declared_size_bytes, p_size % 10 AS chunk_size_bytes, p_partkey % 9 - 1 AS bytes_received,
        CASE WHEN p_size % 3 > 0 THEN concat('d', p_size) END AS declared_sha256, CASE p_partkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'lost' ELSE 'in_progress' END AS status FROM {part}""",
    "jobs": """SELECT concat('j', event_id - event_id % 8 / 7) AS id, event_type AS job_type, CASE WHEN event_id % 9 > 0 THEN 'queued' ELSE 'paused' END AS status, value / 90 AS progress,
        CASE WHEN event_id % 3 > 0 THEN concat('p', user_id + 30) END AS project_id, CASE WHEN event_id % 4 > 0 THEN concat(md5(concat('b', user_id % 1300)), md5(concat('c', user_id % 1300))) END AS sha256 FROM {events}""",
}


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every constraint of the catalog, and how many rows are at fault."""
    filled = {}
    for name, sql in FILLED.items():
        source = sql[sql.rindex("{") + 1 : sql.rindex("}")]
        filled[name] = spark.sql(sql, **{source: table(spark, sf_dir, source)})
    return constraints.broken_constraints(filled)


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the catalog's tables in a database where they were made, with how many columns of the given tables have the type."""
    name = f"catalog_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        lacking = len(schemas.missing_tables(spark, name))
        schemas.create_all(spark, name)
        made = [(t, f.name, f.dataType.simpleString()) for t in sorted(x.name for x in spark.catalog.listTables(name)) for f in spark.table(f"{name}.{t}").schema.fields]
        schemas.create_all(spark, name, up=False)
        gone = len(schemas.missing_tables(spark, name))
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    given = [f.dataType.simpleString() for t in ("orders", "part", "events") for f in table(spark, sf_dir, t).schema.fields]
    rows = [(t, c, k, given.count(k), lacking, gone) for t, c, k in made]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, alike long, lacking long, gone long")


def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose file is there, by a listing of names and lengths alone; rows of lost files go, and a row without a path has none."""
    names = F.array(*[F.lit(f"{n}.parquet") for n in STORED])
    rows_ = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % (len(STORED) + 1)).cast("int")).alias("stored_path"))
    there = files.listing(spark, f"{sf_dir}/*").select(F.regexp_extract("path", r"/([^/]+[.]parquet)(/|$)", 1).alias("name")).distinct()
    return files.without_lost(rows_, there)


def prompt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each of a plan's steps stands, by which of its two files are there."""
    plan = spark.sql("SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN 'orders' WHEN 1 THEN 'gone' ELSE 'part' END, '.parquet') AS report, concat(CASE p_partkey % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'lost' ELSE 'nation' END, '.parquet') AS gate FROM {part}", part=table(spark, sf_dir, "part"))
    there = files.listing(spark, f"{sf_dir}/*").select(F.regexp_extract("path", r"/([^/]+[.]parquet)(/|$)", 1).alias("name")).distinct()
    return catalog.evidence(plan, there).select("id", "report_exists", "gate_exists", "status", "notes")


def catalog_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each check fails, over tables with checks of our own."""
    checks = {"discounted_too_far": "l_discount <= 0.08", "too_many": "l_quantity <= 48", "ships_late": "l_shipdate < TIMESTAMP '1998-11-01'", "tax_not_negative": "l_tax >= 0"}
    items = table(spark, sf_dir, "lineitem")
    _, bad = rows.split_valid(items, checks)
    return bad.select(F.explode("failed_checks").alias("failed_check")).groupBy("failed_check").agg(F.count("*").alias("rows"))


def upsert_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("value"))
    current = items.where("l_linenumber <= 3")
    once = items.where("l_linenumber >= 3").withColumn("change_seq", F.lit(1))
    again = items.where("l_linenumber = 4").withColumn("value", F.col("value") + 1000).withColumn("change_seq", F.lit(2))
    return rows.upsert(current, once.withColumn("value", F.col("value") + 100).unionByName(again), ["l_orderkey", "l_linenumber"])


def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first and a second run of the same append add."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    key, order = ["l_orderkey", "l_returnflag"], ["l_linenumber"]
    current = rows.first_per_key(items.where("l_orderkey % 2 = 0"), key, order)
    first = rows.append_new(current, items, key, order)
    second = rows.append_new(current.unionByName(first), items, key, order)
    return first.agg(F.count("*").alias("added")).withColumn("run", F.lit(1)).unionByName(second.agg(F.count("*").alias("added")).withColumn("run", F.lit(2)))


def updated_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as blobs: balance and segment are set by the last of their finished orders, a segment to null by some."""
    blobs = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changes = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("change_seq"), F.col("o_totalprice").alias("c_acctbal"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("c_mktsegment"),
    )
    return rows.updated(blobs, changes, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare and set: of orders asked for, those still open are taken."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    after, won = rows.claim(jobs, jobs.where("id % 7 = 0"), "O", "P")
    moved = after.groupBy("status").agg(F.count("*").alias("rows"))
    return moved.unionByName(won.agg(F.count("*").alias("rows")).withColumn("status", F.lit("claimed")))


def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that are expected and not there, as a set difference with repeats."""
    expected = spark.sql("SELECT explode(array('A', 'N', 'R', 'X', 'X')) AS kind")
    return expected.exceptAll(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind")).distinct())


def stored_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, least, greatest and spread of sizes, and digests that have the right shape."""
    pages = table(spark, sf_dir, "pages").withColumn("sha256", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    return pages.agg(F.sum("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"), (F.max("size") - F.min("size")).alias("spread"), F.count_if(is_digest(F.col("sha256"))).alias("digests"))


QUERIES = {f.__name__: f for f in (
    media_library, scene_tags, recent_jobs, point_lookup, open_jobs, wave_rollup, plan_totals, empty_report, artifacts_complete, artifact_lookup,
    analysis_missing, analysis_done, restricted_delete, cascaded_delete, first_per_key, next_position, constraint_violations, catalog_columns, kept_files, prompt_evidence, catalog_violations, upsert_artifacts,
    idempotent_append, updated_blobs, claimed_jobs, table_difference, stored_bytes,
)}

_ROLL = """count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'P') AS in_progress,
    count(*) FILTER (o_orderstatus = 'O') AS pending, CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) ELSE 0.0::DOUBLE END AS completion"""
_CURRENT = "(l_returnflag = 'A' AND l_linenumber = 1 OR l_returnflag = 'N' AND l_linenumber = 1 OR l_returnflag = 'R' AND l_linenumber = 2)"

def _rules() -> str:
    """A select for each constraint of the catalog over the filled tables."""
    found = []
    for name, spec in schemas.CATALOG.items():
        found += [f"SELECT '{name}' AS table_name, 'not_null' AS kind, '{f.name}' AS rule, count(*) AS rows FROM {name}_ WHERE {f.name} IS NULL" for f in spec.schema.fields if not f.nullable]
        found += [f"SELECT '{name}', 'check', '{rule}', count(*) FROM {name}_ WHERE NOT ({condition})" for rule, condition in spec.checks.items()]
        for columns, where in constraints.uniques(spec):
            names, there = ", ".join(columns), " AND ".join(f"{c} IS NOT NULL" for c in columns)
            found.append(f"SELECT '{name}', 'unique', '{names}', count(*) - count(DISTINCT ({names})) FROM {name}_ WHERE {there} AND {where or 'true'}")
        found += [f"SELECT '{name}', 'reference', '{c} -> {p}.{k}', count(*) FROM {name}_ WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p}_ WHERE {k} IS NOT NULL)" for c, (p, k, _) in spec.references.items()]
    return " UNION ALL ".join(found)


_FILLED = ", ".join(f"{name}_ AS ({sql.format(**{t: t for t in ('customer', 'orders', 'lineitem', 'events', 'labels', 'part')})})" for name, sql in FILLED.items())
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}

ORACLE_SQL = {
    "constraint_violations": f"WITH {_FILLED} {_rules()}",
    "catalog_columns": f"""
        WITH made AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{c}', '{k}')" for t, c, k, _ in constraints.catalog_columns())}) AS v(table_name, column_name, type)),
        given AS (SELECT CASE data_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())} END AS type, count(*) AS n FROM duckdb_columns() WHERE table_name IN ('orders', 'part', 'events') GROUP BY 1)
        SELECT made.*, coalesce(n, 0) AS alike, {len(schemas.CATALOG)}::BIGINT AS lacking, {len(schemas.CATALOG)}::BIGINT AS gone FROM made LEFT JOIN given USING (type)""",
    "kept_files": """SELECT p_partkey, stored_path FROM (SELECT p_partkey, (['orders.parquet', 'part.parquet', 'lost.parquet', 'region.parquet', 'gone.parquet', 'events.parquet'])[p_partkey % 7 + 1] AS stored_path FROM part)
        WHERE replace(stored_path, '.parquet', '') IN (SELECT table_name FROM information_schema.tables)""",
    "prompt_evidence": """
        WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'orders' WHEN 1 THEN 'gone' ELSE 'part' END AS report, CASE p_partkey % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'lost' ELSE 'nation' END AS gate FROM part),
        e AS (SELECT id, report IN (SELECT table_name FROM information_schema.tables) AS report_exists, gate IN (SELECT table_name FROM information_schema.tables) AS gate_exists FROM p)
        SELECT *, CASE WHEN report_exists AND gate_exists THEN 'PASSED' WHEN report_exists OR gate_exists THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status,
               CASE WHEN report_exists AND gate_exists THEN 'Report present and gate script verified' WHEN report_exists OR gate_exists THEN 'Report or gate script in progress' ELSE 'Pending execution' END AS notes FROM e""",
    "media_library": f"""
        SELECT o_custkey AS project_id, c_name AS project, o_orderkey AS sha256, o_orderpriority AS display_name, o_orderdate AS added_at, o_totalprice AS size,
               o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND {_CURRENT}) AS "has_A",
               o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND {_CURRENT}) AS "has_N",
               o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND {_CURRENT}) AS "has_R"
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "scene_tags": f"""WITH c AS (SELECT *, {CACHED.format()} AS raw FROM labels),
        u AS (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' AND coalesce(json_type(raw, '$.content_type'), 'NULL') IN ('VARCHAR', 'NULL') AND coalesce(json_type(raw, '$.energy_level'), 'NULL') IN ('VARCHAR', 'NULL') ELSE false END AS usable FROM c)
        SELECT d.doc_id AS id, lang, n_chars, coalesce(usable, false) AS has_tags, CASE WHEN usable THEN toxic ELSE -1 END AS toxic
        FROM documents d LEFT JOIN u ON d.doc_id = u.doc_id AND u.quality = 1 WHERE source = 'src3'""",
    "recent_jobs": "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "point_lookup": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 7",
    "open_jobs": """SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id ELSE -1 END AS project_id, event_type FROM events
        WHERE event_type IN ('click', 'view', 'purchase') AND (user_id % 5 = 0 OR user_id = 7)""",
    "wave_rollup": f"SELECT o_orderpriority, {_ROLL} FROM orders GROUP BY o_orderpriority",
    "plan_totals": f"SELECT {_ROLL} FROM orders",
    "empty_report": f"SELECT {_ROLL} FROM orders WHERE o_orderkey < 0",
    "artifacts_complete": f"SELECT l_orderkey AS sha256 FROM lineitem WHERE {_CURRENT} GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3",
    "artifact_lookup": f"SELECT l_orderkey AS sha256, l_returnflag AS artifact_kind, min(l_linenumber) AS params_version FROM lineitem WHERE {_CURRENT} AND l_orderkey = 7 GROUP BY 1, 2",
    "analysis_missing": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)",
    "analysis_done": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)",
    "restricted_delete": "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    "cascaded_delete": """SELECT 'customer' AS kept, count(*) AS rows FROM customer WHERE NOT c_acctbal < 0
        UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT c_acctbal < 0""",
    "first_per_key": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "next_position": """SELECT o_custkey, o_orderkey, coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position
        FROM orders LEFT JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) ON c = o_custkey WHERE o_orderkey % 3 = 0""",
    "catalog_violations": """SELECT failed_check, count(*) AS rows FROM (
        SELECT 'discounted_too_far' AS failed_check FROM lineitem WHERE NOT l_discount <= 0.08::DOUBLE
        UNION ALL SELECT 'too_many' FROM lineitem WHERE NOT l_quantity <= 48
        UNION ALL SELECT 'ships_late' FROM lineitem WHERE NOT l_shipdate < TIMESTAMP '1998-11-01'
        UNION ALL SELECT 'tax_not_negative' FROM lineitem WHERE NOT l_tax >= 0) GROUP BY failed_check""",
    "upsert_artifacts": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 THEN l_quantity WHEN l_linenumber = 4 THEN l_quantity + 1000 ELSE l_quantity + 100 END AS value
        FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)""",
    "idempotent_append": """SELECT 1 AS run, count(*) AS added FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 <> 0)
        UNION ALL SELECT 2, 0""",
    "updated_blobs": """
        WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
        SELECT c_custkey, c_name, coalesce(o_totalprice, c_acctbal) AS c_acctbal, CASE WHEN o_orderkey IS NULL THEN c_mktsegment WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS c_mktsegment FROM customer LEFT JOIN l ON o_custkey = c_custkey""",
    "claimed_jobs": """SELECT CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS status, count(*) AS rows FROM orders GROUP BY 1
        UNION ALL SELECT 'claimed', count(*) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus = 'O'""",
    "table_difference": "SELECT unnest(['X', 'X']) AS kind",
    "stored_bytes": """SELECT CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, min(octet_length(encode(html))) AS least, max(octet_length(encode(html))) AS most,
        max(octet_length(encode(html))) - min(octet_length(encode(html))) AS spread, count(*) AS digests FROM pages""",
}
