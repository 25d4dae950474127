"""Queries of the rules at the library's edges: listings, settings, served bytes, tool reports, colours, budgets. Stand-ins: parts for
listings, settings, versions and colours, events for progress and loudness reports, customers for state files, documents for
stored bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.functions import text, timing
from spoolworks.sources import files, settings
from spoolworks.sources.tables import table

# Inputs as SQL that Spark and DuckDB both read; `|` stands for the NUL of a listing.
LISTING = "concat(p_name, '|', CASE WHEN p_partkey % 3 = 0 THEN '|' ELSE '' END, 'src/', p_brand, '|', CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END)"
SETTING = "concat(' ', p_brand, ' , ,', p_name, ',', p_size, ',', p_brand, CASE WHEN p_partkey % 5 = 0 THEN ',  ' ELSE ', last' END)"
VERSION = """CASE p_partkey % 5 WHEN 0 THEN concat('ffmpeg version ', p_size, '.1-', p_partkey, ' Copyright', chr(10), 'built with gcc') WHEN 1 THEN concat(' ffmpeg  version  n', p_size, chr(10))
    WHEN 2 THEN concat('ffprobe version ', p_size) WHEN 3 THEN concat(chr(10), 'ffmpeg version 1') ELSE '' END"""
PROGRESS = """CASE event_id % 6 WHEN 0 THEN concat('out_time_us=', event_id * 7000) WHEN 1 THEN 'out_time_us=N/A' WHEN 2 THEN concat('frame=', user_id)
    WHEN 3 THEN concat(' out_time_us=', user_id * 100000, ' ') WHEN 4 THEN concat('out_time_us=-', user_id) ELSE 'progress=continue' END"""
LOUDNESS = """CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('RMS level dB: -', event_id % 50, '.5', chr(10), CASE event_id % 5 WHEN 0 THEN 'RMS level dB: -inf'
    WHEN 1 THEN concat('Overall', chr(10), ' RMS level dB:   -', user_id % 80) WHEN 2 THEN 'Peak level dB: -3' WHEN 3 THEN 'RMS level dB: 1.25' ELSE '' END) END"""
STATE = """CASE c_custkey % 6 WHEN 0 THEN concat('{"date": "2024-05-01", "count": ', c_custkey % 40, '}') WHEN 1 THEN '{"date": "2024-04-30", "count": 3}' WHEN 2 THEN 'not json'
    WHEN 3 THEN '{"date": "2024-05-01"}' WHEN 4 THEN concat('{"date": "2024-05-01", "count": -', c_custkey, '}') END"""
INK, PAPER = ("concat('#', substring(md5({}), 1, 6))".format(c) for c in ("p_name", "p_brand"))
LINES = """SELECT o_custkey AS scope, o_orderkey % 2 AS rank, o_orderkey AS place, CASE o_orderkey % 13 WHEN 0 THEN concat('ENGINE_PORT=', o_orderkey) WHEN 1 THEN concat(' log_level = "', CASE o_custkey % 3 WHEN 0 THEN 'debug' WHEN 1 THEN 'Info' ELSE o_orderpriority END, '" ')
    WHEN 2 THEN concat('export Torch_Device=', CASE o_custkey % 4 WHEN 0 THEN 'CUDA' WHEN 1 THEN ' cpu' ELSE 'tpu' END) WHEN 3 THEN concat('# UI_PORT=', o_custkey) WHEN 4 THEN concat('EXTRA_ALLOWED_HOSTS= a, ,', o_orderpriority, ' ,b,') WHEN 5 THEN concat('data_dir=./store/../', o_orderstatus)
    WHEN 6 THEN concat('DATA_DIR=/abs//', o_orderstatus, '/.') WHEN 7 THEN concat('GEMINI_RPM_LIMIT=', o_custkey % 3 - 1) WHEN 8 THEN 'UNKNOWN=1' WHEN 9 THEN concat('ui_port=', o_orderstatus) WHEN 10 THEN concat('engine_host=', chr(39), '0.0.0.', o_custkey % 9, chr(39)) WHEN 11 THEN 'engine_url' END AS line FROM {orders}"""
CLIP_SECONDS, TODAY, DAY_LIMIT = 60.0, "2024-05-01", 20


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of each NUL-separated listing."""
    names = F.replace(F.expr(LISTING), F.lit("|"), F.lit("\x00"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(files.listed(names)).alias("name"))


def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each comma-separated setting, by place."""
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(files.setting_list(F.expr(SETTING))).alias("pos", "value"))


def served_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's bytes from the hundreds' rest of its id on, in the chunks they are sent in."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    spans = files.chunk_spans(F.pmod("doc_id", F.lit(100)).cast("long"), F.octet_length(content).cast("long") - 1)
    # Digests are taken inside the array, so that no row repeats its text for each chunk.
    digests = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.md5(F.hex(files.byte_slice(content, s["start"].cast("int"), s["end"].cast("int"))).cast("binary")).alias("digest")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(digests))


def tool_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.version_token(F.expr(VERSION)).alias("version"))


def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = timing.progress_fraction(F.expr(PROGRESS), F.lit(CLIP_SECONDS))
    return table(spark, sf_dir, "events").select("event_id", F.round(done, 6).alias("done"))


def loudness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amplitude that the last level of each report tells."""
    level = timing.overall_level(F.expr(LOUDNESS))
    return table(spark, sf_dir, "events").select("event_id", F.round(timing.linear_from_db(level), 9).alias("amplitude"))


def label_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.contrast_ratio(F.expr(INK), F.expr(PAPER)), 4).alias("contrast"))


def spent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests spent today by each state file."""
    return table(spark, sf_dir, "customer").select("c_custkey", files.day_count(F.expr(STATE), F.lit(TODAY), DAY_LIMIT).alias("spent"))


def effective_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting of every customer, whose orders are lines of its environment and of its file."""
    return settings.effective(spark.sql(LINES, orders=table(spark, sf_dir, "orders")), "/srv/engine")


QUERIES = {f.__name__: f for f in (listed_files, setting_values, effective_settings, served_chunks, tool_versions, progress_lines, loudness_levels, label_contrasts, spent_requests)}


def _luminance(colour: str) -> str:
    """SQL of the relative luminance of a #rrggbb colour."""
    shares = [f"(('0x' || substring({colour}, {i}, 2))::BIGINT / 255.0)::DOUBLE" for i in (2, 4, 6)]
    linear = [f"(CASE WHEN {s} <= 0.04045 THEN {s} / 12.92::DOUBLE ELSE power(({s} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)" for s in shares]
    return f"(0.2126::DOUBLE * {linear[0]} + 0.7152::DOUBLE * {linear[1]} + 0.0722::DOUBLE * {linear[2]})"


ORACLE_SQL = {
    "listed_files": f"SELECT * FROM (SELECT p_partkey, unnest(string_split({LISTING}, '|')) AS name FROM part) WHERE name <> ''",
    "setting_values": f"""
        WITH s AS (SELECT p_partkey, string_split({SETTING}, ',') AS parts FROM part),
        r AS (SELECT p_partkey, trim(unnest(parts)) AS value, generate_subscripts(parts, 1) AS i FROM s),
        v AS (SELECT p_partkey, value, min(i) AS first FROM r WHERE value <> '' GROUP BY p_partkey, value)
        SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY first) - 1 AS INTEGER) AS pos, value FROM v""",
    "effective_settings": rf"""
        WITH l AS ({LINES.format(orders="orders")}),
        a AS (SELECT scope, rank, place, lower(regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$', 1)) AS name, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$', 2) AS v FROM l),
        g AS (SELECT scope, name, rank, CASE WHEN v[1] IN ('"', chr(39)) AND length(v) > 1 AND v[-1] = v[1] THEN v[2:-2] ELSE v END AS v FROM a QUALIFY row_number() OVER (PARTITION BY scope, name ORDER BY rank DESC, place DESC) = 1),
        d(name, kind, v) AS (VALUES {", ".join(f"('{n}', '{k}', '{v}')" for n, (k, v) in settings.SETTINGS.items())}),
        e AS (SELECT s.scope, d.name, d.kind, g.rank AS origin, coalesce(g.v, d.v) AS v FROM (SELECT DISTINCT scope FROM l) s CROSS JOIN d LEFT JOIN g ON g.scope = s.scope AND g.name = d.name),
        n AS (SELECT *, try_cast(CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN trim(v) END AS BIGINT) AS num, CASE WHEN v[1] = '/' THEN v ELSE '/srv/engine/' || v END AS whole FROM e),
        p AS (SELECT *, CASE WHEN kind = 'number' AND num IS NULL THEN 'no whole number' WHEN name IN ('engine_port', 'ui_port') AND num < 1 OR kind = 'number' AND num < 0 THEN 'too small' WHEN name IN ('engine_port', 'ui_port') AND num > 65535 THEN 'too large'
                        WHEN name = 'log_level' AND upper(trim(v)) NOT IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL') OR name = 'torch_device' AND lower(trim(v)) NOT IN ('auto', 'cuda', 'cpu') THEN 'unknown word' END AS problem FROM n)
        SELECT scope, name, origin, problem, CASE WHEN problem IS NOT NULL THEN NULL ELSE CASE kind WHEN 'number' THEN num::VARCHAR WHEN 'upper' THEN upper(trim(v)) WHEN 'lower' THEN lower(trim(v))
               WHEN 'list' THEN array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> ''), ',')
               WHEN 'path' THEN list_reduce(list_prepend('', list_filter(string_split(whole, '/'), lambda x: x NOT IN ('', '.'))), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) ELSE v END END AS value FROM p""",
    "served_chunks": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, h, unnest(range(doc_id % 100, length(h) // 2, 65536)) AS "start" FROM d),
        e AS (SELECT *, least("start" + 65535, length(h) // 2 - 1) AS "end" FROM c)
        SELECT doc_id, "start", "end", md5(substring(h, 2 * "start" + 1, 2 * ("end" - "start" + 1))) AS digest FROM e""",
    "tool_versions": rf"""
        WITH t AS (SELECT p_partkey, regexp_split_to_array(trim(split_part({VERSION}, chr(10), 1)), '\s+') AS t FROM part)
        SELECT p_partkey, CASE WHEN t[1] = 'ffmpeg' AND t[2] = 'version' THEN t[3] END AS version FROM t""",
    "progress_lines": rf"""
        WITH l AS (SELECT event_id, try_cast(regexp_extract(trim({PROGRESS}), '^out_time_us=(.*)$', 1) AS DOUBLE) AS micros FROM events)
        SELECT event_id, CASE WHEN micros IS NOT NULL THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, micros / 1e6 / {CLIP_SECONDS}::DOUBLE)), 6) END AS done FROM l""",
    "loudness_levels": rf"""
        WITH l AS (SELECT event_id, try_cast(regexp_extract_all({LOUDNESS}, 'RMS level dB:\s*(-?inf|-?[\d.]+)', 1)[-1] AS DOUBLE) AS level FROM events)
        SELECT event_id, CASE WHEN level >= -60 THEN round(power(10.0::DOUBLE, level / 20), 9) ELSE 0.0::DOUBLE END AS amplitude FROM l""",
    "label_contrasts": f"""
        WITH c AS (SELECT p_partkey, {INK} AS ink, {PAPER} AS paper FROM part),
        l AS (SELECT p_partkey, {_luminance("ink")} AS a, {_luminance("paper")} AS b FROM c)
        SELECT p_partkey, round((greatest(a, b) + 0.05::DOUBLE) / (least(a, b) + 0.05::DOUBLE), 4) AS contrast FROM l""",
    "spent_requests": f"""
        WITH s AS (SELECT c_custkey, {STATE} AS state FROM customer),
        p AS (SELECT c_custkey, CASE WHEN json_valid(state) THEN state ->> '$.date' END AS day, try_cast(CASE WHEN json_valid(state) THEN state ->> '$.count' END AS BIGINT) AS n FROM s)
        SELECT c_custkey, CASE WHEN day IS NULL OR n IS NULL OR n < 0 THEN {DAY_LIMIT} WHEN day <> '{TODAY}' THEN 0 ELSE n END::BIGINT AS spent FROM p""",
}
