"""Scene, frame, energy, probe and display queries. Stand-ins: events per user for clips and job reports,
embeddings as frames of 8 by 8 pixels, parts and events for probe documents, paths, headers and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.functions import probe, text, timing
from spoolworks.operators import frames, sequences
from spoolworks.sources import frames as gray
from spoolworks.sources.tables import shared_dir, table, written

# Inputs by rule over all parts, as SQL that Spark and DuckDB both read; `||` and chr() mean the same in both.
_RATE = """CASE (p_partkey {0}) % 11 WHEN 0 THEN '30/1' WHEN 1 THEN '1560/121' WHEN 2 THEN '25/1' WHEN 3 THEN '0/0' WHEN 4 THEN 'N/A' WHEN 5 THEN '' WHEN 6 THEN '30'
    WHEN 7 THEN '30000/1001' WHEN 8 THEN NULL WHEN 9 THEN '-5/1' ELSE p_size || '/' || (p_partkey % 4) END"""
RATES = f"""SELECT p_partkey, {_RATE.format("+ 0")} AS nominal, {_RATE.format("* 5 + 3")} AS average,
    CASE p_partkey % 5 WHEN 0 THEN 'mov,mp4,m4a,3gp,3g2,mj2' WHEN 1 THEN 'matroska,webm' WHEN 2 THEN 'MP4' WHEN 3 THEN 'avi' ELSE '3gp' END AS container FROM {{part}}"""
PATHS = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'media/' || p_name WHEN 1 THEN '../' || p_brand WHEN 2 THEN 'a/../../' || p_name WHEN 3 THEN 'a/../' || p_name WHEN 4 THEN '/' || p_name
    WHEN 5 THEN 'C:/' || p_name WHEN 6 THEN '' WHEN 7 THEN './' || p_brand || '/./b/..' ELSE 'a/b/../../..' END AS path,
    CASE p_partkey % 8 WHEN 0 THEN '-' || p_name WHEN 1 THEN 'http://host/' || p_size WHEN 2 THEN 'C:/clips/' || p_size || '.mp4' WHEN 3 THEN p_name WHEN 4 THEN 'file:' || p_size WHEN 5 THEN 'OneDrive - ' || p_brand || '/x'
    WHEN 6 THEN 'home/OneDrive/' || p_size ELSE 'home/OneDriver/x' END AS source FROM {part}"""
RANGES = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'bytes=0-' || p_size WHEN 1 THEN 'bytes=-' || (p_size - 1) WHEN 2 THEN 'bytes=' || (p_size * 30) || '-' WHEN 3 THEN 'bytes=' || p_size || '-5000'
    WHEN 4 THEN 'bytes=50-' || p_size WHEN 5 THEN 'bytes=-' WHEN 6 THEN 'bytes=0-1,5-6' WHEN 7 THEN 'items=0-' || p_size END AS header, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1000 END AS size FROM {part}"""
REPORTS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'opening /home/u' || user_id || '/clips/' || event_id || '.mp4 failed' || chr(10) WHEN 1 THEN '   ' || chr(10) WHEN 2 THEN 'Could not find codec parameters for C:/users/me/' || event_id || '.mov' || chr(10) ELSE '' END
    || CASE event_id % 7 WHEN 0 THEN 'Unknown encoder lib' || user_id WHEN 1 THEN 'moov atom not found' WHEN 2 THEN '  Write: No space left on device /mnt/store/' || event_id || '.bin ' WHEN 3 THEN 'Invalid filtergraph' || chr(10) || 'unknown decoder' WHEN 4 THEN 'frame ' || event_id
       WHEN 5 THEN 'x' || chr(10) || 'No such filter: y' ELSE '' END AS report FROM {events}"""
PROBES = """SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'not json' ELSE '{{"streams":[' || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '{{"codec_type":"video","codec_name":"' || p_brand || '","width":' || (p_size * (p_partkey % 19)) || ',"height":' || p_size
    || ',"r_frame_rate":"' || CASE p_partkey % 4 WHEN 0 THEN '30/1' WHEN 1 THEN '0/0' WHEN 2 THEN '25/1' ELSE 'N/A' END || '","avg_frame_rate":"' || CASE p_partkey % 3 WHEN 0 THEN '30/1' WHEN 1 THEN '0/0' ELSE '30000/1001' END || '"'
    || CASE p_partkey % 5 WHEN 0 THEN ',"side_data_list":[{{"rotation":-90}}]' WHEN 1 THEN ',"tags":{{"rotate":"180"}}' WHEN 2 THEN ',"side_data_list":[{{"rotation":450}},{{"rotation":1}}],"tags":{{"rotate":"180"}}' WHEN 3 THEN ',"tags":{{"rotate":"sideways"}}' ELSE '' END
    || CASE p_partkey % 7 WHEN 0 THEN ',"duration":"3.5"' ELSE '' END || CASE p_partkey % 11 WHEN 0 THEN ',"color_transfer":" arib-std-b67 "' WHEN 1 THEN ',"color_primaries":"bt2020"' WHEN 2 THEN ',"color_transfer":" "' ELSE '' END || '}},' END
    || '{{"codec_type":"audio","codec_name":"aac","sample_rate":"' || CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE '44100' END || '"}}],"format":{{"format_name":"' || CASE p_partkey % 3 WHEN 0 THEN 'mov,mp4,m4a,3gp,3g2,mj2' WHEN 1 THEN 'matroska,webm' ELSE 'mp4' END
    || '","duration":"' || CASE p_partkey % 8 WHEN 0 THEN 'N/A' WHEN 1 THEN '0' ELSE CAST(p_size AS STRING) || '.5' END || '"}}}}' END AS document FROM {part}"""


def energy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    motion, db = F.col("value") / 21, -(F.col("event_id") % 70).cast("double")
    return events.select("event_id", F.round(timing.linear_from_db(db), 9).alias("audio_energy"), timing.energy_score(motion, timing.linear_from_db(db)).alias("energy_score"))


def energy_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = energy_scores(spark, sf_dir)
    return scored.agg(F.min("energy_score").alias("least"), F.max("energy_score").alias("most"), F.round(F.max("energy_score") - F.min("energy_score"), 2).alias("spread"), F.greatest(F.lit(0.0001), F.max("audio_energy")).alias("loudest"))


def candidate_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.posexplode(timing.candidate_times(F.col("value"), F.col("value") + 5, 3))).select("event_id", "pos", F.round("col", 6).alias("at"))


def sample_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    picks = timing.sample_frames(F.col("value"), F.col("value") + F.col("event_id") % 3 * 0.5, F.lit(30.0), 8)
    return events.select("event_id", F.explode(picks).alias("frame"))


def media_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    seconds = F.col("p_retailprice") / 100
    return part.select(
        "p_partkey",
        timing.proxy_height(F.col("p_size") * 25 + F.col("p_partkey").cast("int") % 2).alias("proxy_height"),
        timing.strip_cells(seconds).alias("cells"),
        F.round(timing.render_budget(F.when(F.col("p_partkey") % 5 != 0, seconds)), 6).alias("budget"),
        timing.frame_at(seconds, F.lit(29.97)).alias("frame"),
        timing.least_scene_frames(F.lit(0.5), F.col("p_size").cast("double")).alias("least_frames"),
        F.round(timing.backoff(F.col("p_partkey") % 6, F.lit(1.0)), 6).alias("backoff"),
        F.round(timing.span_progress(F.lit(0.2), F.lit(0.9), F.col("p_partkey") % 4, F.lit(4)), 6).alias("progress"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    change = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return sequences.cuts_to_scenes(events.withColumn("change", change), "user_id", ["ts", "event_id"], "change", 27.0, 3).select("user_id", "sequence_index", F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"))


def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot and the live events over it, with repeats, down to the newest of each key. Keepalive pings are no events of a job."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value").where("event_type <> 'ping'")
    return sequences.latest(events.where("event_id % 2 = 0").unionByName(events), "user_id", "event_id")


def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 100).alias("value"))
    return sequences.monotone(events, "user_id", ["event_id"], "value").select("user_id", "event_id", "progress")


def monotone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.is_monotone(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value")


def sparkline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a line 240 wide and 40 high, broken where there is no value."""
    events = table(spark, sf_dir, "events").withColumn("y", F.when(F.col("event_id") % 7 != 3, F.col("value")))
    w = Window.partitionBy("user_id")
    placed = events.withColumn("i", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("n", F.count("*").over(w)).withColumn("top", F.greatest(F.lit(0.0001), F.max("y").over(w)))
    drawn = sequences.islands(placed, "user_id", ["event_id"], "y")
    x = F.when(F.col("n") > 1, F.col("i") * (240.0 / (F.col("n") - 1))).otherwise(0.0)
    return drawn.select("user_id", "event_id", "island", F.round(x, 3).alias("x"), F.round(40 - F.col("y") / F.col("top") * 40, 1).alias("y"))


def frame_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "embeddings").select("vec_id", "label", frames.sharpness(8, 8)("embedding").alias("sharpness"))
    return scored.select("vec_id", "label", F.round("sharpness", 6).alias("sharpness"))


def sharpest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sharpest(frame_sharpness(spark, sf_dir), "label", "vec_id", "sharpness")


def motion_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.when(F.col("vec_id") % 9 != 4, F.col("embedding")).alias("embedding"))
    return frames.motion(clips, "label", "vec_id", "embedding").select("label", F.round("motion", 6).alias("motion"))


def downscaled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = table(spark, sf_dir, "embeddings").select("vec_id", frames.block_mean(F.col("embedding"), 8, 8, 4).alias("small"))
    return small.select("vec_id", F.posexplode("small")).select("vec_id", "pos", F.round("col", 6).alias("pixel"))


def scaled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 by 8 at 3 by 5: pixels are shared between the areas they lie in."""
    small = table(spark, sf_dir, "embeddings").select("vec_id", frames.area_resized(8, 8, 3, 5)("embedding").alias("small"))
    return small.select("vec_id", F.posexplode_outer("small")).select("vec_id", "pos", F.round("col", 6).alias("pixel"))


def flow_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.when(F.col("vec_id") % 9 != 4, F.col("embedding")).alias("embedding"))
    return frames.flow_motion(clips, "label", "vec_id", "embedding", 8, 8).select("label", F.round("motion", 6).alias("motion"))


def indexed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written to a file a clip, and some read back by index: past the end, of a file that is not there, and twice too."""
    pixel = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 40 + 128))).cast("long")
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("clip"), F.col("vec_id").alias("frame"), F.unhex(F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(pixel(e)), 2, "0")), "")).alias("pixels"))
    files = written(gray.write_gray(vectors, f"{shared_dir(spark)}/clips-{uuid.uuid4().hex}"), "clips")
    clips = files.select(F.col("clip").cast("long").alias("clip"), "path")
    there = clips.select("clip", F.explode(F.array(*map(F.lit, (0, 7, 14, 7, 21, -1)))).alias("frame"), "path")
    gone = clips.select("clip", F.lit(0).alias("frame"), F.concat("path", F.lit(".gone")).alias("path"))
    read = gray.frames_at(there.union(gone), 8, 8)
    numbers = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("long"))
    return read.select("clip", "frame", "reading", F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.get(numbers, 9).alias("tenth"))


def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of each of two streams, and how far they end apart."""
    events = table(spark, sf_dir, "events").withColumn("end", F.col("event_id") / 10 + F.coalesce(F.col("value"), F.lit(0.0)) / 1000)
    ends = events.groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("end"))).alias("video"), F.max(F.when(F.col("event_id") % 2 == 1, F.col("end"))).alias("audio"))
    return ends.select("user_id", F.round(F.abs(F.col("video") - F.col("audio")), 6).alias("drift"))


def probe_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.sql(RATES, part=table(spark, sf_dir, "part"))
    return rates.select("p_partkey", F.round(probe.rational(F.col("nominal")), 9).alias("nominal_fps"), F.round(probe.rational(F.col("average")), 9).alias("average_fps"), text.rate_mode(probe.variable_rate(F.col("container"), F.col("nominal"), F.col("average"))).alias("mode"))


def probe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.sql(PROBES, part=table(spark, sf_dir, "part"))
    return docs.select("p_partkey", probe.parsed(F.col("document")).alias("p")).select("p_partkey", "p.*").withColumn("fps_source", F.round("fps_source", 6))


def job_failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(REPORTS, events=table(spark, sf_dir, "events")).withColumn("f", text.failure(F.col("report")))
    return found.select("event_id", F.col("f.class").alias("failure_class"), F.col("f.detail").alias("detail"))


def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.sql(RANGES, part=table(spark, sf_dir, "part")).withColumn("r", text.byte_range(F.col("header"), F.col("size").cast("long")))
    return ranges.select("p_partkey", F.coalesce("r.start", F.lit(-1)).alias("first_byte"), F.coalesce("r.end", F.lit(-1)).alias("last_byte"), "r.status")


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.sql(PATHS, part=table(spark, sf_dir, "part"))
    return paths.select("p_partkey", text.is_contained(F.col("path")).alias("contained"), text.is_safe_source(F.col("source")).alias("safe"), text.in_synced_folder(F.col("source"), "OneDrive").alias("synced"))


def store_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("sha", F.sha2(F.col("p_partkey").cast("string"), 256)).withColumn("container", F.when(F.col("p_size") % 3 == 0, "matroska,webm").when(F.col("p_size") % 3 == 1, "WAV x,y").otherwise("?"))
    suffix = text.container_suffix(F.col("container"))
    return part.select("p_partkey", suffix.alias("suffix"), text.blob_path(F.col("sha"), suffix).alias("blob"), text.derived_path(F.col("sha"), F.lit("proxy"), F.col("p_size"), F.lit("proxy.mp4")).alias("derived"))


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    price, size = F.col("p_retailprice"), (F.col("p_partkey") * F.col("p_partkey") * F.col("p_size") * 7).cast("long")
    return part.select(
        "p_partkey",
        text.shown_duration(price * 7).alias("duration"),
        text.shown_timecode(F.floor(price) + 0.5, F.lit(24.0)).alias("timecode"),
        text.shown_bytes(size).alias("bytes"),
        text.shown_fps(F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 0.0).otherwise(F.col("p_size") + 0.25)).alias("fps"),
        text.shown_percent(price / 2000).alias("percent"),
        text.shown_resolution(F.col("p_size"), F.nullif(F.col("p_size") % 4, F.lit(0))).alias("resolution"),
        text.rate_mode(F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3 == 1)).alias("mode"),
    )


QUERIES = {f.__name__: f for f in (
    energy_scores, energy_spread, candidate_timestamps, sample_indices, media_arithmetic, scenes, latest_job_state, monotone_progress, monotone_check,
    sparkline_segments, frame_sharpness, sharpest_frame, motion_energy, flow_energy, downscaled_frames, scaled_frames, indexed_frames, stream_drift, probe_rates, probe_parse, job_failure_class,
    byte_ranges, path_safety, store_paths, display_formats,
)}

_ENERGY = """SELECT event_id, round(a, 9) AS audio_energy, round(100 * (0.5::DOUBLE * least(1.0::DOUBLE, value / 21 / 6) + 0.5::DOUBLE * least(1.0::DOUBLE, a / 0.5::DOUBLE)), 2) AS energy_score
    FROM (SELECT *, CASE WHEN event_id % 70 <= 60 THEN pow(10.0::DOUBLE, -(event_id % 70)::DOUBLE / 20) ELSE 0.0::DOUBLE END AS a FROM events)"""
_PIXEL = "embedding[({r}) * 8 + ({c}) + 1]::DOUBLE"
_REFLECT = "CASE WHEN ({0}) < 0 THEN 1 WHEN ({0}) > 7 THEN 6 ELSE ({0}) END"
_SHARP = f"""SELECT vec_id, label, round(var_pop({_PIXEL.format(r=_REFLECT.format("r - 1"), c="c")} + {_PIXEL.format(r=_REFLECT.format("r + 1"), c="c")}
    + {_PIXEL.format(r="r", c=_REFLECT.format("c - 1"))} + {_PIXEL.format(r="r", c=_REFLECT.format("c + 1"))} - 4 * {_PIXEL.format(r="r", c="c")}), 6) AS sharpness
    FROM embeddings, range(8) AS a(r), range(8) AS b(c) GROUP BY vec_id, label"""
_NUM = "try_cast({0} AS DOUBLE)"
_RATIONAL = "CASE WHEN contains({0}, '/') AND try_cast(split_part({0}, '/', 2) AS DOUBLE) <> 0 AND try_cast(split_part({0}, '/', 1) AS DOUBLE) > 0 THEN try_cast(split_part({0}, '/', 1) AS DOUBLE) / try_cast(split_part({0}, '/', 2) AS DOUBLE) END"

ORACLE_SQL = {
    "energy_scores": _ENERGY,
    "energy_spread": f"SELECT min(energy_score) AS least, max(energy_score) AS most, round(max(energy_score) - min(energy_score), 2) AS spread, greatest(0.0001::DOUBLE, max(audio_energy)) AS loudest FROM ({_ENERGY})",
    "candidate_timestamps": """SELECT event_id, (i - 1)::INT AS pos, round(value + 5.0::DOUBLE * i / 4, 6) AS at FROM events, range(1, 4) AS t(i)""",
    "sample_indices": """
        WITH s AS (SELECT event_id, round_even(value * 30, 0)::BIGINT AS first, round_even((value + event_id % 3 * 0.5::DOUBLE) * 30, 0)::BIGINT AS last FROM events),
        k AS (SELECT event_id, first, greatest(first + 1, last) AS last, greatest(2, least(8, greatest(first + 1, last) - first + 1)) AS n FROM s)
        SELECT DISTINCT event_id, round_even(first + (last - first) * i / (n - 1)::DOUBLE, 0)::BIGINT AS frame FROM k, range(8) AS t(i) WHERE i < n""",
    "media_arithmetic": """
        SELECT p_partkey, (least(720, p_size * 25 + p_partkey % 2) // 2 * 2)::INT AS proxy_height, greatest(1, ceil(p_retailprice / 100 / 2))::BIGINT AS cells,
               round(CASE WHEN p_partkey % 5 = 0 OR p_retailprice <= 0 THEN 900.0::DOUBLE ELSE greatest(120.0::DOUBLE, p_retailprice / 100 * 6) END, 6) AS budget,
               round_even(p_retailprice / 100 * 29.97::DOUBLE, 0)::BIGINT AS frame, greatest(1, round_even(0.5::DOUBLE * p_size, 0))::BIGINT AS least_frames,
               round(least(2.0::DOUBLE, 0.2::DOUBLE * pow(2.0::DOUBLE, p_partkey % 6)) * 1.5::DOUBLE, 6) AS backoff, round(0.2::DOUBLE + 0.7::DOUBLE * (p_partkey % 4) / 4, 6) AS progress FROM part""",
    "scenes": """
        WITH RECURSIVE e AS (SELECT user_id, row_number() OVER w - 1 AS frame, abs(value - lag(value) OVER w) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        c AS (SELECT user_id, frame FROM e WHERE change >= 27),
        n AS (SELECT user_id, count(*) AS frames FROM e GROUP BY user_id),
        s AS (SELECT user_id, 0 AS sequence_index, 0::BIGINT AS start_frame FROM n
              UNION ALL
              SELECT s.user_id, s.sequence_index + 1, (SELECT min(c.frame) FROM c WHERE c.user_id = s.user_id AND c.frame >= s.start_frame + 3) AS f
              FROM s WHERE (SELECT min(c.frame) FROM c WHERE c.user_id = s.user_id AND c.frame >= s.start_frame + 3) IS NOT NULL)
        SELECT user_id, sequence_index, start_frame, coalesce(lead(start_frame) OVER (PARTITION BY user_id ORDER BY sequence_index), frames) AS end_frame FROM s JOIN n USING (user_id)""",
    "latest_job_state": "SELECT user_id, event_id, event_type, value FROM events WHERE event_type <> 'ping' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "monotone_progress": "SELECT user_id, event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, max(value / 100) OVER (PARTITION BY user_id ORDER BY event_id))) AS progress FROM events",
    "monotone_check": """SELECT user_id, bool_and(ok) AS monotone FROM (
        SELECT user_id, coalesce(value >= lag(value) OVER (PARTITION BY user_id ORDER BY event_id), true) AS ok FROM events) GROUP BY user_id""",
    "sparkline_segments": """
        WITH p AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 3 THEN value END AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        q AS (SELECT *, greatest(0.0001::DOUBLE, max(y) OVER (PARTITION BY user_id)) AS top, count(*) FILTER (y IS NULL) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM p)
        SELECT user_id, event_id, island, round(CASE WHEN n > 1 THEN i * (240.0::DOUBLE / (n - 1)) ELSE 0 END, 3) AS x, round(40 - y / top * 40, 1) AS y FROM q WHERE y IS NOT NULL""",
    "frame_sharpness": _SHARP,
    "sharpest_frame": f"SELECT label, vec_id, sharpness FROM ({_SHARP}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY sharpness DESC, vec_id) = 1",
    "motion_energy": """
        WITH f AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings WHERE vec_id % 9 <> 4),
        d AS (SELECT label, vec_id, avg(abs(embedding[i]::DOUBLE - before[i]::DOUBLE)) AS change FROM f, range(1, 65) AS t(i) WHERE before IS NOT NULL GROUP BY label, vec_id)
        SELECT label, round(coalesce(avg(change), 0), 6) AS motion FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN d USING (label) GROUP BY label""",
    "downscaled_frames": """SELECT vec_id, (r // 4 * 2 + c // 4)::INT AS pos, round(avg(embedding[r * 8 + c + 1]::DOUBLE), 6) AS pixel FROM embeddings, range(8) AS a(r), range(8) AS b(c) GROUP BY vec_id, r // 4, c // 4""",
    "scaled_frames": """
        WITH w AS (SELECT r, i, greatest(0, least(i + 1, (r + 1) * 8 / 3.0::DOUBLE) - greatest(i, r * 8 / 3.0::DOUBLE)) * 3 / 8.0::DOUBLE AS w FROM range(3) AS a(r), range(8) AS b(i)),
        h AS (SELECT c, j, greatest(0, least(j + 1, (c + 1) * 8 / 5.0::DOUBLE) - greatest(j, c * 8 / 5.0::DOUBLE)) * 5 / 8.0::DOUBLE AS h FROM range(5) AS a(c), range(8) AS b(j))
        SELECT vec_id, (r * 5 + c)::INT AS pos, round(sum(w * h * embedding[i * 8 + j + 1]::DOUBLE), 6) AS pixel FROM embeddings, w, h GROUP BY vec_id, r, c""",
    "indexed_frames": """
        WITH f AS (SELECT vec_id // 20 AS clip, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda e: least(255, greatest(0, floor(e::DOUBLE * 40 + 128)))::BIGINT) AS p FROM embeddings),
        a AS (SELECT DISTINCT clip, k, unnest([0, 7, 14, 7, 21, -1]) AS frame, unnest([1, 2, 3, 4, 5, 6]) AS nth, false AS gone FROM f, (VALUES (1)) AS t(k) UNION ALL SELECT DISTINCT clip, 1, 0, 0, true FROM f)
        SELECT a.clip, a.frame, CASE WHEN gone THEN 'no_file' WHEN p IS NULL THEN 'no_frame' ELSE 'readable' END AS reading, CASE WHEN NOT gone THEN list_sum(p)::BIGINT END AS total, CASE WHEN NOT gone THEN p[10] END AS tenth
        FROM a LEFT JOIN f ON f.clip = a.clip AND f.frame = a.frame""",
    "stream_drift": """SELECT user_id, round(abs(max(e) FILTER (event_id % 2 = 0) - max(e) FILTER (event_id % 2 = 1)), 6) AS drift
        FROM (SELECT *, event_id / 10 + coalesce(value, 0) / 1000 AS e FROM events) GROUP BY user_id""",
    "probe_rates": f"""SELECT p_partkey, round({_RATIONAL.format("nominal")}, 9) AS nominal_fps, round({_RATIONAL.format("average")}, 9) AS average_fps,
        CASE CASE WHEN list_has_any(string_split(lower(container), ','), ['mov', 'mp4', 'm4a', '3gp', '3g2', 'mj2']) AND ({_RATIONAL.format("nominal")}) IS NOT NULL AND ({_RATIONAL.format("average")}) IS NOT NULL
        THEN ({_RATIONAL.format("nominal")}) <> ({_RATIONAL.format("average")}) END WHEN true THEN 'variable' WHEN false THEN 'constant' ELSE 'unknown' END AS mode FROM ({RATES.format(part="part")})""",
    "job_failure_class": f"""
        WITH l AS (SELECT event_id, list_filter(string_split(report, chr(10)), lambda x: trim(x) <> '') AS l FROM ({REPORTS.format(events="events")})),
        h AS (SELECT event_id, l, {", ".join(f"list_filter(l, lambda x: regexp_matches(lower(x), '{'|'.join(needles)}')) AS {name}" for name, needles in text.FAILURES)} FROM l),
        c AS (SELECT event_id, CASE {" ".join(f"WHEN len({name}) > 0 THEN {{'class': '{name}', 'line': {name}[1]}}" for name, _ in text.FAILURES)} ELSE {{'class': 'encode', 'line': coalesce(l[1], '')}} END AS f FROM h)
        SELECT event_id, f.class AS failure_class, substring(regexp_replace(trim(f.line), '(?:[A-Za-z]:)?(?:/[^/\\s''"]+)+/([^/\\s''"]+)', '.../\\1', 'g'), 1, 200) AS detail FROM c""",
    "probe_parse": f"""
        WITH d AS (SELECT p_partkey, CASE WHEN json_valid(document) THEN document::JSON END AS j FROM ({PROBES.format(part="part").replace("STRING", "VARCHAR")})),
        v AS (SELECT p_partkey, j, list_filter(json_extract(j, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'video')[1] AS v, list_filter(json_extract(j, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'audio')[1] AS a FROM d),
        f AS (SELECT p_partkey, j, v, v ->> 'codec_name' AS video_codec, a ->> 'codec_name' AS audio_codec, try_cast(a ->> 'sample_rate' AS INT) AS audio_sample_rate, j ->> '$.format.format_name' AS container_format,
                     (v ->> 'width')::INT AS w, (v ->> 'height')::INT AS h, v ->> 'r_frame_rate' AS nominal, v ->> 'avg_frame_rate' AS average, nullif(trim(v ->> 'color_primaries'), '') AS color_primaries, nullif(trim(v ->> 'color_transfer'), '') AS color_transfer,
                     coalesce(CASE WHEN try_cast(j ->> '$.format.duration' AS DOUBLE) > 0 THEN try_cast(j ->> '$.format.duration' AS DOUBLE) END, CASE WHEN try_cast(v ->> 'duration' AS DOUBLE) > 0 THEN try_cast(v ->> 'duration' AS DOUBLE) END) AS duration_seconds,
                     coalesce(((v ->> '$.side_data_list[0].rotation')::INT % 360 + 360) % 360, (try_cast(v ->> '$.tags.rotate' AS INT) % 360 + 360) % 360, 0)::INT AS rotation_degrees FROM v)
        SELECT p_partkey, container_format, duration_seconds, CASE WHEN rotation_degrees IN (90, 270) THEN h ELSE w END AS display_width, CASE WHEN rotation_degrees IN (90, 270) THEN w ELSE h END AS display_height, rotation_degrees,
               round(coalesce({_RATIONAL.format("average")}, {_RATIONAL.format("nominal")}), 6) AS fps_source,
               CASE WHEN list_has_any(string_split(container_format, ','), ['mov', 'mp4', 'm4a', '3gp', '3g2', 'mj2']) AND ({_RATIONAL.format("nominal")}) IS NOT NULL AND ({_RATIONAL.format("average")}) IS NOT NULL THEN ({_RATIONAL.format("nominal")}) <> ({_RATIONAL.format("average")}) END AS is_variable_frame_rate,
               video_codec, audio_codec, audio_sample_rate, color_primaries, color_transfer, coalesce(color_transfer IN ('arib-std-b67', 'smpte2084'), false) OR coalesce(color_primaries = 'bt2020', false) AS is_hdr,
               CASE WHEN j IS NULL THEN '{probe.NOT_JSON}' WHEN v IS NULL THEN '{probe.NO_VIDEO}' WHEN w * h <= 0 THEN '{probe.NO_SIZE}' WHEN duration_seconds IS NULL THEN '{probe.NO_DURATION}' END AS reject_reason FROM f""",
    "byte_ranges": f"""
        WITH p AS (SELECT p_partkey, size::BIGINT AS size, regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 1) AS f, regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 2) AS l,
                          coalesce(regexp_matches(header, '^bytes=[0-9]*-[0-9]*$'), false) AND size > 0 AS ok FROM ({RANGES.format(part="part")})),
        s AS (SELECT *, CASE WHEN NOT ok OR (f = '' AND l = '') THEN 200 WHEN f = '' THEN CASE WHEN l::BIGINT = 0 THEN 416 ELSE 206 END
                             WHEN f::BIGINT >= size THEN 416 WHEN l <> '' AND l::BIGINT < f::BIGINT THEN 200 ELSE 206 END AS status FROM p)
        SELECT p_partkey, CASE status WHEN 200 THEN 0 WHEN 206 THEN CASE WHEN f = '' THEN greatest(0, size - l::BIGINT) ELSE f::BIGINT END ELSE -1 END AS first_byte,
               CASE status WHEN 200 THEN size - 1 WHEN 206 THEN CASE WHEN f = '' OR l = '' THEN size - 1 ELSE least(l::BIGINT, size - 1) END ELSE -1 END AS last_byte, status FROM s""",
    "path_safety": f"""
        WITH p AS (SELECT *, list_transform(string_split(path, '/'), lambda x: CASE WHEN x = '..' THEN -1 WHEN x IN ('', '.') THEN 0 ELSE 1 END) AS steps, string_split(source, '/') AS parts FROM ({PATHS.format(part="part")}))
        SELECT p_partkey, NOT regexp_matches(path, '^(/|[A-Za-z]:)') AND list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) >= 0 AS contained,
               NOT regexp_matches(source, '^-|^[A-Za-z][A-Za-z0-9+.-]+:') AS safe, len(list_filter(parts, lambda x: x = 'OneDrive' OR starts_with(x, 'OneDrive ') OR starts_with(x, 'OneDrive-'))) > 0 AS synced FROM p""",
    "store_paths": """SELECT p_partkey, s AS suffix, 'media/blobs/' || sha[1:2] || '/' || sha || '/source' || s AS blob, CASE WHEN p_size >= 1 THEN 'media/derived/' || sha[1:2] || '/' || sha || '/proxy/' || p_size || '/proxy.mp4' END AS derived
        FROM (SELECT *, sha256(p_partkey::VARCHAR) AS sha, CASE p_size % 3 WHEN 0 THEN '.mkv' WHEN 1 THEN '.wavx' ELSE '.bin' END AS s FROM part)""",
    "display_formats": """
        WITH p AS (SELECT *, floor(p_retailprice * 7)::BIGINT AS w, floor(p_retailprice)::BIGINT AS t, (p_partkey * p_partkey * p_size * 7)::BIGINT AS b FROM part)
        SELECT p_partkey, CASE WHEN w >= 3600 THEN (w // 3600) || ':' || lpad((w % 3600 // 60)::VARCHAR, 2, '0') ELSE (w // 60)::VARCHAR END || ':' || lpad((w % 60)::VARCHAR, 2, '0') AS duration,
               CASE WHEN t >= 3600 THEN (t // 3600) || ':' || lpad((t % 3600 // 60)::VARCHAR, 2, '0') ELSE (t // 60)::VARCHAR END || ':' || lpad((t % 60)::VARCHAR, 2, '0') || '.12' AS timecode,
               CASE WHEN b < 1024 THEN b || ' B' ELSE (SELECT CASE WHEN v >= 100 THEN printf('%.0f', round(v, 0)) ELSE printf('%.1f', round(v, 1)) END || u FROM (SELECT
                    CASE WHEN b < 1024 ** 2 THEN b / 1024 WHEN b < 1024 ** 3 THEN b / 1024 ** 2 WHEN b < 1024 ** 4 THEN b / 1024 ** 3 ELSE b / 1024 ** 4 END AS v,
                    CASE WHEN b < 1024 ** 2 THEN ' KB' WHEN b < 1024 ** 3 THEN ' MB' WHEN b < 1024 ** 4 THEN ' GB' ELSE ' TB' END AS u)) END AS bytes,
               CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE printf('%.2f', p_size + 0.25::DOUBLE) END AS fps, floor(100 * least(1, greatest(0, p_retailprice / 2000)) + 0.5)::INT AS percent,
               CASE WHEN p_size % 4 = 0 THEN '—' ELSE p_size || 'x' || (p_size % 4) END AS resolution, CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'variable' ELSE 'constant' END AS mode FROM p""",
}
