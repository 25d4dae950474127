"""Scalar rules on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from spoolworks.functions import probe, requests, text, timing

PROBES = [
    '{"streams":[{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"30/1","avg_frame_rate":"1560/121","side_data_list":[{"rotation":-90}]},{"codec_type":"audio","codec_name":"aac","sample_rate":"44100"}],"format":{"format_name":"mov,mp4,m4a,3gp,3g2,mj2","duration":"12.5"}}',
    '{"streams":[{"codec_type":"video","codec_name":"vp9","width":640,"height":360,"r_frame_rate":"25/1","avg_frame_rate":"0/0","duration":"3.5","tags":{"rotate":"180"},"color_transfer":" arib-std-b67 "}],"format":{"format_name":"matroska,webm","duration":"N/A"}}',
    '{"streams":[{"codec_type":"audio","codec_name":"aac"}],"format":{"format_name":"mp4","duration":"1"}}',
    '{"streams":[{"codec_type":"video","width":10,"height":10}],"format":{"format_name":"mp4"}}',
    '{"streams":[{"codec_type":"video","width":0,"height":10}],"format":{"format_name":"mp4","duration":"2"}}',
    "not json",
]


def one(spark, column, **values):
    """A column's value on one row of strings."""
    row = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} string" for k in values) or "x string")
    return row.select(column.alias("v")).first().v


def test_rational(spark):
    cases = {"30/1": 30.0, "30000/1001": 30000 / 1001, "60/2": 30.0, "0/0": None, "0/1": None, "N/A": None, "": None, "30": None, "5/-1": -5.0, "1d/2": None}
    for value, want in cases.items():
        assert one(spark, probe.rational(F.col("r")), r=value) == want


def test_probe_document(spark):
    rows = [r.p for r in spark.createDataFrame([(p,) for p in PROBES], ["d"]).select(probe.parsed(F.col("d")).alias("p")).collect()]
    assert [r.reject_reason for r in rows] == [None, None, probe.NO_VIDEO, probe.NO_DURATION, probe.NO_SIZE, probe.NOT_JSON]
    first, second = rows[:2]
    assert (first.display_width, first.display_height, first.rotation_degrees, first.is_variable_frame_rate) == (1080, 1920, 270, True)
    assert (second.rotation_degrees, second.duration_seconds, second.fps_source, second.is_variable_frame_rate, second.is_hdr) == (180, 3.5, 25.0, None, True)


def test_rounding_is_half_even(spark):
    assert one(spark, timing.frame_at(F.lit(2.5), F.lit(1.0))) == 2
    assert one(spark, timing.frame_at(F.lit(3.5), F.lit(1.0))) == 4


def test_silence(spark):
    levels = spark.createDataFrame([(None,), (-60.01,), (float("-inf"),), (float("nan"),), (0.0,)], "db double")
    assert [r.v for r in levels.select(timing.linear_from_db(F.col("db")).alias("v")).collect()] == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_overall_level(spark):
    assert one(spark, timing.overall_level(F.col("t")), t="RMS level dB: -20.5\nRMS level dB: -inf\nRMS level dB: -31.25") == -31.25
    assert one(spark, timing.overall_level(F.col("t")), t="RMS level dB: -inf") == -math.inf
    assert one(spark, timing.overall_level(F.col("t")), t="nothing") is None


def test_progress_line(spark):
    for line, want in {"out_time_us=5000000": 0.5, "out_time_us=N/A": None, "frame=3": None, "out_time_us=99000000": 1.0}.items():
        assert one(spark, timing.progress_fraction(F.col("s"), F.lit(10.0)), s=line) == want


def test_anchors_refuse_a_trailing_line_break(spark):
    assert one(spark, text.is_digest(F.col("s")), s="a" * 64) is True
    assert one(spark, text.is_digest(F.col("s")), s="a" * 64 + "\n") is False


def test_redaction(spark):
    assert one(spark, text.redacted(F.col("s")), s=r"open C:\users\me\clip.mp4 at fps=1/2") == "open .../clip.mp4 at fps=1/2"


def test_contrast(spark):
    assert round(one(spark, text.contrast_ratio(F.lit("#000000"), F.lit("#ffffff"))), 6) == 21.0


def test_version_token(spark):
    assert one(spark, text.version_token(F.col("s")), s="ffmpeg version 6.1.1-static x\nmore") == "6.1.1-static"
    assert one(spark, text.version_token(F.col("s")), s="other version 1") is None


@pytest.mark.parametrize("limit", [-1, 0, 201])
def test_limits_out_of_bounds_are_refused(limit):
    assert [requests.page_limit(n) for n in (1, 200)] == [1, 200]
    with pytest.raises(ValueError):
        requests.page_limit(limit)


def test_sending_steps_and_seeks(spark):
    rows = [("sending scene 2 of 9 to Gemini for analysis", 5.0, 40.0), ("Sending scene 2 of 9", -9.0, float("nan")), (None, 99.0, 40.0)]
    found = spark.createDataFrame(rows, "step string, delta double, duration double").select(requests.sending_step(F.col("step")).alias("s"), requests.seek(F.lit(3.0), F.col("delta"), F.col("duration")).alias("at")).collect()
    assert [r.s and tuple(r.s) for r in found] == [(2, 9), None, None] and [r.at for r in found] == [8.0, 0.0, 40.0]
