"""Settings over defaults, upload bodies, updates in place: corner cases beside the queries' SQL."""

import hashlib

from pyspark.sql import functions as F

from spoolworks.operators import rows
from spoolworks.sources import settings
from spoolworks.streaming import uploads


def test_settings_over_defaults(spark):
    lines = [
        (1, 0, 1, "ENGINE_PORT=9000"), (1, 1, 0, "engine_port = 9001"), (1, 0, 2, "ENGINE_PORT=9002"), (1, 0, 3, "LOG_LEVEL='warning'"), (1, 0, 4, "UI_PORT=0"), (1, 0, 5, "gemini_daily_limit=-1"),
        (1, 0, 6, "export DATA_DIR=\"../x/./y//z\""), (1, 0, 7, "TORCH_DEVICE=metal"), (1, 0, 8, "EXTRA_ALLOWED_HOSTS= b ,, a,b "), (1, 0, 9, "GEMINI_RPM_LIMIT=1.5"), (1, 0, 10, "ENGINE_URL="),
        (2, 0, 1, "# LOG_LEVEL=DEBUG"), (2, 0, 2, None), (2, 0, 3, "no setting"), (2, 0, 4, "OTHER=1"), (None, 0, 1, "UI_PORT=65535"), (None, 0, 1, "ui_port=65536"), (None, 1, 1, "engine_port=99999999999999999999"),
    ]
    found = settings.effective(spark.createDataFrame([(*line, "x") for line in lines], "scope long, rank int, place int, line string, value string"), "/srv/app")
    at = {(r.scope, r.name): (r.value, r.origin, r.problem) for r in found.collect()}
    assert len(at) == 3 * len(settings.SETTINGS)
    assert at[1, "engine_port"] == ("9001", 1, None) and at[1, "log_level"] == ("WARNING", 0, None) and at[1, "ui_port"] == (None, 0, "too small") and at[1, "gemini_daily_limit"] == (None, 0, "too small")
    assert at[1, "data_dir"] == ("/srv/x/y/z", 0, None) and at[1, "torch_device"] == (None, 0, "unknown word") and at[1, "extra_allowed_hosts"] == ("b,a,b", 0, None)
    assert at[1, "gemini_rpm_limit"] == (None, 0, "no whole number") and at[1, "engine_url"] == ("", 0, None)
    assert {n: v for (s, n), v in at.items() if s == 2} == {n: ("/srv/app/data" if k == "path" else d, None, None) for n, (k, d) in settings.SETTINGS.items()}
    assert at[None, "ui_port"] == (None, 0, "too large") and at[None, "engine_port"] == (None, 1, "no whole number")
    assert settings.effective(spark.createDataFrame([], "scope long, rank int, place int, line string")).isEmpty()


def test_paths_keep_below_the_root(spark):
    asked = ["/a/../../b", "a//b/", "..", "", ".", "/", "x/.."]
    found = spark.createDataFrame([(p,) for p in asked], "p string").select(settings.anchored(F.col("p"), "/r/s/")).collect()
    assert [r[0] for r in found] == ["/b", "/r/s/a/b", "/r", "/r/s", "/r/s", "/", "/r/s"]


def test_updates_in_place(spark):
    current = spark.createDataFrame([(1, "a", 1.0, "keep"), (2, "b", 2.0, "keep"), (2, "b", 2.5, "twin"), (3, None, None, "keep"), (None, "n", 9.0, "keep")], "id long, kind string, value double, other string")
    changes = spark.createDataFrame([(1, 1, "x", 5.0), (1, 2, None, 6.0), (2, 1, "y", None), (2, 1, "y", 7.0), (7, 1, "new", 1.0), (None, 1, "z", 0.0), (3, None, "s", 3.0)], "id long, change_seq int, kind string, value double")
    found = {tuple(r) for r in rows.updated(current, changes, ["id"], ["kind", "value"]).collect()}
    assert found == {(1, None, 6.0, "keep"), (2, "y", 7.0, "keep"), (2, "y", 7.0, "twin"), (3, "s", 3.0, "keep"), (None, "n", 9.0, "keep")}
    assert rows.updated(current, changes.where("false"), ["id"], ["kind"]).exceptAll(current).isEmpty()


def test_upload_bodies(spark):
    """Pieces sent twice, out of order, beyond the size; an upload of many bodies streams through one digest."""
    big = [(5, i, i * 10, bytes([i % 251]) * 10, 30000) for i in range(3000)]
    chunks = [(1, 0, 0, b"ab", 5), (1, 1, 0, b"ab", 5), (1, 2, 3, b"d", 5), (1, 3, 2, b"cd", 5), (1, 4, 4, b"efg", 5), (1, 5, 4, b"e", 5), (2, 0, 1, b"x", 9), (3, 0, 0, b"", 0), (None, 0, 0, b"q", 1), (4, 0, 0, None, 1), *big]
    found = uploads.stored_digests(spark.createDataFrame(chunks, "upload_id long, seq long, offset long, body binary, declared long")).collect()
    whole = {1: b"abcde", 3: b"", 5: b"".join(c[3] for c in big)}
    assert sorted(map(tuple, found)) == [(i, len(b), hashlib.sha256(b).hexdigest()) for i, b in whole.items()]
    empty = spark.createDataFrame([], "upload_id long, seq long, offset long, body binary, declared long")
    assert uploads.stored_digests(empty).isEmpty()
