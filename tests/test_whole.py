"""Queries read every row of their tables: against plain Python over the whole tables."""

import collections

import duckdb

from spoolworks.operators import lookups, sequences
from spoolworks.plans.registry import ORACLE_SQL, QUERIES
from spoolworks.sources import files


def events_of(spark, sf):
    found = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value").orderBy("event_id").collect():
        found[r.user_id].append(r)
    return found


def test_monotone_check_reads_all_events(spark, sf):
    want = {u: all(b.value >= a.value for a, b in zip(rows, rows[1:], strict=False)) for u, rows in events_of(spark, sf).items()}
    assert {r.user_id: r.monotone for r in QUERIES["monotone_check"](spark, sf).collect()} == want


def test_candidate_timestamps_reads_all_events(spark, sf):
    want = {(r.event_id, i): round(r.value + 5 * (i + 1) / 4, 6) for rows in events_of(spark, sf).values() for r in rows for i in range(3)}
    found = {(r.event_id, r.pos): r.at for r in QUERIES["candidate_timestamps"](spark, sf).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)


def test_sample_indices_reads_all_events(spark, sf):
    want = set()
    for rows in events_of(spark, sf).values():
        for r in rows:
            first = round(r.value * 30)
            last = max(first + 1, round((r.value + r.event_id % 3 * 0.5) * 30))
            n = max(2, min(8, last - first + 1))
            want |= {(r.event_id, round(first + (last - first) * i / (n - 1))) for i in range(n)}
    found = [tuple(r) for r in QUERIES["sample_indices"](spark, sf).select("event_id", "frame").collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_clip_neighbours_answers_all_events(spark, sf):
    want = {}
    for rows in events_of(spark, sf).values():
        for r in rows:
            at = r.event_id % 90
            want[r.event_id] = (at, float(abs(rows[at].event_id - r.event_id)) if at < len(rows) else 1e308)
    assert {r.event_id: (r.frame, r.error) for r in QUERIES["clip_neighbours"](spark, sf).collect()} == want


def test_clip_neighbours_of_missing_repeated_and_many_ids(spark, tmp_path):
    ids = [(u, i * 7 + u) for u in range(5) for i in range(60 * u)]  # users 2 to 4 have ids beyond the 90 positions that are asked for
    ids += [(u, None) for u in range(6) for _ in range(40 * u)] + [(None, 3), (None, None), (7, -5), *[(8, 10)] * 3]
    spark.createDataFrame(ids, "user_id long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["clip_neighbours"]).fetchall()
    assert len(want) == len(ids) and collections.Counter(map(tuple, QUERIES["clip_neighbours"](spark, str(tmp_path)).collect())) == collections.Counter(want)


def test_scoped_scenes_numbers_every_clip(spark, sf):
    lines = collections.Counter(r.l_orderkey for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").collect())
    places = collections.defaultdict(list)
    for r in QUERIES["scoped_scenes"](spark, sf).select("l_orderkey", "scene", "l_partkey").collect():
        places[r.l_orderkey].append((r.scene, r.l_partkey))
    assert {k: len(v) for k, v in places.items()} == lines
    for found in places.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found))) and [p for _, p in found] == sorted(p for _, p in found)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_key_is_gathered_into_an_array(spark, sf):
    for name in ("clip_neighbours", "scenes"):
        assert "collect_list" not in plan_of(QUERIES[name](spark, sf))


def test_scenes_of_null_and_busy_clips(spark):
    frames = [(None, i, 30.0 if i in (2, 4, 5) else 0.0) for i in range(7)] + [(1, i, 30.0) for i in range(5000)] + [(2, 0, None)]
    found = sequences.cuts_to_scenes(spark.createDataFrame(frames, "k long, i long, change double"), "k", ["i"], "change", 27.0, 3).collect()
    want = {(None, 0, 0, 4), (None, 1, 4, 7), (2, 0, 0, 1)} | {(1, n, 3 * n, min(3 * n + 3, 5000)) for n in range(1667)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_finished_sum_tells_changes_and_not_order(spark):
    one = [("a", 1, "done"), ("a", 2, "failed"), ("a", 3, "queued"), ("b", 4, "running"), (None, 5, "done")]
    sums = lambda rows: {r.s: (r.n, r.finished) for r in lookups.finished_sum(spark.createDataFrame(rows, "s string, j long, status string"), "s", "j", "status").collect()}
    first = sums(one)
    assert first == sums(one[::-1]) and first["b"] == (0, 0) and first["a"][0] == 2 and first[None][0] == 1
    assert sums([*one[:2], ("a", 3, "done"), *one[3:]])["a"] != first["a"]


def test_stream_end_adds_the_last_step(spark):
    times = spark.createDataFrame([("a", 0.0), ("a", 3.5), ("a", 3.0), ("b", 2.0), (None, 1.0), (None, 3.0)], "k string, t double")
    assert {tuple(r) for r in sequences.stream_end(times, "k", "t").collect()} == {("a", 4.0), ("b", 2.0), (None, 5.0)}


def test_rows_of_lost_files_go(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "x")], "id int, stored_path string")
    assert sorted(r.id for r in files.without_lost(rows, spark.createDataFrame([("x",), ("x",), ("z",)], "path string")).collect()) == [1, 4]


def test_descendants_of_chains_cycles_and_orphans(spark):
    nodes = [(0, None), *[(i, i - 1) for i in range(1, 300)], (500, None), (600, 601), (601, 600), (700, 999), (501, 500)]
    found = {r.node: (r.root, r.depth) for r in lookups.descendants(spark.createDataFrame(nodes, "n long, p long"), "n", "p").collect()}
    assert found == {i: (0, i) for i in range(300)} | {500: (500, 0), 501: (500, 1)}


def test_utc_times_tell_naive_from_unreadable(spark):
    from pyspark.sql import functions as F

    from spoolworks.functions import timing

    cases = {"2024-03-01 10:00:00+05": ("2024-03-01 05:00:00", False, False), "2024-03-01 10:00:00 UTC": ("2024-03-01 10:00:00", False, False), "2024-03-01T10:00:00.5Z": ("2024-03-01 10:00:00", False, False), "2024-03-01 10:00:00": (None, True, False), "2024-03-05": (None, True, False), "soon": (None, False, True), "": (None, False, True), "2024-03-01 99:00:00Z": (None, False, True), None: (None, False, False)}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", timing.utc_time(F.col("t")).alias("u")).collect()
    assert {r.t: tuple(r.u) for r in rows} == cases


def test_rows_on_both_sides_are_all_rows(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 2 = 1").count()
    assert QUERIES["adopted_uploads"](spark, sf).count() == orders
