"""State machines: rules on small cases, and batches against streams."""

from spoolworks.operators import rows, tagging
from spoolworks.plans import text_queries
from spoolworks.streaming import jobs, uploads


def run(step, key, events):
    state, out = None, []
    for i, e in enumerate(events):
        state, answer = step(state, {key: 1, "seq": i, "value": float("nan"), **e})
        out.append(answer)
    return out


def states(*actions):
    out = run(jobs.step, "job_id", [{"action": a} if isinstance(a, str) else {"action": "report", "value": a} for a in actions])
    return [(o["accepted"], o["status"], o["progress"]) for o in out]


def test_a_cancel_has_three_cases():
    assert states("submit", "cancel", "start", "submit") == [(True, "queued", 0.0), (True, "cancelled", 0.0), (False, "cancelled", 0.0), (False, "cancelled", 0.0)]
    assert states("start", "task", 0.4, "cancel", "finish")[3:] == [(True, "cancelled", 0.4), (False, "cancelled", 0.4)]
    # Running, but the task does not exist yet: the request is kept, and honoured the moment it does.
    assert states("start", "cancel", "cancel", "finish", "task", "finish")[1:] == [(True, "running", 0.0), (True, "running", 0.0), (False, "running", 0.0), (True, "cancelled", 0.0), (False, "cancelled", 0.0)]
    assert states("start", "task", "finish", "cancel")[2:] == [(True, "succeeded", 1.0), (False, "succeeded", 1.0)]
    assert states("start", "cancel", "fail", "task")[2:] == [(True, "failed", 0.0), (False, "failed", 0.0)]


def test_only_tasks_report_and_finish_and_progress_never_falls():
    assert states("start", 0.5, "task", "task", 0.4, 0.2, float("nan"), 7.0)[1:] == [(False, "running", 0.0), (True, "running", 0.0), (False, "running", 0.0), (True, "running", 0.4), (True, "running", 0.4), (True, "running", 0.4), (True, "running", 1.0)]


def test_recovery_starts_over():
    assert states("start", "cancel", "recover", "start", "task", "finish") == [(True, "running", 0.0), (True, "running", 0.0), (True, "queued", 0.0), (True, "running", 0.0), (True, "running", 0.0), (True, "succeeded", 1.0)]
    assert states("start", "task", 0.7, "recover", "start", 0.1)[3:] == [(True, "queued", 0.0), (True, "running", 0.0), (False, "running", 0.0)]
    assert states("start", "task", "finish", "recover")[-1] == (False, "succeeded", 1.0)


def test_chunks_must_continue():
    c = lambda offset, length=10: {"action": "chunk", "offset": offset, "length": length, "declared": 20}
    f = {"action": "finalize", "declared": 20}
    out = run(uploads.step, "upload_id", [c(5), c(0), c(10, 11), f, c(10), f, f, c(20)])
    assert [o["outcome"] for o in out] == ["wrong_offset", "accepted", "too_large", "incomplete", "accepted", "completed", "duplicate", "closed"]


def streamed(spark, tmp_path, actions, run_stream):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    actions.repartition(1).sortWithinPartitions("seq").write.parquet(source)
    stream = run_stream(spark.readStream.schema(actions.schema).parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_job_stream_equals_batch(spark, sf, tmp_path):
    actions = text_queries._job_actions(spark, sf)
    assert sorted(streamed(spark, tmp_path, actions, jobs.run_stream).collect()) == sorted(jobs.run_batch(actions).collect())


def test_upload_stream_equals_batch(spark, sf, tmp_path):
    actions = text_queries._upload_actions(spark, sf)
    assert sorted(streamed(spark, tmp_path, actions, uploads.run_stream).collect()) == sorted(uploads.run_batch(actions).collect())


def test_token_bucket(spark):
    requests = spark.createDataFrame([("k", i, t, d) for i, (t, d) in enumerate([(0.0, "a"), (0.0, "a"), (0.0, "a"), (30.0, "a"), (30.0, "a"), (31.0, "b"), (60.0, "b")])], "key string, request_id long, at double, day string")
    found = [r.granted for r in tagging.token_bucket(requests, per_minute=2, per_day=3).orderBy("request_id").collect()]
    assert found == [True, True, False, True, False, False, True]


def test_a_second_append_adds_nothing_and_null_keys_stay_distinct(spark):
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "e"), (None, "f")], "k int, v string")
    assert sorted(r.v for r in rows.append_new(have, new, ["k"], ["v"]).collect()) == ["c", "e", "f"]


def test_valid_rows_pass_null_checks(spark):
    good, bad = rows.split_valid(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), {"positive": "x > 0"})
    assert good.count() == 2 and [r.failed_checks for r in bad.collect()] == [["positive"]]
