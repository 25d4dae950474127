"""A stream that is killed between write and commit, and started again, gives the table of a batch upsert."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.plans.registry import QUERIES
from spoolworks.streaming import sinks

SCHEMA = "id long, at timestamp, seq long, value string"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def given(spark, tmp_path):
    """Five files with keys that come again, and whole events that come twice."""
    folder = str(tmp_path / "in")
    for n in range(5):
        rows = [(i % 7 if i % 11 else None, 1_700_000_000 + n * 60 + i, n * 100 + i, f"v{n}-{i}") for i in range(20)]
        made = spark.createDataFrame(rows + rows[:4], "id long, at long, seq long, value string").withColumn("at", F.timestamp_seconds("at"))
        made.coalesce(1).write.mode("append").parquet(folder)
    return folder


def newest(spark, folder):
    every = spark.read.schema(SCHEMA).parquet(folder)
    ranked = every.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq"))))
    return sorted(map(str, ranked.where("n = 1").select("id", "at", "seq", "value").collect()))


@pytest.mark.parametrize("fails_at", [0, 2, 4])
def test_a_killed_stream_goes_on(spark, tmp_path, given, fails_at):
    path, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    tries = []

    def killed(number):
        tries.append(number)
        if number == fails_at and tries.count(number) == 1:
            raise RuntimeError("killed")

    changes = sinks.once(stream(spark, given), ["seq"], "at", "1 hour")
    with pytest.raises(Exception, match="killed"):
        sinks.write_changes(changes, path, marks, killed).awaitTermination()
    sinks.write_changes(changes, path, marks, killed).awaitTermination()
    assert tries.count(fails_at) == 2 and set(range(5)) <= set(tries)
    assert sorted(map(str, sinks.current(spark, path, ["id"], ["seq"]).select("id", "at", "seq", "value").collect())) == newest(spark, given)
    assert spark.read.parquet(f"{path}/batch=*").count() == 100  # repeats of an event are gone
    again = len(tries)
    sinks.write_changes(changes, path, marks, killed).awaitTermination()
    assert spark.read.parquet(f"{path}/batch=*").count() == 100 and len(tries) - again <= 1


def test_a_compacted_table_says_the_same(spark, tmp_path, given):
    path, base = str(tmp_path / "out"), str(tmp_path / "base")
    assert sinks.current(spark, path, ["id"], ["seq"]) is None
    sinks.write_changes(stream(spark, given), path, str(tmp_path / "marks")).awaitTermination()
    sinks.compacted(spark, path, ["id"], ["seq"], 4, base)
    assert sorted(map(str, sinks.current(spark, base, ["id"], ["seq"]).select("id", "at", "seq", "value").collect())) == newest(spark, given)


def test_streamed_states(spark, sf, compare):
    from spoolworks.plans.registry import ORACLE_SQL

    compare(QUERIES["streamed_states"], ORACLE_SQL["streamed_states"])
