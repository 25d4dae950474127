"""A sink that may be replayed: every micro-batch has a place of its own, so writing it again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(events: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """A stream without the repeats of a key that come within `delay` of event time; state older than that goes, and so do rows that are
    later than that. Null keys are one key."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def write_changes(changes: DataFrame, path: str, checkpoint: str, after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start a stream that appends its rows below `path`, a folder a micro-batch, until what is there now is done.

    A batch is written with the number the checkpoint gives it, in place of what an earlier try left there. The number is the same when
    a batch is run again after a crash, be it between the write and the commit, so each batch is there once. Only new rows are
    written, whatever the size of the table. `after_write` is told the number of each batch once its rows are there.
    """

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after_write is not None:
            after_write(number)

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame | None:
    """The newest row of each key by `order`, of equals that of the latest batch; None before the first batch. Tasks combine their rows before
    the shuffle, so a key of very many changes sends one row a task. Folders that a crash left unfinished have no _SUCCESS
    and are written again by the stream before it goes on."""
    try:
        changes = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException:
        return None
    rest = [c for c in changes.columns if c not in key]
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, "batch")).alias("__row"))
    return newest.select(*key, "__row.*").drop("batch")


def compacted(spark: SparkSession, path: str, key: list[str], order: list[str], upto: int, base: str) -> None:
    """Write the newest row of each key of batches up to `upto` to `base`, as one batch with that number: what current() gives of `base`
    and the later batches is what it gave of all of them."""
    changes = spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") <= upto)
    rest = [c for c in changes.columns if c not in key]
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, "batch")).alias("__row"))
    newest.select(*key, "__row.*").drop("batch").write.mode("overwrite").parquet(f"{base}/batch={upto}")
