"""The training-data pipeline: documents in, shards out. Every stage is written as Parquet and reread by the next.

Columns of `documents` pass through unchanged until the last stage. Stages take nulls in any column, empty tables and
more columns than they know; names that start with `__` are theirs. Each row is decided for itself: ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.llm.decontamination import contaminated
from spoolworks.llm.language_id import UNDETERMINED, VOCABULARY, learn, pieces, predict
from spoolworks.llm.mixing import mix
from spoolworks.llm.near_dedup import near_duplicates
from spoolworks.llm.sharding import shard
from spoolworks.sources.tables import table, written

LEAST_SHARE = 0.5
NEAR_PERCENT = 80
LEAK_PERCENT = 80
MIX_SEED = 7
SHARDS = 40
ROW = "__row"
#: Files whose numbers are broadcast: some 40 MB.
MOST_FILES = 2_000_000


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a key of each row's own that is the same in every read: the number of its file and its place there.
    Rows that come from no file are written first. Files get their numbers by the hash of their path, 12 bytes each, so the
    table of numbers is broadcast up to `MOST_FILES` of them and no text is moved; beyond that, or where two paths share a
    hash, files and rows are joined."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)
    files = written(placed.select("__file").distinct().select("__file", F.xxhash64("__file").alias("__h"), F.row_number().over(Window.orderBy("__file")).alias("__n")), name)
    paths, hashes = files.agg(F.count("*"), F.count_distinct("__h")).first()
    if paths == hashes <= MOST_FILES:
        numbered = placed.withColumn("__h", F.xxhash64("__file")).join(F.broadcast(files.select("__h", "__n")), "__h")
    else:
        numbered = placed.join(files, "__file")
    return numbered.withColumn(ROW, F.col("__n") * (1 << 40) + F.col("__at")).drop("__file", "__at", "__n", "__h")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents with a language: texts without a letter go, and those no learned language has half the probability of.
    In practice only the former: the probability of a whole text is near 1 after a few words. `vocabulary` is a file on
    the driver's disk."""
    model = learn(docs, pieces(vocabulary), "doc_id", "text", "lang")
    found = predict(docs, model, lang_col="__lang", score_col="__share")
    return found.where((F.col("__lang") != UNDETERMINED) & (F.col("__share") >= LEAST_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (null last, then any one row of it).
    Texts without words stay."""
    rows = keyed(docs, "near-rows")
    found = near_duplicates(rows, percent=NEAR_PERCENT, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    stay = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order)[ROW].alias(ROW))
    return rows.join(stay.select(ROW), ROW, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    rows = keyed(docs, "leak-rows")
    leaks = contaminated(rows, table(spark, sf_dir, "benchmark"), percent=LEAK_PERCENT, id_col=ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(leaks, ROW, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times, a row each time."""
    rows = keyed(docs, "mix-rows")
    taken = mix(rows, seed=MIX_SEED, row_col=ROW).select(ROW, F.col("copies").alias("__copies")).where("__copies > 0")
    both = rows.join(taken, ROW)
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot."""
    return shard(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Sampled languages, rounding draws and sketches are not SQL; tests hold the pipeline against a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
