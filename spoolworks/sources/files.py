"""Files as rows: listings, whole texts, byte slices, a state file, EXIF-free images."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed value: bytes of a chunk of a served file.
CHUNK = 64 << 10
#: Bytes of a block of a digest, and of a file that may be one row: binary columns end at 2 GB.
BLOCK, WHOLE_FILE = 1 << 20, 256 << 20


class UnreadableFile(RuntimeError):
    """A file that can't be opened or read where a task runs."""


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, modified) of the files below a path. Contents are not read; Spark lists no empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def local_path(path: str) -> str:
    """The path in a file system that tasks have mounted, of a `file:` URI or a plain path; other schemes are refused by name."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise UnreadableFile(f"{parts.scheme}: is read by Spark only, whole files up to {WHOLE_FILE} bytes")
    return unquote(parts.path) if parts.scheme else path


def block_digest(path: str, block: int = BLOCK) -> str:
    """SHA-256 of a file of any size, read block by block."""
    digest = hashlib.sha256()
    try:
        with open(local_path(path), "rb") as handle:
            while data := handle.read(block):
                digest.update(data)
    except OSError as error:
        raise UnreadableFile(f"{path}: {error.strerror}") from error
    return digest.hexdigest()


def digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE, block: int = BLOCK) -> DataFrame:
    """(path, name, length, sha256) of the files below a path, of any size.

    Up to `whole` bytes a file is one row that Spark reads from whatever store it is in. Larger ones are streamed through
    the digest in blocks of `block` bytes, so a task holds one block; tasks must have such files mounted, else the error
    says so. Each large file is a task, as a digest can't be made in parts.
    """
    found = listing(spark, path)
    small = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= whole)
    small = small.select("path", F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > whole).select("path").repartition(F.col("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([block_digest(p, block)])], ["path", "sha256"])

    return found.drop("modified").join(small.union(large.mapInArrow(run, "path string, sha256 string")), "path").select("path", "name", "length", "sha256")


def stored_length(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) below a path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def present(rows: DataFrame, listing: DataFrame, stored: str = "stored_path") -> DataFrame:
    """`rows` with `on_disk`: a row may outlive its file. listing: (stored path)."""
    there = listing.select(F.col(listing.columns[0]).alias("__there")).distinct()
    return rows.join(there, F.col(stored) == F.col("__there"), "left").withColumn("on_disk", F.col("__there").isNotNull()).drop("__there")


def without_lost(rows: DataFrame, listing: DataFrame, stored: str = "stored_path") -> DataFrame:
    """`rows` without those whose file is gone; a null path has no file. listing: (stored path)."""
    lost = present(rows, listing, stored).where("NOT on_disk").select(F.col(stored).alias("__lost")).distinct()
    return rows.where(F.col(stored).isNotNull()).join(lost, F.col(stored) == F.col("__lost"), "left_anti")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each text file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listed(names: Column) -> Column:
    """The parts of a NUL-separated list."""
    return F.filter(F.split(names, "\x00"), lambda n: n != "")


def setting_list(value: Column) -> Column:
    """The parts of a comma-separated setting, trimmed, empty ones left out, in order and once each."""
    return F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != ""))


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end, both counted, of a binary."""
    return F.substring(content, start + 1, end - start + 1)


def chunk_spans(start: Column, end: Column, size: int = CHUNK) -> Column:
    """struct(start, end), both counted, of each chunk that the bytes start to end are sent in; none if there are no such bytes."""
    spans = F.transform(F.sequence(start, F.greatest(start, end), F.lit(size).cast("long")), lambda a: F.struct(a.alias("start"), F.least(a + size - 1, end).alias("end")))
    return F.filter(spans, lambda s: s["start"] <= s["end"])


def day_count(state: Column, today: Column, limit: int) -> Column:
    """Requests already spent today by a state file's JSON (date, count): none if it is of another day, all if it can't be read."""
    parsed = F.try_parse_json(state)
    day, count = F.try_variant_get(parsed, "$.date", "string"), F.try_variant_get(parsed, "$.count", "long")
    return F.when(day.isNull() | count.isNull() | (count < 0), F.lit(limit)).when(day != today, F.lit(0)).otherwise(count).cast("long")


# Markers of a JPEG, and how the payload of an EXIF segment begins.
JPEG_START, SCAN, APP1 = b"\xff\xd8", 0xDA, 0xE1
WITHOUT_LENGTH = {0xD8, 0xD9, *range(0xD0, 0xD8)}
EXIF = b"Exif\x00\x00"


@F.pandas_udf(T.BinaryType())
def without_exif(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JPEG bytes without their EXIF segments; other APP1 segments stay. What is no JPEG or ends inside a segment's head comes
    back as it is."""

    def strip(data: bytes | None) -> bytes | None:
        if data is None or not data.startswith(JPEG_START):
            return data
        out, at = [JPEG_START], 2
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] != bytes([SCAN]):
            head = data[at : at + 4]
            if len(head) > 1 and head[1] in WITHOUT_LENGTH:
                size = 2
            elif len(head) < 4:
                return data
            else:
                size = 2 + int.from_bytes(head[2:], "big")
            if not (head[1] == APP1 and data[at + 4 : at + size].startswith(EXIF)):
                out.append(data[at : at + size])
            at += size
        return b"".join([*out, data[at:]])

    for batch in images:
        yield batch.map(strip)
