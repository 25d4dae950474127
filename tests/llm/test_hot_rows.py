"""A third of all rows under one id, or equal, in the fixity audit and in exact dedup."""

from pyspark.sql import functions as F

from spoolworks.llm import exact_dedup, warc


def pages(spark):
    rows = [(i, f"http://h/{i}", f"body {i}") for i in range(2000)] + [(None, f"http://n/{i % 1500}", "x" * (i % 3)) for i in range(1500)] + [(5, "http://h/same", "same")] * 1500
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_records_of_one_id_are_numbered_as_by_one_window(spark):
    from pyspark.sql.window import Window

    records = warc.record_hashes(pages(spark), F.lit("m").alias("rows"))
    found = warc.manifest(records, per_file=16)
    bucket = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2), F.lit("00"))
    n = F.row_number().over(Window.partitionBy(bucket).orderBy("page_id", "url", "digest")) - 1
    want = records.select("page_id", "url", "digest", F.concat_ws("-", bucket, F.floor(n / 16).cast("string")).alias("file"), (n % 16).cast("long").alias("record"))
    assert found.count() == 5000 and found.columns == ["page_id", "url", "length", "digest", "rows", "file", "record", "offset"]
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    files = found.groupBy("file").agg(F.max("record").alias("m"), F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"), F.sum("length").alias("s")).collect()
    assert all(r.n == r.m + 1 and r.e == r.s for r in files)


def test_no_records_make_no_files(spark):
    assert warc.manifest(warc.record_hashes(pages(spark)).where("false")).count() == 0


def test_ranges_split_a_hot_id(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(warc, "written", lambda df, name, f=warc.written: kept.setdefault(name, f(df, name)))
    warc.manifest(warc.record_hashes(pages(spark))).count()
    spread = [r["count"] for r in kept["record-ranges"].where("page_id IS NULL").groupBy("__range").count().collect()]
    equal = kept["records"].where("page_id = 5").collect()
    assert kept["records"].where("page_id IS NULL").count() == 1500 and sum(spread) == 1500
    assert sorted(r["__rows"] for r in equal) == [1, 1500]


def test_copies_of_one_id_are_dealt_over_tasks(spark, request):
    rows = [(7, "copy  of a text")] * 3000 + [(None, "copy of a\ttext")] * 3000 + [(i, f"text {i}") for i in range(100)]
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # as with tables of any size, without splits at run time
    for key, value in plain.items():
        spark.conf.set(key, value)
    request.addfinalizer(lambda: [spark.conf.unset(key) for key in plain])
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    hot = found.where("group_size = 6000").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in hot) == 6000 and len(hot) > 2 and max(r["count"] for r in hot) < 3000
    assert found.where("group_size = 6000 AND keep_id = 7").count() == 6000 and found.where("kept").count() == 3100
