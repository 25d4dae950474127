"""Files and plans."""

import hashlib
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spoolworks.operators import plan, scan, sequences
from spoolworks.plans.handlers import Handlers
from spoolworks.sources import files, tables

PLAN = """# Guide
| 0 – Base Camp | x | 01 |
| 1 - *Long* Way | x | 02–03 |
| 1 - Ignored | x | 09 |
| Wave 0 | 01 | 1 week |
| Wave 1 | 02 | `3 weeks` |
| 01 | **First** | does a thing | no | Spark · SQL |
| 02 | Second | another | *yes*, late | Arrow |
| 04 | Fourth | third | | x |
## PROMPT 01 — First
text
### Deliverables
intro
1. one
   goes on
2. `two`
### Next
3. not this
## PROMPT 02 - Second
nothing
"""


@pytest.fixture()
def doc(spark, tmp_path):
    (tmp_path / "plan.md").write_text(PLAN)
    return files.documents(spark, str(tmp_path / "plan.md"))


def test_plan_tables(doc):
    found = {r.wave: (r.title, r.timeline, r.prompt_ids) for r in plan.waves(doc).collect()}
    assert found == {0: ("Base Camp", "1 week", ["01"]), 1: ("Long Way", "3 weeks", ["02", "03"])}
    assert {r.id: r.deliverables for r in plan.deliverables(doc).collect()} == {"01": ["one goes on", "two"]}
    rows = {r.id: r for r in plan.prompts(doc).collect()}
    assert (rows["01"].name, rows["01"].tech, rows["01"].wave_title, rows["01"].deliverables) == ("First", ["Spark", "SQL"], "Base Camp", ["one goes on", "two"])
    assert (rows["02"].review_required, rows["02"].review_note, rows["02"].timeline) == (True, "yes, late", "3 weeks")


def test_digests_and_lengths(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.bin").write_bytes(b"d")
    found = {r.name: (r.length, r.sha256) for r in files.digests(spark, str(tmp_path)).collect()}
    assert found == {"a.bin": (3, hashlib.sha256(b"abc").hexdigest()), "c.bin": (1, hashlib.sha256(b"d").hexdigest())}
    assert tuple(files.stored_length(spark, str(tmp_path)).first()) == (2, 4)
    rows = spark.createDataFrame([("a.bin",), ("gone.bin",)], ["stored_path"])
    assert sorted((r.stored_path, r.on_disk) for r in files.present(rows, files.digests(spark, str(tmp_path)).select("name")).collect()) == [("a.bin", True), ("gone.bin", False)]


def test_small_column_sources(spark):
    row = spark.sql("SELECT 'a' || chr(0) || chr(0) || 'b' AS names, ' x, ,y,x' AS setting, CAST('hello' AS binary) AS content, '{\"date\":\"2026-01-02\",\"count\":7}' AS state")
    found = row.select(files.listed(F.col("names")), files.setting_list(F.col("setting")), files.byte_slice(F.col("content"), F.lit(1), F.lit(3)), files.day_count(F.col("state"), F.lit("2026-01-02"), 9), files.day_count(F.col("state"), F.lit("2026-01-03"), 9), files.day_count(F.lit("{"), F.lit("2026-01-03"), 9)).first()
    assert [list(found[0]), list(found[1]), bytes(found[2]), *found[3:]] == [["a", "b"], ["x", "y"], b"ell", 7, 0, 9]


def test_exif_goes(spark):
    segment = lambda kind, body: b"\xff" + bytes([kind]) + (len(body) + 2).to_bytes(2, "big") + body
    image = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xE1, b"Exif\0\0secret") + segment(0xE1, b"http://xmp") + b"\xff\xd0" + b"\xff\xda" + b"pixels"
    rows = spark.createDataFrame([(image,), (b"png",), (None,)], "i binary").select(files.without_exif("i").alias("o")).collect()
    assert [None if r.o is None else bytes(r.o) for r in rows] == [b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xE1, b"http://xmp") + b"\xff\xd0\xff\xda" + b"pixels", b"png", None]


def test_titles_by_join_are_those_of_the_automaton(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    titles = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("title_id"), F.substring("text", 1, 20).alias("text"))
    assert sorted(scan.title_matches(docs, titles).collect()) == sorted(scan.title_matches(docs, titles, automaton_bytes=0).collect())


def test_titles_of_repeated_rows_are_the_same_on_both_ways(spark):
    docs = spark.createDataFrame([(1, "A long  title here"), (1, "A long  title here"), (1, "other text"), (None, "so a long title hereby"), (2, None), (3, "short")], "doc_id long, text string")
    titles = spark.createDataFrame([(7, "a long title"), (7, "a long title"), (None, "LONG TITLE HERE"), (8, "a long titmouse"), (9, None), (9, "short")], "title_id long, text string")
    ways = [sorted(map(str, scan.title_matches(docs, titles, automaton_bytes=n).collect())) for n in (scan.AUTOMATON_BYTES, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 9


def test_written_tables_go_and_a_cluster_needs_a_shared_folder(spark, tmp_path):
    scratch = tables.Scratch(spark)
    kept, gone = scratch.written(spark.range(5), "kept"), scratch.written(spark.range(7), "gone")
    where = scratch.paths["gone"].removeprefix("file://")
    assert gone.count() == 7 and os.path.isdir(where)
    scratch.remove("gone")
    assert kept.count() == 5 and not os.path.exists(where) and set(scratch.paths) == {"kept"}

    class Elsewhere:
        getConf = staticmethod(lambda: {})

    session = SimpleNamespace(sparkContext=Elsewhere, conf=SimpleNamespace(get=lambda *_: None))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        Elsewhere.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session)


def test_windows_cover_and_overlap(spark):
    texts = spark.createDataFrame([(1, "x" * 25), (2, ""), (3, "abc")], "k long, t string")
    found = sorted((r.k, r.window, r.start, len(r.text)) for r in scan.windows(texts, "k", "t", 10, 3).collect())
    assert found == [(1, 0, 0, 10), (1, 1, 7, 13), (1, 2, 17, 8), (2, 0, 0, 0), (3, 0, 0, 3)]


def test_cuts_need_a_distance(spark):
    frames = spark.createDataFrame([(1, i, 30.0 if i in (1, 3, 4, 9) else 0.0) for i in range(10)], "clip long, i long, change double")
    found = sorted((r.sequence_index, r.start_frame, r.end_frame) for r in sequences.cuts_to_scenes(frames, "clip", ["i"], "change", 27.0, 3).collect())
    assert found == [(0, 0, 3), (1, 3, 9), (2, 9, 10)]


def test_unknown_job_types_fail_with_a_cause(spark):
    handlers = Handlers(keep=lambda df: df)
    assert handlers.run("keep", spark.range(3)).count() == 3
    with pytest.raises(LookupError, match="not supported"):
        handlers.run("other", spark.range(1))


def test_chunks_cover_a_body_once(spark):
    asked = spark.createDataFrame([(0, 9), (3, 3), (0, 0), (5, 4), (2, 11), (None, 4)], "s long, e long")
    found = [[tuple(c) for c in r.c] if r.c is not None else None for r in asked.select(files.chunk_spans(F.col("s"), F.col("e"), 4).alias("c")).collect()]
    assert found == [[(0, 3), (4, 7), (8, 9)], [(3, 3)], [(0, 0)], [], [(2, 5), (6, 9), (10, 11)], None]
