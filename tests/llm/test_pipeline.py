"""The pipeline's stages against plain Python, and on corner cases."""

import collections

import pytest

import corpus_pipeline
from spoolworks.llm.mixing import mix
from spoolworks.llm.words import shingle_set
from spoolworks.sources.tables import written


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_columns_and_take_anything(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, __x array<int>"
    docs = [(1, None, None, None, None, None, None), (None, "some words in a text", "en", "s", 1, "c", [1]), (2, "", "en", None, 0, None, None), (3, "12 34", "en", "s", 5, None, None), (4, "some words in a text", "en", "s", 1, "c", [1]), (4, "some words in a text", "en", "s", 1, "c", [1])]
    for frame in (spark.createDataFrame(docs, schema), spark.createDataFrame([], schema)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            frame = written(f(spark, frame, sf), "stage")
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "__x"]
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() == frame.count()


@pytest.mark.parametrize("files", [0, 3])
def test_null_and_repeated_ids_are_decided_row_by_row(spark, sf, tmp_path, files):
    """Rows of no file, and of several: equal rows lie in one file and in different ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text IS NOT NULL").first().text
    twin, other = "one plain text of seven small words", "quite another text that has no twin here"
    rows = [(None, twin), (None, twin), (5, twin), (5, twin), (7, twin), (7, other), (None, "a null id with its own text"), (None, None), (None, item), (9, item), (9, "nine again without any item inside")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, n) for n, (i, t) in enumerate(rows)], schema)
    if files:
        for part in range(files):
            docs.where(f"n % {files} = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        assert len(docs.inputFiles()) == files
    near = {r.n for r in stage("near_dedup")(spark, docs, sf).collect()}
    assert len(near & {2, 3}) == 1 and near - {2, 3} == {5, 6, 7, 9, 10}
    clean = sorted(r.n for r in stage("decontamination")(spark, docs, sf).collect())
    assert clean == [0, 1, 2, 3, 4, 5, 6, 7, 10]


def test_mixing_of_null_ids_stays_near_the_target(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int"
    docs = spark.createDataFrame([(None, "w " * (1 + n % 7), "en", "ab"[n % 2], 1, n) for n in range(400)], schema)
    wanted = {r.source: r.target for r in mix(docs, seed=corpus_pipeline.MIX_SEED).select("source", "target").distinct().collect()}
    words = collections.Counter()
    for r in stage("mixing")(spark, docs, sf).collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= 7 for s, t in wanted.items())


@pytest.fixture(scope="module")
def passed(spark, sf):
    """What each stage returned, in order."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, sf), name)
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_language_id_keeps_texts_with_letters(passed):
    assert {r["doc_id"] for r in passed[0]} - {r["doc_id"] for r in passed[1]} <= {r["doc_id"] for r in passed[0] if not any(c.isalpha() for c in r["text"])}


def test_near_dedup_keeps_one_of_each_group(passed):
    sets = {r["doc_id"]: set(shingle_set(r["text"].encode()).tolist()) for r in passed[1]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in passed[2]} == {i for i in ids if find(i) == i}


def test_decontamination_drops_what_holds_an_item(passed, spark, sf):
    items = [set(shingle_set(r.text.encode()).tolist()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = set()
    for r in passed[2]:
        there = set(shingle_set(r["text"].encode()).tolist())
        if not any(len(i & there) * 100 >= len(i) * 80 for i in items):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in passed[3]} == clean


def test_mixing_repeats_rows(passed):
    before = {r["doc_id"]: r for r in passed[3]}
    times = collections.Counter(r["doc_id"] for r in passed[4])
    assert set(times) <= set(before) and max(times.values()) <= 3
    assert all(r == before[r["doc_id"]] for r in passed[4])


def test_every_row_gets_a_slot(passed):
    assert len(passed[5]) == len(passed[4])
    slots = collections.defaultdict(list)
    for r in passed[5]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_same(passed, spark, sf):
    assert sorted((r.doc_id, r["shard"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r["doc_id"], r["shard"]) for r in passed[5])
