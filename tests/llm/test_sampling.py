"""What language ID and the quality classifier learn from, when one id, text, language or class holds very many rows."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from spoolworks.llm import language_id, quality


def learnable(k):
    """The k-th id that is not held out."""
    return [i for i in range(3 * k + 9) if zlib.crc32(str(i).encode()) % 3 != 1][k]


@pytest.mark.parametrize("equal", [False, True])
def test_a_language_under_one_id_is_learned(spark, equal):
    draw, hot = random.Random(1), learnable(5)
    french = [(hot, "le chat est sur la table" + ("" if equal else f" numero {draw.randrange(10**6)}"), "fr") for _ in range(4000)]
    english = [(i, f"the cat is on the table number {i}", "en") for i in range(4000, 4300)]
    docs = spark.createDataFrame(french + english, "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.pieces(), "doc_id", "text", "lang", per_language=50)
    assert model.languages == ["en", "fr"]
    asked = spark.createDataFrame([(1, "le chat est la"), (2, "the cat is the")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {1: "fr", 2: "en"}


def test_the_sample_of_a_language_is_bounded_in_characters(spark):
    """Long texts without a space: of 120 of 20,000 characters the first that fit are fitted."""
    draw = random.Random(2)
    rows = [(i, "".join(draw.choices("abcdeé" if i % 2 else "ghijkñ", k=20_000)), "xy"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, ["a", "b", "ab", "g", "h", "gh"], "doc_id", "text", "lang", most_chars=50_000)
    asked = language_id.predict(docs, model).collect()
    assert np.mean([r.lang_pred == r.lang for r in asked]) == 1
    assert language_id.learn(docs, ["a", "g"], "doc_id", "text", "lang", most_chars=1).languages == ["x", "y"]


def test_long_words_take_memory_by_the_block():
    word = "▁" + "".join(random.Random(3).choices("abc", k=200_000))
    vocabulary = ["a", "b", "c", "ab", "bc", "abc", "a" * 16]
    lattices = language_id.Lattices(vocabulary)
    table = np.full((len(vocabulary) + 2, 1), 1 / 9)
    table[lattices.none] = 0
    whole = lattices.total_along(word, table, block=1 << 20)
    tracemalloc.start()
    parted = lattices.total_along(word, table, block=1 << 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(whole, parted) and peak < 4 << 20
    counts = [np.zeros(len(table)) for _ in range(2)]
    with np.errstate(divide="ignore"):
        costs = np.log(table[:, 0])
    for block, found in zip((777, 1 << 20), counts, strict=True):
        lattices.count_along(found, word[:3000], 2.0, table, costs, block=block)
    assert np.allclose(*counts)
    letters = sum(n * len(p) for n, p in zip(counts[0], vocabulary, strict=False)) + counts[0][lattices.unknown]
    assert abs(letters - 2 * 3000) < 1e-6  # each place is in one piece of a segmentation


def texts_of(label, n, draw):
    words = ("good", "fine", "clear", "plain") if label else ("bad", "junk", "noise", "spam")
    return [" ".join(draw.choices(words, k=8)) for _ in range(n)]


@pytest.mark.parametrize("equal", [False, True])
def test_a_class_under_one_id_is_fitted(spark, equal, monkeypatch):
    """One id has all rows of class 0, 3,000 texts or the same text 3,000 times; the linear model is fitted all the same."""
    draw, hot = random.Random(4), learnable(7)
    bad = texts_of(0, 1 if equal else 3000, draw) * (3000 if equal else 1)
    good = texts_of(1, 400, draw)
    rows = [(hot, t) for t in bad] + [(i, t) for i, t in enumerate(good, 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(hot, 0)] + [(i, 1) for i in range(10_000, 10_400)] + [(i, 0) for i in range(50_000, 50_400)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality, "dual_coordinate_descent", lambda rows, marks, scale, f=quality.dual_coordinate_descent: fitted.append(marks) or f(rows, marks, scale))
    asked = spark.createDataFrame([(1, "good clear fine plain"), (2, "junk bad noise spam")], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in quality.classify(docs.union(asked), labels, sample_rows=40).where("doc_id < 3").collect()}
    assert found == {1: 1, 2: 0}
    assert len(fitted) == 1 and set(fitted[0]) == {0, 1} and len(fitted[0]) < 200


def test_ids_beyond_the_broadcast_go_by_merge(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, texts_of(i % 2, 1, draw)[0]) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    first = sorted(map(tuple, quality.classify(docs, labels).collect()))
    monkeypatch.setattr(quality, "MOST_IDS", 10)
    assert sorted(map(tuple, quality.classify(docs, labels).collect())) == first


def test_ratios_against_plain_python(spark):
    """The scale of each feature from sets of n-grams, hashed one by one."""
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choices(["ab", "ab ab", "c", "é", "x y"], k=draw.randint(0, 6))) or None) for i in range(120)]
    labels = {i: i % 3 % 2 for i, _ in rows if i % 7}
    plain = spark.createDataFrame(rows, "id long, text string")
    marked = spark.createDataFrame(list(labels.items()), "id long, label int")
    model = quality.learn(plain, marked, orders=(1, 2), bits=12)
    grams = quality.Grams((1, 2), 12)
    counts, n = np.zeros((2, 1 << 12)), np.zeros(2)
    for i, text in rows:
        if i in labels:
            n[labels[i]] += 1
            data = (text or "").encode()
            single = set()
            for size in (1, 2):
                for k in range(len(data) - size + 1):
                    single |= set(grams.of(data[k : k + size]))
            own = set(grams.of(data))
            assert {f for f in own if f < (1 << 12) - quality.REPEATS} == {f for f in single if f < (1 << 12) - quality.REPEATS}
            for f in own:
                counts[labels[i]][f] += 1
    want = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    want[counts.sum(axis=0) == 0] = 0
    assert np.allclose(model.scale, want)
    assert len(model.weights) == (1 << 12) + 1


def test_equal_rows_fill_no_part_of_a_mix(spark):
    """A third of all rows are equal: they are dealt like any others, and their source's words still come near its target."""
    from spoolworks.llm import mixing

    rows = [(7, "one two three", "a")] * 3000 + [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(1000, 7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(rows) and (found.doc_id == 7).sum() == 3000
    for _, group in found.groupby("source"):
        assert abs(group.taken.sum() - group.target.iloc[0]) <= 5
        assert (group.copies <= 3).all() and group["size"].sum() == group.source_size.iloc[0]
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, again.to_numpy().tolist())) == sorted(map(tuple, found.to_numpy().tolist()))
    places = mixing.mix(docs).where("doc_id = 7").groupBy("copies").count().collect()
    assert len(places) == 2  # rounded each for itself


def test_equal_rows_are_dealt_over_parts(spark, monkeypatch):
    """The table of placed rows, as written: no part holds more than a few times the mean."""
    from spoolworks.llm import mixing

    kept = {}
    monkeypatch.setattr(mixing, "written", lambda df, name, f=mixing.written: kept.setdefault(name, f(df, name)))
    docs = spark.createDataFrame([(7, "one two three", "a")] * 20_000 + [(i, "w", "a") for i in range(40_000)], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 60_000
    parts = [r["count"] for r in kept["placed"].groupBy("part").count().collect()]
    assert len(parts) == 256 and max(parts) < 1.5 * 60_000 / 256
