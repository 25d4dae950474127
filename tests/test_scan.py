"""Windows that begin at lines, hits united over them, Unicode white space and case."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from spoolworks.functions import text
from spoolworks.operators import scan


def plain_windows(whole, size, overlap):
    """One after another, each opened by what the last one carries on."""
    found, carry, at = [], "", 0
    while at < len(whole):
        chunk = whole[at : at + size]
        tail = chunk[max(0, len(chunk) - overlap) :]
        kept = chunk[: chunk.rindex("\n") + 1] if "\n" in tail and at + size < len(whole) else chunk
        found.append((at - len(carry), carry + kept))
        carry = tail.partition("\n")[2] if "\n" in tail else tail
        at += size
    return found or [(0, "")]


@pytest.mark.parametrize(("size", "overlap"), [(10, 4), (7, 7), (5, 0), (1, 1), (50, 20)])
def test_windows_follow_lines(spark, size, overlap):
    draw = random.Random(size)
    texts = ["".join(draw.choices("ab \n\ré𝄞中", k=draw.randint(0, 60))) for _ in range(80)] + ["", None, "x" * 37, "\n" * 23, "ab\n" * 9]
    rows = [(i if i % 9 else None, t, "w", 1) for i, t in enumerate(texts)]
    found = scan.windows(spark.createDataFrame(rows, "id long, text string, window string, start int"), "id", "text", size, overlap)
    want = [(str(i if i % 9 else None), n, start, piece) for i, t in enumerate(texts) for n, (start, piece) in enumerate(plain_windows(t or "", size, overlap))]
    assert sorted((str(r.id), r.window, r.start, r.text) for r in found.collect()) == sorted(want)
    with pytest.raises(ValueError):
        scan.cut_windows(spark.range(1).selectExpr("'' text"), "text", 5, 6)


def test_rows_of_windows_do_not_carry_the_text(spark):
    texts = spark.createDataFrame([(1, "ab\n" * 99)], "id long, text string")
    plan = scan.windows(texts, "id", "text", 50, 10)._jdf.queryExecution().optimizedPlan()
    generate = next(x for x in plan.toString().split("\n") if "Generate" in x)
    assert "[__windows" in generate or re.search(r"explode\(__windows#\d+\), \[\d\]", generate), generate
    while plan.nodeName() != "Generate":
        plan = plan.children().apply(0)
    assert "text" not in [plan.output().apply(i).name() for i in range(plan.output().size())]


LINES = ["Wave 1 - Solid Ground", "Wave 2: Next Step", "Wave 3 Last Mile", "make verify-01", "make verify-02", "see docs/reports/prompt-03.md now", "2-3 weeks (Wave 1)", 'id: "04", name: "Fourth one"', "| 05 | A name here | a summary long enough to count | no | Spark |", "| 06 | B name here | a summary long enough to count | no | Spark |"]


def test_verdict_of_windows_is_that_of_the_whole(spark):
    """Texts of many windows whose lines are shorter than the overlap: the same hits, on both ways, as from one window."""
    draw = random.Random(1)
    rows = [(i, "\n".join(draw.choice(LINES) if draw.random() < 0.15 else "filler " * draw.randint(0, 12) for _ in range(400))) for i in range(30)] + [(99, None), (98, "")]
    texts = spark.createDataFrame(rows, "id long, text string")
    plain = lambda df: sorted(tuple(r) for r in df.drop("text").collect())
    whole = plain(scan.leak_verdict(texts))
    assert plain(scan.leak_verdict(texts, size=1000, overlap=400)) == whole
    assert plain(scan.leak_verdict_of_windows(scan.windows(texts, "id", "text", 1000, 400), "id")) == whole
    assert {r[-1] for r in whole} == {True, False}


def test_a_record_over_a_seam(spark):
    """A record without line feeds that lies over a seam is found; a row of a table is not made up in the middle of a line."""
    record = 'id: "07", name: "Seventh one"'
    padded = "x" * 989 + " " + record + "y" * 500
    row = "z" * 985 + "\n" + "q" * 10 + "| 05 | A name here | a summary long enough to count | no | Spark |"
    texts = spark.createDataFrame([(1, padded), (2, row)], "id long, text string")
    found = {r.id: r for r in scan.leak_verdict(texts, size=1000, overlap=100).collect()}
    assert found[1].n_prompt_entries == 1 and found[2].n_prompt_rows == 0


def test_white_space_and_case_of_unicode(spark):
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]  # the JVM may know more characters
    rows = spark.createDataFrame([(i, "".join(every[i : i + 64])) for i in range(0, len(every), 64)], "i int, t string")
    bad = [r.t for r in rows.select("t", text.folded(F.col("t")).alias("f")).collect() if r.f != re.sub(r"\s+", " ", r.t).casefold()]
    assert not bad, bad
    asked = ["ΟΔΟΣ ΣΑΣ ς", "ﬁne ﬂow", "STRAẞE  x", "ẞ\x1c\x85", "İstanbul", "ŉ ΐ", " a \n", None]
    rows = spark.createDataFrame([(t,) for t in asked], "t string").select(text.folded(F.col("t")).alias("f"), text.stripped(F.col("t")).alias("s")).collect()
    assert [r.f for r in rows] == [t and re.sub(r"\s+", " ", t).casefold() for t in asked]
    assert [r.s for r in rows] == [t and t.strip() for t in asked]


def test_titles_with_wide_spaces(spark):
    plan = "PROMPT 03 —  Analysis Engine  . *\nWave ٣ - Arabic digit title\nWAVE 2: Short\nPrompt 3: _Emphasised_ title_ "
    found = spark.createDataFrame([(plan,)], "t string").select(text.plan_titles(F.col("t")).alias("x")).first().x
    want = {t for p in text.TITLES for m in re.finditer(p, plan) if len(t := m[1].strip().rstrip(".*_ ")) >= 8}
    assert set(found) == want and "Arabic digit title" in want


def test_titles_match_whatever_their_case(spark):
    docs = spark.createDataFrame([(1, "the  STRASSE der ﬁsche"), (2, "ὈΔΥΣΣΕΎΣ und mehr"), (3, "nothing")], "doc_id long, text string")
    titles = spark.createDataFrame([(10, " straße der Fische "), (11, "Ὀδυσσεύς und")], "title_id long, text string")
    for size in (1 << 20, 0):
        assert sorted(map(tuple, scan.title_matches(docs, titles, automaton_bytes=size).collect())) == [(1, 10), (2, 11)]


def test_titles_that_begin_alike_are_joined_on_their_rarest_gram(spark):
    """Titles with one beginning that every document has: each is anchored where documents differ, and no key is hot."""
    docs = [(i, f"chapter of the book, part {i * 7919:08d} and more") for i in range(200)] + [(900, "Chapter of the  book, part 00000000 and more")] * 3 + [(None, None), (901, "")]
    titles = [(i, f"chapter of the book, part {i * 7919:08d}") for i in range(0, 260, 2)] + [(777, "CHAPTER OF THE BOOK"), (778, "chapter of the book"), (None, "of the book, "), (779, "short")]
    docs, titles = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(titles, "title_id long, text string")
    ways = [sorted(map(str, scan.title_matches(docs, titles, automaton_bytes=n).collect())) for n in (scan.AUTOMATON_BYTES, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 100 + 3 + 203 * 3
    flat = docs.select("doc_id", text.folded(F.col("text")).alias("flat"))
    keyed = titles.where("length(text) > 30").select(F.col("title_id").alias("key"), F.col("text").alias("title"))
    grams = keyed.mapInArrow(scan._grams_of, "key long, gram long")
    counts = scan.gram_counts(flat, grams)
    chosen = [r.gram for r in scan.anchors(keyed, counts).collect()]
    assert len(chosen) == 130 and max(counts[g & (scan.COUNTERS - 1)] for g in chosen) < 30 and counts.max() >= 203


def test_hot_anchors_are_dealt_over_parts(spark):
    docs = spark.createDataFrame([(i, "the same words in all of them") for i in range(50)], "doc_id long, flat string")
    titles = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, "in all of them")], "title_id long, title string")
    found = scan._titles_by_join(docs, titles, part=7).collect()
    assert sorted((r.doc_id, r.title_id) for r in found) == sorted((i, t) for i in range(50) for t in (1, 1, 2))
    assert scan._titles_by_join(docs.where("false"), titles).isEmpty() and scan._titles_by_join(docs, titles.where("false")).isEmpty()
