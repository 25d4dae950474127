"""URL filter, spelling variants and fill-in-the-middle: corner cases, brute force and round trips."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolworks.llm import fill_middle, spelling, urls
from spoolworks.llm.queries import QUERIES
from spoolworks.llm.rope import rope, split

# --- URL filter ---


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(lower), m[2]) if m else ("", "")


def grams(url):
    host, path = parts(url)
    if not host and not path:
        return set()
    signs = "^" + host + "$" + re.sub("[0-9]+", "0", path.lower())
    return {signs[i : i + n] for n in (3, 4, 5) for i in range(len(signs) - n + 1)}


def plain_regression(rows):
    """Weights by gram, without hashing, by gradient steps on the same objective."""
    names = {g: i for i, g in enumerate(sorted({g for u, _ in rows for g in grams(u)}))}
    x = np.zeros((len(rows), len(names) + 1))
    for k, (u, _) in enumerate(rows):
        own = [names[g] for g in grams(u)]
        x[k, own] = len(own) ** -0.5
        x[k, -1] = 1
    y = np.array([label for _, label in rows], float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = ahead = np.zeros(x.shape[1])
    decay = np.full(x.shape[1], urls.PENALTY)
    decay[-1] = 0
    for t in range(5000):
        slope = x.T @ (share * (1 / (1 + np.exp(-x @ ahead)) - y)) + decay * ahead
        new = ahead - 2 * slope
        ahead, w = new + t / (t + 3) * (new - w), new
    return names, w


def test_url_query_against_brute_force(spark, sf):
    rows = [(r.url, r.label) for r in urls.labelled_urls(spark).collect()]
    assert len(rows) == len(set(rows)) < 200
    names, weights = plain_regression(rows)
    url = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = QUERIES["op11_url_filter"](spark, sf).collect()
    assert sorted(r.page_id for r in found) == sorted(url)
    fine = urls.filter_urls(spark.read.parquet(f"{sf}/pages.parquet"), urls.labelled_urls(spark), buckets=1 << 21).collect()
    for r, slack in [(r, 0.08) for r in found] + [(r, 0.02) for r in fine]:  # grams that share a bucket
        host, path = parts(url[r.page_id])
        fit = [(of + start, verdict) for verdict, of, start in urls.RULES if (host == of or host.endswith("." + of)) and path.startswith(start)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
        own = grams(url[r.page_id])
        score = 1 / (1 + np.exp(-sum(weights[names[g]] for g in own if g in names) * len(own) ** -0.5 - weights[-1]))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.score - score) < slack
        if abs(score - 0.5) > slack:
            assert r.verdict == (verdict or ("block" if score >= 0.5 else "allow"))


def test_url_filter_tells_unseen_sites_apart(spark):
    """Sites that are not in the labelled table, on pages that tell nothing."""
    bad = ["https://www.mega-casino.test/en/4", "http://poker-bets.test/de/1", "https://cheap-pharmacy-pills.test/", "http://m.adult-cams.test/fr/2", "https://ads-network.test/x", "http://spam-blog.test/es/6"]
    good = ["https://www.geography.test/en/4", "http://philharmonic.test/de/1", "https://town-museum.test/", "http://m.library-news.test/fr/2", "https://recipes-and-gardens.test/x", "http://university-press.test/es/6"]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, urls.labelled_urls(spark), rules=[]).collect()}
    assert sum(got[i] == ("block" if i < 6 else "allow") for i in range(12)) >= 11


def test_url_filter_takes_anything(spark):
    odd = [(1, None), (2, ""), (3, "no scheme/here"), (4, "http://Sub.Example.ORG/es/1?x#y"), (4, "http://Sub.Example.ORG/es/1?x#y"), (None, "https://example.org/en/1"), (5, "https://example.org/en/2"), (6, "http://xorg/a"), (7, "HTTP://A.org"), (8, "a://b://c/d"), (9, "http://www.x.com/de/" + "ab/" * 100_000), (10, "http://中文.com/fr/é?#"), (11, "http://x.com/de/\nz"), (12, "http://h?q/r"), (13, "://")]
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "v", 1.0) for i, u in odd], "page_id long, url string, host string, path string, rule string, verdict string, score double")
    table = urls.labelled_urls(spark)
    found = urls.filter_urls(pages, table).collect()
    assert len(found) == len(odd) and all(r.verdict in ("allow", "block") and 0 <= r.score <= 1 for r in found)
    by = {r.page_id: r for r in found}
    rule = {i: (by[i].rule, by[i].verdict if by[i].rule else None) for i in by}
    assert rule[4] == ("example.org/es/", "block") and by[4].host == "sub.example.org" and by[4].path == "/es/1"
    assert rule[None] == ("example.org/en/1", "block") and rule[5] == ("org/", "allow")
    assert rule[6] == (None, None) and rule[7] == (None, None) and (by[7].host, by[7].path) == ("a.org", "")
    assert (by[8].host, by[8].path) == ("b:", "//c/d") and (by[12].host, by[12].path) == ("h", "") and by[11].path == "/de/\nz"
    assert rule[9] == ("com/de/", "block") and rule[10] == ("com/fr/", "allow")
    assert [(by[i].host, by[i].path, by[i].rule) for i in (1, 2, 3, 13)] == [("", "", None)] * 4
    assert urls.filter_urls(pages.limit(0), table).count() == 0
    for empty in (table.limit(0), table.where("label = 1"), table.withColumn("label", F.lit(None).cast("int"))):
        assert {(r.verdict, r.score) for r in urls.filter_urls(pages, empty).collect() if r.rule is None} == {("allow", None)}
    more = table.select(F.lit("x").alias("host"), "url", "label").union(spark.createDataFrame([("y", None, 1), ("y", "http://q.test/", 7)], "host string, url string, label int"))
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, more).collect()} == {r.page_id: r.verdict for r in found}


# --- Spelling variants ---


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio):
    found = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        found[w] = (form, n, len(others), counts[form] if form else None)
    for w, row in found.items():
        end = w
        while found[end][0]:
            end = found[end][0]
        found[w] = (row[0], end, *row[1:])
    return found


def got(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_spelling_against_brute_force(spark, seed):
    """Few letters, so that anagrams, ties, chains and words with many neighbours abound."""
    draw = random.Random(seed)
    counts = {"".join(draw.choice("abé中") for _ in range(draw.randint(1, 6))): draw.choice([1, 2, 3, 10, 40, 40, 400, 4000, 40000]) for _ in range(500)}
    counts[""] = 3
    words = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n long").withColumns({"value": F.lit(1), "own": F.lit("x")})
    assert got(spelling.spelling_variants(words, 10)) == variants(counts, 10)
    assert got(spelling.spelling_variants(words, 2)) == variants(counts, 2)


def test_spelling_of_long_words(spark):
    """Lengths around the one from which residues stand for letters, and runs of one letter."""
    draw = random.Random(5)
    counts = {}
    for size in (63, 64, 65, 66, 67, 90):
        base = "".join(draw.choice("abcdefgh") for _ in range(size))
        for w in (base, base[:5] + "x" + base[6:], base[:-1], "z" + base, base[: size // 2] + base[size // 2] + base[size // 2 :]):
            counts[w] = draw.choice([2, 30, 500])
        counts["q" * size] = size
        counts["q" * (size - 3) + "rqq"] = 2000
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.spelling_variants(words)) == variants(counts, 10)


def test_spelling_of_a_very_long_word(spark):
    long = "".join(random.Random(1).choices("abcde", k=200_000))
    rows = [(long, 2), (long[:100_000] + "e" + long[100_000:], 50), (long[:7] + "zz" + long[9:], 3)]
    found = got(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert found[long][0] == rows[1][0] and [v[3] for v in (found[r[0]] for r in rows)] == [1, 1, 0]


def test_anagrams_make_no_pairs(spark):
    """5,000 words of the same letters, and as many with one letter more: groups of the two keys stay linear."""
    draw, letters = random.Random(3), list("abcdefghij")
    some = {"".join(draw.sample(letters, 10)) for _ in range(5000)}
    counts = dict.fromkeys(some, 2) | {w[:4] + "z" + w[4:]: 20 for w in some}
    found = got(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert all(found[w][:2] == (w[:4] + "z" + w[4:],) * 2 or found[w][3] > 1 for w in some) and len(found) == len(counts)


def test_word_counts_and_corner_cases(spark):
    texts = [(1, "Cheating cheating CHEATING"), (1, "Cheating cheating CHEATING"), (2, None), (None, "cheating"), (3, ""), (4, "naïveté NAÏVETÉ x" * 3), (5, "abcdefg-hijklmn_" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in texts], "doc_id long, text string, n int, word string, id int")
    pattern = r"[A-Za-z\u00C0-\u00FF]+"
    want = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            want[run[:at] + run[at + 1 :] if h % 3 == 0 else run] += 1
    found = {r.word: r.n for r in spelling.word_counts(docs, pattern, slip=3, least_length=6, least_count=2).collect()}
    assert found == {w: n for w, n in want.items() if len(w) >= 6 and n >= 2}
    assert got(spelling.spelling_variants(spelling.word_counts(docs.limit(0), pattern))) == {}
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs.select("word", "n"), 1)


# --- Fill-in-the-middle ---


@pytest.mark.parametrize("unit", [None, r"\S+", r"\n", r"[aé]"])
def test_rope_splits_like_a_string(unit):
    draw = random.Random(unit)
    pattern = unit and re.compile(unit)
    for _ in range(400):
        text = "".join(draw.choice("ab <PSM>é中\n") for _ in range(draw.randint(0, 70)))
        whole = rope(text, pattern, leaf_units=3)
        assert str(whole) == text and whole.points == len(text)
        k = draw.randint(0, whole.units)
        before, after = split(whole, k)
        assert (str(before) + str(after), before.units, after.units) == (text, k, whole.units - k)
        k = draw.randint(0, len(text))
        assert [str(x) for x in split(whole, k, points=True)] == [text[:k], text[k:]]


def turned(text, key, unit=None):
    units, last = [], 0
    for m in re.finditer(unit or "(?s).", text):
        units.append(text[last : m.end()])
        last = m.end()
    units += [text[last:]] if last < len(text) else []
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


@pytest.mark.parametrize("unit", [None, r"\S+", r"\n"])
def test_fill_in_middle(spark, unit):
    draw = random.Random(2)
    texts = [(i, "".join(draw.choice("ab <PSM>é中\n") for _ in range(draw.randint(0, 40)))) for i in range(300)]
    texts += [(300, None), (300, "x y"), (300, "x y"), (None, "no id <"), (301, "a<S>b"), (302, "wörd 中 " * 300_000), (303, "<" * 50), (-304, " \n")]
    docs = spark.createDataFrame([(i, t, 1, "f", "o", 5) for i, t in texts], "doc_id long, text string, n int, form string, output string, prefix_chars int")
    found = fill_middle.restore(fill_middle.fill_in_middle(docs, unit=unit)).collect()
    want = sorted((str(i), *map(str, turned(t or "", "" if i is None else i, unit)), t or "") for i, t in texts)
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.digests(fill_middle.fill_in_middle(docs.limit(0), unit=unit)).count() == 0
