"""Spelling variants by anagram hashing (Reynaert, 2004): words one letter apart, found by arithmetic on integer keys.

A word's key is the sum of the fifth powers of its code points, modulo 2^64, so all words of the same letters share one. Taking a
letter out of a word takes that letter's power off its key. Hence
  * two words differ by one added letter only if a key less one of its letters' powers is the other's key;
  * two words differ by one exchanged letter only if their keys less one letter's power each are the same value.
First keys alone are joined, on those values. Only words and letters whose value has met another key go on, and their
letter order is verified by grouping on the value and the letters in order, without the letter that is gone.
No pair of words is ever written: counts and best words are aggregates of these groups.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoolworks.sources.tables import Scratch

POWER = 5
RATIO = 10
#: What is left of a word up to this length is compared as it is, of a longer one by four 31-bit residues.
PLAIN_LENGTH = 64
#: Stands for the exchanged letter.
GAP = "?"
# The four largest primes below 2^31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1566083941, 1812433253, 1664525017)


def codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)


def powers(letters: np.ndarray) -> np.ndarray:
    """Each letter's value. uint64 wraps at 2^64."""
    return letters**np.uint64(POWER)


def key_of(word: str) -> int:
    return int(powers(codes(word)).sum(dtype=np.uint64).view(np.int64))


@functools.lru_cache(maxsize=4)
def rising(which: int, size: int) -> np.ndarray:
    """The first `size` powers of a base modulo its prime."""
    prime, found = PRIMES[which], np.ones(1, np.uint64)
    while len(found) < size:
        found = np.concatenate([found, found * np.uint64(pow(BASES[which], len(found), prime)) % np.uint64(prime)])
    return found[:size]


class Residues:
    """A long word as a polynomial in each base, so that taking a letter out costs no pass over the word."""

    def __init__(self, letters: np.ndarray):
        self.size = len(letters)
        step = 1 << max(self.size - 1, 1).bit_length()  # few lengths, so that powers are reused
        self.terms = [letters * rising(k, step)[: self.size] % np.uint64(p) for k, p in enumerate(PRIMES)]
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t)]) % np.uint64(p) for t, p in zip(self.terms, PRIMES, strict=True)]

    def whole(self) -> list[int]:
        return [int(s[-1]) for s in self.sums]

    def gapped(self, at: np.ndarray) -> list[np.ndarray]:
        return [(s[-1] + np.uint64(p) - t[at]) % np.uint64(p) for t, s, p in zip(self.terms, self.sums, PRIMES, strict=True)]

    def without(self, at: np.ndarray) -> list[np.ndarray]:
        found = []
        for k, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True)):
            back = np.uint64(pow(BASES[k], -1, p))
            found.append((s[at] + (s[-1] + np.uint64(p) - s[at + 1]) % np.uint64(p) * back) % np.uint64(p))
        return found


def residue_text(kind: str, size: int, parts: list) -> list[str]:
    return [f"{kind}{size}:" + "".join(f"{int(x):08x}" for x in row) for row in zip(*parts, strict=True)]


def own_order(word: str) -> str:
    if len(word) <= PLAIN_LENGTH:
        return f"d{word}"
    return residue_text("D", len(word), [[x] for x in Residues(codes(word)).whole()])[0]


def orders(word: str, letter: int, swaps: bool, drops: bool) -> list[str]:
    """The distinct orders of what is left if one `letter` is exchanged (swaps) or deleted (drops). Deleting any letter of a run
    of equal ones leaves the same."""
    if len(word) - 1 <= PLAIN_LENGTH:
        sign, found, last = chr(letter), [], -2
        i = word.find(sign)
        while i >= 0:
            before, after = word[:i], word[i + 1 :]
            if swaps:
                found.append(f"x{before}{GAP}{after}")
            if drops and i > last + 1:
                found.append(f"d{before}{after}")
            last, i = i, word.find(sign, i + 1)
        return found
    letters = codes(word)
    at = np.flatnonzero(letters == letter)
    heads = at[np.diff(at, prepend=-2) > 1]
    residues = Residues(letters)
    found = residue_text("X", len(word), residues.gapped(at)) if swaps else []
    return found + (residue_text("D", len(word) - 1, residues.without(heads)) if drops else [])


def word_counts(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, least_length: int = 1, least_count: int = 1) -> DataFrame:
    """(word, n): how often each match of `pattern` occurs in the texts of `docs`, A-Z lower-cased, of those with `least_length` code points and
    `least_count` occurrences.

    With `slip`, a match loses a letter where the CRC-32 h of `<id>:<match>` is a multiple of it: the one at h modulo its
    length, so a known share of the words is misspelt, the same in each rerun. A null id counts as empty, a null text has no words.
    """
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("word"))
    word = F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if slip:
        found = found.select("id", word.alias("word"))
        h, size = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")), F.length("word")
        at = F.pmod(h, F.greatest(size, F.lit(1)).cast("long")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
        word = F.when(h % slip == 0, cut).otherwise(F.col("word"))
    return found.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Every row of `words` (word, n; each word once) as (word, form, root, n, n_near, form_n).

    Near words differ by exactly one inserted, deleted or exchanged code point. `n_near` counts them; `form` is the one with the largest n (ties: the
    smallest in code-point order) if that is `ratio` times n at least, else null; `root` is where following forms ends, the word itself
    without a form. `ratio` is 2 or more, so n grows along forms and their chains are short and end. Null words are left out; an
    empty word is near all words of one letter; an empty table gives no rows. Words of any length cost time and rows in
    proportion to their length.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    scratch = Scratch(words.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pa.list_(pa.struct([("letter", pa.int64()), ("value", pa.int64())]))
        for batch in batches:
            keys, cuts = [], []
            for word in batch.column(0).to_pylist():
                letters = codes(word)
                key, distinct = powers(letters).sum(dtype=np.uint64), np.unique(letters)
                keys.append(int(key.view(np.int64)))
                cuts.append([{"letter": int(c), "value": int(v)} for c, v in zip(distinct, (key - powers(distinct)).view(np.int64), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64()), pa.array(cuts, cut)], ["word", "n", "key", "cuts"])

    # In the order of the words, so that comparing places compares words and a long word is carried once only.
    ordered = words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL").orderBy("word")
    given = ordered.mapInArrow(keyed, "word string, n long, key long, cuts array<struct<letter: long, value: long>>")
    given = scratch.written(given.withColumn("place", F.monotonically_increasing_id()), "words")

    # Keys that differ by one letter. There are as many letters to a value as the alphabet has, whatever the number of words.
    cuts = given.select("key", F.inline("cuts")).distinct()
    both = cuts.select("value", F.lit(1).alias("cut"), F.lit(0).alias("own")).union(given.select(F.col("key").alias("value"), F.lit(0), F.lit(1)).distinct())
    met = both.groupBy("value").agg(F.sum("cut").alias("cut"), F.max("own").alias("own")).where("cut > 0 AND cut + own > 1")
    met = scratch.written(met, "values")
    asked = cuts.join(met, "value").select("key", "letter", "value", (F.col("cut") > 1).alias("swaps"), (F.col("own") > 0).alias("drops"))
    asked = asked.union(met.where("own > 0").select(F.col("value").alias("key"), F.lit(None).cast("long"), "value", F.lit(False), F.lit(False)))

    def ordering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n, value, order = [], [], [], []
            for word, letter, swaps, drops, at, many, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [own_order(word)] if letter is None else orders(word, letter, swaps, drops)
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    place += [at if letter is not None else -1 - at] * len(part)
                    n += [many] * len(part)
                    value += [of] * len(part)
                    order += part
                    if len(order) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(value, pa.int64()), pa.array(order, pa.string())], ["place", "n", "value", "order"])
                        place, n, value, order = [], [], [], []
            if order:
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(value, pa.int64()), pa.array(order, pa.string())], ["place", "n", "value", "order"])

    # A negative place marks the word whose own order this is; the others of its group have one letter more.
    members = given.select("key", "word", "n", "place").join(asked, "key").select("word", "letter", "swaps", "drops", "place", "n", "value")
    members = members.mapInArrow(ordering, "place long, n long, value long, order string")
    own = F.col("place") < 0
    members = members.select("value", "order", own.alias("own"), F.struct((-F.col("n")).alias("less"), F.when(own, -1 - F.col("place")).otherwise(F.col("place")).alias("place")).alias("who"))
    group = Window.partitionBy("value", "order")
    ranked = members.withColumns({
        "others": F.count(F.when(~F.col("own"), 1)).over(group),
        "best": F.min(F.when(~F.col("own"), F.col("who"))).over(group),
        "base": F.min(F.when(F.col("own"), F.col("who"))).over(group),
        "second": F.nth_value("who", 2).over(group.orderBy("who").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    swap = F.lower(F.substring("order", 1, 1)) == "x"
    near = F.when(swap, F.col("others") - 1).when(F.col("own"), F.col("others")).otherwise(F.when(F.col("base").isNotNull(), 1).otherwise(0))
    top = F.when(swap, F.when(F.col("who") == F.col("best"), F.col("second")).otherwise(F.col("best"))).when(F.col("own"), F.col("best")).otherwise(F.col("base"))
    counted = ranked.select(F.col("who.place").alias("place"), near.alias("near"), top.alias("top")).where("near > 0").groupBy("place").agg(F.sum("near").alias("n_near"), F.min("top").alias("top"))
    counted = scratch.written(counted.select("place", "n_near", F.col("top.place").alias("to"), (-F.col("top.less")).alias("to_n")), "near")

    listed = given.select("place", "word", "n").join(counted, "place", "left")
    has_form = F.col("to_n") >= ratio * F.col("n")
    listed = scratch.written(listed.select("place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("to")).alias("to"), F.when(has_form, F.col("to_n")).alias("form_n")), "listed")
    names = listed.select(F.col("place").alias("to"), F.col("word").alias("form"))
    linked = listed.where("to IS NOT NULL").join(names, "to").select("place", "form").join(roots(listed.where("to IS NOT NULL").select("place", "to")), "place")
    linked = linked.join(names.select(F.col("to").alias("end"), F.col("form").alias("root")), "end").select("place", "form", "root")
    scratch.remove("words", "values", "near")
    return listed.join(linked, "place", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """(place, end): where following `links` (place, to) ends. Each round doubles the steps, so a chain of n takes about log2(n) rounds."""
    scratch, turn = Scratch(links.sparkSession), 0
    now = scratch.written(links.withColumnRenamed("to", "end"), "ends-0")
    while True:
        ahead = now.select(F.col("place").alias("end"), F.col("end").alias("next"))
        turn += 1
        after = scratch.written(now.join(ahead, "end", "left").select("place", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved")), f"ends-{turn}")
        moved = after.where("moved").limit(1).count()
        scratch.remove(f"ends-{turn - 1}")
        now = after.drop("moved")
        if not moved:
            return now
