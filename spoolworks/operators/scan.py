"""Scans over texts: titles inside documents, signals of a copied plan, bounded windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolworks.functions.text import COMBINED_LIMIT, FAMILY_LIMIT, SIGNALS, folded, signal_hits, stripped
from spoolworks.sources.tables import written

#: Titles of up to so many bytes go to the executors as one automaton, some 20 times as large there; more go through a join.
AUTOMATON_BYTES = 4 << 20
WINDOW, OVERLAP = 1_000_000, 4_096
GRAM = 8
#: Bits of the filter over the titles' grams that the join sends ahead: 2 MB, whatever their number.
FILTER_BITS = 24
#: Counts of the sketch that tells rare grams from frequent ones: 8 MB, whatever the number of grams and documents.
COUNTERS = 1 << 20
#: Documents that one part of an anchor takes.
PART_ROWS = 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str) -> np.ndarray:
    """The hash of each run of GRAM characters, in their order; none for shorter texts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < GRAM:
        return np.empty(0, np.int64)
    total = codes[: len(codes) - GRAM + 1].copy()
    for i in range(1, GRAM):
        total = total * FACTOR + codes[i : len(codes) - GRAM + 1 + i]
    return ((total ^ (total >> np.uint64(32))) * FACTOR).view(np.int64)


def _passing(packed: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which of `grams` a packed bitmap lets through."""
    place = grams & ((1 << FILTER_BITS) - 1)
    return (packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _filter(grams: DataFrame) -> np.ndarray:
    """A packed bitmap over the last FILTER_BITS bits of `grams` (gram); tasks fill blocks of 2**15 bits."""

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        block = np.zeros(1 << 15, bool)
        block[group.column("bit").to_numpy()] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([np.packbits(block).tobytes()], pa.binary())})

    place = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    placed = grams.select(F.shiftright(place, 15).alias("block"), place.bitwiseAND(F.lit((1 << 15) - 1)).cast("int").alias("bit")).distinct()
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in placed.groupBy("block").applyInArrow(fill, "block long, packed binary").collect():
        packed[row.block * 4096 : (row.block + 1) * 4096] = np.frombuffer(row.packed, np.uint8)
    return packed


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram): the distinct grams of each row's text."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.unique(gram_hashes(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found)], ["key", "gram"])


def gram_counts(flat_docs: DataFrame, grams: DataFrame) -> np.ndarray:
    """In how many of `flat_docs` (flat) each of `grams` (gram) is, as a sketch: COUNTERS counts, that of a gram at its last bits,
    never too small. A task adds up its own and sends them once, so neither the driver nor the shuffle grows with the texts."""
    passing = flat_docs.sparkSession.sparkContext.broadcast(_filter(grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, counts = passing.value, np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = np.unique(gram_hashes(text or ""))
                counts[np.unique(found[_passing(packed, found)] & (COUNTERS - 1))] += 1
        held = np.flatnonzero(counts)
        for first in range(0, len(held), 1 << 16):
            at = held[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["place", "n"])

    summed = flat_docs.select("flat").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[summed.column("place").to_numpy()] = summed.column("n").to_numpy()
    return counts


def anchors(titles: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, gram): of each of `titles` (key, title) the gram that the fewest documents hold, by `counts`; the smaller one of equals."""
    shared = titles.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for title in batch.column(1).to_pylist():
                found = np.unique(gram_hashes(title))
                chosen.append(int(found[np.argmin(shared.value[found & (COUNTERS - 1)])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int64())], ["key", "gram"])

    return titles.select("key", "title").mapInArrow(rarest, "key long, gram long")


def _titles_by_join(flat_docs: DataFrame, flat_titles: DataFrame, part: int = PART_ROWS) -> DataFrame:
    """A document that contains a title holds its anchor, the gram of it that the fewest documents hold, so titles that begin alike
    don't meet under one key. Of a document only anchors are shuffled, without its text, which is fetched once for each candidate
    and searched. Documents of an anchor that more than `part` hold are dealt over parts; equal titles are one."""
    titles = written(flat_titles.select("title").distinct().withColumn("key", F.monotonically_increasing_id()), "titles")
    counts = gram_counts(flat_docs, titles.select("key", "title").mapInArrow(_grams_of, "key long, gram long"))
    chosen = written(anchors(titles, counts), "title-anchors")
    context = flat_docs.sparkSession.sparkContext
    passing, salts = context.broadcast(_filter(chosen)), context.broadcast(-(-counts // part))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(gram_hashes(text or ""))
                near = found[_passing(passing.value, found)]
                salt = row % np.maximum(1, salts.value[near & (COUNTERS - 1)])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(near), pa.int64()), pa.array(near), pa.array(salt, pa.int64())], ["row", "gram", "salt"])

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, gram in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = max(1, int(salts.value[gram & (COUNTERS - 1)]))
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([gram] * n, pa.int64()), pa.array(np.arange(n))], ["key", "gram", "salt"])

    rows = flat_docs.withColumn("row", F.xxhash64("doc_id", "flat"))
    held = rows.select("row", "flat").mapInArrow(spread, "row long, gram long, salt long")
    pairs = held.join(chosen.mapInArrow(repeat, "key long, gram long, salt long"), ["gram", "salt"]).select("row", "key").distinct()
    both = rows.join(pairs, "row").join(titles, "key").where(F.contains("flat", F.col("title")))
    return both.select("doc_id", "title").join(flat_titles, "title").select("doc_id", "title_id")


def title_matches(docs: DataFrame, titles: DataFrame, least: int = GRAM, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(doc_id, title_id): each title that a document contains, white space and case folded in both.

    docs (doc_id, text), titles (title_id, text). A row for each row of `docs` and row of `titles` that is in it: repeated rows
    give repeated results, on both ways. One pass of an automaton over each document finds all titles at once; titles too
    large for one executor are joined on the gram of theirs that the fewest documents hold. Titles shorter than `least` (GRAM at least) are left out.
    """
    flat_docs = docs.select("doc_id", folded(F.col("text")).alias("flat"))
    flat_titles = titles.select("title_id", folded(stripped(F.col("text"))).alias("title")).where(F.length("title") >= max(least, GRAM))
    size = flat_titles.agg(F.sum(F.octet_length("title") + 64)).first()[0] or 0
    if size > automaton_bytes:
        return _titles_by_join(flat_docs, flat_titles)
    rows = [(r.title_id, r.title) for r in flat_titles.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, ids = ahocorasick.Automaton(), {}
        for title_id, title in shared.value:
            ids.setdefault(title, []).append(title_id)
        for title in ids:
            automaton.add_word(title, title)
        automaton.make_automaton()
        for batch in batches:
            docs_found, titles_found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for title in {t for _, t in automaton.iter(text)} if text and len(automaton) else ():
                    docs_found += [doc] * len(ids[title])
                    titles_found += ids[title]
            yield pa.RecordBatch.from_arrays([pa.array(docs_found, pa.int64()), pa.array(titles_found, pa.int64())], ["doc_id", "title_id"])

    return flat_docs.mapInArrow(run, "doc_id long, title_id long")


def cut_windows(texts: DataFrame, text: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """`texts` with `__windows`, the windows of each text as an array of struct(start, text): pieces of `size` characters, each opened
    by the end of the piece before.

    Of the last `overlap` characters of that piece a window takes what follows the first line feed, so it begins at the
    start of a line, and the window before ends with the last line that is whole; where there is no line feed it takes all of them and
    nothing is left off, so a record without line feeds still lies whole in a window. What is shorter than `overlap` by the
    length of a line lies whole in some window. An empty or null text has one empty window. Time and memory are in proportion
    to the text: it is cut into pieces once, and what is done to a piece hangs on the piece.
    """
    if not 0 <= overlap <= size or size < 1:
        raise ValueError("overlap must be between 0 and size")
    cut = texts.withColumn("__pieces", F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))))
    none = F.array(F.lit(None).cast("string"))
    before = F.concat(none, F.slice("__pieces", 1, F.greatest(F.lit(0), F.size("__pieces") - 1)))
    after = F.concat(F.slice("__pieces", 2, F.greatest(F.lit(0), F.size("__pieces") - 1)), none)
    cut = cut.withColumn("__pieces", F.arrays_zip(F.col("__pieces").alias("piece"), before.alias("before"), after.alias("after")))

    def opened(p: Column, i: Column) -> Column:
        tail = F.right(p["before"], F.lit(overlap))
        feed = F.instr(tail, "\n")
        carry = F.coalesce(F.when(feed > 0, F.substring(tail, feed + 1, F.lit(overlap))).otherwise(tail), F.lit(""))
        rest = F.instr(F.reverse(F.right(p["piece"], F.lit(overlap))), "\n")  # the next window has this last part of a line whole
        kept = F.when(p["after"].isNotNull() & (rest > 0), F.substring(p["piece"], F.lit(1), F.length(p["piece"]) - rest + 1)).otherwise(p["piece"])
        return F.struct((i.cast("long") * size - F.length(carry)).alias("start"), F.concat(carry, kept).alias("text"))

    empty = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit("").alias("text")))
    found = F.when(F.col(text).isNull() | (F.col(text) == ""), empty).otherwise(F.transform("__pieces", opened))
    return cut.withColumn("__windows", found).drop("__pieces")


def windows(texts: DataFrame, key: str, text: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, window, start, text): the windows of each text, a row each that carries no more than its own piece."""
    cut = cut_windows(texts.select(key, text), text, size, overlap).select(key, "__windows")
    # Never empty; outer, as otherwise the optimiser asks for that in a filter that cuts every text once more.
    return cut.select(key, F.posexplode_outer("__windows").alias("window", "__w")).select(key, "window", "__w.start", "__w.text")


def united(hits: Column) -> Column:
    """One struct of distinct hits from an array of them: hits are values, so a window that repeats some adds none."""
    return F.struct(*[F.array_distinct(F.flatten(F.transform(hits, lambda h: h[name]))).alias(name) for name in SIGNALS])


def _judged(counts: DataFrame, family_limit: int, combined_limit: int) -> DataFrame:
    """`counts` (n_<signal>, ...) with the strongest, the sum of those with two or more, and the verdict."""
    each = [F.col(f"n_{name}") for name in SIGNALS]
    total = sum((F.when(c >= 2, c).otherwise(0) for c in each), F.lit(0))
    found = counts.withColumns({"strongest": F.greatest(*each), "combined": total})
    return found.withColumn("leak", (F.col("strongest") >= family_limit) | (F.col("combined") >= combined_limit))


def leak_verdict(texts: DataFrame, family_limit: int = FAMILY_LIMIT, combined_limit: int = COMBINED_LIMIT, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """`texts` (text, ...) with the number of distinct hits of each signal over its windows, the strongest, the sum of those with two or
    more, and the verdict. One row in, one row out: hits are united on arrays, and nothing is shuffled. A null text shows none."""
    cut = cut_windows(texts, "text", size, overlap).withColumn("__windows", F.transform("__windows", lambda w: signal_hits(w["text"])))
    hits = cut.withColumn("__hits", united(F.col("__windows")))
    return _judged(hits.withColumns({f"n_{name}": F.size(f"__hits.{name}") for name in SIGNALS}).drop("__hits", "__windows"), family_limit, combined_limit)


def leak_verdict_of_windows(pieces: DataFrame, key: str, family_limit: int = FAMILY_LIMIT, combined_limit: int = COMBINED_LIMIT) -> DataFrame:
    """The same a key, from rows (key, text) that are windows of its text, in any order and any number of partitions: only
    distinct hits are shuffled, and counted before they meet, so a text may be larger than any task. Null keys are one key."""
    def of(name: str) -> Column:
        return F.transform(f"h.{name}", lambda x: F.struct(F.lit(name).alias("signal"), x.alias("hit")))

    hits = pieces.select(key, signal_hits(F.col("text")).alias("h"))
    each = F.flatten(F.array(*map(of, SIGNALS)))
    found = hits.select(key, F.explode_outer(each).alias("e")).select(key, "e.signal", "e.hit").distinct()
    counts = found.groupBy(key).agg(*[F.count_if(F.col("signal") == name).cast("int").alias(f"n_{name}") for name in SIGNALS])
    return _judged(counts, family_limit, combined_limit)
