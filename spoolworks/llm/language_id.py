"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces, which the forward algorithm adds up position by position; pieces do not
cross words, so a text's log-probability is the sum over its words. The probabilities come from
expectation-maximisation over the same lattices. Words repeat, so each worker keeps the scores of those it has seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from spoolworks.llm.words import slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of what is learned from: documents, characters and distinct words of each language.
SAMPLE_DOCUMENTS = 1500
SAMPLE_CHARS = 16_000_000
SAMPLE_WORDS = 50_000
ROUNDS = 3
#: Pseudo-counts of the mean over languages in each language's counts, and of each piece in that mean.
SMOOTHING = 50.0
FLOOR = 0.1
#: Scores that a worker keeps: words times languages, but this many words at least.
KNOWN_SCORES, KNOWN_WORDS = 8_000_000, 1000
UNDETERMINED = "und"
WORD_START = "▁"
#: Marked words longer than this go alone, in blocks of so many places.
LONG_WORD = 200
BLOCK = 1 << 16
# Odd multipliers of the hashes.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FILTER_BITS = 20


def pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces that can occur in lower-cased text, from a SentencePiece model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p == p.lower()})


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L); digits and number signs are none."""
    return any(map(str.isalpha, text))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all beginnings, a row for each length from 0."""
    out = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
    for i in range(codes.shape[1]):
        out[i + 1] = out[i] * BASE + (codes[:, i].astype(np.uint64) + np.uint64(1))
    return out


#: (start, end, words, pieces): in these words the stretch from start to end is this piece.
Place = tuple[int, int, np.ndarray, np.ndarray]


class Lattices:
    """Segmentation lattices of words over a vocabulary: the pieces that stand in a word, and where.

    A character outside the vocabulary is the piece `unknown`; `none` stands for no piece. A stretch is looked up by
    its 64-bit hash for all words of one length at once. Words of more than `LONG_WORD` characters go alone, place by place.
    """

    def __init__(self, vocabulary: list[str]):
        self.longest = max(map(len, vocabulary), default=1)
        self.unknown, self.none = len(vocabulary), len(vocabulary) + 1
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(vocabulary):
            by_length[len(p)].append(i)
        hashes = np.zeros(len(vocabulary), np.uint64)
        for members in by_length.values():
            hashes[members] = prefix_hashes(code_points([vocabulary[i] for i in members]))[-1]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slots(hashes)] = True

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * SPREAD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, pieces) of the hashes that are pieces."""
        near = np.flatnonzero(self.filter[self._slots(hashes)])
        if not len(near):
            return near, near
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        good = self.hashes[at] == hashes[near]
        return near[good], self.order[at[good]]

    def places(self, marked: list[str]) -> Iterator[Place]:
        """The lattices of words of one length, in the order of the ends."""
        before = prefix_hashes(code_points(marked))
        count = len(marked)
        every = np.arange(count)
        for end in range(1, len(before)):
            first = max(0, end - self.longest)
            at, ids = self._found((before[end] - before[first:end] * self.power[end - first : 0 : -1, None]).ravel())
            cuts = np.searchsorted(at, np.arange(end - first + 1) * count)
            for start, low, high in zip(range(first, end), cuts, cuts[1:], strict=False):
                if end == start + 1:
                    pieces = np.full(count, self.unknown)
                    pieces[at[low:high] % count] = ids[low:high]
                    yield start, end, every, pieces
                elif low < high:
                    yield start, end, at[low:high] % count, ids[low:high]

    def along(self, marked: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """The lattice of one word: for each place from `first` to `last`, the piece of each length that ends there."""
        last = len(marked) if last is None else min(last, len(marked))
        low = max(0, first - self.longest + 1)
        before = prefix_hashes_of_one(marked[low:last])
        ids = np.full((last - first, self.longest), self.none, np.int32)
        ids[:, 0] = self.unknown
        for length in range(1, min(self.longest, last - low) + 1):
            rows, found = self._found(before[length:] - before[:-length] * self.power[length])
            at = rows + low + length - 1 - first
            ids[at[at >= 0], length - 1] = found[at >= 0]
        return ids

    def onward(self, marked: str, first: int, last: int) -> np.ndarray:
        """The same of the pieces that start at each place."""
        ends = self.along(marked, first, last + self.longest - 1)
        ids = np.full((last - first, self.longest), self.none, np.int32)
        for k in range(self.longest):
            held = ends[k : k + last - first, k]
            ids[: len(held), k] = held
        return ids

    def total_along(self, marked: str, table: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """The log-probability of one word in each language. Memory hangs on the block, not on the word."""
        walk = Walk(self.longest, table)
        for first in range(0, len(marked), block):
            logs = walk.over(self.along(marked, first, first + block))
        return logs[-1]

    def count_along(self, counts: np.ndarray, marked: str, weight: float, table: np.ndarray, costs: np.ndarray, block: int = BLOCK) -> None:
        """Add to `counts` how often each piece is used in the segmentations of one word: forward sums first, 8 bytes a place, then
        blocks from the last to the first."""
        size, walk, ahead = len(marked), Walk(self.longest, table), [np.zeros(1)]
        for first in range(0, size, block):
            ahead.append(walk.over(self.along(marked, first, first + block))[:, 0])
        ahead = np.concatenate(ahead)
        walk, later = Walk(self.longest, table), np.zeros(1)
        for first in range((size - 1) // block * block, -1, -block):
            last = min(first + block, size)
            ids = self.onward(marked, first, last)
            back = np.concatenate([walk.over(ids[::-1])[::-1, 0], later])
            for k in range(min(self.longest, size - first)):
                own = ids[: size - k - first, k]
                share = np.exp(ahead[first : first + len(own)] + costs[own] + back[k + 1 : k + 1 + len(own)] - ahead[size])
                np.add.at(counts, own, share * weight)
            later = back[: self.longest]

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """The log of the summed probability of all segmentations, a row a word and a column a language.

        `table` has a row for each piece, one for unknown characters and one of zeros.
        """
        out = np.empty((len(words), table.shape[1]))
        for members, marked in marked_groups(words):
            if len(marked[0]) > LONG_WORD:
                out[members] = [self.total_along(w, table) for w in marked]
            else:
                out[members] = sums(self.places(marked), len(marked), len(marked[0]), self.longest, table)[-1]
        return out

    def expected_counts(self, lattices: list, weights: np.ndarray, column: np.ndarray) -> np.ndarray:
        """How often each piece is used in the segmentations of the weighted words, under one language's column.
        lattices: (members, length, places) of `held()`."""
        counts = np.zeros(len(column))
        table = column[:, None]
        with np.errstate(divide="ignore"):
            costs = np.log(column)
        for members, length, found in lattices:
            if isinstance(found, str):
                self.count_along(counts, found, weights[members][0], table, costs)
                continue
            mirrored = sorted(((length - end, length - start, rows, ids) for start, end, rows, ids in found), key=lambda p: p[1])
            ahead = sums(iter(found), len(members), length, self.longest, table)[:, :, 0]
            back = sums(iter(mirrored), len(members), length, self.longest, table)[::-1, :, 0]
            for start, end, rows, ids in found:
                share = np.exp(ahead[start, rows] + costs[ids] + back[end, rows] - ahead[length, rows])
                np.add.at(counts, ids, share * weights[members[rows]])
        counts[self.none] = 0
        return counts

    def held(self, words: list[str]) -> list[tuple]:
        """The lattices of `words`, kept: (members, length, places). A long word is kept itself: its lattice is made in blocks each time."""
        found: list[tuple] = []
        for members, marked in marked_groups(words):
            if len(marked[0]) > LONG_WORD:
                found += [(members[i : i + 1], len(w), w) for i, w in enumerate(marked)]
            else:
                found.append((members, len(marked[0]), list(self.places(marked))))
        return found


def prefix_hashes_of_one(word: str) -> np.ndarray:
    """prefix_hashes() of one word of any length, as a vector."""
    codes, out, value = code_points([word])[0].tolist(), [0], 0
    for c in codes:
        value = (value * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        out.append(value)
    return np.array(out, np.uint64)


def marked_groups(words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(positions, words with the mark of a word's start) for each length of word, so many at a time."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for members in groups.values():
        for first in range(0, len(members), most):
            part = members[first : first + most]
            yield np.array(part), [WORD_START + words[i] for i in part]


def sums(places: Iterator[Place], count: int, length: int, longest: int, table: np.ndarray) -> np.ndarray:
    """The forward algorithm: logs of the summed probabilities up to each place, [place, word, language].

    Now and then the window that later places still read is scaled to the last place, so no word runs out of range.
    """
    ahead, logs = np.zeros((length + 1, count, table.shape[1])), np.zeros((length + 1, count, table.shape[1]))
    ahead[0] = 1
    scale, at = np.zeros((count, table.shape[1])), 0
    for start, end, rows, ids in places:
        if end != at:
            if at:
                logs[at] = np.log(ahead[at]) + scale
                if at % 8 == 0:
                    peak = ahead[at].copy()
                    ahead[max(0, at - longest) : at + 1] /= peak
                    scale += np.log(peak)
            at = end
        ahead[end, rows] += ahead[start, rows] * table[ids]
    logs[length] = np.log(ahead[length]) + scale
    return logs


class Walk:
    """The forward algorithm over one word, block after block: only as many places are kept as the longest piece reads."""

    def __init__(self, longest: int, table: np.ndarray):
        self.table, self.scale, self.steps = table, np.zeros(table.shape[1]), 0
        self.window = np.zeros((longest, table.shape[1]))
        self.window[0] = 1

    def over(self, ids: np.ndarray, step: int = 4096) -> np.ndarray:
        """Logs of the summed probabilities up to each place of the next block, [place, language]. ids: the pieces that end there, by length."""
        logs, window = np.empty((len(ids), self.table.shape[1])), self.window
        for first in range(0, len(ids), step):
            for i, chance in enumerate(self.table[ids[first : first + step]], first):
                new = (window * chance).sum(axis=0)
                window[1:] = window[:-1]
                window[0] = new
                logs[i] = np.log(new) + self.scale
                self.steps += 1
                if self.steps % 8 == 0:
                    window /= new
                    self.scale = self.scale + np.log(new)
        return logs


class Model:
    """Languages and the piece probabilities of each."""

    def __init__(self, languages: list[str], vocabulary: list[str], table: np.ndarray):
        self.languages, self.vocabulary, self.table = languages, vocabulary, table

    def predictor(self):
        """A function from texts to (language, probability) that keeps the scores of words it has seen, but for long ones."""
        lattices, known = Lattices(self.vocabulary), {}
        rows = np.empty((0, len(self.languages)))

        def predict(texts: list[str | None]) -> Iterator[tuple[str, float]]:
            nonlocal rows
            split = [words_of(t) for t in texts]
            every = set().union(*split)
            if len(known) + len(every) > max(KNOWN_WORDS, KNOWN_SCORES // max(1, len(self.languages))):
                known.clear()
                rows = rows[:0]
            new = sorted(every - known.keys(), key=len)
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                rows = np.concatenate([rows, lattices.log_probabilities(new, self.table)])
            for text, found in zip(texts, split, strict=True):
                if not self.languages or not text or not has_letter(text):
                    yield UNDETERMINED, 0.0
                    continue
                total = rows[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum(axis=0)
                shares = np.exp(total - total.max())
                best = int(np.argmax(total))
                yield self.languages[best], float(shares[best] / shares.sum())
            while new and len(new[-1]) > LONG_WORD:
                del known[new.pop()]
            rows = rows[: len(known)]

        return predict


def piece_counts(words: list[str], numbers: np.ndarray, vocabulary: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation: how often each piece is used in words that occur `numbers` times each."""
    lattices = Lattices(vocabulary)
    held = lattices.held(words)
    # A long piece starts as likely as a short one, so one piece beats two.
    column = np.full(lattices.none + 1, 1.0 / lattices.none)
    column[lattices.none] = 0
    counts = np.zeros(len(column))
    for _ in range(rounds):
        counts = lattices.expected_counts(held, numbers, column)
        column = (counts + 1e-3) / (counts + 1e-3).sum()
        column[lattices.none] = 0
    return counts


def fit(counts: dict[str, np.ndarray], vocabulary: list[str]) -> Model:
    """The model of piece counts by language: each is smoothed by the mean over languages."""
    languages = sorted(counts)
    if not languages:
        return Model([], vocabulary, np.zeros((len(vocabulary) + 2, 0)))
    columns = [counts[language] for language in languages]
    mean = sum(c / max(c.sum(), 1) for c in columns) / len(columns)
    mean = mean * 1e5 + FLOOR
    mean /= mean.sum()
    table = np.stack([(c + SMOOTHING * mean) / (c.sum() + SMOOTHING) for c in columns], axis=1)
    table[-1] = 0
    return Model(languages, vocabulary, table)


def held_out(id_col: Column) -> Column:
    """Whether crc32(id as text) mod 3 is 1; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(
    docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCUMENTS, most_words: int = SAMPLE_WORDS, most_chars: int = SAMPLE_CHARS
) -> Model:
    """The model of a bounded sample of `docs`: of each language about `per_language` rows by the hash of id and text, one at least, of
    them the first that hold `most_chars` characters together (the very first whatever its length), and the `most_words` most
    frequent words of these. Rows equal in id and text count once. A task fits each language; a number for each piece and
    language, and the rows of each language, reach the driver. Languages are taken to be thousands at most."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    own = own.withColumn("h", F.xxhash64("i", "t")).withColumn("place", F.pmod("h", F.lit(1_000_003)) / 1_000_003)
    sizes = [(r.l, max(r.least, per_language / r.n)) for r in own.groupBy("l").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()]
    shares = spark.createDataFrame(sizes, "l string, share double")
    drawn = own.join(F.broadcast(shares), "l").where(F.col("place") <= F.col("share")).dropDuplicates(["l", "h"])
    # Not many more rows than the sample has meet in this window.
    first = Window.partitionBy("l").orderBy("place", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = drawn.withColumn("so_far", F.sum(F.length("t")).over(first)).withColumn("nth", F.count("*").over(first))
    sample = held.where((F.col("so_far") <= most_chars) | (F.col("nth") == 1)).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[tuple[str, str], int] = defaultdict(int)
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    found[language, w] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["l", "w", "n"])

    counted = sample.mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))).where(F.col("r") <= most_words)
    shared = spark.sparkContext.broadcast(vocabulary)

    def train(key: tuple, group: pa.Table) -> pa.Table:
        counts = piece_counts(group.column("w").to_pylist(), group.column("n").to_numpy().astype(float), shared.value)
        return pa.table({"l": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([counts.tobytes()], pa.binary())})

    trained = top.select("l", "w", "n").groupBy("l").applyInArrow(train, "l string, counts binary").collect()
    shared.destroy()
    return fit({r.l: np.frombuffer(r.counts) for r in trained}, vocabulary)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with two columns more: the language and its probability among those learned.

    A null text or one without a letter is `und` with score 0, as is every text if nothing was learned from. The
    probability is of the whole text, so it is near 1 after a few words, whatever the text is.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.vocabulary, model.table))
    schema = StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
    at, names = docs.columns.index(text_col), [*docs.columns, lang_col, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Model(*shared.value).predictor()
        for part in slices(batches):
            found = list(guess(part.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row of `docs` as (doc_id, held_out, lang_pred, score), learned from its own labelled rows that are not held out.

    Rows with a null text or language are not learned from. Null ids count as held out. Repeated rows get one answer.
    An empty table gives no rows; other columns are left behind.
    """
    model = learn(docs, pieces(vocabulary_path), id_col, text_col, lang_col)
    scored = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
