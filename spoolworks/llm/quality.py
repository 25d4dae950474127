"""Quality classifier: Naive Bayes support vectors (Wang and Manning, 2012).

A text's features are indicators of n-grams of two sequences: its bytes (n = 1 to 4, hashed), and its words written as
the symbols "same as the word before" and "another word" (runs of the first, n = 1, 2, 4, ...), which byte n-grams of
bounded length can't express. Each is scaled by the log of the ratio of its shares in the two classes; a linear
hinge-loss model on the scaled indicators of unit length is fitted by dual coordinate descent (Hsieh et al., 2008). The class counts behind the ratios come from every labelled row that may be learned from; the
linear model is fitted on a bounded sample of them. Margins become scores by a logistic curve (Platt, 1999).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from spoolworks.llm.words import slices

ORDERS = (1, 2, 3, 4)
BITS = 18
#: Bounds of what the linear model is fitted on: rows of each class, and bytes of their features on the driver (four a
#: distinct feature). Long texts lower the number of rows, never the features of a row.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 64 << 20
#: Ids that are broadcast at most, and the steps of the hash that draws.
MOST_IDS = 50_000
PLACES = 1_000_003
PENALTY = 1.0
EPOCHS = 12
#: The last features are not hashed to: a run of 2**i words that equal the word before.
REPEATS = 8
PRIOR = 1.0


class Grams:
    """Distinct hashed n-grams of a text, by a table of the last place of each hash."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS):
        self.orders, self.shift = orders, np.uint32(32 - bits)
        self.last = np.zeros(1 << bits, np.int32)

    def of(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        data = np.frombuffer(text, np.uint8).astype(np.uint32)
        parts, code = [], np.zeros(len(data), np.uint32)
        for n in range(1, max(self.orders) + 1):
            if len(data) < n:
                break
            code = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :]
            if n in self.orders:
                parts.append(((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> self.shift)
        hashes = np.concatenate(parts).astype(np.int32)
        places = np.arange(len(hashes), dtype=np.int32)
        self.last[hashes] = places
        distinct = hashes[self.last[hashes] == places]
        top = len(self.last) - REPEATS
        return np.concatenate([distinct[distinct < top], np.arange(top, top + min(REPEATS, longest_repeat(text).bit_length()), dtype=np.int32)])


def longest_repeat(text: bytes) -> int:
    """The most words in a row that equal the word before them."""
    found = text.split()
    again = np.fromiter(map(bytes.__eq__, found[1:], found), bool, max(0, len(found) - 1))
    breaks = np.flatnonzero(~np.concatenate([[False], again, [False]]))
    return int(np.diff(breaks).max(initial=1)) - 1


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights of a hinge-loss model with an intercept (the last weight) on scaled indicators of unit length."""
    weights = np.zeros(len(scale) + 1)
    values = []
    for r in rows:
        v = scale[r]
        norm = np.sqrt(v @ v)
        values.append(v / norm if norm > 0 else v)
    square = np.array([v @ v + 1.0 for v in values])
    alpha, signs = np.zeros(len(rows)), np.where(labels > 0, 1.0, -1.0)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slope = signs[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), penalty)
            if new != alpha[i]:
                move = (new - alpha[i]) * signs[i]
                weights[rows[i]] += move * values[i]
                weights[-1] += move
                alpha[i] = new
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    positive, negative = weight[labels > 0].sum(), weight[labels <= 0].sum()
    goal = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - goal)) + 1e-3 * at
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


class Model:
    """scale: log-count ratio of each feature; weights: of scaled features and the intercept; curve: margin to score."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, curve: tuple[float, float], orders: tuple[int, ...], bits: int):
        self.scale, self.weights, self.curve, self.orders, self.bits = scale, weights, curve, orders, bits

    def parts(self) -> tuple:
        return self.scale, self.weights, self.curve, self.orders, self.bits

    def scorer(self):
        grams, product, square = Grams(self.orders, self.bits), self.scale * self.weights[:-1], self.scale**2

        def score(text: bytes | None) -> float:
            found = grams.of(text)
            norm = np.sqrt(square[found].sum())
            margin = (product[found].sum() / norm if norm > 0 else 0.0) + self.weights[-1]
            return float(1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -700, 700))))

        return score


def held_out(id_col: Column) -> Column:
    """Whether crc32(id as text) mod 3 is 1; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(plain: DataFrame, marked: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of `plain` (id, text) and `marked` (id, label 0 or 1). Every labelled row counts in the ratios. The linear model is
    fitted on the driver, to about `sample_rows` rows of each class, one at least, and fewer if their features take more
    than `sample_bytes`: first ids are drawn by their hash, among the labels, then of their rows as many as are
    asked for by the hash of id and text. Rows equal in id and text count once in the sample. Ids go to the texts by a
    broadcast where they are few, by a merge where the labels name many ids that have no text."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, rows, least = Grams(orders, bits), np.zeros((2, size), np.int64), np.zeros(2, np.int64), [PLACES, PLACES]
        for batch in slices(batches):
            for text, label, at in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                counts[label][grams.of(text)] += 1
                rows[label] += 1
                least[label] = min(least[label], at)
        for label in (0, 1):
            held = np.flatnonzero(counts[label])
            features, numbers = np.append(held, -1), np.append(counts[label][held], rows[label])
            first = pa.array([least[label]] * len(features), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(features), pa.int32()), pa.array(features, pa.int32()), pa.array(numbers, pa.int64()), first], ["label", "feature", "n", "least"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(orders, bits)
        for batch in slices(batches):
            data = [grams.of(t).tobytes() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], ["id", "label", "grams"])

    # By merge at every size: whether the labels would fit a broadcast hangs on their number.
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES))
    labelled = plain.join(marked.hint("merge"), "id").select("id", "text", "label", place.alias("place"))
    summed = labelled.mapInArrow(count, "label int, feature int, n long, least long").groupBy("label", "feature").agg(F.sum("n").alias("n"), F.min("least").alias("least")).toPandas()
    counts, rows = np.zeros((2, size)), np.zeros(2)
    for label in (0, 1):
        of = summed[summed.label == label]
        rows[label] = of.n[of.feature == -1].sum()
        counts[label][of.feature[of.feature >= 0].to_numpy()] = of.n[of.feature >= 0].to_numpy()
    if not rows.all():
        # One class only, or none: everything scores as the labels do.
        return Model(np.zeros(size), np.zeros(size + 1), (0.0, 0.0 if not rows.any() else 4.0 if rows[1] else -4.0), orders, bits)
    scale = np.log((counts[1] + PRIOR) / (rows[1] + 2 * PRIOR)) - np.log((counts[0] + PRIOR) / (rows[0] + 2 * PRIOR))
    scale[counts.sum(axis=0) == 0] = 0.0
    shares = sample_rows / rows
    # The least place of a row that has a text and a label, so each class keeps a row.
    limits = [max(int(shares[label] * PLACES), int(summed[(summed.label == label) & (summed.feature == -1)].least.min()) + 1) for label in (0, 1)]
    chosen = marked.where(place < F.when(F.col("label") == 1, limits[1]).otherwise(limits[0])).distinct()
    chosen = F.broadcast(chosen) if chosen.limit(MOST_IDS + 1).count() <= MOST_IDS else chosen.hint("merge")
    # An id may have any number of rows; their number needs no text.
    many = {r.label: r["count"] for r in plain.select("id").join(chosen, "id").groupBy("label").count().collect()}
    h = F.xxhash64("id", "text")
    drawn = plain.join(chosen, "id").select("id", "text", "label", h.alias("h"))
    asked = [max(1, int(PLACES * min(1.0, sample_rows / many[label]))) for label in (0, 1)]
    some = drawn.where(F.pmod("h", F.lit(PLACES)) < F.when(F.col("label") == 1, asked[1]).otherwise(asked[0])).dropDuplicates(["id", "label", "h"])
    offered = some.mapInArrow(draw, StructType([some.schema["id"], StructField("label", IntegerType()), StructField("grams", BinaryType())]))
    # Not many more rows than the sample has meet in this window. Either class gets half of the bytes, and the first row at least.
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("id", "grams"), "id", "grams")
    bounded = offered.withColumn("n", F.row_number().over(so_far)).withColumn("bytes", F.sum(F.octet_length("grams")).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sample = bounded.where((F.col("bytes") <= sample_bytes // 2) | (F.col("n") == 1)).select("id", "label", "grams").toPandas()
    for label in {0, 1} - set(sample.label):
        # All rows of the class fell together: they are equal, or nearly all of them.
        one = drawn.where(F.col("label") == label).orderBy("h", "id").limit(1)
        sample = pd.concat([sample, one.mapInArrow(draw, offered.schema).toPandas()])
    sample = sample.sort_values(["id", "label"], kind="stable")
    found, labels = [np.frombuffer(g, np.int32) for g in sample.grams], sample.label.to_numpy()
    weights = dual_coordinate_descent(found, labels, scale)
    model = Model(scale, weights, (1.0, 0.0), orders, bits)
    score = [(scale[f] * weights[:-1][f]).sum() / max(np.sqrt((scale[f] ** 2).sum()), 1e-12) + weights[-1] for f in found]
    model.curve = logistic_curve(np.array(score), labels, np.where(labels > 0, rows[1] / (labels > 0).sum(), rows[0] / (labels <= 0).sum()))
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """Every row of `docs` as (doc_id, held_out, score, predicted), learned from the rows of `labels` not held out.

    Texts alone are scored; a null or empty text scores what the intercept gives. Rows whose label is neither 0 nor 1
    and rows of null ids are not learned from; a text counts once for each row of its id in the labels, and each row of
    a repeated id with its own text; without labels everything scores 0.5 and is predicted 1. Repeated rows
    score alike. An empty table gives no rows; other columns are left behind.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    learned = learn(plain.withColumnRenamed("doc_id", "id").where(~held_out(F.col("id"))), marked, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(learned.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model(*shared.value).scorer()
        for batch in slices(batches):
            scores = [score(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    marked_out = plain.withColumn("held_out", held_out(F.col("doc_id")))
    schema = StructType([plain.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType())])
    return marked_out.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
