"""Fill-in-the-middle: a text cut at two places, its parts put in another order between sentinels, and back.

The text is a rope. Two unit ranks split the tree, the subtrees are joined in the new order with leaves for the sentinels, and
the result is flattened once. The way back splits a rope of the output at the code-point ranks of its sentinels.

Places and form come from the first four 8-digit groups of the hex SHA-256 of `<seed>:<id>`, read as integers h1 to h4, so a
rerun and any partitioning give the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spoolworks.llm.rope import Rope, joined, rope, split
from spoolworks.llm.words import slices

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Percent of the texts that are rearranged, and of those that put the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20


def draws(seed: int, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(prefix: Rope, middle: Rope, suffix: Rope, form: str, sentinels: tuple[str, str, str]) -> Rope:
    p, s, m = (Rope(x) for x in sentinels)
    return joined(p, prefix, s, suffix, m, middle) if form == "psm" else joined(s, suffix, p, prefix, m, middle)


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that gave `output`. The text holds no sentinel, so the first of each kind is the one put in."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (p, s) if form == "psm" else (s, p)
    head = len(first)
    turn = output.index(second, head)
    last = output.index(m, turn + len(second))
    rest, middle = split(rope(output), last + len(m), points=True)
    rest, _ = split(rest, last, points=True)
    one, two = split(rest, turn, points=True)
    one, two = split(one, head, points=True)[1], split(two, len(second), points=True)[1]
    return str(joined(one, middle, two) if form == "psm" else joined(two, middle, one))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str | None = None,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """Every row of `docs` as (doc_id, n, form, prefix_chars, middle_chars, output).

    A text of n units is cut after h1 mod (n + 1) and h2 mod (n + 1) of them, the smaller first. `unit` is a regular expression whose matches,
    taken left to right over code points, end a unit; without one each code point is a unit. Form `psm` is prefix, suffix,
    middle; `spm` puts the suffix first. A text that is empty, null (taken as empty), holds a sentinel or draws
    h3 mod 100 >= `fim_percent` is `plain`: it stays as it is, and its two counts are null. A null id is drawn as the
    empty string, repeated ids draw alike. Rows stand alone: no shuffle, other columns are left behind, an empty table
    gives no rows. A text and its output are whole in one task's memory.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text"))
    schema = StructType([plain.schema["doc_id"], StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def turned(key: str, text: str, pattern: re.Pattern | None) -> tuple:
        whole = rope(text, pattern)
        h = draws(seed, key)
        if not text or any(x in text for x in sentinels) or h[2] % 100 >= fim_percent:
            return whole.units, "plain", None, None, text
        low, high = sorted(x % (whole.units + 1) for x in h[:2])
        rest, suffix = split(whole, high)
        prefix, middle = split(rest, low)
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        return whole.units, form, prefix.points, middle.points, str(arranged(prefix, middle, suffix, form, sentinels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = None if unit is None else re.compile(unit)
        for batch in slices(batches):
            rows = [turned(k, t or "", pattern) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))], schema.names)

    return plain.mapInArrow(run, schema)


def restore(turned: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """`turned` with a column more, the text rebuilt from output and form alone."""
    schema = StructType([*turned.schema.fields, StructField(name, StringType())])
    at, by = turned.columns.index(output_col), turned.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [restored(o, f, sentinels) for o, f in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return turned.mapInArrow(run, schema)


def digests(turned: DataFrame) -> DataFrame:
    """What fill_in_middle() gives, with the hashes of the output and of the text rebuilt from it in place of the texts."""
    hashed = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return restore(turned).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
