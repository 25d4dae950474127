"""Secret scan: an Aho-Corasick keyword prefilter, anchored expressions at its hits, embedded checksums.

One automaton of all keywords runs over the text with A-Z lower-cased. An expression is tried only at the places of
its keyword, left to right, skipping hits inside a match. Runs of hexadecimal digits have no keyword: bytes are
mapped to one of two classes, and a substring search for 24 of the first class decides whether to look closer.
Tokens that carry a checksum count only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from spoolworks.llm.words import slices

# The expressions of each kind and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SIGNED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The order of kinds that start at one place; the first three are the base.
KINDS = ["assign", "access", "hex", "github", "npm"]
HEX_CLASS = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def checksum_holds(body: str, sign: str) -> bool:
    """Whether `sign` is the CRC-32 of `body` in base 62, six digits."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(6, "0") == sign


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, keywords in KEYWORDS.items():
            for k in keywords:
                self.automaton.add_word(k, (kind, len(k)))
        self.automaton.make_automaton()

    def spans(self, data: bytes | None) -> list[tuple[int, int, str]]:
        """(start, order of the kind, end) of every secret in a UTF-8 text, sorted; places count code points."""
        if not data:
            return []
        found, text = [], data.decode()
        past = dict.fromkeys(KINDS, 0)
        for last, (kind, length) in self.automaton.iter(data.lower().decode()):
            start = last - length + 1
            if start < past[kind]:
                continue
            match = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else SIGNED).match(text, start)
            if match is None:
                continue
            if kind in ("assign", "access"):
                past[kind] = match.end()
                if len(match[2] if kind == "assign" else match[0]) < LEAST[kind]:
                    continue
            elif (start and text[start - 1].isalnum()) or not checksum_holds(match[1], match[2]):
                continue
            found.append((start, KINDS.index(kind), match.end()))
        if b"x" * LEAST["hex"] in data.translate(HEX_CLASS):
            found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
        return sorted(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` as (doc_id, secrets): an array of (kind, start, end), by start and then kind.

    Kinds: `assign`, a keyword with a value of 6 characters or more; `access`, an access key id of 20 or more;
    `hex`, 24 hexadecimal digits or more; `github` and `npm`, tokens whose CRC-32 holds. Spans of different kinds
    may overlap. Null and empty texts have none. Repeated rows are scanned each; other columns are left behind.
    """
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([plain.schema["doc_id"], StructField("secrets", ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            rows = []
            for data in batch.column(1).cast(pa.large_binary()).to_pylist():
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], ["doc_id", "secrets"])

    return plain.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text, of what find_secrets() gives."""

    def joined(secrets):
        return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
