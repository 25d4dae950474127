"""Text: paths, failures, ranges, tables of a plan, signals, and how values are shown."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an encoder says, by class, the most specific first.
FAILURES = [
    (
        "filter_graph",
        [
            "no such filter",
            "filter not found",
            "error parsing filterchain",
            "error parsing filtergraph",
            "error parsing a filter description",
            "error initializing filter",
            "error initializing filters",
            "error reinitializing filters",
            "error initializing complex filters",
            "invalid filtergraph",
            "unable to parse graph",
        ],
    ),
    (
        "unsupported_codec",
        [
            "unknown encoder",
            "unknown decoder",
            "encoder not found",
            "decoder not found",
            "unsupported codec",
            "automatic encoder selection failed",
            "error selecting an encoder",
        ],
    ),
    ("unreadable", ["invalid data found when processing input", "moov atom not found", "could not find codec parameters"]),
    ("no_space", ["no space left on device"]),
]
# Suffixes by container, the shape of a path, signals of a copied plan.
SUFFIXES = {
    "mov,mp4,m4a,3gp,3g2,mj2": ".mp4",
    "matroska,webm": ".mkv",
    "avi": ".avi",
    "mpegts": ".ts",
    "flv": ".flv",
    "asf": ".wmv",
}
SIGNALS = {
    "wave_titles": (r"Wave[ \t]*[0-5][^\n]{0,24}?\b([A-Z][a-z]{2,}(?:[ \t]+[A-Z][a-z]+){0,3})", 1),
    "prompt_entries": (r"""(?i)\bid\s*[=:]\s*["']?(\d{2})["']?[\s\S]{0,200}?\bname\s*[=:]\s*["'][^"']{4,80}["']""", 1),
    "prompt_rows": (r"(?m)^\|\s*(\d{2})\s*\|\s*[^|\n]{4,80}\|\s*[^|\n]{20,}\|[^|\n]*\|[^|\n]*\|", 1),
    "gate_commands": (r"\bmake\s+verify-(\d{2})\b", 1),
    "timelines": (
        r"(?i)\d+\s*[—–-]?\s*\d*\s*weeks?[^\n]{0,30}?(?:Wave|Prompt)\s*\d|(?:Wave|Prompt)\s*\d[^\n]{0,30}?\d+\s*[—–-]?\s*\d*\s*weeks?",
        0,
    ),
    "report_paths": (r"docs/reports/prompt-(\d{2})\.md", 1),
}
# Suffixes of files that may hold video, and where a plan binds a title to a number.
VIDEO_SUFFIXES = [".mp4", ".mov", ".m4v", ".mkv", ".webm", ".avi", ".3gp", ".mts", ".m2ts", ".ts", ".wmv"]
TITLES = [
    r"(?:PROMPT|Prompt)\s*\d{1,2}\s*[\u2014\u2013:\-]\s*([^\n|]{4,80})",
    r"(?:WAVE|Wave)\s*\d\s*[\u2014\u2013:\-]\s*([^\n|]{3,60})",
]
# What begins a protocol, a range of numbers in a plan, and what stands between the parts of a cell.
SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]+:"
NUMBER_RANGE = r"(\d{2})(?:\s*[—–-]\s*(\d{2}))?"
PARTS = r"\s*(?:·|\|)\s*"
LEAST_TITLE = 8
FAMILY_LIMIT, COMBINED_LIMIT = 3, 6
MOST_DETAIL = 200
UNKNOWN = "—"


#: White space of Unicode and the four separators U+001C to U+001F; the part that is ASCII, without the space.
SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
NARROW = r"\x09-\x0D\x1C-\x1F"
#: White space, digits, letters and word bounds of Unicode; a line ends at a line feed only.
LINES, UNICODE = "(?d)", "(?dU)"
SHARP_S = "ß"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@functools.cache
def fold_tables() -> tuple[str, str, list[tuple[str, str]], str]:
    """What full case folding does beyond lower case: single characters and what they become, those that become several, and a
    short character class that holds all of them but the sharp s."""
    lower = {c.lower() for c in map(chr, range(sys.maxunicode + 1))}
    apart = {c: c.casefold() for c in sorted(lower) if len(c) == 1 and c.casefold() != c}
    single = {c: f for c, f in apart.items() if len(f) == 1}
    spans: list[list[str]] = []
    for c in sorted(apart.keys() - {SHARP_S}):
        if spans and ord(c) - ord(spans[-1][1]) < 64 and ord(c) > 0x100:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(single), "".join(single.values()), [(c, f) for c, f in apart.items() if len(f) > 1], "".join(a if a == b else f"{a}-{b}" for a, b in spans)


def case_folded(text: Column) -> Column:
    """Full case folding, as comparing without regard to case asks for: sharp s as ss, every sigma as one, ligatures as letters. The
    sharp s is common, so it goes first; texts with any of the others are rare, and take a pass for each."""
    before, after, several, near = fold_tables()
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in several if c != SHARP_S])
    lower = F.replace(F.lower(text), F.lit(SHARP_S), F.lit("ss"))
    whole = F.aggregate(pairs, F.translate(lower, before, after), lambda t, p: F.replace(t, p["c"], p["f"]))
    return F.when(is_ascii(lower) | ~lower.rlike(f"[{near}]"), lower).otherwise(whole)


def stripped(text: Column) -> Column:
    """White space at both ends off."""
    return F.regexp_replace(text, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def folded(text: Column) -> Column:
    """Runs of white space as one space, and case folded. A single space is no match, so most text is not rewritten."""

    def runs(others: str) -> str:
        return f" ?[{others}][ {others}]*|  [ {others}]*"

    wide = SPACES.replace(r"\x1C-\x20", r"\x1C-\x1F")
    narrow = F.regexp_replace(text, runs(NARROW), " ")
    return case_folded(F.when(is_ascii(text), narrow).otherwise(F.regexp_replace(text, runs(wide), " ")))


def redacted(text: Column) -> Column:
    """Every path of two segments or more as `.../` and its last segment."""
    plain = F.replace(text, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(plain, r"""(?:[A-Za-z]:)?(?:/[^/\s'"]+)+/([^/\s'"]+)""", r".../$1")


def detail(line: Column) -> Column:
    return F.substring(redacted(F.trim(line)), 1, MOST_DETAIL)


def failure(report: Column) -> Column:
    """struct(class, detail): the first class any line shows, and that line; `encode` and the first line if none does."""
    lines = F.filter(F.split(report, "\r\n|\n|\r"), lambda x: F.trim(x) != "")

    def showing(needles: list[str]) -> Column:
        return F.filter(lines, lambda x: F.exists(F.array(*[F.lit(k) for k in needles]), lambda k: F.contains(F.lower(x), k)))

    hits = [(name, showing(needles)) for name, needles in FAILURES]
    kind, line = F.lit("encode"), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    for name, found in reversed(hits):
        kind = F.when(F.size(found) > 0, F.lit(name)).otherwise(kind)
        line = F.when(F.size(found) > 0, F.try_element_at(found, F.lit(1))).otherwise(line)
    return F.struct(kind.alias("class"), detail(line).alias("detail"))


def container_suffix(format_name: Column) -> Column:
    """The file suffix of a container; an unknown one gives its first token, cleaned, or `.bin`."""
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    first = F.regexp_replace(F.lower(F.trim(F.substring_index(format_name, ",", 1))), "[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(known, format_name), F.when(first != "", F.concat(F.lit("."), first)), F.lit(".bin"))


def blob_path(sha256: Column, suffix: Column) -> Column:
    """media/blobs/<2 digits>/<sha256>/source<suffix>; null if the digest isn't 64 lower-case hex digits."""
    cleaned = F.nullif(F.regexp_replace(F.lower(F.ltrim(suffix, F.lit("."))), "[^a-z0-9]", ""), F.lit(""))
    return F.when(is_digest(sha256), F.concat_ws("/", F.lit("media/blobs"), F.substring(sha256, 1, 2), sha256, F.concat(F.lit("source."), F.coalesce(cleaned, F.lit("bin")))))


def derived_path(sha256: Column, kind: Column, version: Column, name: Column) -> Column:
    good = is_digest(sha256) & is_slug(kind) & (version >= 1) & is_component(name)
    return F.when(good, F.concat_ws("/", F.lit("media/derived"), F.substring(sha256, 1, 2), sha256, kind, version.cast("string"), name))


def is_digest(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{64}\z")


def is_uuid(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")


def is_slug(text: Column) -> Column:
    return text.rlike(r"\A[a-z0-9][a-z0-9_-]*\z")


def is_component(text: Column) -> Column:
    """One path component: not empty, no separator, not . or .."""
    return text.rlike(r"\A[^/\\\x00]+\z") & ~text.isin(".", "..")


def is_contained(path: Column) -> Column:
    """Whether a relative path stays below its root at every step; absolute paths and drives don't. Links aren't followed."""
    depth = F.aggregate(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda s, p: F.struct(
            F.when(p == "..", s["at"] - 1).when(p.isin("", "."), s["at"]).otherwise(s["at"] + 1).alias("at"),
            F.least(s["least"], F.when(p == "..", s["at"] - 1).otherwise(s["at"])).alias("least"),
        ),
    )
    return ~path.rlike(r"\A([/\\]|[A-Za-z]:)") & (depth["least"] >= 0)


def is_safe_source(path: Column) -> Column:
    """Neither an option (leading dash) nor a protocol (two characters or more before a colon)."""
    return ~(path.startswith("-") | path.rlike(SCHEME))


def in_synced_folder(path: Column, folder: str) -> Column:
    """Whether any part of the path is the folder or starts with it and a space or dash."""
    return F.exists(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p == folder) | p.startswith(f"{folder} ") | p.startswith(f"{folder}-"))


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end, status): 200 for the whole, 206 for a part, 416 for a range past the end (start, end null)."""
    shape = r"\Abytes=(\d{0,19})-(\d{0,19})\z"
    plain = F.trim(header)
    first, last = (F.regexp_extract(plain, shape, i) for i in (1, 2))
    start, stop = first.try_cast("long"), F.coalesce(last.try_cast("long"), F.when(last != "", F.lit(2**63 - 1)))
    start = F.coalesce(start, F.when(first != "", F.lit(2**63 - 1)))
    usable = plain.rlike(shape) & (size > 0) & ((first != "") | (last != ""))
    suffix = usable & (first == "")
    end = F.when(last == "", size - 1).otherwise(F.least(stop, size - 1))
    status = (
        F.when(~F.coalesce(usable, F.lit(False)), 200)
        .when(suffix, F.when(stop == 0, 416).otherwise(206))
        .when(start >= size, 416)
        .when(end < start, 200)
        .otherwise(206)
    )
    return F.struct(
        F.when(status == 206, F.when(suffix, F.greatest(F.lit(0).cast("long"), size - stop)).otherwise(start)).when(status == 200, F.lit(0).cast("long")).alias("start"),
        F.when(status == 206, F.when(suffix, size - 1).otherwise(end)).when(status == 200, size - 1).alias("end"),
        status.alias("status"),
    )


def without_emphasis(text: Column) -> Column:
    """Markdown stars and backticks off; underscores stay."""
    return F.trim(F.regexp_replace(text, "[*`]+", ""))


def expanded_range(text: Column) -> Column:
    """`03–06` as [03, 04, 05, 06]; one number as itself; nothing as an empty array."""
    first = F.regexp_extract(text, NUMBER_RANGE, 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(text, NUMBER_RANGE, 2).try_cast("int"), first)
    return F.when(first.isNull() | (last < first), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(first, F.greatest(first, last)), lambda n: F.lpad(n.cast("string"), 2, "0")))


def parts_of(text: Column, separator: str = PARTS) -> Column:
    """The parts between separators, empty ones left out."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def review_note(text: Column) -> Column:
    """struct(required, note): whether it says yes, and the text unless empty."""
    return F.struct(F.contains(F.lower(text), F.lit("yes")).alias("required"), F.nullif(without_emphasis(text), F.lit("")).alias("note"))


def signal_hits(text: Column) -> Column:
    """struct of the distinct hits of each signal, trimmed and case folded."""
    def hits(pattern: str, group: int) -> Column:
        plain, wide = (F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group)) for flags in (LINES, UNICODE))
        return F.when(is_ascii(text), plain).otherwise(wide)

    found = {name: hits(p, g) for name, (p, g) in SIGNALS.items()}
    return F.struct(*[F.array_distinct(F.transform(hits, lambda h: case_folded(stripped(h)))).alias(name) for name, hits in found.items()])


def plan_titles(text: Column) -> Column:
    """The distinct titles of prompts and waves in a plan, white space and trailing emphasis off, short ones left out."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(UNICODE + p), 1) for p in TITLES]))
    plain = F.transform(found, lambda t: F.regexp_replace(stripped(t), r"[.*_ ]+\z", ""))
    return F.array_distinct(F.filter(plain, lambda t: F.length(t) >= LEAST_TITLE))


def has_video_suffix(name: Column) -> Column:
    """Whether the last extension of a file name, in lower case, is one of video. A name that only has a leading dot has none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1)).isin(*VIDEO_SUFFIXES)


def metric(value: Column) -> Column:
    """Two decimals, or that it wasn't measured."""
    return F.when(value.isNull(), "not measured").otherwise(F.format_string("%.2f", value))


def version_token(report: Column) -> Column:
    """The third token of a first line `ffmpeg version X ...`, else null."""
    tokens = F.split(F.trim(F.substring_index(report, "\n", 1)), r"\s+")
    return F.when((F.get(tokens, F.lit(0)) == "ffmpeg") & (F.get(tokens, F.lit(1)) == "version"), F.get(tokens, F.lit(2)))


def shown_duration(seconds: Column) -> Column:
    """m:ss or h:mm:ss; a dash for null, negative and endless ones."""
    whole = F.floor(seconds)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    text = F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(minutes), two(rest))).otherwise(F.concat_ws(":", minutes.cast("string"), two(rest)))
    return F.when((seconds >= 0) & (seconds < float("inf")), text).otherwise(UNKNOWN)


def shown_timecode(seconds: Column, fps: Column) -> Column:
    """m:ss.ff; without frames if the rate is unknown."""
    frame = F.least(F.floor((seconds - F.floor(seconds)) * fps), F.ceil(fps) - 1)
    framed = F.concat_ws(".", shown_duration(seconds), F.lpad(frame.cast("string"), 2, "0"))
    return F.when((seconds >= 0) & (seconds < float("inf")) & (fps > 0) & (fps < float("inf")), framed).otherwise(shown_duration(seconds))


def shown_bytes(size: Column) -> Column:
    """Binary units, one decimal under 100."""
    value, text = size / 1024, None
    for i, unit in enumerate(["KB", "MB", "GB", "TB"]):
        here = F.when(value >= 100, F.format_string(f"%.0f {unit}", value)).otherwise(F.format_string(f"%.1f {unit}", value))
        text = F.when((value < 1024) | F.lit(unit == "TB"), here) if text is None else text.when((value < 1024) | F.lit(unit == "TB"), here)
        value = value / 1024
    return F.when(size.isNull() | (size < 0), UNKNOWN).when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).otherwise(text)


def shown_fps(fps: Column) -> Column:
    """Whole rates bare, others with two decimals."""
    text = F.when(fps == F.floor(fps), fps.cast("long").cast("string")).otherwise(F.format_string("%.2f", fps))
    return F.when((fps > 0) & (fps < float("inf")), text).otherwise(UNKNOWN)


def shown_resolution(width: Column, height: Column) -> Column:
    return F.when(width.isNull() | height.isNull(), UNKNOWN).otherwise(F.concat_ws("x", width.cast("string"), height.cast("string")))


def rate_mode(variable: Column) -> Column:
    """Three answers: null is not constant."""
    return F.when(variable.isNull(), "unknown").when(variable, "variable").otherwise("constant")


def shown_percent(share: Column) -> Column:
    """0 to 100, halves up; not a number is 0."""
    safe = F.when(share.isNull() | F.isnan(share) | F.abs(share).eqNullSafe(F.lit(float("inf"))), 0.0).otherwise(share)
    return F.floor(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), safe)) + 0.5).cast("int")


def contrast_ratio(one: Column, two: Column) -> Column:
    """WCAG contrast of two #rrggbb colours."""

    def luminance(colour: Column) -> Column:
        def channel(i: int) -> Column:
            c = F.conv(F.substring(colour, i, 2), 16, 10).cast("double") / 255
            return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

        return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)

    a, b = luminance(one), luminance(two)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
