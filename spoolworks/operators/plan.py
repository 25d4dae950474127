"""A plan written in Markdown: its wave, timeline and build tables, and the deliverables under its headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolworks.functions.text import expanded_range, parts_of, review_note, without_emphasis

# The shapes of the tables and headings.
DASH = "[—–-]"
WAVE_ROW = rf"(?m)^\|\s*(\d)\s*{DASH}\s*([^|\n]+?)\s*\|[^|\n]*\|\s*([^|\n]+?)\s*\|\s*$"
TIMELINE_ROW = r"(?m)^\|\s*Wave\s+(\d)\s*\|[^|\n]*\|\s*([^|\n]+?)\s*\|\s*$"
PLAN_ROW = r"(?m)^\|\s*(\d{2})\s*\|\s*([^|\n]+?)\s*\|\s*([^|\n]+?)\s*\|\s*([^|\n]+?)\s*\|\s*([^|\n]+?)\s*\|\s*$"
PROMPT_HEADING = rf"(?m)^##\s+PROMPT\s+(\d{{2}})\s*{DASH}\s*(.+?)\s*$"
PROMPT_START = rf"(?m)(?=^##\s+PROMPT\s+\d{{2}}\s*{DASH})"
DELIVERABLES = r"(?m)^###\s+Deliverables\s*$"
NEXT_HEADING = r"(?m)^#{2,3}\s+\S"
LIST_ITEM = r"^\s*\d+\.\s+(.+?)\s*$"
UNASSIGNED, NOT_STATED = "Unassigned", "not stated"


def _matches(text: Column, pattern: str, groups: list[str]) -> Column:
    """The matches in order as structs of their groups."""
    zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), i + 1).alias(g) for i, g in enumerate(groups)])
    return F.transform(zipped, lambda m: F.struct(*[m[g].alias(g) for g in groups]))


def waves(docs: DataFrame) -> DataFrame:
    """(path, wave, title, timeline, prompt_ids) of `docs` (path, text): a wave's first row counts."""
    found = docs.select("path", F.posexplode(_matches(F.col("text"), WAVE_ROW, ["number", "title", "prompts"])).alias("at", "w"), _matches(F.col("text"), TIMELINE_ROW, ["number", "timeline"]).alias("times"))
    named = found.groupBy("path", F.col("w.number").cast("int").alias("wave")).agg(F.min_by("w", "at").alias("w"), F.first("times").alias("times"))
    # A later timeline row of the same wave replaces an earlier one.
    time = F.try_element_at(F.filter("times", lambda t: t["number"] == F.col("w.number")), F.lit(-1))["timeline"]
    return named.select("path", "wave", without_emphasis(F.col("w.title")).alias("title"), F.coalesce(without_emphasis(time), F.lit(NOT_STATED)).alias("timeline"), expanded_range(F.col("w.prompts")).alias("prompt_ids"))


def deliverables(docs: DataFrame) -> DataFrame:
    """(path, id, deliverables): numbered items of each prompt's section, wrapped lines joined to their item.

    A section ends at the next prompt heading; its list at the next heading of two or three signs.
    """
    pieces = docs.select("path", F.explode(F.split("text", PROMPT_START)).alias("piece"))
    headed = pieces.withColumn("id", F.regexp_extract("piece", PROMPT_HEADING, 1)).where("id <> ''")
    rest = F.regexp_extract("piece", rf"(?s){DELIVERABLES}(.*)\z", 1)
    block = F.try_element_at(F.split(rest, NEXT_HEADING), F.lit(1))
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    def add(items: Column, line: Column) -> Column:
        joined = F.concat(F.slice(items, 1, F.greatest(F.lit(0), F.size(items) - 1)), F.array(F.concat_ws(" ", F.try_element_at(items, F.lit(-1)), F.trim(line))))
        return (
            F.when(line.rlike(LIST_ITEM), F.array_append(items, without_emphasis(F.regexp_extract(line, LIST_ITEM, 1))))
            .when((F.size(items) > 0) & ~F.ltrim(line).startswith("#"), joined)
            .otherwise(items)
        )

    return headed.where(F.col("piece").rlike(DELIVERABLES)).select("path", "id", F.aggregate(lines, F.array().cast("array<string>"), add).alias("deliverables"))


def prompts(docs: DataFrame) -> DataFrame:
    """(path, id, name, summary, review_required, review_note, tech, wave, wave_title, timeline, deliverables), the first row of an id."""
    groups = ["id", "name", "summary", "review", "tech"]
    found = docs.select("path", F.posexplode(_matches(F.col("text"), PLAN_ROW, groups)).alias("at", "p"))
    first = found.groupBy("path", F.col("p.id").alias("id")).agg(F.min_by("p", "at").alias("p"))
    note = review_note(F.col("p.review"))
    rows = first.select("path", "id", *[without_emphasis(F.col(f"p.{c}")).alias(c) for c in ("name", "summary")], note["required"].alias("review_required"), note["note"].alias("review_note"), parts_of(without_emphasis(F.col("p.tech"))).alias("tech"))
    held = waves(docs).select("path", F.explode("prompt_ids").alias("id"), "wave", F.col("title").alias("wave_title"), "timeline").groupBy("path", "id").agg(F.min_by(F.struct("wave", "wave_title", "timeline"), "wave").alias("w"))
    joined = rows.join(held, ["path", "id"], "left").join(deliverables(docs), ["path", "id"], "left")
    return joined.select(
        *rows.columns,
        F.coalesce("w.wave", F.lit(-1)).alias("wave"),
        F.coalesce("w.wave_title", F.lit(UNASSIGNED)).alias("wave_title"),
        F.coalesce("w.timeline", F.lit(NOT_STATED)).alias("timeline"),
        F.coalesce("deliverables", F.array().cast("array<string>")).alias("deliverables"),
    )
