"""Settings of many scopes: lines of environment files and of the environment, put over defaults and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each setting with its kind and default; bounds of numbers; the words a setting may be.
SETTINGS = {
    "data_dir": ("path", "data"),
    "engine_host": ("text", "127.0.0.1"),
    "engine_port": ("number", "8000"),
    "ui_port": ("number", "3000"),
    "engine_url": ("text", "http://localhost:8000"),
    "extra_allowed_hosts": ("list", ""),
    "extra_allowed_origins": ("list", ""),
    "log_level": ("upper", "INFO"),
    "gemini_rpm_limit": ("number", "10"),
    "gemini_daily_limit": ("number", "1400"),
    "torch_device": ("lower", "auto"),
}
BOUNDS = {"engine_port": (1, 65535), "ui_port": (1, 65535), "gemini_rpm_limit": (0, None), "gemini_daily_limit": (0, None)}
WORDS = {"log_level": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), "torch_device": ("auto", "cuda", "cpu")}
LINE = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"


def assignment(line: Column) -> Column:
    """struct(name, value) of a line NAME=value, the name in lower case, one pair of quotes off; null for comments and all else."""
    value = F.regexp_replace(F.regexp_extract(line, LINE, 2), "^(?:\"(.*)\"|'(.*)')$", "$1$2")
    return F.when(line.rlike(LINE), F.struct(F.lower(F.regexp_extract(line, LINE, 1)).alias("name"), value.alias("value")))


def anchored(path: Column, root: str) -> Column:
    """A path as it is if it is absolute, else below `root`; `.` parts and doubled slashes go, `..` takes the part before with it."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), path))
    def add(parts: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))).otherwise(F.array_append(parts, part))

    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/"))


def _checked(name: Column, kind: Column, raw: Column, root: str) -> Column:
    """struct(value, problem): the value in its normal form, or null and what is wrong with it."""
    plain = F.trim(raw)
    number = F.when(plain.rlike("^[+-]?[0-9]+$"), plain.try_cast("long"))
    low, high, word = F.lit(False), F.lit(False), F.lit(False)
    for setting, (least, most) in BOUNDS.items():
        low = low | (F.lit(setting) == name) & (number < least)
        high = high | ((F.lit(setting) == name) & (number > most) if most is not None else F.lit(False))
    cased = F.when(kind == "upper", F.upper(plain)).otherwise(F.lower(plain))
    for setting, words in WORDS.items():
        word = word | (F.lit(setting) == name) & ~cased.isin(*words)
    items = F.array_join(F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != ""), ",")
    problem = (
        F.when((kind == "number") & number.isNull(), "no whole number").when((kind == "number") & low, "too small").when((kind == "number") & high, "too large")
        .when(kind.isin("upper", "lower") & word, "unknown word")
    )
    value = F.when(kind == "number", number.cast("string")).when(kind.isin("upper", "lower"), cased).when(kind == "list", items).when(kind == "path", anchored(raw, root)).otherwise(raw)
    return F.struct(F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))


def effective(lines: DataFrame, root: str = "/") -> DataFrame:
    """(scope, name, value, origin, problem): every setting of every scope in `lines` (scope, rank, place, line).

    Of the lines that set a name, those of the highest `rank` count (an environment over a file), of these the last by `place`; of
    equal places the greatest value. Names are compared without case; unknown names and lines that set nothing are passed over, and a scope whose lines all
    are has the defaults. `origin` is the rank, or null for a default. A wrong value is null and says its problem. Null scopes are one.
    """
    named = lines.withColumn("__a", assignment(F.col("line")))
    last = F.max(F.when(F.col("__a.name").isin(*SETTINGS), F.struct("rank", "place", "__a.value")))
    one = named.groupBy("scope", F.when(F.col("__a.name").isin(*SETTINGS), F.col("__a.name")).alias("name")).agg(last.alias("at"))
    # A scope has a row a setting at most, so its map is small.
    found = one.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "at")))).alias("given"))
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(d).alias("default")) for n, (k, d) in SETTINGS.items()])
    rows = found.select("scope", "given", F.explode(every).alias("s")).select("scope", "s.name", "s.kind", "s.default", F.try_element_at("given", F.col("s.name")).alias("at"))
    checked = _checked(F.col("name"), F.col("kind"), F.coalesce("at.value", "default"), root)
    return rows.withColumn("c", checked).select("scope", "name", "c.value", F.col("at.rank").alias("origin"), "c.problem")
