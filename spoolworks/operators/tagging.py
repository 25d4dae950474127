"""Cache-first tagging of scenes under a request budget, and the reply parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.functions.timing import BACKOFF_BASE, BACKOFF_JITTER, BACKOFF_MOST

# The fields of a reply.
TAGS = ["content_type", "exercise_guess", "environment", "lighting_quality", "lighting_temperature", "lighting_direction", "energy_level", "aesthetic_notes"]


def parsed_reply(reply: Column) -> Column:
    """The eight tags of a model reply (JSON text whose parts hold JSON text); null if it is no object, a tag is not
    text, or anything on the way has another shape. An object without tags is a result with null tags."""
    parts = F.from_json(F.get_json_object(reply, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return cached_tags(F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), ""))


def cached_tags(raw: Column) -> Column:
    """The tags of a cache row's JSON; null for a null answer, and for a row that is no JSON or no longer has the shape."""
    document = F.try_parse_json(raw)
    kind = F.schema_of_variant(document)
    well = kind.startswith("OBJECT<")
    for tag in TAGS:
        of = F.schema_of_variant(F.try_variant_get(document, f"$.{tag}", "variant"))
        well = well & (of.isNull() | of.isin("STRING", "VOID"))
    tags = F.struct(*[F.try_variant_get(document, f"$.{t}", "string").alias(t) for t in TAGS])
    return F.when(F.coalesce(well, F.lit(False)), tags)


GRANTS = "key string, request_id long, at double, day string, granted boolean, tokens double, day_count long"


def token_bucket(requests: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """Each request (key, request_id, at in seconds, day) with whether its key's budget grants it.

    A bucket starts full with `per_minute` tokens and refills evenly; a day grants `per_day` at most, and the count
    starts anew when the day changes. A refused request spends nothing. The rule hangs on the tokens left by the last
    request, so each key is folded in order of (at, request_id); state and rows stream, and a key is not held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last, day, count = None, 0.0, 0.0, None, 0
        for batch in batches:
            granted, left, counts = [], [], []
            for k, at, today in zip(batch["key"], batch["at"], batch["day"], strict=True):
                if k != key:
                    key, tokens, last, day, count = k, float(per_minute), at, None, 0
                if today != day:
                    day, count = today, 0
                ok = count < per_day
                if ok:
                    tokens = min(float(per_minute), tokens + max(0.0, at - last) * per_minute / 60.0)
                    last = at
                    ok = tokens >= 1.0
                if ok:
                    tokens, count = tokens - 1.0, count + 1
                granted.append(ok)
                left.append(tokens)
                counts.append(count)
            yield batch.assign(granted=granted, tokens=left, day_count=counts)

    dealt = requests.select("key", "request_id", "at", "day").repartition("key").sortWithinPartitions("key", "at", "request_id")
    return dealt.mapInPandas(run, GRANTS)


SENDS = "key string, scene_id long, request long, attempt int, again boolean, at double, granted boolean, status int, verdict string, waited double, tokens double, day_count long"
#: How a call ends, or null: a usable reply; two that are not; no token; a refusal that stays; the last try.
ANSWERED, UNUSABLE, REFUSED, PERMANENT, GIVEN_UP = "reply", "unusable", "refused", "permanent", "gave_up"


class Bucket:
    """The budget of one key: `per_minute` tokens that refill evenly, `per_day` requests a UTC day."""

    def __init__(self, per_minute: int, per_day: int, at: float):
        self.per_minute, self.per_day = per_minute, per_day
        self.tokens, self.last, self.day, self.count = float(per_minute), at, None, 0

    def take(self, at: float) -> bool:
        today = at // 86400
        if today != self.day:
            self.day, self.count = today, 0
        if self.count >= self.per_day:
            return False
        self.tokens = min(float(self.per_minute), self.tokens + max(0.0, at - self.last) * self.per_minute / 60.0)
        self.last = at
        if self.tokens < 1.0:
            return False
        self.tokens, self.count = self.tokens - 1.0, self.count + 1
        return True


class Call:
    """One scene's call. It asks for a token before each request; an answer below 400 that can't be used is asked for once more in the
    same try, without a wait; other failures are tried again after a wait, up to `most` tries, but a 4xx other than 429."""

    def __init__(self, most: int, jitter: float):
        self.most, self.jitter = most, jitter
        self.attempt, self.again, self.waited = 0, False, 0.0

    def told(self, granted: bool, status: int | None, usable: bool) -> tuple[str | None, float]:
        """(how the call ends, or None; seconds until the next request)."""
        if not granted:
            return REFUSED, 0.0
        if status is not None and status < 400:
            if usable:
                return ANSWERED, 0.0
            if self.again:
                return UNUSABLE, 0.0
            self.again = True
            return None, 0.0
        if status is not None and status < 500 and status != 429:
            return PERMANENT, 0.0
        if self.attempt + 1 >= self.most:
            return GIVEN_UP, 0.0
        wait = min(BACKOFF_MOST, BACKOFF_BASE * 2.0**self.attempt) * (1 + BACKOFF_JITTER * self.jitter)
        self.attempt, self.again, self.waited = self.attempt + 1, False, self.waited + wait
        return None, wait


def requests_sent(replies: DataFrame, per_minute: int, per_day: int, most: int = 3) -> DataFrame:
    """Every request that calls make or are refused, in order: the log behind a disclosure of what was sent.

    replies (key, scene_id, at, request from 0, status, usable, jitter): what each scene's next request would be answered,
    `status` null where no response comes, `usable` whether it parses; `at` is when a scene is due, in UTC seconds, `jitter` 0 to 1 the draw of its
    waits. Scenes of a key are called one after another by (at, scene_id), each when it is due and the one before is over, and
    share a token bucket. A request beyond the rows given gets no response; rows beyond the end of a call are not
    asked for. A null usable counts as false, a null jitter as 0.

    Two machines make one fold: whether a request goes out hangs on the tokens left, when the next one is hangs on the
    reply. A key streams past them in order and is not held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = scene = bucket = call = None
        clock, number, over, out = 0.0, 0, True, []

        def ask(status: int | None, usable: bool) -> None:
            nonlocal clock, number, over
            attempt, again = call.attempt, call.again
            granted = bucket.take(clock)
            verdict, wait = call.told(granted, status, usable)
            out.append((key, scene, number, attempt, again, clock, granted, status if granted else None, verdict, call.waited, bucket.tokens, bucket.count))
            clock, number, over = clock + wait, number + 1, verdict is not None

        def finish() -> None:
            while not over:
                ask(None, False)

        def table() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=[c.split()[0] for c in SENDS.split(", ")])
            out.clear()
            return made.astype({"status": "Int32"})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.key != key or row.scene_id != scene or bucket is None:
                    finish()
                    if row.key != key or bucket is None:
                        key, bucket, clock = row.key, Bucket(per_minute, per_day, row.at), row.at
                    scene, call, number, over = row.scene_id, Call(most, 0.0 if pd.isna(row.jitter) else row.jitter), 0, False
                    clock = max(clock, row.at)
                while not over and number < row.request:
                    ask(None, False)
                if not over:
                    ask(None if pd.isna(row.status) else int(row.status), row.usable is not None and not pd.isna(row.usable) and bool(row.usable))
            if out:
                yield table()
        finish()
        if out:
            yield table()

    dealt = replies.select(F.col("key").cast("string"), F.col("scene_id").cast("long"), F.col("at").cast("double"), F.col("request").cast("long"), F.col("status").cast("int"), "usable", F.col("jitter").cast("double"))
    dealt = dealt.where("key IS NOT NULL AND scene_id IS NOT NULL AND at IS NOT NULL AND request IS NOT NULL")
    return dealt.repartition("key").sortWithinPartitions("key", "at", "scene_id", "request").mapInPandas(run, SENDS)


def call_outcomes(sent: DataFrame) -> DataFrame:
    """(key, scene_id, source, cached, tries, tokens, waited, verdict) of each call in what requests_sent() gives.

    `source` is `api` if the service answered, be it with nothing usable, else `degraded`. Only the former is `cached`: a usable reply,
    or null after two that were not, as asking again would not change it. `tries` counts waits and the first try.
    """
    ended = F.max_by("verdict", "request")
    found = sent.groupBy("key", "scene_id").agg(ended.alias("verdict"), (F.max("attempt") + 1).alias("tries"), F.count_if("granted").alias("tokens"), F.max("waited").alias("waited"))
    reached = F.col("verdict").isin(ANSWERED, UNUSABLE)
    return found.select("key", "scene_id", F.when(reached, "api").otherwise("degraded").alias("source"), reached.alias("cached"), "tries", "tokens", "waited", "verdict")


def cache_first(scenes: DataFrame, cache: DataFrame, granted: DataFrame, call: Callable[[pd.Series], pd.Series], context: str) -> tuple[DataFrame, DataFrame]:
    """(tags of every scene with their source, the rows to add to the cache).

    scenes (scene_id, `context`), cache (scene_id, tag), granted (scene_id) of misses that the budget lets through.
    `call` maps contexts to replies, null where the round trip failed; such scenes and refused ones are `degraded`
    and are not cached. A hit costs no call.
    """
    hits = scenes.join(cache.select("scene_id", "tag"), "scene_id").select("scene_id", "tag", F.lit("cache").alias("source"))
    misses = scenes.join(cache.select("scene_id"), "scene_id", "left_anti")
    ask = F.pandas_udf(call, T.StringType())
    asked = misses.join(granted.select("scene_id").distinct(), "scene_id").select("scene_id", ask(F.col(context)).alias("tag"))
    refused = misses.join(granted.select("scene_id"), "scene_id", "left_anti").select("scene_id", F.lit(None).cast("string").alias("tag"), F.lit("degraded").alias("source"))
    answered = asked.select("scene_id", "tag", F.when(F.col("tag").isNull(), "degraded").otherwise("api").alias("source"))
    return hits.unionByName(answered).unionByName(refused), answered.where("source = 'api'").select("scene_id", "tag")
