"""Calls under a budget: a plain simulation, one case for each way a call ends, and cached answers."""

import random

import pytest
from pyspark.sql import functions as F

from spoolworks.operators import catalog, tagging

SCHEMA = "key string, scene_id long, at double, request long, status int, usable boolean, jitter double"


def outcomes(spark, rows, per_minute=100, per_day=1000):
    found = tagging.call_outcomes(tagging.requests_sent(spark.createDataFrame(rows, SCHEMA), per_minute, per_day)).collect()
    return {r.scene_id: (r.source, r.cached, r.tries, r.tokens, round(r.waited, 6), r.verdict) for r in found}


def test_each_end_of_a_call(spark):
    cases = {
        1: [(200, True)],
        2: [(200, False), (200, True)],  # asked once more in the same try, at once
        3: [(200, False), (200, False), (200, True)],  # a null answer, and cached
        4: [(302, False), (302, False)],
        5: [(404, True), (200, True)],
        6: [(429, True), (200, True)],
        7: [(503, True), (None, True), (500, True), (200, True)],
        8: [(200, False), (503, True), (200, False), (200, True)],  # a failure after an unusable reply begins a new try
        9: [],
        10: [(None, True), (302, True)],
        11: [(500, None), (200, None), (200, None)],
        12: [(429, True), (200, False), (400, True)],
    }
    rows = [("k", s, 100.0 * s, n, status, usable, 0.0) for s, given in cases.items() for n, (status, usable) in enumerate(given)]
    rows += [("k", 9, 900.0, 2, 200, True, None), (None, 50, 1.0, 0, 200, True, 0.0), ("k", None, 1.0, 0, 200, True, 0.0)]
    assert outcomes(spark, rows) == {
        1: ("api", True, 1, 1, 0.0, "reply"),
        2: ("api", True, 1, 2, 0.0, "reply"),
        3: ("api", True, 1, 2, 0.0, "unusable"),
        4: ("api", True, 1, 2, 0.0, "unusable"),
        5: ("degraded", False, 1, 1, 0.0, "permanent"),
        6: ("api", True, 2, 2, 0.2, "reply"),
        7: ("degraded", False, 3, 3, 0.6, "gave_up"),
        8: ("api", True, 2, 4, 0.2, "reply"),
        9: ("api", True, 3, 3, 0.6, "reply"),  # no rows for two requests: no response came
        10: ("api", True, 2, 2, 0.2, "reply"),
        11: ("api", True, 2, 3, 0.2, "unusable"),
        12: ("degraded", False, 2, 3, 0.2, "permanent"),
    }


def test_refusals_come_from_the_tokens_left(spark):
    """Three tokens and one more every 20 s: an unusable reply takes two of them, a wait refills a little, a day's budget ends."""
    rows = [("k", 1, 0.0, 0, 200, False, 0.0), ("k", 1, 0.0, 1, 200, True, 0.0), ("k", 2, 1.0, 0, 503, False, 0.0), ("k", 2, 1.0, 1, 200, True, 0.0), ("k", 3, 21.0, 0, 200, True, 0.0)]
    assert outcomes(spark, rows, per_minute=3) == {1: ("api", True, 1, 2, 0.0, "reply"), 2: ("degraded", False, 2, 1, 0.2, "refused"), 3: ("api", True, 1, 1, 0.0, "reply")}
    day = [("k", s, 1000.0 * s, 0, 200, True, 0.0) for s in range(1, 91)] + [("other", 500, 5.0, 0, 200, True, 0.0)]
    found = outcomes(spark, day, per_day=2)
    assert [s for s, r in found.items() if r[0] == "api"] and sorted(s for s, r in found.items() if r[0] == "api") == [1, 2, 87, 88, 500]


def simulate(rows, per_minute, per_day):
    """One call after another with a clock, written out."""
    log, keys = [], {}
    for r in rows:
        keys.setdefault(r[0], {}).setdefault((r[2], r[1]), {})[r[3]] = r
    for key, scenes in keys.items():
        tokens, day, count = float(per_minute), None, 0
        clock = last = min(scenes)[0]
        for (at, scene), given in sorted(scenes.items()):
            clock, n = max(clock, at), 0
            jitter = next(iter(given.values()))[6]
            for attempt in range(3):
                end = None
                for again in (False, True):
                    if clock // 86400 != day:
                        day, count = clock // 86400, 0
                    ok = count < per_day
                    if ok:
                        tokens, last = min(per_minute, tokens + (clock - last) * per_minute / 60), clock
                        ok = tokens >= 1
                    if ok:
                        tokens, count = tokens - 1, count + 1
                    status, usable = given[n][4:6] if n in given else (None, False)
                    answered = ok and status is not None and status < 400
                    end = "refused" if not ok else ("reply" if usable else "unusable" if again else None) if answered else "permanent" if status is not None and status < 500 and status != 429 else "gave_up" if attempt == 2 else None
                    log.append((key, scene, n, attempt, again, round(clock, 6), ok, status if ok else None, end))
                    n += 1
                    if end or not answered:
                        break
                if end:
                    break
                clock += min(2.0, 0.2 * 2**attempt) * (1 + 0.5 * jitter)
    return log


@pytest.mark.parametrize(("seed", "per_minute", "per_day"), [(0, 3, 20), (1, 1, 1000), (2, 50, 7)])
def test_against_a_plain_simulation(spark, seed, per_minute, per_day):
    draw = random.Random(seed)
    rows = []
    for s in range(200):
        key, at, jitter = draw.choice("ab"), float(draw.randint(0, 200_000 if seed == 2 else 2000)), draw.choice([0.0, 0.5, 1.0])
        rows += [(key, s, at, n, draw.choice([200, 200, 204, 302, 400, 429, 500, 503, None]), draw.random() < 0.4, jitter) for n in range(6)]
    sent = tagging.requests_sent(spark.createDataFrame(rows, SCHEMA), per_minute, per_day)
    found = [(r.key, r.scene_id, r.request, r.attempt, r.again, round(r.at, 6), r.granted, r.status, r.verdict) for r in sent.collect()]
    assert sorted(map(str, found)) == sorted(map(str, simulate(rows, per_minute, per_day)))
    assert tagging.requests_sent(spark.createDataFrame([], SCHEMA), 1, 1).count() == 0


def test_cached_answers(spark):
    rows = [(1, None), (2, "{"), (3, "[1]"), (4, '{"content_type": 5}'), (5, "{}"), (6, '{"content_type": "a", "more": [1]}'), (7, ""), (8, '{"energy_level": null}'), (9, "null"), (10, '"x"')]
    cache = spark.createDataFrame([(i, 1, i * 10, raw) for i, raw in rows], "scene_id long, prompt_version int, tag long, raw_response_json string")
    scenes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    found = {r.id: r.tags and r.tags.tag for r in catalog.tagged(scenes, cache, F.lit(1), ["tag"]).collect()}
    assert found == dict.fromkeys(range(12)) | {5: 50, 6: 60, 8: 80}
