"""Ordered folds: one step function for each machine, run over batches in order or over a stream with state.

A batch fold repartitions by key, sorts, and streams rows past the state, so a key of any length is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict[str, Any] | None, dict[str, Any]], tuple[dict[str, Any], dict[str, Any]]]


def fold(events: DataFrame, key: str, order: list[str], step: Step, out: str) -> DataFrame:
    """A row for each event: what `step(state, event)` answers, state starting at None for each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            rows = []
            for event in batch.to_dict("records"):
                if event[key] != at:
                    at, state = event[key], None
                state, answer = step(state, event)
                rows.append(answer)
            yield pd.DataFrame(rows)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


def stream_fold(events: DataFrame, key: str, order: list[str], step: Step, out: str, state: str) -> DataFrame:
    """The same over a stream: events of a micro-batch are put in order, and state is kept between micro-batches."""
    names = [c.split()[0] for c in state.split(",")]

    def run(found: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, held.get, strict=True)) if held.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        answers = []
        for event in rows.to_dict("records"):
            now, answer = step(now, event)
            answers.append(answer)
        held.update(tuple(now[n] for n in names))
        yield pd.DataFrame(answers)

    return events.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)
