"""Job handlers by type: a job is a DataFrame in and a DataFrame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Handler = Callable[[DataFrame], DataFrame]
# Fixed value: the cause of a job that nobody handles.
UNSUPPORTED = "this job type is not supported by the engine"


class Handlers:
    def __init__(self, **known: Handler):
        self.known = dict(known)

    def register(self, job_type: str, handler: Handler) -> None:
        self.known[job_type] = handler

    def run(self, job_type: str, df: DataFrame) -> DataFrame:
        if job_type not in self.known:
            raise LookupError(UNSUPPORTED)
        return self.known[job_type](df)
