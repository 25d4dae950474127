"""Chunked uploads: offsets that must continue, finalize, abort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolworks.streaming.folds import fold, stream_fold

OUT = "upload_id long, seq long, action string, outcome string, received long, status string"
STATE = "received long, status string"


def resume_offset(bytes_received: Column, file_size: Column) -> Column:
    """Where a transfer goes on: no further than what is recorded or on disk."""
    return F.least(bytes_received, file_size)


def step(state: dict[str, Any] | None, event: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """One action on an upload of `declared` bytes: chunk (offset, length), finalize, abort.

    A chunk counts only at the offset received so far and only up to the declared size. Finalize of a complete upload
    completes it; again, it says duplicate; before, incomplete, without a change. Completed and aborted stay.
    """
    now = dict(state or {"received": 0, "status": "in_progress"})
    action, outcome = event["action"], "closed"
    if action == "finalize" and now["status"] == "completed":
        outcome = "duplicate"
    elif now["status"] == "in_progress":
        if action == "chunk":
            if event["offset"] != now["received"]:
                outcome = "wrong_offset"
            elif event["offset"] + event["length"] > event["declared"]:
                outcome = "too_large"
            else:
                now["received"], outcome = int(event["offset"] + event["length"]), "accepted"
        elif action == "finalize":
            outcome = "completed" if now["received"] == event["declared"] else "incomplete"
            if outcome == "completed":
                now["status"] = "completed"
        else:
            now["status"], outcome = "aborted", "aborted"
    return now, {"upload_id": event["upload_id"], "seq": event["seq"], "action": action, "outcome": outcome, "received": now["received"], "status": now["status"]}


def run_batch(actions: DataFrame) -> DataFrame:
    """actions (upload_id, seq, action, offset, length, declared), each answered in the order of seq."""
    return fold(actions.select("upload_id", "seq", "action", "offset", "length", "declared"), "upload_id", ["seq"], step, OUT)


def run_stream(actions: DataFrame) -> DataFrame:
    return stream_fold(actions.select("upload_id", "seq", "action", "offset", "length", "declared"), "upload_id", ["seq"], step, OUT, STATE)


def stored_digests(chunks: DataFrame) -> DataFrame:
    """(upload_id, bytes, sha256) of what each upload holds after its chunks (upload_id, seq, offset, body, declared).

    A body counts whole or not at all, by the rule of `step`: what a broken request still brought is its body. Those that count go
    on without a gap in the order of seq, so bodies are shuffled once and stream past the offset and the digest, and an upload may be larger
    than a task's memory. Chunks without an upload, a place or a body are none; an upload none of whose chunks count has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, digest = None, None, None

        def ended(rows: list[tuple]) -> pa.RecordBatch:
            ids, sizes, hexes = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hexes, pa.string())], ["upload_id", "bytes", "sha256"])

        for batch in batches:
            done = []
            for upload, seq, offset, body, declared in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), batch.column(4).to_pylist(), strict=True):
                if upload != at:
                    if digest:
                        done.append((at, state["received"], digest.hexdigest()))
                    at, state, digest = upload, None, None
                view = body.as_buffer()
                state, answer = step(state, {"upload_id": upload, "seq": seq, "action": "chunk", "offset": offset, "length": len(view), "declared": declared})
                if answer["outcome"] == "accepted":
                    digest = digest or hashlib.sha256()
                    digest.update(view)
            yield ended(done)
        if digest:
            yield ended([(at, state["received"], digest.hexdigest())])

    known = chunks.where("upload_id IS NOT NULL AND seq IS NOT NULL AND offset IS NOT NULL AND body IS NOT NULL AND declared IS NOT NULL")
    longs = [F.col(c).cast("long").alias(c) for c in ("upload_id", "seq", "offset")]
    ordered = known.select(*longs, F.col("body").cast("binary").alias("body"), F.col("declared").cast("long").alias("declared"))
    return ordered.repartition("upload_id").sortWithinPartitions("upload_id", "seq").mapInArrow(run, "upload_id long, bytes long, sha256 string")
