"""Frames and images of gray pixels in files: written from rows, read by index, without a pass over what is not wanted.

A raw gray file is its frames one after another, a byte a pixel, row by row. Images are Netpbm files, binary gray (P5) or binary
colour (P6). Both are read where tasks run, so they must be in a file system that tasks have mounted.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolworks.sources.files import UnreadableFile, local_path

# The weights of red, green and blue in luma, and the head of a Netpbm file.
LUMA = np.array([0.299, 0.587, 0.114])
NETPBM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
READABLE, NO_FILE, NO_FRAME, NO_IMAGE = "readable", "no_file", "no_frame", "no_image"


def write_gray(frames: DataFrame, folder: str, clip: str = "clip", order: str = "frame", pixels: str = "pixels") -> DataFrame:
    """(clip, path, frames, bytes) of the raw gray files written below `folder`, one a clip, its frames in order.

    `pixels` is binary, a byte a pixel; nulls are left out. A clip streams into its file, which gets its name when it is whole, so a
    task that is run again replaces it and no half-written file is seen. Clips go over tasks by their hash, a clip is one task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, done, made = None, None, [], [0, 0]

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                path = f"{local_path(folder)}/clip-{at}.gray"
                os.replace(out.name, path)
                done.append((at, f"{folder}/clip-{at}.gray", *made))
                out = None

        def table() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["clip", "path", "frames", "bytes"])
            done.clear()
            return batch

        os.makedirs(local_path(folder), exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != at or out is None:
                    close()
                    at, made = name, [0, 0]
                    out = open(f"{local_path(folder)}/.clip-{name}.{os.getpid()}", "wb")  # noqa: SIM115  closed by close()
                out.write(data)
                made[0], made[1] = made[0] + 1, made[1] + len(data)
            yield table()
        close()
        yield table()

    rows = frames.where(F.col(clip).isNotNull() & F.col(pixels).isNotNull()).select(F.col(clip).cast("string").alias("clip"), F.col(order).alias("frame"), F.col(pixels).alias("pixels"))
    dealt = rows.repartition("clip").sortWithinPartitions("clip", "frame").select("clip", "pixels")
    return dealt.mapInArrow(run, "clip string, path string, frames long, bytes long")


def frames_at(wanted: DataFrame, height: int, width: int, path: str = "path", frame: str = "frame") -> DataFrame:
    """`wanted` (path, frame, ...) with `pixels`, the bytes of that frame of that raw gray file, and `reading`.

    A file is opened once in a task and sought from frame to frame in their order, so what is read is what is wanted, whatever the
    length of the file. `reading` is `readable`, `no_frame` (before the first, past the last whole frame, or null) or `no_file` (not there,
    or null); pixels are null in these cases. Rows that ask for the same frame are answered each. A file that is there but can't be
    read is an `UnreadableFile`. Files go over tasks in stretches of `frame`, so one long file is many tasks' work.
    """
    size = height * width
    names = [*wanted.columns, "pixels", "reading"]
    at, index = wanted.columns.index(path), wanted.columns.index(frame)

    def read(handle, number: int | None) -> bytes | None:
        if number is None or number < 0:
            return None
        handle.seek(number * size)
        data = handle.read(size)
        return data if len(data) == size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, handle = None, None
        try:
            for batch in batches:
                pixels, reading = [], []
                for name, number in zip(batch.column(at).to_pylist(), batch.column(index).to_pylist(), strict=True):
                    if name != held or handle is None:
                        if handle is not None:
                            handle.close()
                        held, handle = name, None
                        try:
                            handle = open(local_path(name), "rb", buffering=0) if name is not None else None  # noqa: SIM115
                        except FileNotFoundError:
                            pass
                        except OSError as error:
                            raise UnreadableFile(f"{name}: {error.strerror}") from error
                    data = read(handle, number) if handle is not None else None
                    pixels.append(data)
                    reading.append(NO_FILE if handle is None else READABLE if data is not None else NO_FRAME)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pixels, pa.binary()), pa.array(reading, pa.string())], names)
        finally:
            if handle is not None:
                handle.close()

    stretch = F.floor(F.col(frame) / 4096)
    dealt = wanted.withColumn("__stretch", stretch).repartition(F.col(path), "__stretch").sortWithinPartitions(path, frame).drop("__stretch")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, pixels binary, reading string")


def gray_image(data: bytes | None) -> tuple[int, int, bytes] | None:
    """(height, width, gray bytes) of a binary Netpbm image; colour goes by luma, rounded half up. None for anything else, or a part."""
    head = NETPBM.match(data) if data else None
    if head is None:
        return None
    width, height, most = (int(head[i]) for i in (2, 3, 4))
    depth = 1 if head[1] == b"5" else 3
    if not width or not height or not 0 < most < 256 or len(data) < head.end() + width * height * depth:
        return None
    values = np.frombuffer(data, np.uint8, width * height * depth, head.end())
    if most != 255:
        values = np.minimum(255, (values.astype(np.int32) * 255 + most // 2) // most).astype(np.uint8)
    if depth == 3:
        values = np.floor(values.reshape(-1, 3) @ LUMA + 0.5).astype(np.uint8)
    return height, width, values.tobytes()


def gray_images(images: DataFrame, content: str = "content") -> DataFrame:
    """`images` (content, ...) with `height`, `width`, `pixels` and `reading`: `readable`, or `no_image` with nulls for what is no binary
    Netpbm image or ends too soon. `content` is the whole file, as Spark's binaryFile gives it."""
    at, names = images.columns.index(content), [*images.columns, "height", "width", "pixels", "reading"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gray_image(x) for x in batch.column(at).to_pylist()]
            parts = [[f and f[i] for f in found] for i in range(3)]
            state = [READABLE if f else NO_IMAGE for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts[0], pa.int32()), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.binary()), pa.array(state, pa.string())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)
    return images.mapInArrow(run, f"{kinds}, height int, width int, pixels binary, reading string")
