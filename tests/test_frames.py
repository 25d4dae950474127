"""Frames by index, gray images, sizes that do not divide, dense flow, digests of large files."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolworks.operators import frames as operators
from spoolworks.sources import files, frames


@pytest.fixture(scope="module")
def clips(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('clips')}"
    draw = np.random.default_rng(1)
    rows = [(c, n, bytes(draw.integers(0, 256, 6).astype(np.uint8))) for c in ("a", "b c", "é") for n in range(10)]
    given = [*rows, ("a", 100, None), (None, 0, b"x" * 6)]
    made = frames.write_gray(spark.createDataFrame(given, "clip string, frame long, pixels binary").orderBy(F.rand(3)), folder)
    return {r.clip: r for r in made.collect()}, {(c, n): p for c, n, p in rows}


def test_frames_are_written_in_order(clips):
    made, pixels = clips
    assert set(made) == {"a", "b c", "é"}
    for name, r in made.items():
        with open(files.local_path(r.path), "rb") as handle:
            assert handle.read() == b"".join(pixels[name, n] for n in range(10))
        assert (r.frames, r.bytes) == (10, 60)
        assert [f for f in os.listdir(os.path.dirname(files.local_path(r.path))) if f.startswith(".")] == []


def test_frames_are_read_by_index(spark, clips):
    made, pixels = clips
    path = {c: r.path for c, r in made.items()}
    asked = [(path[c], n, c) for c in made for n in (3, 0, 9, 3, 10, -1, 5_000_000)] + [("/nowhere/x.gray", 0, "gone"), (None, 1, None), (path["a"], None, "a")]
    wanted = spark.createDataFrame(asked, "path string, frame long, tag string")
    found = frames.frames_at(wanted, 2, 3)
    assert found.columns == ["path", "frame", "tag", "pixels", "reading"]
    want = [(p, n, t, pixels.get((t, n)) if p else None, "no_file" if p is None or p.startswith("/nowhere") else "readable" if (t, n) in pixels else "no_frame") for p, n, t in asked]
    assert sorted(str((r.path, r.frame, r.tag, r.pixels and bytes(r.pixels), r.reading)) for r in found.collect()) == sorted(map(str, want))
    assert frames.frames_at(wanted.limit(0), 2, 3).count() == 0


def test_only_wanted_frames_are_read(spark, tmp_path):
    """A sparse file of 3 GB: its last frame comes at once."""
    path = tmp_path / "long.gray"
    with open(path, "wb") as handle:
        handle.truncate(3 << 30)
        handle.seek((3 << 30) - 4)
        handle.write(b"\x01\x02\x03\x04")
    wanted = spark.createDataFrame([(str(path), (3 << 28) - 1), (str(path), 3 << 28)], "path string, frame long")
    assert {r.frame: (r.pixels, r.reading) for r in frames.frames_at(wanted, 2, 2).collect()} == {(3 << 28) - 1: (b"\x01\x02\x03\x04", "readable"), 3 << 28: (None, "no_frame")}


def test_unreadable_files_have_a_name(spark, tmp_path):
    with pytest.raises(Exception, match="UnreadableFile"):
        frames.frames_at(spark.createDataFrame([(str(tmp_path), 0)], "path string, frame long"), 2, 2).collect()
    with pytest.raises(files.UnreadableFile, match="s3"):
        files.local_path("s3://bucket/x")
    assert files.local_path("file:///a%20b/c") == "/a b/c" and files.local_path("/a%20b") == "/a%20b"


def test_gray_images(spark):
    gray = b"P5\n# note\n3 2\n255\n" + bytes(range(6))
    colour = b"P6 2 1 255\n" + bytes([255, 0, 0, 10, 20, 30])
    cases = {"gray": (gray, (2, 3, bytes(range(6)))), "colour": (colour, (1, 2, bytes([76, 18]))), "small": (b"P5 2 1 15 \x00\x0f", (1, 2, b"\x00\xff")), "more": (gray + b"tail", (2, 3, bytes(range(6))))}
    bad = {"null": None, "empty": b"", "short": gray[:-1], "text": b"P2 1 1 255 7", "jpeg": b"\xff\xd8\xff", "wide": b"P5 0 1 255 ", "deep": b"P5 1 1 65535 \x00\x00"}
    rows = [(k, v[0], 1) for k, v in cases.items()] + [(k, v, 2) for k, v in bad.items()]
    found = {r.name: r for r in frames.gray_images(spark.createDataFrame(rows, "name string, content binary, `height of` int")).collect()}
    for k, (_, want) in cases.items():
        assert (found[k].height, found[k].width, bytes(found[k].pixels), found[k].reading) == (*want, "readable")
    assert all((found[k].height, found[k].pixels, found[k].reading) == (None, None, "no_image") for k in bad)


def test_area_resized(spark):
    draw = np.random.default_rng(2)
    one = draw.random((6, 10))
    for to in ((3, 5), (6, 10), (1, 1), (4, 7), (9, 13)):
        # The exact mean over a grid fine enough for both sizes.
        fine = np.kron(one, np.ones((to[0], to[1])))
        want = fine.reshape(to[0], 6, to[1], 10).mean(axis=(1, 3))
        rows = [(1, one.ravel().tolist()), (2, None), (3, [1.0])]
        found = {r.i: r.x for r in spark.createDataFrame(rows, "i int, f array<double>").select("i", operators.area_resized(6, 10, *to)("f").alias("x")).collect()}
        assert np.allclose(np.reshape(found[1], to), want) and found[2] is None and found[3] is None
    assert [operators.scaled_height(*x) for x in ((720, 1280, 160), (1, 4000, 160), (1080, 1920, 160), (3, 320, 160))] == [90, 1, 90, 2]


def textured(shift, size=64, seed=3):
    """A smooth random texture, and the same moved by `shift` (right, down), from its waves."""
    draw = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size].astype(float)
    waves = [(draw.uniform(-0.4, 0.4), draw.uniform(-0.4, 0.4), draw.uniform(0, 6.28), draw.uniform(0.5, 1)) for _ in range(12)]
    at = lambda dx, dy: sum(a * np.cos(kx * (x - dx) + ky * (y - dy) + p) for kx, ky, p, a in waves)
    return at(0, 0), at(*shift)


@pytest.mark.parametrize("shift", [(0.0, 0.0), (1.0, 0.0), (0.0, -0.5), (2.5, 1.0), (-4.0, 3.0), (6.0, -5.0)])
def test_dense_flow_recovers_shifts(shift):
    a, b = textured(shift)
    u, v = operators.dense_flow(np.stack([a, a]), np.stack([b, a]))
    inner = np.s_[0, 8:-8, 8:-8]
    assert abs(np.median(u[inner]) - shift[0]) < 0.15 and abs(np.median(v[inner]) - shift[1]) < 0.15
    assert abs(np.hypot(u, v)[inner].mean() - np.hypot(*shift)) < 0.1 * np.hypot(*shift) + 0.05
    assert np.hypot(u[1], v[1]).max() < 1e-6


def test_flow_of_odd_sizes_and_flat_images():
    flat = np.ones((3, 5, 9))
    assert np.hypot(*operators.dense_flow(flat, flat * 7)).max() < 1e-6
    a, b = textured((1.5, 0.5), size=41)
    u, v = operators.dense_flow(a[None, :33], b[None, :33])
    assert u.shape == (1, 33, 41) and abs(np.median(u) - 1.5) < 0.2


def test_flow_motion_of_clips(spark):
    """Unreadable frames are left out and their neighbours meet; a clip of one frame, or none that can be read, does not move."""
    a, b = (x.ravel().tolist() for x in textured((2.0, 0.0), size=32))
    rows = [("moves", 0, a), ("moves", 1, None), ("moves", 2, [1.0]), ("moves", 3, b), ("still", 0, a), ("still", 1, a), ("one", 0, a), ("none", 0, None), (None, 0, a), (None, 1, b)]
    found = {r.clip: r.motion for r in operators.flow_motion(spark.createDataFrame(rows, "clip string, n int, f array<double>"), "clip", "n", "f", 32, 32).collect()}
    assert set(found) == {"moves", "still", "one", "none", None}
    assert abs(found["moves"] - 2) < 0.4 and abs(found[None] - found["moves"]) < 1e-9 and found["still"] < 1e-6 and found["one"] == found["none"] == 0.0


def test_digests_by_rows_and_by_blocks(spark, tmp_path):
    texts = {"a.bin": b"x" * 10, "b c.bin": os.urandom(3000), "sub/é.bin": b"\x00" * 1000}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {(n.rpartition("/")[2], len(d), hashlib.sha256(d).hexdigest()) for n, d in texts.items()}
    for whole in (1 << 20, 1500, 0):
        assert {(r.name, r.length, r.sha256) for r in files.digests(spark, f"file://{tmp_path}", whole=whole, block=700).collect()} == want


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """Slow: 2.2 GB through the digest, more than a binary column can hold."""
    size = (2 << 30) + (200 << 20)
    with open(tmp_path / "large.bin", "wb") as handle:
        handle.truncate(size)
    want, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(zeros)
    found = files.digests(spark, f"file://{tmp_path}").collect()
    assert [(r.length, r.sha256) for r in found] == [(size, want.hexdigest())]


def test_stored_files_of_all_tables(spark, sf):
    from spoolworks.plans.registry import QUERIES

    found = {r.name: r for r in QUERIES["stored_files"](spark, sf).collect()}
    assert len(found) == 14
    for name in os.listdir(sf):
        with open(f"{sf}/{name}", "rb") as handle:
            assert found[name].sha256 == hashlib.sha256(handle.read()).hexdigest()
