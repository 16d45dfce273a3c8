"""Image matching, PNG, drawing, aligned similarity and trees of files against brute force."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright.functions import draw, features, png, raster
from pairwright.operators import images
from pairwright.plans import image_queries
from pairwright.sources import tree

SF = "/root/testdata/sf0.001"


def mosaic(seed, cell=12, n=8):  # noqa: ANN001, ANN201
    return np.kron(np.random.default_rng(seed).integers(0, 256, (n, n)), np.ones((cell, cell))).astype(np.uint8)


def rasters(spark, named):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(k, None, None, None) if a is None else (k, a.shape[1], a.shape[0], bytearray(a.tobytes())) for k, a in named.items()], "image_id string, width int, height int, pixels binary")


@pytest.mark.parametrize("one_bit", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_hamming_matches_by_hand(spark, monkeypatch, one_bit, small):  # noqa: ANN001
    """All pairs of descriptors by hand: the nearest within the radius, and the second or just beyond it; with and without a broadcast."""
    if not small:
        monkeypatch.setattr(images, "BROADCAST_ROWS", 0)
    noise = np.random.default_rng(0)
    named = {f"m{i}": mosaic(i % 5) for i in range(9)} | {"flat": np.full((96, 96), 7, np.uint8), "tiny": np.zeros((3, 4), np.uint8), "null": None}
    named |= {f"n{i}": np.clip(mosaic(i).astype(int) + noise.integers(-6, 7, (96, 96)), 0, 255).astype(np.uint8) for i in range(4)}
    points = {k: features.keypoints(a) for k, a in named.items() if a is not None}
    points = {k: v for k, v in points.items() if len(v[0]) >= 4}
    assert "flat" not in points and "tiny" not in points
    every = images.find_keypoints(rasters(spark, named))
    got = {(r.sample_id, r.other_id): {(m.at, m.bx, m.by) for m in r.matches} for r in images.hamming_matches(every.where("image_id in ('m1', 'n2', 'n3')"), every, one_bit).collect()}
    radius, want = 31 if one_bit else 15, {}
    for a in ("m1", "n2", "n3"):
        for b in points:
            d = np.unpackbits(points[a][1][:, None] ^ points[b][1][None], axis=2).sum(2)
            hits = set()
            for i, row in enumerate(d):
                order = np.lexsort((np.arange(len(row)), row))
                first, second = row[order[0]], min(row[order[1]], radius + 1)
                if first <= radius and first < 0.75 * second:
                    hits.add((i, *points[b][0][order[0]]))
            if a != b and len(hits) >= 4:
                want[a, b] = hits
    assert got == want and ("m1", "m6") in want


def test_image_matches_find_cuts(spark):  # noqa: ANN001
    whole = {f"{i:03}": mosaic(100 + i) for i in range(40)}
    cut = {f"cut-{k}": np.clip(a[6:, 3:90].astype(int) + 12, 0, 255).astype(np.uint8) for k, a in whole.items() if int(k) % 10 == 0}
    sample, others = images.find_keypoints(rasters(spark, cut)), images.find_keypoints(rasters(spark, whole))
    found = images.image_matches(sample, others).cache()
    first, rate = images.near_duplicate_rate(sample, found, min_inliers=15, screened=True)
    assert {(r.sample_id, r.other_id) for r in first.collect()} == {(k, k[4:]) for k in cut}
    assert rate.first().rate == 1.0
    assert images.near_duplicate_rate(sample, found, min_inliers=10_000)[1].first().rate == 0.0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, images.image_matches(sample.repartition(3), others.repartition(5)).collect()))


def test_homography_and_screen(spark):  # noqa: ANN001
    dice = np.random.default_rng(4)
    true = np.array([[0.9, 0.1, 12], [-0.08, 1.1, -4], [1e-4, -2e-4, 1]])
    a = dice.uniform(0, 600, (120, 2))
    p = np.c_[a, np.ones(120)] @ true.T
    b = p[:, :2] / p[:, 2:] + dice.normal(0, 0.5, (120, 2))
    b[80:] = dice.uniform(0, 600, (40, 2))
    h, kept = features.homography(a, b, 7)
    assert kept[:80].all() and kept[80:].sum() <= 3 and np.allclose(h / h[2, 2], true, atol=0.6)
    assert features.homography(a[:3], b[:3], 1)[0] is None and features.homography(np.zeros((9, 2)), np.zeros((9, 2)), 1)[1].sum() == 0
    square = np.array([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (2, 0), (0, 0)], float)
    assert features.hull_area(square) == 12 and features.hull_area(square[:2]) == 0 and features.hull_area(square[[0, 1, 5]]) == 0
    rows = [(3, 9, 9, None, 0.0, 0.0), (20, 9, 30, 1.0, 1.0, 1.0), (20, 30, 30, None, 1.0, 1.0), (20, 30, 30, -0.001, 1.0, 1.0), (20, 30, 30, -1.0, 1.0, 0.01), (20, 30, 30, 1.0, 0.5, 0.5), (20, 30, 30, float("nan"), 1.0, 1.0)]
    names = ["inliers", "n_a", "n_b", "det", "fa", "fb"]
    told = spark.createDataFrame(rows, "inliers int, n_a int, n_b int, det double, fa double, fb double").select(images.degenerate_reason(*map(F.col, names)).alias("r"))
    assert [r.r for r in told.collect()] == [None, "more_inliers_than_keypoints", "degenerate_homography", "degenerate_homography", "inliers_not_spread", None, "degenerate_homography"]


# ---- PNG ----


def by_the_book(lines, kinds, n):  # noqa: ANN001, ANN201
    """Scanlines filtered byte by byte."""
    out, above = [], [0] * len(lines[0])
    for row, kind in zip(lines, kinds, strict=True):
        new = []
        for i, v in enumerate(row):
            a, b, c = row[i - n] if i >= n else 0, above[i], above[i - n] if i >= n else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c][kind]
            new.append((v - guess) % 256)
        out.append(bytes([kind, *new]))
        above = row
    return b"".join(out)


def picture(color, w, h, raw, palette=None, depth=8):  # noqa: ANN001, ANN201
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    z = zlib.compress(raw)
    return png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", z[:7]) + part(b"tEXt", b"k\0v") + part(b"IDAT", z[7:]) + part(b"IEND", b"")


@pytest.mark.parametrize("color", [0, 2, 4, 6])
def test_png_reads_every_filter(color):  # noqa: ANN001
    n, dice = png.CHANNELS[color], np.random.default_rng(color)
    for kinds in ([0] * 10, [1] * 10, [2] * 10, [3] * 10, [4] * 10, list(dice.integers(0, 5, 10))):
        a = dice.integers(0, 256, (10, 7, n)).astype(np.uint8)
        assert (png.decode(picture(color, 7, 10, by_the_book(a.reshape(10, -1).tolist(), kinds, n))) == a).all()


def test_png_writes_and_refuses(spark):  # noqa: ANN001
    dice = np.random.default_rng(0)
    for shape in ((1, 1), (5, 9), (64, 64, 3), (1, 300, 3), (40, 1)):
        for a in (dice.integers(0, 256, shape).astype(np.uint8), np.zeros(shape, np.uint8), (np.arange(np.prod(shape)) % 251).reshape(shape).astype(np.uint8)):
            assert (png.decode(png.encode(a)).reshape(shape) == a).all()
    palette = bytes(range(30))
    assert png.decode(picture(3, 2, 1, b"\0\x09\0", palette)).tolist() == [[[27, 28, 29], [0, 1, 2]]]
    good = png.encode(mosaic(1))
    bad = {b"": "no signature", good[:-5]: "cut short", good[:-12]: "no end", good[:30] + b"x" + good[31:]: "checksum", picture(0, 2, 2, b"\0" * 5): "size", picture(0, 2, 2, b"\0" * 7): "size", picture(0, 1, 1, b"\x09\0"): "filter 9"}
    bad |= {picture(3, 2, 1, b"\0\x0a\0", palette): "palette", picture(0, 1, 1, b"\0\0", depth=16): "not read: depth 16, colour 0, interlace 0, 1 by 1"}
    rows = [(i, x, "c") for i, x in enumerate([*bad, good])] + [(99, None, "c")]
    got = {r.i: r for r in png.decode_pictures(spark.createDataFrame(rows, "i int, content binary, size string")).collect()}
    assert [got[i].problem for i in range(len(bad))] == list(bad.values())
    assert bytes(got[len(bad)].pixels) == mosaic(1).tobytes() and (got[99].problem, got[99].pixels) == (None, None)


# ---- drawing ----


def test_resize_and_inset():
    assert np.allclose(draw.kernel(5, 5), np.eye(5), atol=1e-12) and np.allclose(draw.kernel(64, 13).sum(1), 1)
    flat = np.full((9, 14, 3), 77, np.uint8)
    assert (draw.resize(flat, 40, 3) == 77).all()
    a = np.repeat(mosaic(3)[..., None], 3, axis=2)
    one = draw.resize(a[None], 31, 17)
    assert one.shape == (1, 17, 31, 3)
    # By hand, one pixel: the windowed sinc of each direction.
    def weights(n, m, i):  # noqa: ANN001, ANN202
        s = max(1.0, n / m)
        x = [(k + 0.5 - (i + 0.5) * n / m) / s for k in range(n)]
        sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
        w = [sinc(v) * sinc(v / 3) if abs(v) < 3 else 0.0 for v in x]
        return [v / sum(w) for v in w]

    by_hand = sum(wy * wx * a[y, x, 0] for y, wy in enumerate(weights(96, 17, 4)) for x, wx in enumerate(weights(96, 31, 20)))
    assert abs(int(one[0, 4, 20, 0]) - min(max(by_hand, 0), 255)) <= 0.5001
    out = draw.zoom_inset(a, (0, 0, 20, 10))
    p = draw.inset_plan(96, 96, (0, 0, 20, 10))
    assert (p["width"], p["height"], p["corner"]) == (38, 19, "top-right")
    framed = out[p["y"] : p["y"] + 21, p["x"] : p["x"] + 40]
    assert (framed[0] == 255).all() and (framed[:, -1] == 255).all() and (framed[1:-1, 1:-1] == draw.resize(a[:10, :20], 38, 19)).all()
    changed = (out != a).any(axis=2)
    changed[p["y"] : p["y"] + 21, p["x"] : p["x"] + 40] = False
    assert not changed.any()
    assert draw.zoom_inset(a[:2, :2], (0, 0, 2, 2)).shape == (2, 2, 3)


def test_lines_and_arrows():
    assert draw.line(10, 8, (1, 2), (8, 2), 3).sum() == 7 * 3 and draw.line(10, 8, (3, 3), (3, 3), 5).sum() == 1
    dice = np.random.default_rng(2)
    for _ in range(50):
        (x1, y1), (x2, y2) = dice.uniform(-5, 45, (2, 2))
        got = draw.line(40, 30, (x1, y1), (x2, y2), 4.0)
        y, x = np.mgrid[0:30, 0:40]
        length = math.hypot(x2 - x1, y2 - y1)
        along, across = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length, np.abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / length
        clear = (np.abs(along) > 1e-6) & (np.abs(along - length) > 1e-6) & (np.abs(across - 2) > 1e-6)
        assert (got == ((along > 0) & (along < length) & (across < 2)))[clear].all()
    a = np.zeros((2, 60, 80, 3), np.uint8)
    out = draw.region_arrow(a, (10, 10, 20, 20))
    assert (out[0] == out[1]).all() and out[0, 15, 16].tolist() == [255, 0, 0] and out[0, 5, 5].tolist() == [0, 0, 0]
    assert draw.arrow_lines(80, 60, (10, 10, 20, 20))[0] == ((79, 59), (15, 15))


def ssim_by_hand(x, y):  # noqa: ANN001, ANN201
    c1, c2, out = (0.01 * 255) ** 2, (0.03 * 255) ** 2, []
    for i in range(x.shape[0] - 6):
        for j in range(x.shape[1] - 6):
            p, q = x[i : i + 7, j : j + 7].ravel(), y[i : i + 7, j : j + 7].ravel()
            cov = np.cov(p, q)
            out.append((2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    return np.mean(out)


def test_ssim_over_offsets(spark):  # noqa: ANN001
    dice = np.random.default_rng(6)
    x, y = dice.uniform(0, 255, (3, 12, 15)), dice.uniform(0, 255, (3, 17, 20))
    y[1, 2:14, 5:20] = x[1]
    want = [max(ssim_by_hand(a, b[t : t + 12, s : s + 15]) for t in (0, 2, 5) for s in (0, 2, 5)) for a, b in zip(x, y, strict=True)]
    assert np.allclose(raster.ssim_stack(x, y), want) and np.allclose(raster.ssim_stack(y, x), want) and want[1] > 0.999
    tall = dice.uniform(0, 255, (3, 20, 10))
    assert np.allclose(raster.ssim_stack(x, tall), [ssim_by_hand(a[:, 2:12], b[4:16]) for a, b in zip(x, tall, strict=True)])
    rgb = lambda h, w, k: np.random.default_rng(k).integers(0, 256, (h, w, 3)).astype(np.uint8)
    pairs = [(i, a.shape[1], a.shape[0], bytearray(a), b.shape[1], b.shape[0], bytearray(b)) for i, (a, b) in enumerate([(rgb(9, 9, 1), rgb(9, 9, 2)), (rgb(9, 9, 3), rgb(12, 9, 4)), (rgb(3, 3, 5), rgb(3, 3, 5)), (rgb(9, 9, 6), rgb(9, 9, 6))])]
    rows = spark.createDataFrame([*pairs, (9, 1, 1, None, 1, 1, None)], "i int, width int, height int, pixels binary, other_width int, other_height int, other binary")
    got = {r.i: r for r in raster.similarities(rows, "i").collect()}
    assert abs(got[0].ssim - ssim_by_hand(raster.gray(rgb(9, 9, 1)), raster.gray(rgb(9, 9, 2)))) < 1e-9 and got[0].changed_share > 0.5
    assert got[1].changed_share is None and (got[2].ssim, got[2].changed_share) == (None, 0.0) and got[3].ssim > 0.999 and got[9].ssim is None


def test_queries_of_pictures(spark):  # noqa: ANN001
    found = image_queries.image_near_duplicates(spark, SF).collect()
    own = {r.sample_id for r in found if r.sample_id == f"cut-{r.other_id}" and r.first}
    whole = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0 and embedding is not null").count()
    assert len(own) == whole
    cues = image_queries.aligned_similarity(spark, SF).collect()
    assert all(r.ssim > 0.2 for r in cues) and {r.changed_share is None for r in cues if "padding" in r.pair} == {True}


# ---- trees ----


def test_tree_source(spark, tmp_path):  # noqa: ANN001
    names = ["root.txt", "a/one.png", "a/two.jpg", "a/x/deep.png", "a/x/y/z/far.png", "b/one.png", "b/x/b.txt", "bb/one.png"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"c" * i)
    for depth in (0, 1, 2, 9):
        got = {r.path: bytes(r.content) for r in tree.read_tree(spark, str(tmp_path), content=True, depth=depth, partitions=3).collect()}
        assert got == {n: b"c" * i for i, n in enumerate(names)}
    listing = tree.read_tree(spark, f"file://{tmp_path}")
    assert listing.where("top = 'a'").count() == 4 and listing.where("top in ('a', 'bb') and suffix = '.png'").count() == 4 and listing.where("path like 'b/%'").count() == 2
    assert listing.where("path like 'a/x/%' and size > 3").select("name").collect()[0].name == "far.png"
    assert listing.where("top is null").select("folder").collect()[0].folder == ""
    assert tree.read_tree(spark, f"{tmp_path}/none").count() == 0
    reader = tree.TreeReader(spark.createDataFrame([], tree.LISTING).schema, {"path": str(tmp_path)})
    left = list(reader.pushFilters([tree.EqualTo(("top",), "a"), tree.StringStartsWith(("path",), "a/x"), tree.EqualTo(("size",), 3)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and sorted(f for p in reader.partitions() for f, _ in p.folders) == ["", "a", "a/x"]


def test_contents_and_stems(spark, tmp_path):  # noqa: ANN001
    rows = [("c/input/s.png", b"1"), ("c/e1/s.png", b"2"), ("c/e1/s.b.png", b"3"), ("c/e1/s", b"4"), ("c/e2/s.jpg", b"5"), ("c/e2/t.x.png", b"6"), ("c/input/t.png", b""), (None, b"7"), ("c/none", None), ("k/input/q.png", b"8")]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    assert sorted((r.path, r.written) for r in tree.write_contents(df, str(tmp_path)).collect()) == sorted((p, True) for p, c in rows if p and c is not None)
    assert not any(r.written for r in tree.write_contents(df, str(tmp_path)).collect())
    assert not [p for p in tmp_path.rglob(".*")]
    entries = spark.createDataFrame([("c", "s"), ("c", "t"), ("c", "t"), ("k", "q"), ("z", "q")], "category string, stem string")
    got = {(r.category, r.stem, r.editor): (r.original, r.edited) for r in tree.match_tree(entries, tree.read_tree(spark, str(tmp_path))).collect()}
    assert got == {("c", "s", "e1"): ("c/input/s.png", "c/e1/s"), ("c", "s", "e2"): ("c/input/s.png", "c/e2/s.jpg"), ("c", "t", "e1"): ("c/input/t.png", None), ("c", "t", "e2"): ("c/input/t.png", "c/e2/t.x.png")}
    with pytest.raises(Exception, match="leaves the tree"):
        tree.write_contents(spark.createDataFrame([("../x", b"1")], "path string, content binary"), str(tmp_path)).collect()


def test_rasters_are_taken_a_few_at_a_time(spark):  # noqa: ANN001
    """One Arrow batch holds all rows; no call sees more than a few of them, and pixels that null rows lack stay null."""

    def seen(frames):  # noqa: ANN001, ANN202
        for f in frames:
            yield pd.DataFrame({"i": f["id"], "rows": len(f), "p": [None if i % 2 else b"x" for i in f["id"]]})

    got = raster.map_slices(spark.range(0, 500, 1, 1), seen, "i long, rows int, p binary").collect()
    assert sorted(r.i for r in got) == list(range(500)) and max(r.rows for r in got) <= raster.ROWS and all((r.p is None) == (r.i % 2 == 1) for r in got)
