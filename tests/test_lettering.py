"""The stroke font, wrapping in the JVM and in numpy, and cues that write on rasters, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pairwright.functions import lettering


def test_every_letter_has_a_glyph():
    assert set(map(chr, range(33, 127))) == set(lettering.GLYPHS)
    seen = {}
    for c, strokes in lettering.GLYPHS.items():
        assert all(0 <= x <= 4 and 0 <= y <= 8 for line in lettering._points(strokes) for x, y in line), c
        m = lettering.glyph(c, 27)
        assert m.any() and m.shape == (27, 3 * lettering.ADVANCE[c])
        assert seen.setdefault(m.tobytes() + bytes([m.shape[1]]), c) == c, (c, "looks like another")
    assert not lettering.glyph(" ", 18).any() and lettering.glyph("数", 18).any()
    assert lettering.lettered("ab c", 9).shape == (9, lettering.width("ab c")) and lettering.lettered("", 9).shape == (9, 0)
    assert lettering.plain("Ünï\tçödé ﬁ") == "Uni code fi"


def test_wrap_alike_in_the_jvm(spark):  # noqa: ANN001
    dice = random.Random(0)
    letters = "".join(lettering.GLYPHS) + "é数"
    texts = ["", " ", "one", "a" * 500, *(" ".join("".join(dice.choices(letters, k=dice.randrange(1, 12))) for _ in range(dice.randrange(1, 40))) for _ in range(60)), "x\t y\n\nz  ", "mmm mmm mmm"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i int, t string")
    for most in (1, 27, 100):
        told = rows.select("i", lettering.wrapped(F.coalesce("t", F.lit("")), most).alias("lines"), lettering.line_count(F.col("t"), most).alias("n"), lettering.width_of(F.col("t")).alias("w")).collect()
        for r in told:
            text = texts[r.i] if r.i != 999 else ""
            want = lettering.wrap(text, most)
            assert (r.lines, r.n.lines, r.n.widest) == (want, len(want), max(map(lettering.width, want)))
            assert all(lettering.width(x) <= most or " " not in x for x in want)
            if r.i != 999 and not set(text) & set("\t\n"):
                assert r.w == lettering.width(text)
    assert lettering.wrap("aa aa", 2 * lettering.width("aa") + lettering.ADVANCE[" "]) == ["aa aa"]


def test_what_is_written_where():
    a = np.full((2, 60, 90, 3), 100, np.uint8)
    out, n = lettering.caption(a, "red")
    assert n == 1 and out.shape == (2, 60 + 9 + 2 + 4, 90, 3) and (out[:, :60] == a).all() and (out[0] == out[1]).all()
    mask = lettering.lettered("Edited: red", 9)
    assert lettering.caption(a, "make it red and more")[1] == 2
    ys, xs = np.nonzero(mask)
    assert (out[0, 62 + ys, 4 + xs] == 20).all() and (out[0, 60:, :4] == 255).all()
    over, n = lettering.text_overlay(a[0], "")
    tall = n * 11 + 2
    assert n == 1 and (over[tall:] == 100).all() and set(np.unique(over[:tall])) == {50, round(50 * (1 - min(1, 0.5 + 120 / 255)) + 255 * min(1, 0.5 + 120 / 255))}
    bottom, _ = lettering.text_overlay(a[0], "x", band="bottom")
    assert (bottom[: 60 - tall] == 100).all() and (bottom[60 - tall] == 50).all()
    marked = lettering.watermark(a[0], "ok")
    own = lettering.lettered("ok", 9)
    y, x = 60 - 9 - 1, 90 - own.shape[1] - 1
    by_hand = a[0].astype(float)
    for color, dy in ((0, 1), (255, 0)):
        for i, j in zip(*np.nonzero(own), strict=True):
            if y + i + dy < 60 and x + j + dy < 90:
                by_hand[y + i + dy, x + j + dy] = round(by_hand[y + i + dy, x + j + dy, 0] * 0.55 + color * 0.45)
    assert np.abs(marked - by_hand).max() <= 1 and (lettering.watermark(a[0], "ok", "top-left")[30:] == 100).all()
    tiny, n = lettering.text_overlay(np.zeros((4, 5, 3), np.uint8), "far too long for this")
    assert tiny.shape == (4, 5, 3) and n == 5


def test_sham_by_hand():
    """One block of gray through the transform written out, odd sizes, and a flat raster that has to change."""
    dice = np.random.default_rng(3)
    g = dice.integers(0, 256, (8, 8)).astype(float)
    q = np.clip((np.array(lettering.LUMINANCE).reshape(8, 8) * 10 + 50) // 100, 1, 255)
    k = lambda u: math.sqrt((1 if u == 0 else 2) / 8)
    basis = [[k(u) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    coded = [[round(sum((g[x, y] - 128) * basis[u][x] * basis[v][y] for x in range(8) for y in range(8)) / q[u, v]) * q[u, v] for v in range(8)] for u in range(8)]
    back = [[128 + sum(coded[u][v] * basis[u][x] * basis[v][y] for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
    assert np.allclose(lettering._through(g[None], lettering.LUMINANCE, 95)[0], back)
    a = np.repeat(g.astype(np.uint8)[None, ..., None], 3, axis=3)
    assert np.abs(lettering.sham(a)[0, ..., 1].astype(float) - np.clip(np.rint(back), 0, 255)).max() <= 1
    for h, w in ((1, 1), (7, 9), (16, 15)):
        smooth = np.clip(np.add.outer(np.arange(h) * 5, np.arange(w) * 3)[None, ..., None] + np.array([0, 20, 60]), 0, 255).astype(np.uint8)
        out = lettering.sham(smooth)
        assert out.shape == smooth.shape and np.abs(out.astype(int) - smooth).mean() < 6 and (out != smooth).any()
    flat = np.full((2, 16, 16, 3), 128, np.uint8)
    assert (lettering.sham(flat) != flat).sum() == 2


def test_text_cues_of_rows(spark):  # noqa: ANN001
    px = bytearray(np.random.default_rng(0).integers(0, 256, 40 * 30 * 3).astype(np.uint8).tobytes())
    rows = spark.createDataFrame([("a", 40, 30, px, "paint it blue"), ("b", 30, 40, px, None), ("c", None, None, None, "x")], "sample_id string, width int, height int, pixels binary, instruction string")
    got = {(r.sample_id, r.bias_type): r for r in lettering.text_cues(rows).collect()}
    assert set(got) == {(s, k) for s in "ab" for k in ("watermark", "text_overlay", "detail_caption", "sham")}
    assert all(len(r.pixels) == r.width * r.height * 3 and bytes(r.pixels) != bytes(px) for r in got.values()) and got["b", "sham"].lines is None and got["b", "text_overlay"].lines == 1
