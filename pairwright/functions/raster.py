"""Cues on rasters (height, width, 3) of bytes: pure numpy, mapped over Arrow batches.

Built: brightness, saturation, padding, warm contrast, region box, revert damage, edit-region estimation, change measures, SSIM (also over the offsets that an
extended canvas may have). Insets and arrows are in ``draw``, PNG in ``png``. Not built, for want of fonts: text and caption cues; JPEG round trip, blur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from pairwright.functions import draw

# Default strengths.
BRIGHTNESS, SATURATION, PADDING, CONTRAST, WARMTH, THRESHOLD = 1.2, 1.2, 0.10, 1.1, 8, 15
LUMA = (0.299, 0.587, 0.114)


#: Rows of rasters that a task turns into pandas at a time.
ROWS = 64


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = ROWS) -> DataFrame:
    """``mapInPandas`` over a few rows at a time, for rows as wide as rasters: Arrow batches count rows, so a whole one with what is made of it may be gigabytes. What ``run`` yields goes on at once."""
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batch.to_pandas() for batch in slices(batches, rows)):
            yield pa.RecordBatch.from_pandas(frame, kind, preserve_index=False)

    return df.mapInArrow(sliced, schema)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(a: np.ndarray) -> np.ndarray:
    return a.astype(float) @ np.array(LUMA)


def brightness(a: np.ndarray, factor: float = BRIGHTNESS) -> np.ndarray:
    return _bytes(a * factor)


def saturation(a: np.ndarray, factor: float = SATURATION) -> np.ndarray:
    flat = np.rint(gray(a))[..., None]
    return _bytes(flat + (a - flat) * factor)


def padding(a: np.ndarray, ratio: float = PADDING) -> np.ndarray:
    y, x = (max(1, round(n * ratio)) for n in a.shape[:2])
    return np.pad(a, ((y, y), (x, x), (0, 0)))


def warm_contrast(a: np.ndarray, contrast: float = CONTRAST, shift: int = WARMTH) -> np.ndarray:
    mean = np.rint(gray(a).mean())
    out = mean + (a.astype(float) - mean) * contrast
    return _bytes(_bytes(out).astype(float) + np.array([shift, 0, -shift]))


def region_box(a: np.ndarray, box: tuple[int, int, int, int], width: int = 3, color: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    left, top, right, bottom = box
    out, width = a.copy(), max(0, min(width, bottom - top, right - left))
    for ys, xs in ((slice(top, top + width), slice(left, right)), (slice(bottom - width, bottom), slice(left, right)), (slice(top, bottom), slice(left, left + width)), (slice(top, bottom), slice(right - width, right))):
        out[ys, xs] = color
    return out


def revert(edited: np.ndarray, original: np.ndarray, box: tuple[int, int, int, int], severity: float = 1.0) -> np.ndarray:
    left, top, right, bottom = box
    out = edited.astype(float)
    out[top:bottom, left:right] = (1 - severity) * out[top:bottom, left:right] + severity * original[top:bottom, left:right]
    return _bytes(out)


def change(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    d = np.abs(a.astype(int) - b.astype(int)).max(axis=2)
    return {"mean_abs_change": float(np.abs(a.astype(float) - b).mean()), "changed_share": float((d > THRESHOLD).mean())}


def _spread(mask: np.ndarray, k: int, any_: bool) -> np.ndarray:
    """Dilation (any_) or erosion by a k by k square."""
    before, out = k // 2, mask
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, k - 1 - before)
        wide = np.pad(out, pad, constant_values=False)
        views = [np.take(wide, range(i, i + out.shape[axis]), axis=axis) for i in range(k)]
        out = np.logical_or.reduce(views) if any_ else np.logical_and.reduce(views)
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected parts from 1, by passing least labels along rows and columns until nothing moves."""
    far = mask.size + 1
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), far)
    while True:
        was = label
        for axis in (0, 1):
            for flip in (False, True):
                x = np.flip(label, axis) if flip else label
                y = x.copy()
                lower, upper = (slice(1, None), slice(None, -1))
                here = (lower, slice(None)) if axis == 0 else (slice(None), lower)
                there = (upper, slice(None)) if axis == 0 else (slice(None), upper)
                y[here] = np.where(x[here] != far, np.minimum(x[here], x[there]), far)
                label = np.flip(y, axis) if flip else y
        if (label == was).all():
            break
    out = np.zeros(mask.shape, int)
    for n, v in enumerate(np.unique(label[mask]), 1):
        out[label == v] = n
    return out


def edit_region(edited: np.ndarray, original: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[tuple[int, int, int, int], str]:
    """(box, method): of a mask, else of the largest part that changed (opened and closed by a square of a hundredth of the short
    edge), else a centred box."""
    h, w = edited.shape[:2]
    for marked, method in ((mask, "mask"), (_changed(edited, original), "diff")):
        if marked is not None and marked.any():
            ys, xs = np.nonzero(marked)
            return (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1), method
    bw, bh = round(w * 0.6), round(h * 0.6)
    left, top = (w - bw) // 2, (h - bh) // 2
    return (left, top, left + bw, top + bh), "fallback"


def _changed(edited: np.ndarray, original: np.ndarray | None) -> np.ndarray | None:
    if original is None or original.shape != edited.shape:
        return None
    mask = np.abs(edited.astype(int) - original.astype(int)).max(axis=2) > THRESHOLD
    k = max(1, round(min(mask.shape) * 0.01))
    mask = _spread(_spread(mask, k, False), k, True)
    mask = _spread(_spread(mask, k, True), k, False)
    labels = components(mask)
    return labels == np.bincount(labels[labels > 0]).argmax() if labels.any() else None


def _sums(v: np.ndarray) -> np.ndarray:
    """Integral images of a stack (n, h, w)."""
    return np.pad(v.cumsum(-2).cumsum(-1), ((0, 0), (1, 0), (1, 0)))


def _means(s: np.ndarray, k: int) -> np.ndarray:
    return (s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]) / (k * k)


def _crop(v: np.ndarray, top: int, left: int, h: int, w: int) -> np.ndarray:
    return v[:, top : top + h, left : left + w]


def ssim_stack(x: np.ndarray, y: np.ndarray, window: int = 7) -> np.ndarray:
    """Best mean structural similarity of each pair of two stacks of gray rasters (n, h, w) and (n, H, W): the smaller is compared with the larger at every
    one of the offsets start, middle and end of the surplus along both axes; if neither holds the other, their centres are. The larger stack's window sums are
    taken once for all offsets."""
    if any(a < b for a, b in zip(y.shape[1:], x.shape[1:], strict=True)):
        x, y = y, x
    if any(a < b for a, b in zip(y.shape[1:], x.shape[1:], strict=True)):
        h, w = (min(a, b) for a, b in zip(x.shape[1:], y.shape[1:], strict=True))
        x, y = (_crop(v, (v.shape[1] - h) // 2, (v.shape[2] - w) // 2, h, w) for v in (x, y))
    (h, w), k = x.shape[1:], window
    mx, mxx = _means(_sums(x), k), _means(_sums(x * x), k)
    sy, syy = _sums(y), _sums(y * y)
    more, c1, c2 = k * k / (k * k - 1), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    best = np.full(len(x), -1.0)
    for top in sorted({0, (y.shape[1] - h) // 2, y.shape[1] - h}):
        for left in sorted({0, (y.shape[2] - w) // 2, y.shape[2] - w}):
            my, myy = (_means(_crop(s, top, left, h + 1, w + 1), k) for s in (sy, syy))
            mxy = _means(_sums(x * _crop(y, top, left, h, w)), k)
            vx, vy, vxy = ((a - b) * more for a, b in ((mxx, mx * mx), (myy, my * my), (mxy, mx * my)))
            score = ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
            best = np.maximum(best, score.mean(axis=(1, 2)))
    return best


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two rasters (h, w, 3)."""
    return float(ssim_stack(gray(a)[None], gray(b)[None], window)[0])


def compared(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """(key, ssim, changed_share) of frames of pairs of rasters; pairs of the same shapes in a frame are one stack."""
    for batch in frames:
        batch = batch.reset_index(drop=True)
        out = pd.DataFrame({key: batch[key], "ssim": None, "changed_share": None}).astype({"ssim": float, "changed_share": float})
        whole = batch[batch.pixels.notna() & batch.other.notna()]
        for (w, h, v, u), g in whole.groupby(["width", "height", "other_width", "other_height"]):
            x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(g), *shape, 3) for c, shape in ((g.pixels, (h, w)), (g.other, (u, v))))
            if min(w, h, v, u) >= 7:
                out.loc[g.index, "ssim"] = ssim_stack(gray(x), gray(y))
            if (w, h) == (v, u):
                out.loc[g.index, "changed_share"] = (np.abs(x.astype(int) - y).max(axis=3) > THRESHOLD).mean(axis=(1, 2))
        yield out


def similarities(pairs: DataFrame, key: str) -> DataFrame:
    """(key, ssim, changed_share) of pairs of rasters (width, height, pixels, other_width, other_height, other), of three channels. The share of
    changed pixels is null where the shapes differ; pairs with a null or with a raster narrower than the window have nulls."""
    columns = [key, "width", "height", "pixels", "other_width", "other_height", "other"]
    kind = pairs.schema[key].dataType.simpleString()
    return map_slices(pairs.select(columns), lambda frames: compared(frames, key), f"{key} {kind}, ssim double, changed_share double")


CUES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"brightness": brightness, "saturation": saturation, "padding": padding, "aesthetic_filter": warm_contrast}


INJECTED = "biased_id string, base_sample_id string, bias_type string, width int, height int, pixels binary, sha1 string"


def injected(frames: Iterator[pd.DataFrame], cues: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of ``inject``, a raster at a time, for steps that make the rasters in the same pass: rasters that go from one step to the next as rows are there in whole Arrow batches."""
    for batch in frames:
        for r in batch.itertuples():
            a = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
            out = [(f"{r.sample_id}__{c}", r.sample_id, c, x.shape[1], x.shape[0], x.tobytes()) for c in cues for x in [CUES[c](a)]]
            yield pd.DataFrame([(*o, hashlib.sha1(o[-1], usedforsecurity=False).hexdigest()) for o in out], columns=[x.split()[0] for x in INJECTED.split(", ")])


def inject(rasters: DataFrame, cues: list[str]) -> DataFrame:
    """(biased_id, base_sample_id, bias_type, width, height, pixels, sha1) of every raster (sample_id, width, height, pixels) and cue."""
    unknown = set(cues) - set(CUES)
    if unknown:
        raise ValueError(f"no such cue: {sorted(unknown)}")
    return map_slices(rasters.select("sample_id", "width", "height", "pixels"), lambda frames: injected(frames, cues), INJECTED)


def region_cues(rasters: DataFrame, severities: tuple[float, ...] = (0.25, 0.5, 1.0)) -> DataFrame:
    """(sample_id, left, top, right, bottom, method, bias_type, severity, sha1) of every raster (sample_id, width, height, pixels, original): the region that
    the edit changed, its outline drawn (region_annotation), and its pixels taken back towards the original (edit_damage, by severity; none without an
    original of the same size). A null raster gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                a = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                same = r.original is not None and len(r.original) == len(r.pixels)
                o = np.frombuffer(r.original, np.uint8).reshape(a.shape) if same else None
                box, method = edit_region(a, o)
                made = [("region_annotation", None, region_box(a, box))] + [("edit_damage", s, revert(a, o, box, s)) for s in severities if o is not None]
                out += [(r.sample_id, *box, method, c, s, hashlib.sha1(x.tobytes(), usedforsecurity=False).hexdigest()) for c, s, x in made]
            yield pd.DataFrame(out, columns=["sample_id", "left", "top", "right", "bottom", "method", "bias_type", "severity", "sha1"])

    schema = "sample_id string, left int, top int, right int, bottom int, method string, bias_type string, severity double, sha1 string"
    return map_slices(rasters.where("pixels is not null").select("sample_id", "width", "height", "pixels", "original"), run, schema)


def drawn_cues(rasters: DataFrame) -> DataFrame:
    """(sample_id, left, top, right, bottom, method, bias_type, corner, x, y, inset_width, inset_height, pixels) of every raster (sample_id, width, height, pixels, original): the
    region that the edit changed, magnified into a corner (zoom_inset, with its place) and pointed at (region_arrow, places null). A null raster gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                a = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                same = r.original is not None and len(r.original) == len(r.pixels)
                box, method = edit_region(a, np.frombuffer(r.original, np.uint8).reshape(a.shape) if same else None)
                p = draw.inset_plan(r.width, r.height, box)
                out.append((r.sample_id, *box, method, "zoom_inset", p["corner"], p["x"], p["y"], p["width"] + 2 * p["edge"], p["height"] + 2 * p["edge"], draw.zoom_inset(a, box).tobytes()))
                out.append((r.sample_id, *box, method, "region_arrow", None, None, None, None, None, draw.region_arrow(a, box).tobytes()))
            names = [x.split()[0] for x in schema.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({k: "Int32" for k in ("x", "y", "inset_width", "inset_height")})

    schema = "sample_id string, left int, top int, right int, bottom int, method string, bias_type string, corner string, x int, y int, inset_width int, inset_height int, pixels binary"
    return map_slices(rasters.where("pixels is not null").select("sample_id", "width", "height", "pixels", "original"), run, schema)
