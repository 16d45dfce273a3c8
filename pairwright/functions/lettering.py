"""A stroke font of our own, widths and wrapping as Column expressions, and the cues that write on rasters: watermark, text overlay, caption, and the sham.

A glyph is a few polylines on a grid of 5 by 9 points (capitals from row 0 to the base line at row 6, descenders to row 8), drawn at any size by the thick lines of ``draw``.
Letters with marks are drawn as their base letter, what has no glyph as a box. Widths are whole grid units, so that the JVM and numpy wrap alike.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import draw
from pairwright.functions.raster import map_slices

#: Rows of the grid, units between glyphs, width of a space.
ROWS, GAP, SPACE = 9, 2, 1
#: The glyphs: polylines parted by spaces, each a run of points, column then row.
GLYPHS = {
    "!": "2024 2526", '"': "1012 3032", "#": "1016 3036 0242 0444", "$": "413010010213334445361605 2026", "%": "4006 0010110100 3545463635", "&": "46120110213305163643", "'": "2022", "(": "30212536", ")": "10212516", "*": "2024 0143 4103", "+": "2125 0343",
    ",": "2517", "-": "1333", ".": "2526", "/": "4006", "0": "100105163645413010 0541", "1": "112026 1636", "2": "01103041420646", "3": "01103041423313 334445361605", "4": "36300444", "5": "400003334445361605", "6": "4130100105163645443303", "7": "004016",
    "8": "13020110304142331304051636454433", "9": "4313020110304145361605", ":": "2223 2526", ";": "2223 2517", "<": "410345", "=": "0242 0444", ">": "014305", "?": "01103041422324 2526", "@": "43322324344441301001051636", "A": "062046 1434", "B": "06003041423303 3344453606",
    "C": "4130100105163645", "D": "00063645413000", "E": "40000646 0333", "F": "400006 0333", "G": "41301001051636454323", "H": "0006 4046 0343", "I": "1030 2026 1636", "J": "4045361605", "K": "0006 400346", "L": "000646", "M": "0600234046", "N": "06004640",
    "O": "100105163645413010", "P": "06003041423303", "Q": "100105163645413010 2446", "R": "06003041423303 2346", "S": "413010010213334445361605", "T": "0040 2026", "U": "000516364540", "V": "002640", "W": "0016233640", "X": "0046 4006", "Y": "002340 2326", "Z": "00400646",
    "[": "30202636", "\\": "0046", "]": "10202616", "^": "022042", "_": "0747", "`": "1021", "a": "12324346 441405163645", "b": "0006 0312324345361605", "c": "4332120305163645", "d": "4046 4332120305163645", "e": "04444332120305163645", "f": "40302126 1232",
    "g": "4247381807 4332120305163645", "h": "0006 0312324346", "i": "2226 2021", "j": "32372818 3031", "k": "0006 420446", "l": "2026", "m": "0602 03122326 23324346", "n": "0602 0312324346", "o": "120305163645433212", "p": "0208 0312324345361605", "q": "4248 4332120305163645",
    "r": "0602 031232", "s": "43321203143445361605", "t": "20253646 1232", "u": "0205163645 4246", "v": "022642", "w": "0216243642", "x": "0246 4206", "y": "0226 4218", "z": "02420646", "{": "30212213242536", "|": "2027", "}": "10212233242516", "~": "03123443",
}
BOX = "0040460600"
#: Shares of the short edge for letters and margins, opacities, words that a cue writes, quality of the sham.
MARK_SIZE, MARK_MARGIN, MARK_OPACITY, BAND_SIZE, BAND_OPACITY, CAPTION_SIZE, CAPTION_WORDS, SHAM_QUALITY = 0.04, 0.03, 0.45, 0.05, 0.5, 0.035, 14, 95
# Shares of red, green and blue in brightness; the quantisation tables of the JPEG standard's annex for brightness and for colour, row by row.
LUMA = (0.299, 0.587, 0.114)
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99) + (99,) * 32


def _points(strokes: str) -> list[list[tuple[int, int]]]:
    return [[(int(p[i]), int(p[i + 1])) for i in range(0, len(p), 2)] for p in strokes.split()]


def _extent(strokes: str) -> tuple[int, int]:
    x = [a for line in _points(strokes) for a, _ in line]
    return min(x), max(x)


#: Units from one glyph to the next.
ADVANCE = {" ": SPACE + GAP} | {c: b - a + GAP for c, (a, b) in ((c, _extent(s)) for c, s in GLYPHS.items())}
UNKNOWN = _extent(BOX)[1] + GAP


def plain(text: str) -> str:
    """The text in letters that have glyphs, as far as they have: marks go, white space becomes spaces."""
    return "".join(" " if c.isspace() else c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def width(text: str) -> int:
    """Units of a text in glyph letters; the gap behind the last glyph counts."""
    return sum(ADVANCE.get(c, UNKNOWN) for c in text)


def wrap(text: str, most: int) -> list[str]:
    """Lines of at most ``most`` units, filled word by word; a longer word has a line of its own; an empty text is one empty line."""
    lines: list[str] = []
    cur, used = "", 0
    for word in text.split():
        own = width(word)
        if not cur or used + ADVANCE[" "] + own <= most:
            cur, used = f"{cur} {word}".strip(), used + (ADVANCE[" "] if cur else 0) + own
        else:
            lines.append(cur)
            cur, used = word, own
    return [*lines, cur] if cur or not lines else lines


def width_of(text: Column) -> Column:
    """``width`` in the JVM: the letters of each advance are counted by what is left when they are taken out."""
    by: dict[int, str] = {}
    for c, n in ADVANCE.items():
        by[n] = by.get(n, "") + c
    count = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))
    known = [(n - UNKNOWN) * count(letters) for n, letters in by.items() if n != UNKNOWN]
    return functools.reduce(lambda a, b: a + b, known, F.length(text) * UNKNOWN)


def _sized_words(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(w.alias("w"), width_of(w).alias("n")))


def wrapped(text: Column, most: int) -> Column:
    """``wrap`` in the JVM, on short text in glyph letters: its lines."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("used"))

    def step(s: Column, x: Column) -> Column:
        joined = s["used"] + ADVANCE[" "] + x["n"]
        first, stays = s["cur"] == "", (s["cur"] == "") | (joined <= most)
        return F.struct(
            F.when(stays, s["done"]).otherwise(F.array_append(s["done"], s["cur"])).alias("done"), F.when(first | ~stays, x["w"]).otherwise(F.concat_ws(" ", s["cur"], x["w"])).alias("cur"),
            F.when(first | ~stays, x["n"]).otherwise(joined).alias("used"),
        )

    told = F.aggregate(_sized_words(text), start, step)
    return F.array_append(told["done"], told["cur"])


def line_count(text: Column, most: int) -> Column:
    """struct<lines, widest> of a text of any length, wrapped: how many lines, and the units of the widest."""
    start = F.struct(F.lit(0).alias("done"), F.lit(0).alias("used"), F.lit(0).alias("widest"))

    def step(s: Column, x: Column) -> Column:
        joined = s["used"] + ADVANCE[" "] + x["n"]
        fresh = (s["used"] == 0) | (joined > most)
        used = F.when(fresh, x["n"]).otherwise(joined)
        return F.struct((s["done"] + F.when((s["used"] > 0) & (joined > most), 1).otherwise(0)).alias("done"), used.alias("used"), F.greatest(s["widest"], used).alias("widest"))

    told = F.aggregate(_sized_words(F.coalesce(text, F.lit(""))), start, step)
    return F.struct((told["done"] + 1).alias("lines"), told["widest"].alias("widest"))


@functools.lru_cache(4096)
def glyph(c: str, size: int) -> np.ndarray:
    """The mask of a glyph, ``size`` pixels of rows high."""
    unit, strokes = size / ROWS, GLYPHS.get(c, "" if c == " " else BOX)
    left = _extent(strokes)[0] if strokes else 0
    w = max(1, round(ADVANCE.get(c, UNKNOWN) * unit))
    mask, thick = np.zeros((size, w), bool), max(1.0, unit * 0.8)
    for line in _points(strokes):
        at = [((x - left + 0.5) * unit, (y + 0.5) * unit) for x, y in line]
        for a, b in zip(at, at[1:], strict=False):
            mask |= draw.line(w, size, a, b, thick)
    return mask


def lettered(text: str, size: int) -> np.ndarray:
    """The mask of a line of text."""
    return np.concatenate([glyph(c, size) for c in text], axis=1) if text else np.zeros((size, 0), bool)


def _blend(a: np.ndarray, mask: np.ndarray, x: int, y: int, color: tuple[int, int, int], alpha: float) -> None:
    """Lay a colour over the pixels of a mask placed at (x, y), in place; what leaves the frame is cut."""
    h, w = a.shape[-3:-1]
    top, left = max(0, -y), max(0, -x)
    part = mask[top : max(top, h - y), left : max(left, w - x)]
    ys, xs = np.nonzero(part)
    ys, xs = ys + y + top, xs + x + left
    a[..., ys, xs, :] = np.rint(a[..., ys, xs, :] * (1 - alpha) + np.array(color) * alpha).astype(np.uint8)


def letter_size(w: int, h: int, share: float) -> int:
    return max(ROWS, int(min(w, h) * share))


def units(pixels: int, size: int) -> int:
    """Whole grid units that fit into so many pixels."""
    return pixels * ROWS // size


def watermark(a: np.ndarray, text: str, corner: str = "bottom-right", opacity: float = MARK_OPACITY) -> np.ndarray:
    """Light letters over a dark shadow in a corner."""
    h, w = a.shape[-3:-1]
    mask, margin, out = lettered(plain(text), letter_size(w, h, MARK_SIZE)), max(1, int(min(w, h) * MARK_MARGIN)), a.copy()
    x = margin if "left" in corner else w - mask.shape[1] - margin
    y = margin if "top" in corner else h - mask.shape[0] - margin
    _blend(out, mask, x + 1, y + 1, (0, 0, 0), opacity)
    _blend(out, mask, x, y, (255, 255, 255), opacity)
    return out


def text_overlay(a: np.ndarray, text: str, band: str = "top", opacity: float = BAND_OPACITY) -> tuple[np.ndarray, int]:
    """(raster, lines): centred letters on a dark band along an edge; an empty text is "edit"."""
    h, w = a.shape[-3:-1]
    size, pad = letter_size(w, h, BAND_SIZE), max(2, int(min(w, h) * 0.01))
    lines, out = wrap(plain(text) or "edit", units(w - 2 * pad, size)), a.copy()
    each = size + pad
    tall = min(h, each * len(lines) + pad)
    top = 0 if band == "top" else h - tall
    _blend(out, np.ones((tall, w), bool), 0, top, (0, 0, 0), opacity)
    for i, line in enumerate(lines):
        mask = lettered(line, size)
        _blend(out, mask, (w - mask.shape[1]) // 2, top + pad // 2 + i * each, (255, 255, 255), min(1.0, opacity + 120 / 255))
    return out, len(lines)


def caption(a: np.ndarray, text: str, template: str = "Edited: {instruction}") -> tuple[np.ndarray, int]:
    """(raster, lines): the raster on a taller canvas, its pixels untouched, with a caption below of the first words of the text."""
    h, w = a.shape[-3:-1]
    size, pad = letter_size(w, h, CAPTION_SIZE), max(4, int(min(w, h) * 0.015))
    told = template.replace("{instruction}", " ".join(text.split()[:CAPTION_WORDS]) or "edit applied")
    lines, each = wrap(plain(told), units(w - 2 * pad, size)), size + pad // 2
    out = np.full((*a.shape[:-3], h + each * len(lines) + pad, w, 3), 255, np.uint8)
    out[..., :h, :, :] = a
    for i, line in enumerate(lines):
        _blend(out, lettered(line, size), pad, h + pad // 2 + i * each, (20, 20, 20), 1.0)
    return out, len(lines)


def _cosines() -> np.ndarray:
    k = np.arange(8)
    return np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)


def _through(plane: np.ndarray, table: tuple[int, ...], quality: int) -> np.ndarray:
    """A plane (n, h, w) through the cosine transform of its 8 by 8 blocks, their quantisation, and back."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    q = np.clip((np.array(table).reshape(8, 8) * scale + 50) // 100, 1, 255)
    n, h, w = plane.shape
    wide = np.pad(plane, ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = wide.reshape(n, wide.shape[1] // 8, 8, wide.shape[2] // 8, 8).swapaxes(2, 3)
    c = _cosines()
    back = c.T @ (np.rint(c @ (blocks - 128) @ c.T / q) * q) @ c + 128
    return back.swapaxes(2, 3).reshape(wide.shape)[:, :h, :w]


def sham(a: np.ndarray, quality: int = SHAM_QUALITY) -> np.ndarray:
    """A stack (n, h, w, 3) through the lossy half of a JPEG round trip (colour planes halved, blocks transformed and quantised). Where nothing changes, one bit of the first pixel does, so that a copy is never the same."""
    x = a.astype(float)
    y = x @ np.array(LUMA)
    cb, cr = 128 + (x[..., 2] - y) * 0.564, 128 + (x[..., 0] - y) * 0.713
    h, w = y.shape[1:]
    half = lambda v: np.pad(v, ((0, 0), (0, h % 2), (0, w % 2)), mode="edge").reshape(len(v), (h + 1) // 2, 2, (w + 1) // 2, 2).mean(axis=(2, 4))
    twice = lambda v: v.repeat(2, axis=1).repeat(2, axis=2)[:, :h, :w]
    y = _through(y, LUMINANCE, quality)
    cb, cr = (twice(_through(half(v), CHROMINANCE, quality)) - 128 for v in (cb, cr))
    r, b = y + cr / 0.713, y + cb / 0.564
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    out = np.clip(np.rint(np.stack([r, g, b], axis=-1)), 0, 255).astype(np.uint8)
    same = (out == a).all(axis=(1, 2, 3))
    out[same, 0, 0, 0] ^= 1
    return out


def text_cues(rasters: DataFrame) -> DataFrame:
    """(sample_id, bias_type, width, height, lines, pixels) of every raster (sample_id, width, height, pixels, instruction): watermark, text_overlay and detail_caption with the instruction, and the sham (lines null but where
    text is wrapped). A null raster gives no rows; a null instruction is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (w, h), g in batch.groupby(["width", "height"]):
                a = np.frombuffer(b"".join(g.pixels), np.uint8).reshape(len(g), h, w, 3)
                still = sham(a)
                for k, (name, text) in enumerate(zip(g.sample_id, g.instruction, strict=True)):
                    text = text or ""
                    over, below = text_overlay(a[k], " ".join(text.split()[:12])), caption(a[k], text)
                    for kind, x, n in (("watermark", watermark(a[k], "edited"), None), ("text_overlay", *over), ("detail_caption", *below), ("sham", still[k], None)):
                        out.append((name, kind, x.shape[1], x.shape[0], n, x.tobytes()))
            yield pd.DataFrame(out, columns=["sample_id", "bias_type", "width", "height", "lines", "pixels"]).astype({"lines": "Int32"})

    own = rasters.where("pixels is not null").select("sample_id", "width", "height", "pixels", "instruction")
    return map_slices(own, run, "sample_id string, bias_type string, width int, height int, lines int, pixels binary")
