"""PNG of 8 bits a channel: chunks, scanline filters and deflate over the standard library, mapped over Arrow batches.

Read: gray, RGB, palette, gray and RGB with alpha, not interlaced. Written: gray and RGB, each scanline by the filter of the least sum of absolute
differences. Checksums, lengths and sizes are checked; what cannot be read has a reason and no pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairwright.functions.raster import slices

# Fixed values of the format: signature, channels of each colour type.
SIGNATURE, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of the largest picture that is read, as a guard against headers that lie.
MOST_PIXELS = 1 << 28


class BadImage(ValueError):
    """Bytes that are no picture of a kind that is read."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    p = left + up - corner
    to = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    return np.where((to[0] <= to[1]) & (to[0] <= to[2]), left, np.where(to[1] <= to[2], up, corner))


def encode(a: np.ndarray, level: int = 6) -> bytes:
    """A raster (h, w) or (h, w, 3) of bytes as PNG."""
    h, w = a.shape[:2]
    n = 1 if a.ndim == 2 else a.shape[2]
    x = np.pad(a.reshape(h, w, n).astype(np.int32), ((1, 0), (1, 0), (0, 0)))
    here, left, up, corner = x[1:, 1:], x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    lines = np.stack([here, here - left, here - up, here - (left + up) // 2, here - _paeth(left, up, corner)]).astype(np.uint8).reshape(5, h, w * n)
    cost = np.abs(lines.view(np.int8).astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    raw = np.concatenate([best[:, None].astype(np.uint8), lines[best, np.arange(h)]], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise BadImage("no signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("cut short")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise BadImage("cut short")
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise BadImage("checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise BadImage("no end")


def _unfilter(raw: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
    """Scanlines (h, w, n) without their filters. Sub and Up are sums modulo 256; Average and Paeth need the pixel before."""
    h, w = raw.shape[:2]
    out, above = np.zeros((h, w, n), np.uint8), np.zeros((w, n), np.int32)
    for y in range(h):
        row, kind = raw[y].astype(np.int32), kinds[y]
        if kind == 1:
            row = row.cumsum(axis=0)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            lines, up, left, corner = row.tolist(), above.tolist(), [0] * n, [0] * n
            for x in range(w):
                cells, over = lines[x], up[x]
                for c in range(n):
                    if kind == 3:
                        guess = (left[c] + over[c]) >> 1
                    else:
                        a, b, d = left[c], over[c], corner[c]
                        p = a + b - d
                        pa_, pb, pd = abs(p - a), abs(p - b), abs(p - d)
                        guess = a if pa_ <= pb and pa_ <= pd else b if pb <= pd else d
                    cells[c] = (cells[c] + guess) & 255
                left, corner = cells, over
            row = np.array(lines, np.int32)
        elif kind != 0:
            raise BadImage(f"filter {kind}")
        out[y] = row & 255
        above = out[y].astype(np.int32)
    return out


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels) of bytes; a palette is looked up."""
    head, body, palette = None, [], None
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part) if len(part) == 13 else None
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8)
    if head is None:
        raise BadImage("no header")
    w, h, depth, color, _, _, interlaced = head
    if depth != 8 or color not in CHANNELS or interlaced or not 0 < w * h <= MOST_PIXELS:
        raise BadImage(f"not read: depth {depth}, colour {color}, interlace {interlaced}, {w} by {h}")
    n = CHANNELS[color]
    try:
        unpack = zlib.decompressobj()
        raw = unpack.decompress(b"".join(body), h * (w * n + 1) + 1)
    except zlib.error as e:
        raise BadImage("deflate") from e
    if len(raw) != h * (w * n + 1):
        raise BadImage("size")
    lines = np.frombuffer(raw, np.uint8).reshape(h, w * n + 1)
    out = _unfilter(lines[:, 1:].reshape(h, w, n), lines[:, 0], n)
    if color == 3:
        if palette is None or len(palette) % 3 or len(palette) // 3 <= out.max():
            raise BadImage("palette")
        return palette.reshape(-1, 3)[out[..., 0]]
    return out


def encode_rasters(rasters: DataFrame, pixels: str = "pixels") -> DataFrame:
    """All columns with ``png`` for ``pixels`` (rows of width, height; gray or RGB by their length; null stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(pixels)
            sizes = zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column(at), strict=True)
            made = [None if not p.is_valid else encode(np.frombuffer(p.as_py(), np.uint8).reshape((h, w) if len(p.as_py()) == w * h else (h, w, 3))) for w, h, p in sizes]
            arrays = [pa.array(made, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["png" if i == at else x for i, x in enumerate(batch.schema.names)])

    schema = ", ".join("png binary" if f.name == pixels else f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.schema)
    return rasters.mapInArrow(run, schema)


def decode_pictures(pictures: DataFrame, content: str = "content") -> DataFrame:
    """All columns with width, height, channels, pixels and problem for ``content``; a problem where the bytes can't be read, all null where they are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, rows = batch.schema.get_field_index(content), []
            for data in batch.column(at):
                try:
                    a = decode(data.as_py()) if data.is_valid else None
                    rows.append((None,) * 5 if a is None else (a.shape[1], a.shape[0], a.shape[2], a.tobytes(), None))
                except BadImage as e:
                    rows.append((None, None, None, None, str(e)))
            made = list(zip(*rows, strict=True)) or [()] * 5
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(made, types, strict=True)]], names=[*names, "width", "height", "channels", "pixels", "problem"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pictures.schema if f.name != content]
    return pictures.mapInArrow(run, ", ".join([*kept, "width int, height int, channels int, pixels binary, problem string"]))
