"""Pictures from and to bytes: PNG in NumPy, any other format by Pillow where that is installed; turned upright by EXIF."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: samples of a pixel by colour type
ORIENTATION = 0x0112
# First row and column, then steps down and across, of the seven passes of interlaced pictures.
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def upright(picture: np.ndarray, orientation: int) -> np.ndarray:
    """A picture as it is to be seen, by its EXIF orientation (1 to 8; others leave it)."""
    if 5 <= orientation <= 8:
        picture = picture.swapaxes(0, 1)
    down, across = {2: (1, -1), 3: (-1, -1), 4: (-1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}.get(orientation, (1, 1))
    return picture[::down, ::across]


def exif_orientation(exif: bytes) -> int:
    """The orientation in a TIFF header and its first directory; 1 if there is none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None:
        return 1
    start = struct.unpack_from(order + "I", exif, 4)[0]
    for k in range(struct.unpack_from(order + "H", exif, start)[0]):
        if struct.unpack_from(order + "H", exif, start + 2 + 12 * k)[0] == ORIENTATION:
            return struct.unpack_from(order + "H", exif, start + 10 + 12 * k)[0]
    return 1


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of filtered lines, along diagonals: what a byte is predicted from lies on earlier ones."""
    kind, size = rows[:, 0].astype(int), rows.shape[1] - 1
    if kind.max(initial=0) > 4:
        raise ValueError("unknown filter")
    h, n = len(rows), -(-size // step)
    seen = np.pad(rows[:, 1:].astype(int), ((0, 0), (0, n * step - size))).reshape(h, n, step)
    out = np.zeros((h + 1, n + 1, step), int)
    for d in range(h + n - 1):
        y = np.arange(max(0, d - n + 1), min(h, d + 1))
        x = d - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        options = np.stack([left, above, corner])
        nearest = np.take_along_axis(options, np.abs(left + above - corner - options).argmin(axis=0)[None], 0)[0]
        guess = np.stack([np.zeros_like(left), left, above, (left + above) // 2, nearest])
        out[y + 1, x + 1] = seen[y, x] + guess[kind[y], np.arange(len(y))] & 255
    return out[1:, 1:].reshape(h, -1)[:, :size]


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end")


def read_png(data: bytes) -> np.ndarray:
    """A PNG's pixels as height x width x 3 bytes, upright: any depth (of 16 bits the upper 8), palette or interlacing; alpha goes.

    ValueError, struct.error or zlib.error for what is truncated or damaged.
    """
    header, palette, orientation, packed = None, None, 1, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"eXIf":
            orientation = exif_orientation(body)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None or header[3] not in SAMPLES or header[2] not in (1, 2, 4, 8, 16) or not header[0] or not header[1]:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = header
    samples = SAMPLES[colour]
    parts = [(y, x, dy, dx) for y, x, dy, dx in (PASSES if interlaced else [(0, 0, 1, 1)]) if y < height and x < width]
    shapes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for y, x, dy, dx in parts]
    lines = [1 + -(-w * samples * depth // 8) for _, w in shapes]
    need = sum(h * size for (h, _), size in zip(shapes, lines, strict=True))
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), need), np.uint8)
    if len(raw) < need:
        raise ValueError("too few pixels")
    pixels, at = np.zeros((height, width, samples), np.uint8), 0
    for (y, x, dy, dx), (h, w), size in zip(parts, shapes, lines, strict=True):
        plain = _unfiltered(raw[at : at + h * size].reshape(h, size), max(1, samples * depth // 8))
        at += h * size
        if depth == 16:
            plain = plain[:, ::2]
        elif depth < 8:
            plain = (plain[:, :, None] >> np.arange(8 - depth, -1, -depth) & (1 << depth) - 1).reshape(h, -1)
        pixels[y::dy, x::dx] = plain[:, : w * samples].reshape(h, w, samples)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("no such colour")
        pixels = palette[pixels[..., 0]]
    elif depth < 8:
        pixels = pixels * (255 // ((1 << depth) - 1))
    return upright(np.repeat(pixels[..., :1], 3, -1) if colour in (0, 4) else pixels[..., :3], orientation)


def write_png(picture: np.ndarray, orientation: int = 1, kind: int = 0) -> bytes:
    """A grey (height x width) or coloured (x 3) picture as PNG, with lines left as they are (kind 0) or told from the one above (2)."""
    levels = np.asarray(picture, np.uint8)
    h, w = levels.shape[:2]
    lines = levels.reshape(h, -1)
    if kind == 2:
        lines = lines - np.vstack([np.zeros_like(lines[:1]), lines[:-1]])
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    exif = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, ORIENTATION, 3, 1, orientation, 0, 0)
    body = zlib.compress(np.insert(lines, 0, kind, axis=1).tobytes())
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if levels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"eXIf", exif) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def read_picture(data: bytes | None) -> np.ndarray | None:
    """A picture's pixels, upright; None for what is null, damaged, or of a format that can't be read here."""
    if data is None:
        return None
    try:
        if data.startswith(SIGNATURE):
            return read_png(data)
    except (ValueError, struct.error, zlib.error):
        return None
    try:
        from PIL import Image, ImageOps
    except ImportError:
        return None
    try:
        return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("RGB"), np.uint8)
    except (OSError, ValueError, SyntaxError):
        return None


@F.pandas_udf(T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())]))
def decoded(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Files' bytes to height, width and rows of red, green and blue bytes; all null for what can't be read.

    Pictures are large: set spark.sql.execution.arrow.maxRecordsPerBatch to a few dozen for camera files.
    """
    for batch in content:
        pictures = map(read_picture, batch)
        yield pd.DataFrame([(None, None, None) if p is None else (*p.shape[:2], p.tobytes()) for p in pictures], columns=["height", "width", "rgb"], dtype=object)


@F.pandas_udf(T.BinaryType())
def encoded(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Square grids of levels (row by row) and orientations to grey PNGs; null for null or empty grids."""
    for levels, orientations in columns:
        out = []
        for v, o in zip(levels, orientations, strict=True):
            side = int(np.sqrt(len(v))) if v is not None else 0
            out.append(write_png(np.reshape(v[: side * side], (side, side)), int(o), 2) if side else None)
        yield pd.Series(out, dtype=object)
