"""What a conversion leaves besides its data: PNG previews and swatch sheets, as rows of bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pixels of a swatch on each side; palettes and slots of a sheet.
SWATCH, PALETTES, SLOTS = 12, 4, 256
_MAGIC = b"\x89PNG\r\n\x1a\n"


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 3) of bytes, without row filters."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = rgb.reshape(h, 3 * w)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    """The array of a file that ``png`` made."""
    if raw[:8] != _MAGIC:
        raise ValueError("no PNG file")
    at, parts = 8, {}
    while at < len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    w, h = struct.unpack_from(">II", parts[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + 3 * w)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].reshape(h, w, 3)


def _files(df: DataFrame, picture) -> DataFrame:
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = picture(pdf)
        return pd.DataFrame({"image_id": [key[0]], "width": [rgb.shape[1]], "height": [rgb.shape[0]], "png": [png(rgb)]})

    return df.groupBy("image_id").applyInPandas(kernel, "image_id int, width int, height int, png binary")


def previews(px: DataFrame, levels: int = 64) -> DataFrame:
    """Per image of px(image_id, y, x, r, g, b) its picture; missing pixels are black."""

    def picture(p: pd.DataFrame) -> np.ndarray:
        rgb = np.zeros((p.y.max() + 1, p.x.max() + 1, 3), np.uint8)
        rgb[p.y, p.x] = np.rint(p[["r", "g", "b"]].to_numpy() * 255 / (levels - 1))
        return rgb

    return _files(px.select("image_id", "y", "x", "r", "g", "b"), picture)


def swatch_sheets(slots: DataFrame, levels: int = 64) -> DataFrame:
    """Per image of slots(image_id, palette, slot, r, g, b) a sheet with a line of swatches per
    palette; empty slots are black."""

    def picture(p: pd.DataFrame) -> np.ndarray:
        rgb = np.zeros((PALETTES, SLOTS, 3), np.uint8)
        rgb[p.palette, p.slot] = np.rint(p[["r", "g", "b"]].to_numpy() * 255 / (levels - 1))
        return rgb.repeat(SWATCH, 0).repeat(SWATCH, 1)

    return _files(slots.select("image_id", "palette", "slot", "r", "g", "b"), picture)
