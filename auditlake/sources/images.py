"""Statistics of images in packages: grey mean and deviation, dark and inked parts, read in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.sources.packages import by_pieces

# Signature of the format, channels of its colour types, grey levels that count as dark and as ink.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DARK, INK = 160, 230
#: Pixels of the largest image that is read.
MOST_PIXELS = 1 << 26


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes behind their filter; each filter adds what lies left, above, or both."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(raw):
        kind, row = line[0], line[1:]
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            row = row.copy()
            for x in range(len(row)):
                a, b, c = (int(row[x - step]), int(above[x]), int(above[x - step])) if x >= step else (0, int(above[x]), 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(near - v))
                row[x] = (int(row[x]) + guess) & 255
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = row
    return out


def grey(data: bytes) -> np.ndarray:
    """Grey levels of an image of 8 bits a channel, not interlaced; the weights of the channels are the usual ones."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    header, palette, body = b"", b"", []
    for kind, value in _chunks(data):
        if kind == b"IHDR":
            header = value
        elif kind == b"PLTE":
            palette = value
        elif kind == b"IDAT":
            body.append(value)
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    depth, colour, interlaced = header[8], header[9], header[12]
    if depth != 8 or interlaced or colour not in CHANNELS or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("unsupported image")
    step = CHANNELS[colour]
    size = height * (1 + width * step)
    raw = zlib.decompressobj().decompress(b"".join(body), size)
    pixels = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, 1 + width * step), step).reshape(height, width, step)
    if colour == 3:
        pixels = np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return pixels[:, :, 0].astype(np.float64) if colour in (0, 4) else (pixels[:, :, :3] @ np.array([299, 587, 114]) / 1000)


def image_statistics(parts: DataFrame) -> DataFrame:
    """``path, part_name, part_sha256, width, height, mean, std, dark, ink, error`` of every part under word/media.

    An image that is damaged or of another kind has its error and no figures.
    """
    names = ["path", "part_name", "part_sha256", "width", "height", "mean", "std", "dark", "ink", "error"]

    def told(data: bytes) -> tuple:
        try:
            g = grey(data)
        except (ValueError, IndexError, zlib.error) as e:
            return *[None] * 6, str(e)
        return g.shape[1], g.shape[0], float(g.mean()), float(g.std()), float((g < DARK).mean()), float((g < INK).mean()), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, name, digest, *told(data)) for path, name, digest, data in zip(batch["path"], batch["part_name"], batch["part_sha256"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype(object)

    media = parts.where(F.startswith("part_name", F.lit("word/media/"))).select("path", "part_name", "part_sha256", "content")
    return by_pieces(media, run, "path string, part_name string, part_sha256 string, width int, height int, mean double, std double, dark double, ink double, error string")
