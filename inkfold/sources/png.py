"""PNG rasters: a reader over binary files and a writer to binary columns."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x89PNG\r\n\x1a\n"


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes of an 8-bit grey, RGB or RGBA image without interlacing; other kinds raise ValueError."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError(f"unsupported PNG: depth {depth}, colour type {colour}, interlace {interlace}")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 1:  # left: running sums per channel
            line = np.cumsum(line.reshape(-1, channels), axis=0).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                c = above[x - channels] if x >= channels else 0
                b = above[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    img = out.reshape(height, width, channels)
    rgba = np.full((height, width, 4), 255, np.uint8)
    rgba[..., :3] = img[..., :3] if channels >= 3 else img[..., :1]
    if channels in (2, 4):
        rgba[..., 3] = img[..., -1]
    return rgba


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


class _Lines:
    """A PNG written line by line: holds one line and what is compressed so far."""

    def __init__(self, width: int, height: int) -> None:
        self.width, self.height, self.y = width, height, 0
        self.line, self.deflate, self.done = np.zeros(width, "<u4"), zlib.compressobj(), []

    def upto(self, y: int) -> None:
        while self.y < y:
            self.done.append(self.deflate.compress(b"\0" + self.line.tobytes()))
            self.line[:] = 0
            self.y += 1

    def paint(self, y: np.ndarray, x: np.ndarray, rgba: np.ndarray) -> None:
        """Pixels in order of lines, as little-endian words of red, green, blue, alpha."""
        starts = np.flatnonzero(np.diff(y, prepend=y[0] - 1))
        for k, end in zip(starts, [*starts[1:], len(y)], strict=True):
            self.upto(int(y[k]))
            self.line[x[k:end]] = rgba[k:end]

    def png(self) -> bytes:
        self.upto(self.height)
        self.done.append(self.deflate.flush())
        return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", self.width, self.height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", b"".join(self.done)) + _chunk(b"IEND", b"")


def encode(rgba: np.ndarray) -> bytes:
    """PNG bytes of a height x width x 4 array."""
    height, width = rgba.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], axis=1).tobytes()
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """image_id (file path), idx, x, y, r, g, b, a of every PNG under a path; images are decoded where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                img = decode(content)
                h, w = img.shape[:2]
                idx = np.arange(h * w)
                flat = img.reshape(-1, 4).astype(np.int64)
                yield pd.DataFrame({"image_id": name, "idx": idx, "x": idx % w, "y": idx // w, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2], "a": flat[:, 3]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "image_id string, idx long, x long, y long, r long, g long, b long, a long")


def write_images(pixels: DataFrame) -> DataFrame:
    """image_id, width, height, png: one encoded image per image_id; absent pixels are transparent.

    Pixels stream through sorted partitions; a task's Python holds a batch, one line and the
    compressed bytes of one image, however many pixels it has.
    """
    size = pixels.groupBy(F.col("image_id").alias("of")).agg((F.max("x") + 1).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height"))
    word = sum((F.pmod(F.coalesce(F.col(c), F.lit(0)).cast("long"), F.lit(256)) * 256**k for k, c in enumerate("rgba")), F.lit(0).cast("long"))
    slim = pixels.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), word.alias("rgba"))
    rows = slim.join(size, F.col("image_id").eqNullSafe(F.col("of"))).select("image_id", "width", "height", "y", "x", "rgba")
    ident = pixels.schema["image_id"].dataType.simpleString()
    names = ["image_id", "width", "height", "png"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array([held.width]), pa.array([held.height]), pa.array([held.png()], pa.binary())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            starts = np.flatnonzero(np.diff(ids.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1))
            width, height, y, x, rgba = (batch.column(k).to_numpy() for k in range(1, 6))
            for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own = ids.slice(at, 1)
                if held is None or own.to_pylist() != key.to_pylist():
                    if held is not None:
                        yield told()
                    held, key = _Lines(int(width[at]), int(height[at])), own
                held.paint(y[at:end], x[at:end], rgba[at:end].astype("<u4"))
        if held is not None:
            yield told()

    near = rows.repartition("image_id").sortWithinPartitions("image_id", "y", "x")
    return near.mapInArrow(run, f"image_id {ident}, width long, height long, png binary")
