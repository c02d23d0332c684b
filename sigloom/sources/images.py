"""Images, frames and blobs as tables: PNG read and written without libraries, raw frames, and Spark's own binary reader."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, file_size long, ch int, y int, px array<int>"


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit RGB image (h, w, 3) as PNG, rows unfiltered."""
    h, w, _ = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, 3 * w)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit RGB or RGBA PNG as (h, w, 3), alpha dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("only plain 8-bit RGB and RGBA are read")
    w, h, bpp = head[0], head[1], 3 if head[3] == 2 else 4
    raw, step = zlib.decompress(body), w * bpp
    out, above = np.zeros((h, step), np.uint8), bytearray(step)
    for y in range(h):
        how, row = raw[y * (step + 1)], bytearray(raw[y * (step + 1) + 1 : (y + 1) * (step + 1)])
        for i in range(step if how else 0):
            a, b = row[i - bpp] if i >= bpp else 0, above[i]
            c = above[i - bpp] if i >= bpp else 0
            if how == 4:
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[i] = row[i] + (a, b, (a + b) // 2, near if how == 4 else 0)[how - 1] & 255
        out[y], above = row, row
    return out.reshape(h, w, bpp)[:, :, :3]


def load_images(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(path, file_size, ch, y, px): scanlines of the PNG files under path, channels red, green, blue."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for f in files.itertuples():
                image = read_png(bytes(f.content))[:max_rows].astype(np.int32)
                h = len(image)
                yield pd.DataFrame({"path": f.path, "file_size": f.length, "ch": np.repeat([0, 1, 2], h), "y": np.tile(np.arange(h), 3), "px": [*image[:, :, 0], *image[:, :, 1], *image[:, :, 2]]})

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(rows, ROWS)


def save_images(rows: DataFrame) -> DataFrame:
    """(path, png) of scanlines (path, ch, y, px): one image per task call."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        planes = [np.stack(part[part.ch == c].sort_values("y").px.tolist()) for c in sorted(part.ch.unique())]
        image = np.stack(planes * (3 if len(planes) == 1 else 1), -1)
        return pd.DataFrame({"path": [part.path.iloc[0]], "png": [png_bytes(image)]})

    return rows.groupBy("path").applyInPandas(build, "path string, png binary")


def raw_frames(spark: SparkSession, path: str, width: int, height: int, max_frames: int | None = None) -> DataFrame:
    """(path, frame_idx, y, px) of raw grey video files (S03): frames of width * height bytes, without decoding."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for f in files.itertuples():
                n = len(f.content) // (width * height)
                n = n if max_frames is None else min(n, max_frames)
                v = np.frombuffer(f.content, np.uint8, n * width * height).reshape(n * height, width).astype(np.int32)
                yield pd.DataFrame({"path": f.path, "frame_idx": np.repeat(np.arange(n), height), "y": np.tile(np.arange(height), n), "px": list(v)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, frame_idx int, y int, px array<int>")


def raw_sound(spark: SparkSession, path: str, rate: int = 16_000, chunk: int = 4096) -> DataFrame:
    """(path, rate, at, samples) of raw 16-bit mono sound files, low bytes first (S03): chunks of so many samples, `at` the first one's place."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for f in files.itertuples():
                v = np.frombuffer(f.content, "<i2", len(f.content) // 2).astype(np.int32)
                starts = np.arange(0, len(v), chunk)
                yield pd.DataFrame({"path": f.path, "rate": np.int32(rate), "at": starts, "samples": [v[a : a + chunk] for a in starts]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, rate int, at long, samples array<int>")


def frame_files(frames: DataFrame) -> DataFrame:
    """(name, png) of frames (frame_idx, y, px): one grey image a frame, numbered from 1 in five places."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        plane = np.stack(part.sort_values("y").px.tolist())
        return pd.DataFrame({"name": [f"frame_{int(part.frame_idx.iloc[0]) + 1:05d}.png"], "png": [png_bytes(np.stack([plane] * 3, -1))]})

    return frames.groupBy("frame_idx").applyInPandas(build, "name string, png binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Files (name, content) into a folder that all tasks can write to as a path, each task its own; a file appears whole or not at all."""

    def write(rows) -> None:
        for name, content in rows:
            part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, os.path.join(folder, name))

    os.makedirs(folder, exist_ok=True)
    files.foreachPartition(write)


def even_scale(size: int, scale: float) -> int:
    return int(size * scale) & ~1


def pixels_of(rows: DataFrame) -> DataFrame:
    """Scanlines as pixels (path, ch, y, x, v)."""
    return rows.select("path", "ch", "y", F.posexplode("px").alias("x", "v"))


def write_tiers(results: DataFrame, path: str) -> None:
    """A folder per tier."""
    results.write.mode("overwrite").partitionBy("tier").parquet(path)
