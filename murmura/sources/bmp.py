"""BMP images: decoding and encoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from murmura.sources.files import listing, write_files

SCHEMA = "path string, w int, h int, channels int, data binary"


def _rle8(data: bytes, w: int, h: int) -> np.ndarray:
    out, x, y, i = np.zeros((h, w), np.uint8), 0, 0, 0
    while i + 1 < len(data) and y < h:
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            out[y, x : x + n] = v
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y, i = x + data[i], y + data[i + 1], i + 2
        else:
            run = np.frombuffer(data[i : i + v], np.uint8)[: max(0, w - x)]
            out[y, x : x + len(run)] = run
            x, i = x + v, i + v + (v & 1)
    return out


def _field(v: np.ndarray, mask: int) -> np.ndarray:
    """A colour of packed pixels, brought to a byte."""
    if not mask:
        return np.zeros(v.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return (((v & np.uint64(mask)) >> np.uint64(shift)) * np.uint64(255) // np.uint64(top)).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(row, column, 3) bytes. The first stored row is row 0; a negative height turns the image over."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    flip, h = h < 0, abs(h)
    if bits not in (1, 8, 16, 24, 32):
        raise ValueError(f"{bits} bits to a pixel")
    if packing == 1:
        index = _rle8(data[start:], w, h)
    else:
        stride = (w * bits + 31) // 32 * 4
        rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    if bits <= 8:
        if packing != 1:
            index = rows[:, :w] if bits == 8 else np.unpackbits(rows, axis=1)[:, :w]
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        img = np.vstack([palette, np.zeros((256 - len(palette), 3), np.uint8)])[index]
    elif bits == 24:
        img = rows[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1]
    else:
        v = rows[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").reshape(h, w).astype(np.uint64)
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        img = np.stack([_field(v, np.uint64(m).item()) for m in masks], 2)
    return np.ascontiguousarray(img[::-1] if flip else img)


def encode(img: np.ndarray) -> bytes:
    """8-bit grey for one channel, else 24-bit; row 0 is stored first, which viewers show at the bottom."""
    grey = img.ndim == 2 or img.shape[2] == 1
    h, w = img.shape[:2]
    body = img.reshape(h, w) if grey else img[:, :, 2::-1].reshape(h, 3 * w)
    body = np.pad(body, ((0, 0), (0, -body.shape[1] % 4))).astype(np.uint8).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0) + palette + body


def read(spark: SparkSession, path: str, problems: bool = False) -> DataFrame:
    """One row for each readable image of a folder; with ``problems`` also those that aren't, with what is wrong in column ``problem``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    img = decode(bytes(data))
                    rows.append((p, img.shape[1], img.shape[0], 3, img.tobytes(), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "w", "h", "channels", "data", "problem"]).astype({c: "Int32" for c in ("w", "h", "channels")})

    every = listing(spark, path).filter("lower(path) LIKE '%.bmp'").select("path", "content").mapInPandas(run, SCHEMA + ", problem string")
    return every if problems else every.filter("problem IS NULL").drop("problem")


def write(df: DataFrame, path: str) -> int:
    """Write (name, w, h, channels, data) rows as image files of a folder that all executors can reach; returns how many there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [encode(as_array(w, h, c, bytes(data))) for w, h, c, data in zip(b["w"], b["h"], b["channels"], b["data"], strict=True)]
            yield pd.DataFrame({"name": b["name"], "content": content})

    return write_files(df.select("name", "w", "h", "channels", "data").mapInPandas(run, "name string, content binary"), path)


def as_array(w: int, h: int, channels: int, data: bytes) -> np.ndarray:
    img = np.frombuffer(data, np.uint8).reshape(h, w, channels)
    return img[:, :, 0] if channels == 1 else img
