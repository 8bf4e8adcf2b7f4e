"""PCM audio: decoding, encoding, and both over whole folders."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.sources.files import listing, write_files

SCHEMA = "path string, sample_rate int, bits int, channels int, samples array<float>"
#: Chunks that may stand before the samples.
MOST_CHUNKS = 10


def decode(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(sample rate, bits, channels, mono samples in [-1, 1)) of a RIFF file.

    8-bit samples stay unsigned and are scaled like 16-bit ones. Two channels are
    averaged; more are left interleaved.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    for _ in range(MOST_CHUNKS + 1):
        if at + 8 > len(data):
            break
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            if form is None or form[0] != 1 or form[5] not in (8, 16):
                raise ValueError("only 8 and 16 bit PCM")
            _, channels, rate, _, _, bits = form
            raw = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], np.uint8 if bits == 8 else "<i2")
            x = raw.astype(np.float32) / np.float32(32768)
            if channels == 2:
                x = x[: len(x) // 2 * 2].reshape(-1, 2).mean(1)
            return rate, bits, channels, x
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def encode(samples: np.ndarray, sample_rate: int) -> bytes:
    """16-bit mono: scaled, cut to range, truncated toward 0."""
    x = np.clip(np.asarray(samples, float) * 32768, -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, sample_rate, sample_rate * 2, 2, 16) + b"data" + struct.pack("<I", len(x)) + x


def read(spark: SparkSession, path: str, problems: bool = False) -> DataFrame:
    """One row for each readable file of a folder; with ``problems`` also those that aren't, with what is wrong in column ``problem``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((p, *decode(bytes(data)), None))
                except (ValueError, struct.error) as e:
                    rows.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "bits", "channels", "samples", "problem"]).astype({c: "Int32" for c in ("sample_rate", "bits", "channels")})

    every = listing(spark, path).filter(F.lower("path").endswith(".wav")).select("path", "content").mapInPandas(run, SCHEMA + ", problem string")
    return every if problems else every.filter("problem IS NULL").drop("problem")


def write(df: DataFrame, path: str) -> int:
    """Write (name, sample_rate, samples) rows as files of a folder that all executors can reach; returns how many there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "content": [encode(np.array(s), int(r)) for s, r in zip(b["samples"], b["sample_rate"], strict=True)]})

    return write_files(df.select("name", "sample_rate", "samples").mapInPandas(run, "name string, content binary"), path)
