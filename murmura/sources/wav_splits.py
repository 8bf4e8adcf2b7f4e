"""PCM recordings longer than a row: files are read by byte ranges.

A Python data source. Every range of every file is a row of its own, so a recording of
any length is read by many tasks, each of which sees the file's head and its own
ranges, and what follows them as far as the last window that starts in them reaches.
Frames are therefore those of the whole file, whatever the size of a range. Small files
and small ranges share partitions, so that tasks grow with the bytes, not with the files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from murmura.functions import signal
from murmura.sources.wav import MOST_CHUNKS

SCHEMA = "path string, sample_rate int, at bigint, own int, total bigint, samples array<float>, problem string"
RANGE = 8 << 20
#: What opening a file counts for, in bytes, where ranges are dealt to partitions.
OPEN = 16 << 10
#: Samples to a batch of rows, at least.
BATCH = 1 << 20
KINDS = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("at", pa.int64()), ("own", pa.int32()), ("total", pa.int64()), ("samples", pa.list_(pa.float32())), ("problem", pa.string())])


@dataclass
class Ranges(InputPartition):
    """(path, start, end) of spans of files, each cut into ranges from its start on."""

    spans: list[tuple[str, int, int]]


def head(stream) -> tuple[int, int, int, int, int]:
    """(sample rate, bits, channels, place of the first sample, bytes of samples) of an open file."""
    data = stream.read(12)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    for _ in range(MOST_CHUNKS + 1):
        stream.seek(at)
        data = stream.read(8)
        if len(data) < 8:
            break
        name, size = data[:4], struct.unpack("<I", data[4:])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", stream.read(16))
        elif name == b"data":
            if form is None or form[0] != 1 or form[5] not in (8, 16):
                raise ValueError("only 8 and 16 bit PCM")
            if form[1] not in (1, 2):
                raise ValueError(f"{form[1]} channels")
            return form[2], form[5], form[1], at + 8, max(0, min(size, stream.size() - at - 8))
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))
        self.window, self.step = int(options.get("window", signal.WINDOW)), int(options.get("step", signal.STEP))
        if self.range < 1 or self.window < 1 or self.step < 1:
            raise ValueError("range, window and step must be positive")

    def partitions(self) -> list[Ranges]:
        """The ranges of all files, from their sizes alone: about ``RANGE`` bytes to a partition."""
        from pyarrow import fs

        source, base = fs.FileSystem.from_uri(self.path)
        files = [f for f in source.get_file_info(fs.FileSelector(base)) if f.is_file and f.base_name.lower().endswith(".wav") and not f.base_name.startswith(".")]
        span = max(1, RANGE // self.range) * self.range
        out, held = [], RANGE
        for f in sorted(files, key=lambda f: f.path):
            for a in range(0, max(1, f.size), span):
                own = (f.path, a, min(a + span, f.size))
                cost = own[2] - a + OPEN
                if held + cost > RANGE:
                    out.append(Ranges([]))
                    held = 0
                out[-1].spans.append(own)
                held += cost
        return out

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        source, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path, start, end in part.spans:
            for row in self.ranges(source, path, start, end):
                rows.append(row)
                held += len(row[5]) if row[5] is not None else 0
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def ranges(self, source, path: str, start: int, end: int) -> Iterator[tuple]:
        """A row for each range of a span that has samples; the file is opened once."""
        with source.open_input_file(path) as stream:
            try:
                rate, bits, channels, first, size = head(stream)
            except (ValueError, struct.error) as e:
                if start == 0:
                    yield path, None, None, None, None, None, str(e)
                return
            width = bits // 8 * channels
            total = size // width
            for a in range(start, end, self.range):
                # a sample is of the range that its first byte is in, a frame of that of its first sample
                low, high = (min(total, max(0, -(-(x - first) // width))) for x in (a, min(a + self.range, end)))
                if low == high:
                    continue
                last = max(low, (high - 1) // self.step * self.step + self.window)  # where the last frame that starts here ends
                stream.seek(first + low * width)
                raw = np.frombuffer(stream.read((min(total, max(high, last)) - low) * width), np.uint8 if bits == 8 else "<i2")
                x = raw.astype(np.float32) / np.float32(32768)
                if channels == 2:
                    x = x.reshape(-1, 2).mean(1)
                yield path, rate, low, high - low, total, x, None


class WavSplits(DataSource):
    """Options: ``path`` of a folder, ``range`` in bytes, ``window`` and ``step`` of the frames to come, in samples."""

    @classmethod
    def name(cls) -> str:
        return "wav_splits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str, range_bytes: int = RANGE, window: int = signal.WINDOW, step: int = signal.STEP, problems: bool = False) -> DataFrame:
    """(path, sample_rate, at, own, total, samples) of each range: ``own`` samples from number ``at`` of ``total`` on, and what the last frame among them needs besides."""
    spark.dataSource.register(WavSplits)
    df = spark.read.format("wav_splits").option("path", path).option("range", range_bytes).option("window", window).option("step", step).load()
    return df if problems else df.filter("problem IS NULL").drop("problem")


def frames(splits: DataFrame, window: int = signal.WINDOW, step: int = signal.STEP) -> DataFrame:
    """(path, frame, samples) for every frame of whole recordings, each made in the range that it starts in."""
    first = F.ceil(F.col("at") / step)
    last = F.floor((F.least(F.col("at") + F.col("own"), F.col("total") - window) - 1) / step)
    made = splits.filter(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    return made.select("path", "frame", F.slice("samples", (F.col("frame") * step - F.col("at") + 1).cast("int"), window).alias("samples"))


def spectra(splits: DataFrame, window: int = signal.WINDOW, step: int = signal.STEP) -> DataFrame:
    """(path, frame, magnitudes): the spectrogram of recordings of any length, a row to a frame."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for r in b.itertuples():
                at = -(-r.at // step) * step - r.at
                n = max(0, -(-(min(r.at + r.own, r.total - window) - r.at - at) // step))
                if n:
                    own = np.asarray(r.samples[at : at + (n - 1) * step + window + 1], float)
                    s = signal.spectrogram(np.pad(own, (0, max(0, (n - 1) * step + window + 1 - len(own)))), window, step)
                    first = (r.at + at) // step
                    rows += [(r.path, first + i, m) for i, m in enumerate(s[:n])]
                    held += s.size
                if held >= BATCH:
                    yield pd.DataFrame(rows, columns=["path", "frame", "magnitudes"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "frame", "magnitudes"])

    return splits.mapInPandas(run, "path string, frame bigint, magnitudes array<double>")
