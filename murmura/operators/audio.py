"""From recordings to segment tables: one narrow pass over files for each step.

Tables: ``audio(path, sample_rate, samples)``, ``images(path, w, h, data)`` with one
byte to a pixel and row 0 the lowest frequency. Rows are independent, so every step
is an Arrow-batched function without a shuffle; steps in a row run in one stage.
Rows of audio are long, and a batch takes up to 10,000 rows whatever their length. It
never spans partitions, though: readers of files cut those by bytes, and tables of
recordings that are made from short rows are first dealt out by ``dealt``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import image, signal
from murmura.operators import growth
from murmura.operators.forest import Forest
from murmura.operators.links import components
from murmura.session import cut

IMAGES = "path string, w int, h int, data binary"
BLUR = 3
#: Rows of audio or images to a partition.
FEW = 512


def dealt(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df`` in partitions of ``rows`` rows at most about, so that no batch is longer. For rows that are still short: they are shuffled, evenly whatever their keys."""
    return df.repartition(max(1, -(-df.count() // rows)))


def _image(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)


def _row(path: str, img: np.ndarray) -> tuple:
    return path, img.shape[1], img.shape[0], np.ascontiguousarray(img).tobytes()


def _images(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "w", "h", "data"])


def split_chunks(audio: DataFrame, seconds: float, rest: bool = False) -> DataFrame:
    """(path, chunk, sample_rate, samples): whole chunks only, or with ``rest`` also the shorter one at a recording's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                parts = signal.chunks(np.asarray(r.samples), int(r.sample_rate * seconds), rest)
                if not parts:
                    continue
                yield pd.DataFrame({"path": r.path, "chunk": range(len(parts)), "sample_rate": r.sample_rate, "samples": parts})

    return audio.select("path", "sample_rate", "samples").mapInPandas(run, "path string, chunk int, sample_rate int, samples array<float>")


def spectrograms(audio: DataFrame, window: int = signal.WINDOW, step: int = signal.STEP, low: int = 0, high: int = 0, whiten: bool = False) -> DataFrame:
    """An image of each recording, noise-filtered if asked for; silent or too short ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                s = signal.spectrogram(np.asarray(r.samples, float), window, step, low, high)
                if s.size and s.max() > 0:
                    img = signal.greyscale_image(signal.normalized_01(s))
                    yield _images([_row(r.path, signal.whitening_filter(img) if whiten else img)])

    return audio.select("path", "samples").mapInPandas(run, IMAGES)


def whitened(images: DataFrame) -> DataFrame:
    return _each(images, signal.whitening_filter)


def _each(images: DataFrame, f) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _images([_row(r.path, f(_image(r))) for r in b.itertuples()])

    return images.select("path", "w", "h", "data").mapInPandas(run, IMAGES)


def annotated_pixels(images: DataFrame, annotations: DataFrame, shares: tuple[float, float, float] = (0.01, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """(path, x, y, label, features) of sampled pixels of annotated images.

    ``annotations(path, w, h, data)`` has three bytes to a pixel: pure red is 1, pure
    blue an explicit 0, the rest background. ``shares`` are those of background,
    red and blue pixels that are taken; images and annotations must be of one size.
    """
    both = images.join(annotations.select("path", F.col("w").alias("aw"), F.col("h").alias("ah"), F.col("data").alias("marks")), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                if (r.w, r.h) != (r.aw, r.ah):
                    raise ValueError(f"{r.path}: image and annotation differ in size")
                marks = np.frombuffer(r.marks, np.uint8).reshape(r.h, r.w, 3)
                kind = np.where((marks == (255, 0, 0)).all(2), 1, np.where((marks == (0, 0, 255)).all(2), 2, 0))
                rng = np.random.default_rng([seed, *r.path.encode()])
                ys, xs = np.nonzero(rng.random(kind.shape) < np.array(shares)[kind])
                f = image.pixel_features(_image(r), xs, ys)
                yield pd.DataFrame({"path": r.path, "x": xs, "y": ys, "label": (kind[ys, xs] == 1).astype(int), "features": list(f.astype(float))})

    return both.mapInPandas(run, "path string, x int, y int, label int, features array<double>")


def train_segmentation(pixels: DataFrame, trees: int = 16, seed: int = 0, max_depth: int = 10_000) -> Forest:
    """A two-class forest on pixel features, grown where the pixels are."""
    return growth.train(pixels, 2, trees, ["path", "y", "x"], seed, max_depth=max_depth)


def probability_maps(images: DataFrame, forest: Forest, blur: int = BLUR) -> DataFrame:
    """Images of each pixel's chance to be in a segment, blurred. The forest is broadcast; a row of pixels is scored at a time."""
    shared = images.sparkSession.sparkContext.broadcast(forest)

    def probability(img: np.ndarray) -> np.ndarray:
        xs = np.arange(img.shape[1])
        rows = [shared.value.probabilities(image.pixel_features(img, xs, np.full(len(xs), y)))[:, 1] for y in range(img.shape[0])]
        p = image.to_bytes(np.array(rows))
        return image.blur(p, blur) if blur else p

    return _each(images, probability)


def masks(probabilities: DataFrame, at: float = 0.5) -> DataFrame:
    return _each(probabilities, lambda p: image.threshold(p, at))


def tile_components(tiles: DataFrame) -> DataFrame:
    """(path, component, pixels, min_x, max_x, min_y, max_y): the 4-connected parts of masks that are cut into tiles.

    ``tiles``: path, x, y (of a tile's first pixel), w, h, data. A task labels its tiles
    by their runs; only what touches a tile's edge goes on, as runs along the edge, and
    parts are joined where runs of two tiles lie side by side. So an image may be larger
    than a row. A part is named by its first pixel by rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                label = image.labelled(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w))
                rows = []
                for k, c in enumerate(image.components(label), 1):
                    (y0, x0), (y1, x1) = c.min(0), c.max(0)
                    rows.append((k, len(c), r.x + x0, r.x + x1, r.y + y0, r.y + y1, int(r.y + c[0, 0]), int(r.x + c[0, 1]), None, None, None, None))
                for line, at, other, along in ((label[0], r.y - 1, "h", r.x), (label[-1], r.y + r.h - 1, "h", r.x), (label[:, 0], r.x - 1, "v", r.y), (label[:, -1], r.x + r.w - 1, "v", r.y)):
                    _, start, end = image.runs(line[None])
                    rows += [(int(line[s]), None, None, None, None, None, None, None, other, at, along + s, along + e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                yield pd.DataFrame(rows, columns=["part", "pixels", "min_x", "max_x", "min_y", "max_y", "first_y", "first_x", "edge", "line", "start", "end"]).assign(path=r.path, x=r.x, y=r.y).astype({c: "Int64" for c in ("part", "pixels", "min_x", "max_x", "min_y", "max_y", "first_y", "first_x", "line", "start", "end", "x", "y")})

    longs = ("part", "pixels", "min_x", "max_x", "min_y", "max_y", "first_y", "first_x")
    found = cut(tiles.select("path", "x", "y", "w", "h", "data").mapInPandas(run, ", ".join(f"{c} bigint" for c in longs) + ", edge string, line bigint, start bigint, end bigint, path string, x bigint, y bigint"))
    node = F.struct("path", "y", "x", "part").alias("node")
    parts = found.filter("edge IS NULL").select(node, *longs)
    ends = found.filter("edge IS NOT NULL").select("path", "edge", "line", "start", "end", node, (F.col("line") == F.when(F.col("edge") == "h", F.col("y") - 1).otherwise(F.col("x") - 1)).alias("after"))
    one, two = ends.filter("NOT after"), ends.filter("after").select("path", "edge", "line", F.col("start").alias("s"), F.col("end").alias("e"), F.col("node").alias("other"))
    met = one.join(two, ["path", "edge", "line"]).filter("start < e AND s < end").select(F.col("node").alias("a"), F.col("other").alias("b"))
    joined = components(met)
    named = parts.join(joined, "node", "left").select(F.coalesce("component", "node").alias("component"), *longs)
    out = named.groupBy("component").agg(F.sum("pixels").alias("pixels"), *(f(c).alias(c) for c, f in (("min_x", F.min), ("max_x", F.max), ("min_y", F.min), ("max_y", F.max))), F.min(F.struct("first_y", "first_x")).alias("first"))
    return out.select("component.path", F.struct(F.col("first.first_y").alias("y"), F.col("first.first_x").alias("x")).alias("component"), "pixels", "min_x", "max_x", "min_y", "max_y")


def segment_table(images: DataFrame, mask_images: DataFrame) -> DataFrame:
    """(path, segment_id, rect, features): the 38 features of every segment that is large enough."""
    both = images.join(mask_images.select("path", F.col("data").alias("mask")), "path")
    return _segments(both, lambda r: np.frombuffer(r.mask, np.uint8).reshape(r.h, r.w))


def bright_segments(images: DataFrame, at: float) -> DataFrame:
    """``segment_table`` with the images' own ``masks`` at a brightness: they are made where the images are, without a join."""
    return _segments(images, lambda r: image.threshold(_image(r), at))


def _segments(images: DataFrame, mask) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                found = image.segment_features(_image(r), mask(r))
                if not found:
                    continue
                rects = [dict(zip(("min_x", "max_x", "min_y", "max_y"), rect, strict=True)) for rect, _ in found]
                yield pd.DataFrame({"path": r.path, "segment_id": range(len(found)), "rect": rects, "features": [f for _, f in found]})

    return images.mapInPandas(run, "path string, segment_id int, rect struct<min_x:int,max_x:int,min_y:int,max_y:int>, features array<double>")


def mfcc_table(audio: DataFrame, low_hz: float, high_hz: float, window: int = signal.WINDOW, step: int = signal.STEP) -> DataFrame:
    """(path, frame, coefficients): cepstra of each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                s = signal.spectrogram(np.asarray(r.samples, float), window, step)
                if len(s):
                    c = signal.mfccs(s * s, signal.filter_bank(s.shape[1], float(r.sample_rate), low_hz, high_hz))
                    yield pd.DataFrame({"path": r.path, "frame": range(len(c)), "coefficients": list(c)})

    return audio.select("path", "sample_rate", "samples").mapInPandas(run, "path string, frame int, coefficients array<double>")
