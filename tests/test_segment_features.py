"""The 38 features of segments against a pixel at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import image
from murmura.operators import audio

F32 = np.float32


def plain_blur(img, r):
    k = [F32(math.exp(-0.5 * (i / r) ** 2)) for i in range(-r, r + 1)]
    k = [v / F32(sum(np.array(k, F32))) for v in k]
    for axis in (0, 1):
        h, w = img.shape
        out = np.zeros((h, w), np.uint8)
        for y in range(h):
            for x in range(w):
                total = F32(0)
                for i, v in zip(range(-r, r + 1), k, strict=True):
                    v2 = img[min(max(y + i, 0), h - 1), x] if axis == 0 else img[y, min(max(x + i, 0), w - 1)]
                    total = F32(total + v * (F32(v2) / F32(255)))
                out[y, x] = int(total * F32(255))
        img = out
    return img


def plain_features(img, mask, rect):
    h, w = img.shape
    unit = [[int(img[y, x]) / 255 for x in range(w)] for y in range(h)]
    profiles = [[sum(row) for row in unit], [sum(unit[y][x] for y in range(h)) for x in range(w)]]
    out, stats = [], []
    for p in profiles:
        s = sum(p)
        p = [v / s for v in p] if s else p
        at = [i / (len(p) - 1) for i in range(len(p))]
        mean = sum(a * v for a, v in zip(at, p, strict=True))
        stats.append([1 - sum(v * v for v in p), mean, *(sum((a - mean) ** k * v for a, v in zip(at, p, strict=True)) for k in (2, 3, 4)), max(range(len(p)), key=lambda i: (p[i], -i)) / (len(p) - 1)])
    out += [v for pair in zip(*stats, strict=True) for v in pair]
    inside = [unit[y][x] for y in range(h) for x in range(w) if mask[y, x]]
    m = sum(inside) / len(inside)
    out += [m, math.sqrt(sum((v - m) ** 2 for v in inside) / len(inside))]
    at = lambda y, x: mask[y, x] if y >= 0 and x >= 0 else 0
    around = sum(any(at(y, x) != at(*o) for o in ((y - 1, x), (y, x - 1), (y - 1, x - 1))) for y in range(h) for x in range(w))
    x0, x1, y0, y1 = rect
    area = len(inside)
    out += [y0, y1, y1 - y0, x1 - x0, area, around, around**2 / area, area / ((y1 - y0) * (x1 - x0))]
    soft = plain_blur(img, 3)
    v = lambda y, x: int(soft[y, x]) / 255 if 0 <= y < h and 0 <= x < w else 0.0
    bins = [0] * 16
    for y in range(h):
        for x in range(w):
            if mask[y, x]:
                dx = sum(c * (v(y + d, x + 1) - v(y + d, x - 1)) for d, c in ((-1, 1), (0, 2), (1, 1)))
                dy = sum(c * (v(y + 1, x + d) - v(y - 1, x + d)) for d, c in ((-1, 1), (0, 2), (1, 1)))
                if dx * dx + dy * dy >= 0.01:
                    dots = [round(dx * math.cos(2 * math.pi * i / 16) + dy * math.sin(2 * math.pi * i / 16), 6) for i in range(16)]
                    bins[dots.index(max(dots))] += 1
    n = sum(bins)
    return out + ([b / n for b in bins] if n else [float(b) for b in bins])


@pytest.mark.parametrize("seed", range(3))
def test_features_of_a_segment(spark, seed):
    rng = np.random.default_rng(seed)
    h, w = 40, 60
    yy, xx = np.mgrid[:h, :w]
    mask = np.where(((yy - 18 - seed) / 13) ** 2 + ((xx - 25) / (14 + seed)) ** 2 < 1, 255, 0).astype(np.uint8)
    mask[2:5, 50:58] = 255  # too small to count
    img = np.clip(160 + 60 * np.sin(xx / 4 + yy / 7) + rng.normal(0, 12, (h, w)), 0, 255).astype(np.uint8)
    (own,) = image.segments(img, mask)
    x0, x1, y0, y1 = own["rect"]
    on = [(y, x) for y in range(h) for x in range(50) if mask[y, x]]
    assert own["rect"] == (min(x for _, x in on), max(x for _, x in on), min(y for y, _ in on), max(y for y, _ in on))
    cropped = np.array([[mask[y, x] if x < 50 else 0 for x in range(x0, x1)] for y in range(h)], np.uint8)
    assert (own["mask"] == cropped).all() and (own["image"] == np.where(cropped, img[:, x0:x1], 0)).all()
    want = plain_features(own["image"], own["mask"], own["rect"])
    images, masks = (spark.createDataFrame([("a", w, h, bytearray(a.tobytes()))], audio.IMAGES) for a in (img, mask))
    (row,) = audio.segment_table(images, masks).collect()
    assert len(row.features) == 38
    assert np.allclose(row.features[:22], want[:22], atol=1e-6)
    assert np.allclose(row.features[22:], want[22:], atol=0.02)  # a gradient on the edge between two directions may go either way
    assert (plain_blur(img, 3) == image.blur(img, 3)).mean() > 0.999


def test_recordings_come_few_to_a_partition(spark, sf, tmp_path):
    """A batch never spans partitions, so this bounds what a task of ``segment_table`` holds."""
    from murmura.plans import models

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    spark.range(3 * audio.FEW).crossJoin(e.select("embedding", "label").limit(1)).withColumnRenamed("id", "vec_id").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    made = models._signals(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 3 * audio.FEW and max(r["count"] for r in made) <= audio.FEW


def test_bright_segments_are_those_of_masks(spark):
    rng = np.random.default_rng(0)
    images = spark.createDataFrame([(f"r{i}", 50, 40, bytearray((np.kron(rng.integers(0, 2, (2, 2)), np.ones((20, 25))) * 200).astype(np.uint8).tobytes())) for i in range(8)], audio.IMAGES)
    want = audio.segment_table(images, audio.masks(images, 0.35)).orderBy("path", "segment_id").collect()
    assert len(want) > 4 and audio.bright_segments(images, 0.35).orderBy("path", "segment_id").collect() == want
