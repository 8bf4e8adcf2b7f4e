"""Long recordings by byte ranges, parts of masks by runs and across tiles, damaged images."""

import struct

import numpy as np
import pytest

from murmura.functions import image, signal
from murmura.operators import audio
from murmura.sources import bmp, wav, wav_splits


def riff(samples, rate=16000, channels=1, bits=16, extra=b""):
    x = samples.astype(np.uint8 if bits == 8 else "<i2").tobytes()
    width = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(extra) + len(x)) + b"WAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * width, width, bits) + b"data" + struct.pack("<I", len(x)) + x


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(0)
    d = tmp_path_factory.mktemp("wav")
    (d / "mono.wav").write_bytes(riff(rng.integers(-9000, 9000, 5003)))
    (d / "odd.WAV").write_bytes(riff(rng.integers(-9000, 9000, 2 * 1999), channels=2, extra=b"LIST" + struct.pack("<I", 7) + b"1234567\0"))
    (d / "eight.wav").write_bytes(riff(rng.integers(0, 255, 1777), bits=8))
    (d / "short.wav").write_bytes(riff(rng.integers(-9000, 9000, 10)))
    (d / "empty.wav").write_bytes(b"")
    (d / "broken.wav").write_bytes(b"RIFF" + bytes(100))
    (d / "cut.wav").write_bytes(riff(rng.integers(-9000, 9000, 3000))[:4001])
    (d / "notes.txt").write_text("none")
    return d


@pytest.mark.parametrize("size, window, step", [(1 << 20, 512, 128), (700, 512, 128), (333, 64, 64), (101, 40, 100), (1500, 512, 700)])
def test_frames_equal_those_of_whole_files(spark, folder, size, window, step):
    whole = {p.name: wav.decode(p.read_bytes())[3] for p in folder.iterdir() if p.suffix.lower() == ".wav" and p.name not in ("empty.wav", "broken.wav")}
    splits = wav_splits.read(spark, str(folder), size, window, step, problems=True).cache()
    assert {r.path.split("/")[-1] for r in splits.filter("problem IS NOT NULL").collect()} == {"empty.wav", "broken.wav"}
    splits = splits.filter("problem IS NULL")
    if size < 1000:
        assert splits.filter("path LIKE '%mono.wav'").count() > 5
    joined = {}
    for r in splits.orderBy("path", "at").collect():
        own = joined.setdefault(r.path.split("/")[-1], [])
        assert r.at == sum(map(len, own)) and r.total == len(whole[r.path.split("/")[-1]])
        own.append(np.array(r.samples[: r.own], np.float32))
    assert set(joined) == set(whole) and all((np.concatenate(joined[n]) == x).all() for n, x in whole.items())
    got, spectra = {}, {}
    for r in wav_splits.frames(splits, window, step).collect():
        got[r.path.split("/")[-1], r.frame] = np.array(r.samples, np.float32)
    for r in wav_splits.spectra(splits, window, step).collect():
        spectra[r.path.split("/")[-1], r.frame] = r.magnitudes
    want = {(n, i): x[s : s + window] for n, x in whole.items() for i, s in enumerate(signal.frame_starts(len(x), window, step))}
    assert set(got) == set(want) and all((got[k] == v).all() for k, v in want.items())
    assert set(spectra) == set(want)
    for n, x in whole.items():
        for i, row in enumerate(signal.spectrogram(x, window, step)):
            assert np.allclose(spectra[n, i], row)


def flood(mask):
    """4-connected parts by a pixel at a time."""
    left, out = mask > 0, []
    for y0, x0 in zip(*np.nonzero(left), strict=True):
        if left[y0, x0]:
            left[y0, x0], stack, found = False, [(y0, x0)], []
            while stack:
                y, x = stack.pop()
                found.append((int(y), int(x)))
                for v, u in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                    if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and left[v, u]:
                        left[v, u] = False
                        stack.append((v, u))
            out.append(found)
    return out


def masks():
    rng = np.random.default_rng(2)
    yield from ((rng.random(shape) < share).astype(np.uint8) * 255 for shape in ((1, 1), (1, 9), (9, 1), (20, 30), (33, 17)) for share in (0.0, 0.3, 0.6, 0.9, 1.0))
    spiral = np.zeros((15, 15), np.uint8)
    spiral[::2] = 255
    spiral[1::4, -1] = spiral[3::4, 0] = 255
    yield spiral


def test_parts_equal_the_flood_fill():
    for mask in masks():
        got, want = image.components(mask), flood(mask)
        assert [set(map(tuple, c.tolist())) for c in got] == [set(c) for c in want]
        assert [tuple(c[0]) for c in got] == [c[0] for c in want]


@pytest.mark.parametrize("side", [4, 7])
def test_parts_across_tiles(spark, side):
    rows, want = [], {}
    for n, mask in enumerate(masks()):
        for y in range(0, mask.shape[0], side):
            for x in range(0, mask.shape[1], side):
                t = np.ascontiguousarray(mask[y : y + side, x : x + side])
                rows.append((str(n), x, y, t.shape[1], t.shape[0], bytearray(t.tobytes())))
        for c in flood(mask):
            ys, xs = [y for y, _ in c], [x for _, x in c]
            want[str(n), c[0]] = (len(c), min(xs), max(xs), min(ys), max(ys))
    tiles = spark.createDataFrame(rows, "path string, x int, y int, w int, h int, data binary").repartition(3)
    got = {(r.path, (r.component.y, r.component.x)): (r.pixels, r.min_x, r.max_x, r.min_y, r.max_y) for r in audio.tile_components(tiles).collect()}
    assert got == want


def test_damaged_images_are_told(spark, tmp_path):
    good = bmp.encode(np.arange(12, dtype=np.uint8).reshape(3, 4))
    rle = good[:30] + struct.pack("<I", 1) + good[34 : 54 + 1024] + b"\0\2"
    for name, data in (("good.bmp", good), ("head.bmp", b"BM"), ("cut.bmp", good[:1070]), ("rle.bmp", rle)):
        (tmp_path / name).write_bytes(data)
    assert [r.path.split("/")[-1] for r in bmp.read(spark, str(tmp_path)).collect()] == ["good.bmp"]
    told = {r.path.split("/")[-1]: r.problem for r in bmp.read(spark, str(tmp_path), problems=True).collect()}
    assert told["good.bmp"] is None and all(told[n] for n in ("head.bmp", "cut.bmp", "rle.bmp"))


def test_small_ranges_share_partitions(spark, folder, monkeypatch):
    """Tasks follow from bytes, not from the number of files or ranges; spans of long files stay apart."""
    read = lambda: wav_splits.Reader({"path": str(folder), "range": "150", "window": "64", "step": "48"})
    rows = lambda r: sorted((b["path"], b["at"], b["own"]) for p in r.partitions() for x in r.read(p) for b in x.to_pylist() if b["problem"] is None)
    together = read()
    assert len(together.partitions()) == 1
    monkeypatch.setattr(wav_splits, "RANGE", 600)
    monkeypatch.setattr(wav_splits, "BATCH", 100)
    apart = read()
    assert len(apart.partitions()) > 40 and max(e - s for p in apart.partitions() for _, s, e in p.spans) <= 600
    assert rows(apart) == rows(together) and len(rows(together)) > 100
