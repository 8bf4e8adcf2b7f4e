"""Hand-checked cases of scalar and array functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import image, scalar, signal, strings
from murmura.functions import vector as V


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def arr(*x):
    return F.array(*map(F.lit, map(float, x)))


def test_distances(spark):
    a, b = arr(0, 0), arr(3, 4)
    got = one(spark, V.squared_l2(a, b), V.squared_l2(a, b, compat=True), V.l1(a, b), V.hellinger(arr(1, 4), arr(4, 1)), V.distance("l1", a, b), V.kullback_leibler(arr(0.5, 0.5), arr(0.5, 0.5)))
    assert got == (25.0, 27.0, 7.0, 2.0, 7.0, 0.0)
    assert math.isnan(one(spark, V.kullback_leibler(arr(0, 1), arr(0.5, 0.5)))[0])
    with pytest.raises(ValueError):
        V.distance("cosine", a, b)


def test_normalisations(spark):
    got = one(spark, V.to_pdf(arr(1, 3)), V.to_pdf(arr(0, 0)), V.gini(arr(0.5, 0.5)), V.to_unit(arr(3, 4)), V.to_max_one(arr(1, 4)), V.gini_of_counts(arr(2, 2)))
    assert got == ([0.25, 0.75], [0.0, 0.0], 0.5, [0.6, 0.8], [0.25, 1.0], 0.5)


def test_places(spark):
    got = one(spark, V.argmax(arr(2, 5, 5)), V.argmin(arr(2, 1, 1)), V.argmax(F.array().cast("array<double>")), V.index_of(arr(1, 2), F.lit(9.0)), V.multi_hot(F.array(F.lit(1), F.lit(3)), 4), V.relative_mean(arr(0, 0, 1)), V.relative_central_moment(arr(0.5, 0, 0.5), 2))
    assert got == (1, 1, 0, -1, [0, 1, 0, 1], 1.0, 0.25)


def test_matrices(spark):
    m = F.array(arr(1, 2), arr(3, 4))
    got = one(spark, V.determinant(m), V.trace(m), V.transpose(m), V.mat_mul(m, m), V.mat_vec(m, arr(1, 1)), V.normalize_01(m), V.mat_scaled(m, F.lit(2.0), divide=True), V.mat_scaled(m, F.lit(2.0), divide=True, compat=True))
    assert got[:5] == (-2.0, 5.0, [[1, 3], [2, 4]], [[7, 10], [15, 22]], [3, 7])
    assert got[5][1][1] == 1.0 and got[6] == [[0.5, 1], [1.5, 2]] and got[7] == [[2, 4], [6, 8]]


def test_complex(spark):
    a, b = V.complex_of(F.lit(1.0), F.lit(2.0)), V.complex_of(F.lit(3.0), F.lit(-1.0))
    m, d, n = one(spark, V.complex_mul(a, b), V.complex_div(a, b), V.complex_magnitude(V.complex_of(F.lit(3.0), F.lit(4.0))))
    assert complex(*m) == (1 + 2j) * (3 - 1j) and abs(complex(*d) - (1 + 2j) / (3 - 1j)) < 1e-12 and n == 5.0


def test_strings(spark):
    s = F.lit("a,,b")
    name = F.lit("PC1_20090604_053000_0.bmp")
    got = one(spark, strings.split(s, ","), strings.split_non_empty(s, ",;"), strings.to_int(F.lit(" 12x")), strings.to_int(F.lit("x")), strings.to_float(F.lit("1.5e2z")), strings.float_text(F.lit(1.239), 2), strings.pack(F.lit("\t a b\n ")), strings.hour(name), strings.site(name), strings.year(name), strings.hour(F.lit("x.bmp")))
    assert got == (["a", "", "b"], ["a", "b"], 12, 0, 150.0, "1.23", "a b", 5, "PC1", 2009, None)


def test_scalars(spark):
    got = one(spark, scalar.clamp01(F.lit(1.5)), scalar.clamp255(F.lit(-3)), scalar.threshold(F.lit(0.5), 0.5), scalar.mel_to_hz(scalar.mel(F.lit(440.0))), scalar.rgb_to_hsv(F.lit(0.0), F.lit(1.0), F.lit(0.0)), scalar.hsv_to_rgb(F.lit(1 / 3), F.lit(1.0), F.lit(1.0)))
    assert got[:3] == (1.0, 0, 255) and abs(got[3] - 440) < 1e-9 and tuple(got[4]) == (120.0, 1.0, 1.0) and np.allclose(tuple(got[5]), (0, 1, 0))


def test_signal():
    assert list(signal.frame_starts(1024)) == [0, 128, 256, 384]
    assert [len(c) for c in signal.chunks(np.arange(25), 10)] == [10, 10]
    assert np.allclose(signal.uniform_blur(np.array([0, 3, 0, 3, 0.0]), 1), [0, 1, 2, 1, 0])
    x = np.random.default_rng(0).normal(size=64)
    assert np.allclose(signal.fft(signal.fft(x), inverse=True), x)
    with pytest.raises(ValueError):
        signal.fft(np.zeros(6))
    re, im = signal.real_fft(x)
    full = np.fft.fft(x)
    assert np.allclose(re, full.real[:32]) and np.isclose(im[0], full.real[32]) and np.allclose(im[1:], full.imag[1:32])
    s = signal.spectrogram(np.sin(np.arange(4000) * 0.5))
    assert s.shape == (28, 256) and signal.normalized_01(s).max() == 1
    assert abs(int(s.mean(0).argmax()) - round(0.5 / (2 * np.pi) * 512)) <= 1
    assert np.allclose(signal.as_pdfs(s).sum(1), 1) and (signal.minus_average(s) >= 0).all()
    bank = signal.filter_bank(256, 16000, 100, 7000)
    assert bank.shape == (24, 256) and signal.mfccs(s * s, bank).shape == (28, 12)
    img = signal.greyscale_image(signal.normalized_01(s))
    assert img.shape == (256, 28) and signal.whitening_filter(img).shape == img.shape


def test_image_figures():
    m = np.zeros((4, 4), np.uint8)
    m[1:3, 1:3] = 255
    assert image.mask_area(m) == 4 and image.mask_perimeter(m) == 8
    assert len(image.components(np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1]], np.uint8))) == 3


@pytest.mark.parametrize(("w", "h", "kept"), [(7, 7, False), (15, 15, True), (6, 100, False)])
def test_segment_sizes(w, h, kept):
    m = np.zeros((120, 120), np.uint8)
    m[5 : 6 + h, 5 : 6 + w] = 255
    found = image.segment_features(m, m)
    assert bool(found) == kept
    if kept:
        rect, f = found[0]
        assert rect == (5, 5 + w, 5, 5 + h) and len(f) == 38


def test_blur_matches_definition():
    img = np.random.default_rng(1).integers(0, 256, (9, 11)).astype(np.uint8)
    k, r = image.gaussian_kernel(2), 2
    first = np.zeros(img.shape, np.uint8)
    for y in range(9):
        for x in range(11):
            v = np.float32(0)
            for i in range(-r, r + 1):
                v += k[i + r] * np.float32(image.get_extend(img, y + i, x)) / np.float32(255)
            first[y, x] = int(v * np.float32(255))
    out = np.zeros(img.shape, np.uint8)
    for y in range(9):
        for x in range(11):
            v = np.float32(0)
            for i in range(-r, r + 1):
                v += k[i + r] * np.float32(image.get_extend(first, y, x + i)) / np.float32(255)
            out[y, x] = int(v * np.float32(255))
    assert (np.abs(out.astype(int) - image.blur(img, 2)) <= 1).all()


def test_pixel_features():
    img = np.random.default_rng(2).integers(0, 256, (256, 30)).astype(np.uint8)
    f = image.pixel_features(img, np.array([0, 12]), np.array([3, 200]))
    assert f.shape == (2, 547)
    assert f[1, 289 + 1] == 200 and np.allclose(f[1, -256:], img[:, 12] / 255) and f[0, 0] == 0


def test_drawing_and_layout():
    img = np.zeros((20, 20), np.uint8)
    image.draw_line(img, 0, 0, 19, 19, 255)
    assert (np.diag(img) == 255).all()
    image.draw_circle(img, 10, 10, 5, 7)
    image.draw_box(img, 1, 1, 4, 4, 9)
    assert img[1, 2] == 9
    assert sorted(i for i, _, _ in image.mosaic([(5, 5), (8, 2), (3, 9)], 20)) == [0, 1, 2]
    assert image.stack_vertical([np.zeros((2, 3)), np.zeros((4, 5))]).shape == (6, 5)
    assert image.stack_horizontal([np.zeros((2, 3)), np.zeros((4, 5))]).shape == (4, 8)
    assert image.convolved(img, image.KERNELS["avg"]).shape == img.shape
    assert image.correlation(img, img[5:10, 5:10]).max() == 255


def test_degenerate_vectors(spark):
    one_, none = arr(2), F.array().cast("array<double>")
    got = one(spark, V.relative_mean(one_), V.relative_central_moment(one_, 2), V.mean(none), V.sample_variance(one_), V.normalize_01(F.array(arr(3, 3))), V.normalize_sum(F.array(arr(1, -1))), V.normalize_sum(F.array(arr(1, 3))))
    assert got == (0.0, 0.0, None, None, [[0.0, 0.0]], [[1.0, -1.0]], [[0.25, 0.75]])


def test_matrix_inverse_and_rows(spark):
    two, three = [[1.0, 2.0], [3.0, 4.0]], [[2.0, 0.0, 1.0], [1.0, 3.0, 2.0], [1.0, 1.0, 4.0]]
    col = lambda m: F.array(*(arr(*r) for r in m))
    a, b, singular, swapped, eye, nil = one(spark, V.inverse(col(two)), V.inverse(col(three)), V.inverse(col([[1, 2], [2, 4]])), V.swap_rows(col(two), 0, 1), V.identity(2), V.zeros(1, 2))
    assert np.allclose(a, np.linalg.inv(two)) and np.allclose(b, np.linalg.inv(three)) and singular is None
    assert swapped == [[3.0, 4.0], [1.0, 2.0]] and eye == [[1.0, 0.0], [0.0, 1.0]] and nil == [[0.0, 0.0]]


def test_random_draws_follow_keys(spark):
    df = spark.range(20000).select(V.gaussian_of("id", mean=3.0, deviation=2.0, seed=5).alias("g"), V.multinomial_of(arr(1, 0, 3), "id", seed=7).alias("m"), V.uniform_of("id").alias("u"))
    r = df.agg(F.avg("g"), F.stddev("g"), F.sum((F.col("m") == 2).cast("int")), F.sum((F.col("m") == 1).cast("int")), F.avg("u")).first()
    assert abs(r[0] - 3) < 0.06 and abs(r[1] - 2) < 0.06 and abs(r[2] - 15000) < 300 and r[3] == 0 and abs(r[4] - 0.5) < 0.01
    assert one(spark, V.multinomial_of(arr(0, 0), F.lit(1)))[0] is None and df.collect() == df.collect()


def test_pixels():
    img = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert image.pixels(img, 1, 2) == 6 and image.pixels(img, [0, -1], [0, 9], "zero").tolist() == [0, 0]
    assert image.pixels(img, [-5, 9], [9, -5], "extend").tolist() == [3, 8] and image.pixels(img, 2, 3, unit=True) == np.float32(11) / np.float32(255)
    with pytest.raises(IndexError):
        image.pixels(img, 3, 0)
    with pytest.raises(ValueError):
        image.pixels(img, 0, 0, "wrap")
    rgb = np.zeros((2, 2, 3), np.uint8)
    out = image.set_pixels(rgb, [0, 5], [1, 5], (1, 2, 3), "zero")
    assert out[0, 1].tolist() == [1, 2, 3] and out.sum() == 6 and rgb.sum() == 0
    assert image.pixels(out, [0, 7], [1, 7], "zero").tolist() == [[1, 2, 3], [0, 0, 0]]
    assert image.set_pixels(img, 0, 0, 0.5, unit=True)[0, 0] == 127
    with pytest.raises(IndexError):
        image.set_pixels(img, 9, 9, 1)
    assert image.matrix_to_image(image.image_to_matrix(img)).shape == img.shape and image.matrix_to_image(np.array([[2.0, -1.0]])).tolist() == [[255, 0]]
    bank = signal.filter_bank_image(signal.filter_bank(64, 16000, 100, 8000))
    assert bank.shape == (64, 24) and bank.max() > 200
