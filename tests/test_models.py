"""Forests, multi-label classifiers and discovery: properties and small exact cases."""

import numpy as np
import pytest

import plain_discovery as D
from murmura.operators import bags as B
from murmura.operators import forest, multilabel, traversal


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 200)
    return rng.normal(size=(200, 5)) + 3 * np.eye(3, 5)[y], y


def test_forest(spark, blobs):
    x, y = blobs
    f = forest.train(spark, x, y, 3, 12, seed=1)
    assert (f.classify(x) == y).mean() > 0.97
    assert (f.out_of_bag(x).argmax(1) == y).mean() > 0.85
    local = forest.train_local(x, y, 3, 12, seed=1)
    assert np.allclose(local.probabilities(x), f.probabilities(x))  # a tree follows from its number
    assert set(np.unique(f.trees[0].hist)) <= {0.0, 1.0}
    soft = forest.train_local(x, y, 3, 2, max_depth=1, leaf="histogram")
    assert len(soft.trees[0].feature) <= 3 and ((soft.trees[0].hist > 0) & (soft.trees[0].hist < 1)).any()
    assert forest.train_local(x, y, 3, 2, balanced=True).probabilities(x).shape == (200, 3)
    with pytest.raises(ValueError):
        forest.verify(np.array([[np.nan]]), np.array([0]), 1)


def test_split_is_the_best():
    x = np.array([[0.0, 5], [1, 1], [2, 9], [3, 2]])
    assert forest.best_split(x, np.array([0, 0, 1, 1]), np.array([1, 0]), 2) == (0, 1.5)
    assert forest.best_split(np.zeros((4, 1)), np.array([0, 1, 0, 1]), np.array([0]), 2) is None


def test_classifiers(blobs):
    x, y = blobs
    hot = np.eye(3, dtype=int)[y]
    for name, options in (("binary_relevance", {"trees": 10}), ("ecc", {"chains": 2, "trees": 6}), ("ecc_oob", {"chains": 2, "trees": 6})):
        m = multilabel.CLASSIFIERS[name](**options).fit(x, hot)
        assert (m.classify(x) == hot).mean() > 0.9, name
        assert m.thresholds.shape == (3,)


def test_calibration_takes_the_first_best():
    s, y = np.array([[0.2], [0.4], [0.6]]), np.array([[0], [0], [1]])
    assert multilabel.calibrate(s, y)[0] == 0.4


def test_hand_checked_measures(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7, 0.2], [1], [1, 2]), ([0.5, 0.5, 0.5, 0.5], [], [])], "s array<double>, y array<int>, p array<int>")
    from pyspark.sql import functions as F

    s, y, p = F.col("s"), F.col("y"), F.col("p")
    a, b = df.select(multilabel.rank_loss(s, y), multilabel.one_error(s, y), multilabel.coverage(s, y), multilabel.hamming_loss(p, y, 4), multilabel.set01_loss(p, y), multilabel.confusion(p, y, 4)).collect()
    assert a[0] == pytest.approx(1 / 3) and a[1:5] == (0.0, 1, 0.25, 1.0) and tuple(a[5]) == (1, 1, 2, 0)
    assert b[0] is None and b[2] == 0 and b[4] == 0.0


def test_split_experiment(spark, blobs):
    x, y = blobs
    hot = np.eye(3, dtype=int)[y]
    got = multilabel.split_experiment(spark, (x[:150], hot[:150]), (x[150:], hot[150:]), "binary_relevance", trees=8)
    assert got["accuracy"] > 0.8 and got["hamming_loss"] == pytest.approx(1 - got["accuracy"])


@pytest.fixture(scope="module")
def experiment():
    rng = np.random.default_rng(5)
    labels = [set(rng.integers(0, 6, rng.integers(0, 3)).tolist()) for _ in range(14)]
    bag = np.repeat(np.arange(12), 3)  # the last two bags are empty
    return D.Bags(np.arange(14), labels, bag, rng.normal(size=(36, 4)))


@pytest.mark.parametrize("name", sorted(D.METHODS))
def test_methods(experiment, name):
    picks = D.METHODS[name](experiment, 6)
    assert len(picks) == len(set(picks)) == 6
    c = D.curve(experiment, picks)
    assert c[0] == 0 and c == sorted(c)
    best = D.curve(experiment, D.coverage_oracle(experiment, 6))
    assert best[1] >= c[1]


def test_farthest_by_hand():
    b = D.Bags(np.arange(4), [set()] * 4, np.arange(4), np.array([[0.0], [1], [10], [4]]))
    assert D.instance_farthest(b, 3)[:3] == [0, 2, 3]
    assert D.bag_farthest(b, 3) == [0, 2, 3]


def test_traversals(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [10.0]), (3, [4.0])], "id int, features array<double>")
    assert traversal.farthest_first(df, 3, ["id"]) == [(0,), (2,), (3,)]
    assert traversal.farthest_first(df, 9, ["id"])[-1] in {(1,), (3,)}
    bags = spark.createDataFrame([(0, [1]), (1, [1, 2]), (2, [3])], "bag_id int, labels array<int>")
    assert traversal.greedy_coverage(bags, 3) == [1, 2, 0]


def test_lloyd_properties(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id int, features array<double>")
    seeds = B.plus_plus(df, 2, ["id"])
    centers, rounds = B.lloyd(df, seeds)
    assert sorted(round(c[0]) for c in centers) == [0, 5] and rounds <= 100
    assert B.lloyd(df, [[0.0, 0.0], [5.0, 5.0], [99.0, 99.0]], iterations=1)[0][2] == [0.0, 0.0]  # a center without members


def test_empty_bags_stay(spark):
    bags = spark.createDataFrame([(0,), (1,)], "bag_id int")
    seg = spark.createDataFrame([(0, 0, [1.0, 3.0]), (0, 1, [3.0, 3.0])], "bag_id int, segment_id int, features array<double>")
    got = {r.bag_id: r.features for r in B.summary_features(bags, seg, 2).collect()}
    assert got == {0: [2.0, 2.0, 1.0, 3.0, 0.0], 1: [0.0] * 5}
    hist = {r.bag_id: r.features for r in B.bag_histograms(bags, B.nearest(seg, [[1.0, 3.0], [3.0, 3.0]]), 2).collect()}
    assert hist == {0: [0.5, 0.5], 1: [0.0, 0.0]}
    assert B.rescaled(seg).orderBy("segment_id").first().features == [0.0, 0.0]
    with pytest.raises(Exception, match="constant"):
        B.rescaled(seg, strict=True).collect()


def test_audio_to_segments(spark):
    from murmura.operators import audio

    t = np.arange(16000)
    x = np.where((t > 4000) & (t < 11000), np.sin(t * 0.4) * 0.5, 0.001 * np.sin(t * t * 0.1))
    df = spark.createDataFrame([("a", 16000, x.tolist()), ("short", 16000, [0.0] * 10)], "path string, sample_rate int, samples array<float>")
    assert audio.split_chunks(df, 0.25).count() == 4
    images = audio.spectrograms(df)
    assert [r.path for r in images.collect()] == ["a"]
    assert audio.whitened(images).first().w == images.first().w
    assert audio.mfcc_table(df, 100, 7000).count() == images.first().w
    img = images.first()
    marks = np.zeros((img.h, img.w, 3), np.uint8)
    marks[:100, 35:80] = (255, 0, 0)
    marks[:, :20] = (0, 0, 255)
    ann = spark.createDataFrame([("a", img.w, img.h, bytes(marks.tobytes()))], "path string, w int, h int, data binary")
    px = audio.annotated_pixels(images, ann, (0.01, 0.05, 0.05))
    f = audio.train_segmentation(px, trees=4)
    p = audio.probability_maps(images, f)
    m = audio.masks(p)
    assert p.first().w == img.w and set(np.frombuffer(m.first().data, np.uint8)) <= {0, 255}
    got = audio.segment_table(images, m).collect()
    assert all(len(r.features) == 38 for r in got)


def test_stream_counts(spark, tmp_path):
    from murmura.streaming import recordings as S

    src = str(tmp_path / "in")
    rows = [(i, f"2024-01-01 0{i % 3}:30:00", float(i)) for i in range(9)]
    spark.createDataFrame(rows, "id int, t string, value double").selectExpr("id", "cast(t as timestamp) ts", "value").write.parquet(src)
    ev = S.read_events(spark, src, "id int, ts timestamp, value double")
    for df, name, mode in ((S.hourly_counts(ev), "c1", "complete"), (S.moving_averages(ev, slide="1 hour"), "c2", "complete"), (S.deduplicated(ev, "id"), "c3", "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert [r.n for r in spark.table("c1").orderBy("hour_start").collect()] == [3, 3, 3]
    assert spark.table("c2").count() == 3 and spark.table("c3").count() == 9


def _naive(bags, n, score, last=False):
    """Bags picked one by one by a score that is worked out anew from all covered instances."""
    picks = [next((i for i, b in enumerate(bags) if len(b)), 0)]
    while len(picks) < min(n, len(bags)):
        covered = [x for i in picks for x in bags[i]]
        best, at = None, None
        for i in range(len(bags)):
            if i not in picks:
                v = score(bags[i], covered)
                if best is None or v > best or last and v >= best:
                    best, at = v, i
        picks.append(at)
    return picks


def _d2(a, b):
    return float(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def _largest(k):
    return lambda own, covered: sum(sorted((min(_d2(x, c) for c in covered) for x in own), reverse=True)[:k]) if len(own) else -1.0


def _within(k):
    def score(own, covered):
        if not len(own):
            return -1.0
        left, held, total = list(own), list(covered), 0.0
        for _ in range(min(k, len(own))):
            d = [min(_d2(x, c) for c in held) for x in left]
            j = max(range(len(d)), key=lambda i: (d[i], i))
            total += d[j]
            held.append(left.pop(j))
        return total

    return score


@pytest.mark.parametrize("method, score, last", [("farthest2", _largest(1), False), ("farthest3", _largest(2), False), ("MIFF", _within(1), True), ("MIFFk1", _within(1), True), ("MIFFk2", _within(2), True), ("instance_coverage", lambda own, covered: sum(_d2(x, c) ** 0.5 for x in own for c in covered), True)])
def test_discovery_against_plain_versions(method, score, last):
    from plain_discovery import METHODS, Bags

    for seed in range(4):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(0, 5, 14)
        own = [rng.normal(size=(k, 3)) for k in sizes]
        b = Bags(np.arange(14), [set() for _ in own], np.repeat(np.arange(14), sizes), np.concatenate(own))
        full = sum(k > 0 for k in sizes)
        got = METHODS[method](b, full)
        assert [int(i) for i in got] == _naive(own, full, score, last)


def test_instance_walk_against_a_plain_version():
    from plain_discovery import METHODS, Bags

    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 4, 10)
    x, bag = rng.normal(size=(sizes.sum(), 3)), np.repeat(np.arange(10), sizes)
    walk = [0]
    while len(walk) < min(4 * 3, len(x)):
        walk.append(max((i for i in range(len(x)) if i not in walk), key=lambda i: (min(_d2(x[i], x[j]) for j in walk), -i)))
    want = list(dict.fromkeys(int(bag[i]) for i in walk))[:3]
    assert METHODS["farthest"](Bags(np.arange(10), [set() for _ in sizes], bag, x), 3)[: len(want)] == want


def test_best_split_against_every_threshold():
    from murmura.operators.forest import best_split

    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.normal(size=(25, 3)), rng.integers(0, 3, 25)

        def impurity(f, t, x=x, y=y):
            total = 0.0
            for side in (y[x[:, f] < t], y[x[:, f] >= t]):
                total += len(side) * (1 - sum((np.mean(side == c)) ** 2 for c in range(3))) if len(side) else 0
            return total / len(y)

        every = [(impurity(f, t), f, t) for f in range(3) for a, b in zip(np.sort(x[:, f]), np.sort(x[:, f])[1:], strict=False) for t in [(a + b) / 2]]
        f, t = best_split(x, y, np.arange(3), 3)
        # with different values, that neighbours of one label aren't split never hides a better threshold
        assert impurity(f, t) <= min(every)[0] + 1e-9


def test_best_splits_by_feature(spark):
    from murmura.operators.forest import best_split, best_splits

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5))
    y = (x[:, 3] + 0.3 * rng.normal(size=80) > 0).astype(int)
    got = {r.feature: r for r in best_splits(spark, x, y, 2).collect()}
    assert set(got) == set(range(5)) and min(got.values(), key=lambda r: r.gini).feature == 3
    for f, r in got.items():
        assert (f, r.threshold) == best_split(x, y, np.array([f]), 2)
