"""Forests grown on tables, against plain growth with the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import forest, growth, multilabel


def best(x, y, features, num_classes):
    """Every midpoint between different values; ``forest.best_split`` skips some where values repeat."""
    least, found = np.inf, None
    for f in features:
        v = np.unique(x[:, f])
        for a, b in zip(v, v[1:], strict=False):
            if b - a >= forest.LEAST_GAP:
                sides = np.stack([np.bincount(y[s], minlength=num_classes) for s in (x[:, f] <= a, x[:, f] > a)]).astype(float)
                score = (sides.sum(1) * forest.gini(sides)).sum() / len(y)
                if score < least - 1e-12:
                    least, found = score, (int(f), (a + b) / 2)
    return found


def plain(x, y, keys, spec, part, num_classes, depth_most, mtry, bootstrap=True):
    """A tree level by level on repeated rows, by sorting values at each node."""
    pool = np.arange(x.shape[1]) if spec.features is None else np.array(spec.features)
    rows = np.repeat(np.arange(len(x)), spec.weights(keys, part, bootstrap=bootstrap))
    nodes, level, depth = [[-1, 0.0, -1, -1, np.eye(num_classes)[0]]], [(0, rows)], 0
    while level:
        following = []
        for k, r in level:
            own = y[r]
            nodes[k][4] = np.eye(num_classes)[np.bincount(own, minlength=num_classes).argmax()]
            split = best(x[r], own, np.random.default_rng((spec.seed, k)).permutation(pool)[:mtry], num_classes) if depth < depth_most and len(r) and (own != own[0]).any() else None
            if split:
                less = x[r, split[0]] < split[1]
                nodes[k][:4] = [*split, len(nodes), len(nodes) + 1]
                for side in (r[less], r[~less]):
                    nodes.append([-1, 0.0, -1, -1, None])
                    following.append((len(nodes) - 1, side))
        level, depth = following, depth + 1
    return forest.Tree.of(nodes)


def same(a, b):
    return (a.feature == b.feature).all() and np.allclose(a.threshold, b.threshold) and (a.left == b.left).all() and (a.hist == b.hist).all()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n, d = 120, 5
    x = rng.normal(size=(n, d))
    y = ((x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n)) > 0).astype(int) + (x[:, 2] > 1)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), i % 3) for i in range(n)], "id bigint, features array<double>, label int, part int").repartition(3).cache()
    keys = {r.id: r.k for r in df.select("id", growth.row_key(["id"]).alias("k")).collect()}
    return df, x, y, np.array([keys[i] for i in range(n)]), np.arange(n) % 3


@pytest.mark.parametrize("cells", [growth.CELLS, 3000])
def test_trees_equal_plain_growth(table, monkeypatch, cells):
    """With exact bins; also where a level takes several passes, and with chosen features and parts."""
    monkeypatch.setattr(growth, "CELLS", cells)
    df, x, y, keys, part = table
    specs = [growth.Spec(1), growth.Spec(2, features=(0, 2, 4)), growth.Spec(3, parts=(0, 2)), growth.Spec(4, parts=(7,))]
    trees = growth.grow(df, specs, 3, ["id"], max_depth=5, mtry=3, bins=150, part=F.col("part"))
    for spec, tree in zip(specs, trees, strict=True):
        assert same(tree, plain(x, y, keys, spec, part, 3, 5, 3)), spec
    assert len(trees[3].feature) == 1 and not trees[3].hist[0][1:].any()


def test_without_bootstrap_and_with_few_bins(table):
    df, x, y, keys, part = table
    (tree,) = growth.grow(df, [growth.Spec(9)], 3, ["id"], max_depth=3, mtry=5, bins=150, bootstrap=False)
    assert same(tree, plain(x, y, keys, growth.Spec(9), part, 3, 3, 5, bootstrap=False))
    f = growth.train(df, 3, 20, ["id"], bins=16)
    assert (f.classify(x) == y).mean() > 0.95
    assert (growth.train(df, 3, 20, ["id"], bins=16, balanced=True).classify(x) == y).mean() > 0.9


def test_out_of_bag_equals_plain(table):
    df, x, y, keys, _ = table
    f = growth.train(df, 3, 12, ["id"], seed=5, max_depth=4)
    total, n = np.zeros((len(x), 3)), np.zeros(len(x))
    for seed, tree in zip(f.seeds, f.trees, strict=True):
        out = growth.draws(keys, seed) == 0
        total[out] += tree.probabilities(x[out])
        n += out
    got = {r.id: r.probabilities for r in growth.out_of_bag(df, f, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(len(x))], total / np.maximum(n, 1)[:, None])
    assert (np.argmax([got[i] for i in range(len(x))], 1) == y).mean() > 0.65


def test_draws():
    h = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 200_000)
    w = growth.draws(h, 3)
    assert abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w, growth.draws(h, 4))[0, 1]) < 0.01
    assert abs(growth.draws(h, 3, 2.5).mean() - 2.5) < 0.03
    rates = np.where(np.arange(len(h)) % 2, 0.5, 3.0)
    assert abs(growth.draws(h, 3, rates)[::2].mean() - 3) < 0.03


def test_exact_splits_with_repeated_values(spark):
    """Against every threshold, over several partitions; values repeat, one feature is constant."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 6, 80), rng.normal(size=80).round(2), np.zeros(80), np.arange(80)]).astype(float)
    y = rng.integers(0, 3, 80)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(80)], "features array<double>, label int").repartition(5)
    got = {r.feature: (r.threshold, r.gini) for r in growth.exact_splits(df, 3).collect()}
    assert set(got) == {0, 1, 3}
    for f, (t, score) in got.items():
        v = np.unique(x[:, f])
        every = {}
        for m in (v[1:] + v[:-1]) / 2:
            sides = [np.bincount(y[side], minlength=3) for side in (x[:, f] < m, x[:, f] >= m)]
            every[m] = sum(s.sum() * forest.gini(s) for s in sides) / 80
        assert score == pytest.approx(min(every.values())) and every[min(every, key=lambda m: abs(m - t))] == pytest.approx(score)


def test_odd_tables(spark):
    schema = "id bigint, features array<double>, label int"
    with pytest.raises(ValueError, match="no examples"):
        growth.grow(spark.createDataFrame([], schema), [growth.Spec(0)], 2, ["id"])
    one = spark.createDataFrame([(1, [1.0, 2.0], 1)], schema)
    (tree,) = growth.grow(one, [growth.Spec(0)], 2, ["id"], bootstrap=False)
    assert len(tree.feature) == 1 and tree.hist[0].tolist() == [0.0, 1.0]
    with pytest.raises(Exception, match="NaN"):
        growth.grow(spark.createDataFrame([(1, [float("nan")], 1)], schema), [growth.Spec(0)], 2, ["id"])
    same_x = spark.createDataFrame([(i, [1.0], i % 2) for i in range(6)], schema)
    assert len(growth.grow(same_x, [growth.Spec(0)], 2, ["id"], bootstrap=False)[0].feature) == 1


@pytest.mark.parametrize("name, options", [("binary_relevance", {"trees": 4}), ("ecc", {"chains": 2, "trees": 3}), ("ecc_oob", {"chains": 2, "trees": 3})])
def test_multi_label_predictions_equal_plain_ones(spark, name, options):
    """Two folds, all learnt together, against a fold at a time with numpy: scores, thresholds and predicted labels."""
    rng = np.random.default_rng(3)
    n, d, c = 60, 4, 3
    x = rng.normal(size=(n, d))
    hot = np.column_stack([x[:, 0] > 0, x[:, 1] > 0.5, x[:, 0] + x[:, 2] > 0]).astype(int)
    part = np.arange(n) % 2
    df = spark.createDataFrame([(i, str(part[i]), np.flatnonzero(hot[i]).tolist(), x[i].tolist()) for i in range(n)], "example_id bigint, partition string, labels array<int>, features array<double>").repartition(3)
    splits = multilabel.k_fold([0, 1])
    got = {(r.split, r.example_id): r for r in multilabel.predictions(df, name, c, splits, seed=8, max_depth=3, mtry=2, bins=100, **options).collect()}
    assert len(got) == n
    h = {r.example_id: r.k for r in df.select("example_id", growth.row_key(["example_id"]).alias("k")).collect()}
    keys = np.array([h[i] for i in range(n)])
    right = 0
    for g, (split, _, _) in enumerate(splits):
        train = 1 - g
        learnt = part == train

        def unseen(wide, label, seeds, features, learnt=learnt, train=train):
            total, m = np.zeros(n), np.zeros(n)
            for s in seeds:
                spec = growth.Spec(s, features=features, parts=(train,))
                tree = plain(wide, label, keys, spec, part, 2, 3, 2)
                out = spec.weights(keys, part) == 0
                total[out] += tree.probabilities(wide[out])[:, 1]
                m += out
            return total / np.maximum(m, 1)

        scores = np.zeros((n, c))
        if name == "binary_relevance":
            for k in range(c):
                scores[:, k] = unseen(x, hot[:, k], [multilabel._seed(8, 0, g, k, t) for t in range(options["trees"])], None)
        else:
            for k in range(options["chains"]):
                wide = x
                for s, label in enumerate(np.random.default_rng((8, 0, k)).permutation(c).tolist()):
                    p = unseen(wide, hot[:, label], [multilabel._seed(8, 0, g, k, s, t) for t in range(options["trees"])], None)
                    scores[:, label] += p / options["chains"]
                    wide = np.column_stack([wide, np.where(learnt, hot[:, label], p) if name == "ecc_oob" else p])
        thresholds = multilabel.calibrate(scores[learnt], hot[learnt])
        for i in np.flatnonzero(~learnt):
            r = got[split, int(i)]
            assert np.allclose(r.scores, scores[i]), (name, i)
            assert r.predicted == np.flatnonzero(scores[i] > thresholds).tolist()
            right += (np.isin(np.arange(c), r.predicted) == hot[i].astype(bool)).sum()
    assert right / (n * c) > 0.75
