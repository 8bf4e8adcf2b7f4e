"""Discovery, seeding and nearest bags on tables, against the plain forms on arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_discovery as D
from murmura.operators import bags as B
from murmura.operators import selection as S


def experiment(spark, seed, n=14, k=6, empty=True):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0 if empty else 1, 5, n)
    bag = np.repeat(np.arange(n), sizes)
    x = rng.normal(size=(sizes.sum(), 3))
    labels = [set(rng.integers(0, 6, rng.integers(0, 3)).tolist()) for _ in range(n)]
    plain = D.Bags(np.arange(n), labels, bag, x)
    centers, at = D.kmeans(x, k)
    segment = np.concatenate([np.arange(s) for s in sizes])
    bags = spark.createDataFrame([(i, sorted(y)) for i, y in enumerate(labels)], "bag_id bigint, labels array<int>").repartition(3).cache()
    instances = spark.createDataFrame([(int(b), int(s), v.tolist()) for b, s, v in zip(bag, segment, x, strict=True)], "bag_id bigint, segment_id int, features array<double>").repartition(3).cache()
    clusters = spark.createDataFrame([(int(b), int(s), int(c)) for b, s, c in zip(bag, segment, at, strict=True)], "bag_id bigint, segment_id int, cluster int").cache()
    return plain, S.Experiment(bags, instances, clusters, k), sum(s > 0 for s in sizes), (centers, at)


@pytest.mark.parametrize("method", ["farthest", "farthest2", "farthest3", "MIFF", "MIFFk2", "instance_coverage", "coverage_oracle"])
def test_picks_equal_plain_ones(spark, method):
    plain, e, full, _ = experiment(spark, 1)
    n = min(full, 7)
    assert S.METHODS[method](e, n) == D.METHODS[method](plain, n)


@pytest.mark.parametrize("method, plain_method", [("cluster_coverage", D.cluster_coverage), ("cluster_coverage_tiebreak", D.cluster_coverage_tiebreak), ("unified_CCMIFF", D.unified_coverage), ("generalized_coverage", D.generalized_coverage), ("CCMIFF", D.coverage_then_miff)])
def test_cluster_picks_equal_plain_ones(spark, method, plain_method):
    plain, e, full, _ = experiment(spark, 2)
    n = min(full, 7)
    assert S.METHODS[method](e, n) == plain_method(plain, n, 6)


def test_a_bag_larger_than_the_pending_block(spark, monkeypatch):
    monkeypatch.setattr(S, "PENDING", 3)
    plain, e, full, _ = experiment(spark, 3)
    assert S.miff(e, 5) == D.miff(plain, 5) and S.instance_coverage(e, 5) == D.instance_coverage(plain, 5)


def test_lazy_gains_with_a_short_queue(spark, monkeypatch):
    """With a queue of two, gains of unfetched bags bound what may be taken; many clusters take several integers."""
    monkeypatch.setattr(S, "QUEUE", 2)
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 150, rng.integers(0, 12)).tolist()) for _ in range(40)]
    rows = [(i, s, c) for i, own in enumerate(sets) for s, c in enumerate(sorted(own))]
    bags = spark.createDataFrame([(i,) for i in range(40)], "bag_id bigint")
    x = spark.createDataFrame([(i, s, [float(c)]) for i, s, c in rows], "bag_id bigint, segment_id int, features array<double>")
    e = S.Experiment(bags, x, spark.createDataFrame(rows, "bag_id bigint, segment_id int, cluster int"))
    assert e.words == 3
    assert S.cluster_coverage(e, 40) == D._greedy_sets(sets, 40)


@pytest.mark.parametrize("block", [S.BLOCK, 5])
def test_cluster_distances(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    plain, e, _, (_, at) = experiment(spark, 4, n=20)
    got = S.cluster_distances(e.assigned, 6)
    for i in range(6):
        for j in range(6):
            if i != j:
                d = np.sqrt(np.square(plain.x[at == i][:, None] - plain.x[at == j][None]).sum(2))
                assert got[i, j] == pytest.approx((d.min(1).sum() + d.min(0).sum()) / sum(d.shape))


def test_every_method_and_curves(spark):
    _, e, _, _ = experiment(spark, 6, n=9)
    made = S.Experiment(e.bags, e.instances, None, 4)
    for method in ("random", "random_non_empty", "cluster_centers", "cluster_coverage"):
        picks = S.METHODS[method](made, 5)
        assert len(set(picks)) == 5, method
    labels = {r.bag_id: set(r.labels) for r in e.bags.collect()}
    known, want = set(), [0]
    for p in picks:
        known |= labels[p]
        want.append(len(known))
    assert [r.n_known for r in S.curve(e.bags, picks).orderBy("i").collect()] == want
    got = S.experiment(e.bags, e.instances, ["random", "MIFF"], 3, 2)
    assert got.groupBy("method", "repetition").count().count() == 4
    none = e.bags.limit(0)
    for method, f in S.METHODS.items():
        if "luster" not in method and "CC" not in method and "coverage" not in method or method == "coverage_oracle":
            assert f(S.Experiment(none, e.instances.limit(0)), 3) == [], method


def test_parallel_seeds(spark):
    """Cost after seeding at most 1.3 times that of one-by-one seeding, on average over seeds."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(8, 4)) * 6
    x = np.concatenate([c + rng.normal(size=(40, 4)) for c in centers])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>").repartition(4).cache()
    cost = lambda c: np.square(x[:, None] - np.array(c)[None]).sum(2).min(1).sum()
    made = [B.parallel_seeds(df, 8, ["id"], seed=s) for s in range(3)]
    assert all(len(m) == 8 for m in made) and made[0] == B.parallel_seeds(df, 8, ["id"], seed=0)
    assert np.mean([cost(m) for m in made]) <= 1.3 * np.mean([cost(B.plus_plus(df, 8, ["id"], seed=s)) for s in range(3)])
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "id bigint, features array<double>")
    assert sorted(B.parallel_seeds(same, 5, ["id"])) == [[1.0, 0.0], [1.0, 1.0]]
    assert B.parallel_seeds(same.limit(0), 5, ["id"]) == []


def test_nearest_bags(spark):
    """Equal to brute force, with most pairs pruned on a line of small bags."""
    rng = np.random.default_rng(1)
    bags = [np.array([i * 2.0, 0]) + rng.normal(size=(rng.integers(1, 4), 2)) * 0.3 for i in range(40)] + [np.array([[0.0, 50.0]])]
    df = spark.createDataFrame([(i, s, v.tolist()) for i, b in enumerate(bags) for s, v in enumerate(b)], "bag_id bigint, segment_id int, features array<double>").repartition(3)
    got = {r.a: r for r in B.nearest_bags(df).collect()}

    def h(a, b):
        d = np.sqrt(np.square(a[:, None] - b[None]).sum(2))
        return (d.min(1).sum() + d.min(0).sum()) / sum(d.shape)

    for i, b in enumerate(bags):
        d = [(round(h(b, o), 9), j) for j, o in enumerate(bags) if j != i]
        assert (got[i].b, got[i].distance) == (min(d)[1], pytest.approx(min(d)[0]))
    compared = sum(r.candidates for r in got.values())
    assert compared < 0.25 * len(bags) * (len(bags) - 1)
    assert B.nearest_bags(df.limit(0)).count() == 0 and B.nearest_bags(df.filter("bag_id = 3")).count() == 0


@pytest.mark.parametrize("digits", [None, 9])
def test_rounds_of_lloyd_need_no_search_by_rows(spark, monkeypatch, digits):
    """Sums of tasks equal those of SQL; a center without members has none, and equal distances go to the first."""
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(700, 5)), 1))]
    df = spark.createDataFrame(rows, "id int, features array<double>").repartition(3).cache()
    centers = [rows[0][1], rows[1][1], rows[1][1], [99.0] * 5, rows[2][1]]
    got, want = B._member_sums(df, centers, "features", digits), B._odd_member_sums(df, centers, "features", digits)
    assert sorted(got) == sorted(want) == [0, 1, 4]
    for c, (t, n, m) in want.items():
        assert got[c][1] == n and got[c][0] == pytest.approx(t) and got[c][2] == pytest.approx(m)
    odd = df.unionByName(spark.createDataFrame([(900, None), (901, [1.0, None, 0.0, 0.0, 0.0])], df.schema))
    assert B.lloyd(odd, centers[:2], 2, digits=digits)[1] == 2
    with monkeypatch.context() as m:
        m.setattr(B, "nearest", None)
        made, rounds = B.lloyd(df, centers[:2], digits=digits)
    assert 1 < rounds < 100 and B.lloyd(df, made, digits=digits)[0] == made


def test_instances_of_an_experiment_leave_their_one_task(spark, monkeypatch):
    """Instances that come as one partition are spread by their keys."""
    seen = []
    monkeypatch.setitem(S.METHODS, "seen", lambda e, n: seen.append(e.instances.select(F.spark_partition_id().alias("p")).distinct().count()) or [])
    x = spark.range(40_000).selectExpr("id DIV 5 AS bag_id", "id % 5 AS segment_id", "transform(sequence(1, 32), i -> rand(1) + i) AS features", "array(0) AS labels").coalesce(1).cache()
    S.experiment(x.select("bag_id", "labels").distinct(), x.drop("labels"), ["seen"], 2, 1)
    assert seen[0] > 1
