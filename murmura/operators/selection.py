"""Class discovery on tables: orders in which to look at bags so as to meet many classes early.

Each method takes an ``Experiment`` (bags and their instances as DataFrames, and how
instances are clustered) and a number of picks, and returns bag ids. ``METHODS`` names
them; add to it to plug one in. What a method keeps between picks is a running column:

* distances: ``Covered`` holds each instance's distance to the nearest covered one (or
  the sum over all). Instances of picked bags wait in a block of at most ``PENDING``
  vectors, which travels to the tasks; a full block is folded into the written column,
  so a pass looks at few picks and a bag of any size takes bounded memory;
* clusters: a bag's clusters are bits of a few integers, gains are bit counts, and the
  best ``QUEUE`` bags are fetched at a time: gains only fall, so a fetched bag whose
  gain still exceeds what the unfetched ones had is the best of all.

Scores are rounded to ``DIGITS`` before they are compared, so that ties don't hang on
the order of a sum. No bag is picked twice. Bags without an instance come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from murmura.functions import vector as V
from murmura.operators import bags as B
from murmura.operators import tiles, traversal
from murmura.session import cut, scratch_dir

PENDING, QUEUE, DIGITS = 4096, 256, 9
#: What an instance's distance is while nothing is covered: the largest 32-bit float.
FAR = 3.4e38
#: Clusters to an integer.
WORD = 62
#: Instances to a block of the cluster distances, and rows compared at a time.
BLOCK, ROWS = 4096, 256
CODEBOOK = 50
SUBSAMPLE = 0.63


@dataclass
class Experiment:
    """``bags``: bag_id, labels; ``instances``: bag_id, segment_id, features; ``clusters``: bag_id, segment_id, cluster, or None to make a codebook of ``k``."""

    bags: DataFrame
    instances: DataFrame
    clusters: DataFrame | None = None
    k: int = CODEBOOK
    seed: int = 0
    compat: bool = False
    _made: dict = field(default_factory=dict)

    @cached_property
    def assigned(self) -> DataFrame:
        """Instances with their cluster."""
        if self.clusters is not None:
            return self.instances.join(self.clusters.select("bag_id", "segment_id", "cluster"), ["bag_id", "segment_id"])
        key = ["bag_id", "segment_id"]
        centers, _ = B.lloyd(self.instances, B.parallel_seeds(self.instances, self.k, key, seed=self.seed))
        return cut(B.nearest(self.instances, centers).select(*key, "features", "cluster", "distance"))

    @cached_property
    def num_clusters(self) -> int:
        return self.assigned.agg(F.coalesce(F.max("cluster") + 1, F.lit(0))).first()[0]

    @cached_property
    def masks(self) -> DataFrame:
        """(bag_id, w0, w1, …): the clusters that a bag touches."""
        words = [F.bit_or(F.when(F.col("cluster").between(i * WORD, i * WORD + WORD - 1), F.expr(f"shiftleft(1L, cast(cluster as int) - {i * WORD})")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(self.words)]
        own = self.assigned.groupBy("bag_id").agg(*words)
        return cut(self.bags.select("bag_id").join(own, "bag_id", "left").fillna(0, [f"w{i}" for i in range(self.words)]))

    @property
    def words(self) -> int:
        return max(1, -(-self.num_clusters // WORD))

    def first(self):
        """The start of traversals: the smallest bag that has an instance, if there is one."""
        found = self.bags.select("bag_id").join(self.instances.select("bag_id").distinct(), "bag_id", "left_semi").agg(F.min("bag_id")).first()[0]
        return found if found is not None else self.bags.agg(F.min("bag_id")).first()[0]

    def chance(self, *salt: int) -> Column:
        """A number from 0 to 1 that follows from a bag's id."""
        return F.pmod(F.xxhash64("bag_id", *(F.lit(s) for s in (self.seed, *salt))), F.lit(1 << 52)) / float(1 << 52)


class Covered:
    """Instances with ``near``: the least distance (squared) to a covered instance, or the sum of distances to all."""

    def __init__(self, instances: DataFrame, total: bool = False, compat: bool = False):
        self.instances = instances.select("bag_id", "segment_id", F.col("features").cast("array<double>").alias("features"))
        self.total, self.compat = total, compat
        self.state = self.instances.withColumn("near", F.lit(0.0 if total else FAR))
        self.pending: list[list[float]] = []

    def cover(self, bag) -> None:
        """Take a bag's instances as covered, however many they are."""
        own = self.instances.filter(F.col("bag_id") == F.lit(bag)).select("features")
        for r in own.toLocalIterator():
            self.pending.append(list(r.features))
            if len(self.pending) == PENDING:
                self.state, self.pending = cut(self.rows()), []

    def rows(self) -> DataFrame:
        if not self.pending:
            return self.state
        update = (lambda near, d, *_: near + np.sqrt(d).sum(1)) if self.total else (lambda near, d, *_: np.minimum(near, d.min(1)))
        return B.compared(self.state, self.pending, update, compat=self.compat)  # at most PENDING vectors

    def largest(self, depth: int, within: bool) -> DataFrame:
        """(bag_id, score): the sum of a bag's ``depth`` largest distances; ``within``: an instance taken covers those left in its bag."""
        rows, found = self.rows(), None
        for i in range(depth):
            last = i + 1 == depth  # then only the distance counts, which needs no sorting
            best = rows.groupBy("bag_id").agg(F.max("near").alias("near") if last else F.max(F.struct("near", "segment_id", "features")).alias("b"))  # the last of equals
            own = best.select("bag_id", F.least("near" if last else "b.near", F.lit(FAR)).alias(f"s{i}"))
            found = own if found is None else found.join(own, "bag_id", "left")
            if not last:
                taken = best.select("bag_id", F.col("b.segment_id").alias("taken"), F.col("b.features").alias("by"))
                rows = rows.join(taken, "bag_id").filter(F.col("segment_id") != F.col("taken"))
                if within:
                    d = V.squared_l2("features", "by") + (F.size("features") if self.compat else F.lit(0))
                    rows = rows.withColumn("near", F.least("near", d))
                rows = rows.drop("taken", "by")
        return found.select("bag_id", sum((F.coalesce(f"s{i}", F.lit(0.0)) for i in range(1, depth)), F.col("s0")).alias("score"))

    def sums(self) -> DataFrame:
        return self.rows().groupBy("bag_id").agg(F.sum("near").alias("score"))


def _left(bags: DataFrame, picks: list) -> DataFrame:
    return bags.filter(~F.col("bag_id").isin(picks)) if picks else bags


def _best(bags: DataFrame, scores: DataFrame, picks: list, missing: Column | float, last: bool = False):
    """The bag with the largest score, the first of equals or the last."""
    score = F.round(F.coalesce("score", missing if isinstance(missing, Column) else F.lit(missing)), DIGITS)
    met = _left(bags.select("bag_id"), picks).join(scores, "bag_id", "left").select("bag_id", score.alias("score"))
    best = F.max(F.struct("score", "bag_id")) if last else F.min(F.struct((-F.col("score")).alias("score"), "bag_id"))
    found = met.agg(best.alias("b")).first().b
    return found.bag_id if found else None


def _by_distance(e: Experiment, n: int, score: Callable[[Covered], DataFrame], missing: float, last: bool, total: bool = False, picks: list | None = None, covered: Covered | None = None) -> list:
    picks = list(picks or [])
    covered = covered or Covered(e.instances, total, e.compat)
    if not picks and (first := e.first()) is not None:
        picks.append(first)
        covered.cover(first)
    while picks and len(picks) < n:
        bag = _best(e.bags, score(covered), picks, missing, last)
        if bag is None:
            break
        picks.append(bag)
        covered.cover(bag)
    return picks[:n]


# -- methods


def random(e: Experiment, n: int) -> list:
    return [r.bag_id for r in e.bags.select("bag_id", e.chance().alias("u")).orderBy("u", "bag_id").limit(n).collect()]


def random_non_empty(e: Experiment, n: int) -> list:
    full = e.instances.select("bag_id").distinct().withColumn("full", F.lit(1))
    met = e.bags.select("bag_id", e.chance().alias("u")).join(full, "bag_id", "left")
    return [r.bag_id for r in met.orderBy(F.col("full").isNull(), "u", "bag_id").limit(n).collect()]


def coverage_oracle(e: Experiment, n: int) -> list:
    """By the true labels: the upper bound."""
    return traversal.greedy_coverage(e.bags, n)


def cluster_centers(e: Experiment, n: int) -> list:
    """The bag of the instance nearest to each of n centers, larger clusters first; filled up with the first bags."""
    near = (e if e.clusters is not None else Experiment(e.bags, e.instances, None, n, e.seed)).assigned
    if "distance" not in near.columns:
        raise ValueError("clusters without distances")
    own = near.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct(F.round("distance", DIGITS).alias("d"), "bag_id", "segment_id")).alias("b"))
    order = list(dict.fromkeys(r.bag for r in own.select("n", "cluster", F.col("b.bag_id").alias("bag")).orderBy(F.desc("n"), "cluster").collect()))  # a row for each cluster
    rest = _left(e.bags.select("bag_id"), order).orderBy("bag_id").limit(max(0, n - len(order)))
    return (order + [r.bag_id for r in rest.collect()])[:n]


def _gain(words: int, known: list[int]) -> Column:
    return sum((F.bit_count(F.col(f"w{i}").bitwiseAND(F.lit(~known[i]))) for i in range(words)), F.lit(0))


def cluster_coverage(e: Experiment, n: int) -> list:
    """Most new clusters first; the first of equals."""
    picks, known, queue, bound = [], [0] * e.words, [], -1
    new = lambda r: sum((r[f"w{i}"] & ~known[i]).bit_count() for i in range(e.words))
    while len(picks) < n:
        best = min(queue, key=lambda r: (-new(r), r.bag_id), default=None)
        if best is None or new(best) <= bound:
            queue = _left(e.masks, picks).withColumn("gain", _gain(e.words, known)).orderBy(F.desc("gain"), "bag_id").limit(QUEUE).collect()
            if not queue:
                break
            best, bound = queue[0], queue[-1].gain if len(queue) == QUEUE else -1
        queue = [r for r in queue if r.bag_id != best.bag_id]
        picks.append(best.bag_id)
        known = [k | best[f"w{i}"] for i, k in enumerate(known)]
    return picks


def _coverage_with_ties(e: Experiment, n: int, score: Callable[[Covered], DataFrame], missing: Callable[[int], Column], until_covered: bool = False) -> tuple[list, Covered]:
    """Cluster coverage whose ties go to the bag with the best score, the first of equals; optionally only until all clusters are covered."""
    picks, known, covered = [], [0] * e.words, Covered(e.instances, compat=e.compat)
    every = e.masks.agg(*(F.coalesce(F.bit_or(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(e.words))).first()
    while len(picks) < n:
        if until_covered and picks and all(every[f"w{i}"] == known[i] for i in range(e.words)):
            break
        left = _left(e.masks, picks).withColumn("gain", _gain(e.words, known))
        top = left.groupBy("gain").agg(F.count("*").alias("n"), F.min("bag_id").alias("bag_id")).orderBy(F.desc("gain")).first()
        if top is None:
            break
        bag = top.bag_id
        if top.n > 1 and picks:  # before the first pick nothing tells bags with instances apart
            bag = _best(left.filter(F.col("gain") == top.gain), score(covered), [], missing(len(picks)))
        elif top.n > 1:
            full = left.filter(F.col("gain") == top.gain).join(e.instances.select("bag_id").distinct(), "bag_id", "left_semi").agg(F.min("bag_id")).first()[0]
            bag = top.bag_id if full is None else full
        own = e.masks.filter(F.col("bag_id") == F.lit(bag)).first()
        picks.append(bag)
        known = [k | own[f"w{i}"] for i, k in enumerate(known)]
        covered.cover(bag)
    return picks, covered


def cluster_coverage_tiebreak(e: Experiment, n: int) -> list:
    """Cluster coverage; ties go to the bag with the instance farthest from the covered."""
    return _coverage_with_ties(e, n, lambda c: c.largest(1, False), lambda i: F.lit(-1.0))[0]


def unified_coverage(e: Experiment, n: int, depth: int = 2) -> list:
    """Cluster coverage; ties go to the best greedy farthest score, empty bags last by chance."""
    return _coverage_with_ties(e, n, lambda c: c.largest(depth, True), lambda i: -2.0 + e.chance(i))[0]


def coverage_then_miff(e: Experiment, n: int, depth: int = 2) -> list:
    """Cluster coverage with tie-breaks until every cluster is covered, then farthest first; of equals the last."""
    picks, covered = _coverage_with_ties(e, n, lambda c: c.largest(1, False), lambda i: F.lit(-1.0), until_covered=True)
    return _by_distance(e, n, lambda c: c.largest(depth, True), -1.0, True, picks=picks, covered=covered)


def bag_farthest(e: Experiment, n: int, depth: int = 1) -> list:
    return _by_distance(e, n, lambda c: c.largest(depth, False), -1.0, False)


def miff(e: Experiment, n: int, depth: int = 1) -> list:
    """Multi-instance farthest first: the best greedy sum of ``depth`` distances; the last of equals."""
    return _by_distance(e, n, lambda c: c.largest(depth, True), -1.0, True)


def instance_coverage(e: Experiment, n: int) -> list:
    """Adds the bag with the largest sum of distances to all covered instances; the last of equals."""
    return _by_distance(e, n, lambda c: c.sums(), 0.0, True, total=True)


def instance_farthest(e: Experiment, n: int) -> list:
    """Bags in the order that a farthest-first walk over instances, four times as long, meets them."""
    walk = traversal.farthest_first(e.instances, 4 * n, ["bag_id", "segment_id"], digits=DIGITS)
    order = list(dict.fromkeys(bag for bag, _ in walk))
    rest = _left(e.bags.select("bag_id"), order).orderBy("bag_id").limit(max(0, n - len(order)))
    return (order + [r.bag_id for r in rest.collect()])[:n]


def _least(one: dict, two: dict, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, squared distances of its instances to the nearest of each cluster in the other block); both blocks' instances are in order of cluster.

    Distances come from products of matrices; those so small that rounding would tell are taken from the differences.
    """
    read = lambda r: (np.frombuffer(r["c"], np.int32), np.frombuffer(r["x"], float).reshape(len(r["c"]) // 4, -1))
    (c, x), (d, y) = read(one), read(two)
    middle = x.mean(0)
    p, q = x - middle, y - middle
    pp, qq = np.square(p).sum(1), np.square(q).sum(1)
    ends = lambda v: [(int(v[s]), s, e) for s, e in zip(*(lambda at: (at, [*at[1:], len(v)]))(np.flatnonzero(np.diff(v, prepend=-1)).tolist()), strict=True)]
    here, there = np.full((len(p), k), np.inf), np.full((len(q), k), np.inf)
    columns = ends(d)
    for at in range(0, len(p), ROWS):
        own = slice(at, at + ROWS)
        m = p[own] @ q.T
        m *= -2
        m += pp[own, None]
        m += qq
        few = 1e-6 * (pp[own, None] + qq.max())
        if (m < few).any():
            for i, j in zip(*np.nonzero((m < few) & (c[own, None] != d)), strict=True):
                m[i, j] = np.square(x[at + i] - y[j]).sum()
        for j, s, e in columns:
            here[own, j] = m[:, s:e].min(1)
        for i, s, e in ends(c[own]):
            np.minimum(there[:, i], m[s:e].min(0), out=there[:, i])
    yield one["block"], here
    if one["block"] != two["block"]:
        yield two["block"], there


def cluster_distances(assigned: DataFrame, k: int, compat: bool = False) -> np.ndarray:
    """The average Hausdorff distance between clusters, k x k.

    Instances are packed into blocks, and all pairs of blocks are compared once, in tiles
    (``tiles.paired``). A tile hands on each block's least distances to every cluster; these are brought
    together block by block before anything is summed.
    """
    spark = assigned.sparkSession
    path = scratch_dir(spark, "blocks")
    n = assigned.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = assigned.select(F.pmod(F.xxhash64("bag_id", "segment_id"), F.lit(blocks)).cast("int").alias("block"), F.col("features").cast("array<double>").alias("features"), F.col("cluster").cast("int").alias("cluster"))

    def pack(t: pa.Table) -> pa.Table:
        c = t.column("cluster").to_numpy().astype(np.int32)
        order = np.argsort(c, kind="stable")
        x = t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        return pa.table({"block": t.column("block")[:1], "x": pa.array([x[order].tobytes()], pa.binary()), "c": pa.array([c[order].tobytes()], pa.binary())})

    dealt.groupBy("block").applyInArrow(pack, "block int, x binary, c binary").write.parquet(path)
    packed = spark.read.parquet(path)

    def least(pairs: list[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, bytes]] = {}
        for one, two in pairs:
            own = {one["block"]: one["c"], two["block"]: two["c"]}
            for block, near in _least(one, two, k):
                best[block] = (np.minimum(best[block][0], near) if block in best else near, own[block])
        for block, (near, c) in best.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "near": pa.array([near.tobytes()], pa.binary()), "c": pa.array([c], pa.binary())})

    def summed(t: pa.Table) -> pa.Table:
        own = np.frombuffer(t.column("c")[0].as_py(), np.int32)
        near = np.full((len(own), k), np.inf)
        for x in t.column("near"):
            np.minimum(near, np.frombuffer(x.as_py(), float).reshape(len(own), k), out=near)
        near = np.sqrt(np.maximum(near, 0) + (t.column("dim")[0].as_py() if compat else 0))
        sums, counts = np.zeros((k, k)), np.bincount(own, minlength=k)
        np.add.at(sums, own, np.where(np.isfinite(near), near, 0.0))
        i, j = np.nonzero(np.ones((k, k)) * (counts[:, None] > 0))
        return pa.table({"a": pa.array(i, pa.int32()), "b": pa.array(j, pa.int32()), "s": sums[i, j], "n": pa.array(counts[i], pa.int64())})

    dim = B.feature_dim(assigned) if compat else 0
    got = tiles.paired(packed, n, blocks, least, "block int, near binary, c binary").withColumn("dim", F.lit(dim)).groupBy("block").applyInArrow(summed, "a int, b int, s double, n bigint").groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums, counts = np.zeros((k, k)), np.zeros(k)
    for r in got.collect():  # k x k
        sums[r.a, r.b], counts[r.a] = r.s, r.n
    apart = (sums + sums.T) / np.maximum(counts[:, None] + counts[None], 1)
    np.fill_diagonal(apart, 0.0)
    return apart


def generalized_coverage(e: Experiment, n: int) -> list:
    """Adds the bag whose clusters raise the summed distance between covered clusters most; the last of equals."""
    spark, words = e.bags.sparkSession, e.words
    k = e.num_clusters
    shared = spark.sparkContext.broadcast(cluster_distances(e.assigned, k, e.compat))  # k x k
    picks, known = [], [0] * words
    while len(picks) < n:
        before = list(known)

        @F.pandas_udf("double")
        def reach(*masks):
            import pandas as pd

            out = []
            for row in zip(*masks, strict=True):
                every = [b | int(m) for b, m in zip(before, row, strict=True)]
                on = [i * WORD + j for i, w in enumerate(every) for j in range(WORD) if w >> j & 1]
                out.append(float(shared.value[np.ix_(on, on)].sum() / 2) if on else 0.0)
            return pd.Series(out, dtype=float)

        columns = [f"w{i}" for i in range(words)]
        kinds = _left(e.masks, picks).groupBy(*columns).agg(F.max("bag_id").alias("bag_id"))  # bags of equal clusters count once
        found = kinds.withColumn("score", F.round(reach(*columns), DIGITS)).agg(F.max(F.struct("score", "bag_id", *columns)).alias("b")).first().b
        if found is None:
            break
        picks.append(found.bag_id)
        known = [b | found[c] for b, c in zip(known, columns, strict=True)]
    return picks


METHODS: dict[str, Callable[[Experiment, int], list]] = {
    "random": random,
    "random_non_empty": random_non_empty,
    "coverage_oracle": coverage_oracle,
    "cluster_centers": cluster_centers,
    "cluster_coverage": cluster_coverage,
    "cluster_coverage_tiebreak": cluster_coverage_tiebreak,
    "unified_CCMIFF": unified_coverage,
    "generalized_coverage": generalized_coverage,
    "instance_coverage": instance_coverage,
    "farthest": instance_farthest,
    "farthest2": bag_farthest,
    "farthest3": lambda e, n: bag_farthest(e, n, 2),
    "MIFF": miff,
    "MIFFk1": miff,
    "MIFFk2": lambda e, n: miff(e, n, 2),
    "CCMIFF": coverage_then_miff,
}


def curve(bags: DataFrame, picks: list) -> DataFrame:
    """(i, n_known): known classes before the first pick and after each."""
    spark = bags.sparkSession
    order = spark.createDataFrame([(i + 1, p) for i, p in enumerate(picks)], StructType([StructField("i", bags.sparkSession.range(0).select(F.col("id").cast("int")).schema[0].dataType), StructField("bag_id", bags.schema["bag_id"].dataType)]))
    seen = bags.join(F.broadcast(order), "bag_id").select("i", F.explode("labels").alias("y")).groupBy("y").agg(F.min("i").alias("i"))  # picks are few
    new = seen.groupBy("i").agg(F.count("*").alias("n"))
    every = spark.range(len(picks) + 1).select(F.col("id").cast("int").alias("i")).join(new, "i", "left").fillna(0)
    return every.select("i", F.sum("n").over(Window.orderBy("i")).cast("int").alias("n_known"))  # as many rows as picks


def select_bags(bags: DataFrame, instances: DataFrame, method: str, n: int, seed: int | None = None, k: int = CODEBOOK) -> list:
    """Bag ids in the order of a method."""
    return METHODS[method](Experiment(bags, instances, None, k, seed or 0), n)


def experiment(bags: DataFrame, instances: DataFrame, methods: list[str], n: int, repetitions: int, bootstrap: bool = True, seed: int = 0, k: int = CODEBOOK) -> DataFrame:
    """(method, repetition, i, n_known): discovery curves, each over a part of the bags drawn by a hash of their ids."""
    out = None
    for rep in range(repetitions):
        whole = Experiment(bags, instances, seed=seed + rep)
        own = cut(bags.filter(whole.chance(1) < SUBSAMPLE) if bootstrap else bags)
        part = instances.join(own.select("bag_id"), "bag_id", "left_semi").repartition("bag_id", "segment_id")  # a file may be a task's alone
        e = Experiment(own, cut(part), None, k, seed + rep)
        for method in methods:
            c = curve(own, METHODS[method](e, n)).select(F.lit(method).alias("method"), F.lit(rep).alias("repetition"), "i", "n_known")
            out = c if out is None else out.unionByName(c)
    return out


def averaged(curves: DataFrame) -> DataFrame:
    """(method, i, mean, std): population deviation over repetitions."""
    return curves.groupBy("method", "i").agg(F.avg("n_known").alias("mean"), F.stddev_pop("n_known").alias("std"))
