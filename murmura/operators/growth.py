"""Random forests grown on tables, level by level.

1. Values become bins: those of a feature with at most ``bins`` different ones are bins
   of their own, which makes its splits exact; others are cut at quantiles. The binned
   rows are written once, a byte to a feature.
2. A level is one pass: each task walks its rows down the trees as far as they have
   grown and counts (tree, node, feature, bin, class); sums of these counts are all that
   is shuffled, and the best split of each node all that comes to the driver. Levels of
   very many nodes take several passes, so that a task's counts stay under ``CELLS``.
3. Bootstrap weights follow from a hash of the row's key and the tree (Poisson, as
   drawing with replacement from a large table gives), so they are never stored: a lost
   task draws the same again, and which trees haven't seen a row is known wherever the
   row is, which makes out-of-bag estimates a narrow pass as well.

All trees of a call grow together, each with its own target, its own choice of
features and of the parts of the table that it learns from: the forests of all classes
and of all folds of a cross-validation take as many passes as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators.forest import LEAST_GAP, Forest, Tree, gini
from murmura.session import cut, scratch_dir

BINS = 128
#: Counts that a task holds for a pass, and rows that it works on at a time.
CELLS, ROWS = 1 << 22, 1 << 14
ACCURACY = 10_000


@dataclass(frozen=True)
class Spec:
    """What one tree learns: a target (place in the row's targets) from some features and some parts of the table (None: all)."""

    seed: int
    target: int = 0
    features: tuple[int, ...] | None = None
    parts: tuple[int, ...] | None = None

    def weights(self, keys: np.ndarray, part: np.ndarray, rate: float | np.ndarray = 1.0, bootstrap: bool = True) -> np.ndarray:
        """How often the tree's training set holds each row."""
        w = draws(keys, self.seed, rate) if bootstrap else np.ones(len(keys), np.int64)
        return w if self.parts is None else np.where(np.isin(part, self.parts), w, 0)


@dataclass
class Cuts:
    """A feature's bins: either one for each value, or the ranges between edges."""

    values: np.ndarray
    exact: bool

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.values, x, "left" if self.exact else "right").astype(np.uint8)

    def threshold(self, left: int, right: int) -> float:
        """Between two bins with none in use between them."""
        return float((self.values[left] + self.values[right]) / 2 if self.exact else self.values[left])

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.values[right] - self.values[left] >= LEAST_GAP if self.exact else np.ones(len(left), bool)


@dataclass
class Growing:
    """A tree under way; a node is (feature, threshold, left, right, counts), ``bin`` its last left bin."""

    spec: Spec
    nodes: list[list] = field(default_factory=list)
    bins: list[int] = field(default_factory=list)

    def add(self, counts) -> int:
        self.nodes.append([-1, 0.0, -1, -1, counts])
        self.bins.append(-1)
        return len(self.nodes) - 1

    def finished(self, leaf: str, num_classes: int) -> Tree:
        hists = []
        for n in self.nodes:
            counts = np.asarray(n[4] if n[4] is not None else np.zeros(num_classes), float)
            hist = counts / max(1.0, counts.sum())
            hists.append(hist if leaf == "histogram" else np.eye(num_classes)[hist.argmax()])
        return Tree.of([[*n[:4], h] for n, h in zip(self.nodes, hists, strict=True)])


# -- draws


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@cache
def _poisson(rate: float) -> np.ndarray:
    """Cumulative chances of 0, 1, … as far as they differ from 1."""
    p, total, out, k = math.exp(-rate), 0.0, [], 0
    while total < 1 - 1e-12 and k < 200:
        total += p
        out.append(total)
        k += 1
        p *= rate / k
    return np.array(out)


def draws(keys: np.ndarray, seed: int, rate: float | np.ndarray = 1.0) -> np.ndarray:
    """How often a tree's bootstrap holds each row, from the hashes of their keys."""
    u = (_mixed(keys.view(np.uint64) ^ _mixed(np.array([seed + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)) * 2.0**-53
    if np.isscalar(rate):
        return np.searchsorted(_poisson(float(rate)), u, "right")
    out = np.empty(len(u), np.int64)
    for r in np.unique(rate):
        own = rate == r
        out[own] = np.searchsorted(_poisson(float(r)), u[own], "right")
    return out


def row_key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


# -- bins


def cuts_of(df: DataFrame, features: str = "features", bins: int = BINS) -> list[Cuts]:
    """Each feature's bins; what reaches the driver is at most ``bins`` numbers for each."""
    if not 2 <= bins <= 255:
        raise ValueError("2 to 255 bins")
    dim = df.agg(F.coalesce(F.max(F.size(features)), F.lit(0))).first()[0]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.empty(0)] * dim
        for b in batches:
            x = _matrix(b.column(0), dim)
            for f, v in enumerate(held):
                if v is not None:
                    v = np.unique(np.concatenate([v, x[:, f]]))
                    held[f] = v if len(v) <= bins else None
        rows = [(f, y) for f, v in enumerate(held) for y in ([None] if v is None else v.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.int32()), pa.array([y for _, y in rows], pa.float64())], names=["feature", "x"])

    found = df.select(features).mapInArrow(values, "feature int, x double").distinct()
    few = found.groupBy("feature").agg(F.count("*").alias("n"), F.max(F.col("x").isNull()).alias("many")).filter(~F.col("many") & (F.col("n") <= bins)).select("feature")
    exact: dict[int, list[float]] = {}
    for r in found.join(few, "feature").collect():  # at most ``bins`` to a feature
        exact.setdefault(r.feature, []).append(r.x)
    out = [Cuts(np.array(sorted(exact.get(f, []))), True) for f in range(dim)]
    if rest := [f for f in range(dim) if f not in exact]:
        marks = [i / bins for i in range(1, bins)]
        by = df.select(F.posexplode(features).alias("feature", "x")).filter(F.col("feature").isin(rest)).groupBy("feature")
        for r in by.agg(F.percentile_approx("x", marks, ACCURACY).alias("q")).collect():
            out[r.feature] = Cuts(np.unique(np.array(r.q, float)), False)
    return out


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), dim)
    if not np.isfinite(x).all():
        raise ValueError("features hold NaN or infinity")
    return x


def _binned(cuts: list[Cuts]):
    """(key, part, targets, features) rows to (key, part, targets, bins), a byte to each target and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _matrix(b.column(3), len(cuts))
                bins = np.stack([c.bin(x[:, f]) for f, c in enumerate(cuts)], 1) if len(cuts) else np.empty((len(x), 0), np.uint8)
                y = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _bytes(y.astype(np.uint8)), _bytes(bins)], names=["key", "part", "targets", "bins"])

    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return flat.reshape(len(column), -1)


# -- levels


def _walked(tree: Growing, bins: np.ndarray) -> np.ndarray:
    """The node that each binned row has reached."""
    feature, last, left, right = (np.array(v) for v in zip(*((n[0], b, n[2], n[3]) for n, b in zip(tree.nodes, tree.bins, strict=True)), strict=True))
    at = np.zeros(len(bins), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        k = at[inner]
        at[inner] = np.where(bins[inner, feature[k]] <= last[k], left[k], right[k])


def _counted(trees: list[Growing], slots: list[tuple[int, int]], chosen: np.ndarray, width: int, num_classes: int, rates: np.ndarray | None, bootstrap: bool):
    """A task's counts by cell; a cell is (slot, place among the slot's features, bin, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = chosen.shape[1]
        counts = np.zeros(len(slots) * most * width * num_classes, np.int64)
        by: dict[int, list[tuple[int, int]]] = {}
        for s, (t, node) in enumerate(slots):
            by.setdefault(t, []).append((node, s))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                keys, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                y, bins = _unpacked(b.column(2)), _unpacked(b.column(3))
                for t, own in by.items():
                    tree = trees[t]
                    label = y[:, tree.spec.target].astype(np.int64)
                    w = tree.spec.weights(keys, part, 1.0 if rates is None else rates[tree.spec.target][label], bootstrap)
                    rows = np.flatnonzero(w)
                    slot_of = np.full(len(tree.nodes), -1)
                    for node, s in own:
                        slot_of[node] = s
                    slot = slot_of[_walked(tree, bins[rows])]
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                    for j in range(most):
                        f = chosen[slot, j]
                        ok = f >= 0
                        cell = ((slot[ok] * most + j) * width + bins[rows[ok], f[ok]]) * num_classes + label[rows[ok]]
                        np.add.at(counts, cell, w[rows[ok]])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used // (most * width * num_classes), pa.int32()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["slot", "cell", "n"])

    return run


SPLITS = "slot int, place int, last int, next int, left array<bigint>, right array<bigint>"


def _chosen(chosen: np.ndarray, width: int, num_classes: int, cuts: list[Cuts]):
    """A slot's best split from its cells: the least weighted Gini, the first of equals."""

    def run(t: pa.Table) -> pa.Table:
        slot, most = t.column("slot")[0].as_py(), chosen.shape[1]
        cell, n = t.column("cell").to_numpy(), t.column("n").to_numpy()
        counts = np.zeros((most, width, num_classes), np.int64)
        counts.ravel()[cell - slot * most * width * num_classes] = n
        total, best, found = counts[0].sum(0), np.inf, (None, None, None)
        for j, f in enumerate(chosen[slot]):
            used = np.flatnonzero(counts[j].sum(1)) if f >= 0 else ()
            if len(used) < 2:
                continue
            left = np.cumsum(counts[j][used], 0)[:-1]
            can = np.flatnonzero(cuts[f].apart(used[:-1], used[1:]))
            if not len(can):
                continue
            left = left[can].astype(float)
            right = total - left
            score = (left.sum(1) * gini(left) + right.sum(1) * gini(right)) / total.sum()
            i = int(score.argmin())
            if score[i] < best - 1e-12:
                best, found, sides = score[i], (j, int(used[can[i]]), int(used[can[i] + 1])), (left[i].astype(int).tolist(), right[i].astype(int).tolist())
        if found[0] is None:
            sides = (total.tolist(), [0] * num_classes)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array([v], k) for v, k in zip((slot, *found, *sides), kinds, strict=True)], names=["slot", "place", "last", "next", "left", "right"])

    return run


def grow(
    df: DataFrame,
    specs: Sequence[Spec],
    num_classes: int,
    keys: Sequence[str],
    features: str = "features",
    targets: Column | str = "label",
    max_depth: int = 15,
    leaf: str = "majority",
    mtry: int | None = None,
    bins: int = BINS,
    bootstrap: bool = True,
    balanced: bool = False,
    part: Column | None = None,
) -> list[Tree]:
    """One tree for each spec, from a table of any size. ``targets``: a label, or an array of one for each target.

    ``keys`` tell rows apart; ``balanced`` draws every class of a target as often as the
    others. Labels are 0 to ``num_classes`` - 1. ``part``: the number of each row's part,
    by which specs choose rows; quantiles are those of all parts. A table without rows or
    features is refused; a tree whose parts have none is a leaf of zeros.
    """
    spark = df.sparkSession
    target = F.col(targets) if isinstance(targets, str) else targets
    wide = df.select(row_key(keys).alias("key"), (part if part is not None else F.lit(0)).cast("int").alias("part"), target.alias("targets"), F.col(features).cast("array<double>").alias("features"))
    if not wide.schema["targets"].dataType.typeName() == "array":
        wide = wide.withColumn("targets", F.array("targets"))
    wide = wide.withColumn("targets", F.col("targets").cast("array<int>"))
    cuts = cuts_of(wide, "features", bins)
    if not cuts:
        raise ValueError("no examples, or none with a feature")
    path = scratch_dir(spark, "bins")
    wide.mapInArrow(_binned(cuts), "key bigint, part int, targets binary, bins binary").write.parquet(path)
    rows = spark.read.parquet(path)
    rates = None
    if balanced:
        n = wide.select(F.posexplode("targets").alias("t", "y")).groupBy("t", "y").agg(F.count("*").alias("n")).collect()  # by target and class
        rates = np.ones((1 + max(r.t for r in n), num_classes))
        for t in range(len(rates)):
            own = {r.y: r.n for r in n if r.t == t}
            for y, m in own.items():
                rates[t, y] = sum(own.values()) / (len(own) * m)

    width = max((len(c.values) + 1 for c in cuts), default=1)
    trees = [Growing(s) for s in specs]
    for t in trees:
        t.add(None)
    frontier, depth = [(t, 0) for t in range(len(trees))], 0
    while frontier:
        every, following = {}, []
        for t, node in frontier:
            pool = np.arange(len(cuts)) if trees[t].spec.features is None else np.array(trees[t].spec.features)
            k = min(len(pool), mtry or int(math.log2(max(1, len(pool)))) + 1)
            every[t, node] = np.random.default_rng((trees[t].spec.seed, node)).permutation(pool)[:k]
        most = max(map(len, every.values()))
        step = max(1, CELLS // (most * width * num_classes))
        for a in range(0, len(frontier), step):
            slots = frontier[a : a + step]
            chosen = np.full((len(slots), most), -1)
            for i, s in enumerate(slots):
                chosen[i, : len(every[s])] = every[s]
            cells = rows.mapInArrow(_counted(trees, slots, chosen, width, num_classes, rates, bootstrap), "slot int, cell bigint, n bigint")
            best = cells.groupBy("slot", "cell").agg(F.sum("n").alias("n")).groupBy("slot").applyInArrow(_chosen(chosen, width, num_classes, cuts), SPLITS)
            for r in best.collect():  # a row for each node of the level
                t, node = slots[r.slot]
                tree = trees[t]
                tree.nodes[node][4] = tree.nodes[node][4] or [x + y for x, y in zip(r.left, r.right, strict=True)]
                if r.place is None or depth == max_depth:
                    continue
                f = int(chosen[r.slot, r.place])
                sides = [tree.add(c) for c in (list(r.left), list(r.right))]
                tree.nodes[node][:4] = [f, cuts[f].threshold(r.last, r.next), *sides]
                tree.bins[node] = r.last
                following += [(t, s) for s in sides if sum(x > 0 for x in tree.nodes[s][4]) > 1]
        depth += 1
        if depth >= max_depth:
            break
        frontier = sorted(following)
    return [t.finished(leaf, num_classes) for t in trees]


def train(df: DataFrame, num_classes: int, trees: int, keys: Sequence[str], seed: int = 0, features: str = "features", label: str = "label", **options) -> Forest:
    """A forest from a table; ``options`` as for ``grow``."""
    grown = grow(df, [Spec(seed * 100_003 + t) for t in range(trees)], num_classes, keys, features, label, **options)
    dim = df.agg(F.max(F.size(features))).first()[0]
    return Forest(grown, num_classes, dim, seeds=[seed * 100_003 + t for t in range(trees)])


def unseen(df: DataFrame, forests: Sequence[tuple[Sequence[Spec], Sequence[Tree]]], num_classes: int, keys: Sequence[str], features: str = "features", part: Column | None = None, name: str = "probabilities") -> DataFrame:
    """``df`` with the class probabilities of each forest, end to end, by the trees that haven't seen a row; zeros where all have.

    A narrow pass: which trees those are follows from the row's key and part, so rows
    must have the keys that the forests were grown with (not balanced). Rows of parts that
    a forest hasn't learnt from get what all its trees say.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(forests))  # models

    @F.pandas_udf("array<double>")
    def of(key, part, vectors):
        import pandas as pd

        out = np.zeros((len(key), len(shared.value), num_classes))
        if len(key):
            x, h, p = np.array(vectors.tolist(), float), key.to_numpy(), part.to_numpy()
            for i, (specs, trees) in enumerate(shared.value):
                n = np.zeros(len(x))
                for spec, tree in zip(specs, trees, strict=True):
                    rows = np.flatnonzero(spec.weights(h, p) == 0)
                    out[rows, i] += tree.probabilities(x[rows])
                    n[rows] += 1
                out[:, i] /= np.maximum(n, 1)[:, None]
        return pd.Series(list(out.reshape(len(key), -1)), dtype=object)

    return df.withColumn(name, of(row_key(keys), (part if part is not None else F.lit(0)).cast("int"), F.col(features)))


def out_of_bag(df: DataFrame, forest: Forest, keys: Sequence[str], features: str = "features") -> DataFrame:
    """The training rows with ``probabilities`` by the trees that haven't seen them; zeros where all have."""
    return unseen(df, [([Spec(s) for s in forest.seeds], forest.trees)], forest.num_classes, keys, features)


# -- exact splits of a whole table


def exact_splits(df: DataFrame, num_classes: int, features: str = "features", label: str = "label") -> DataFrame:
    """(feature, threshold, gini): each feature's best split at a midpoint between different neighbours; the first of equals.

    Different values are counted by class and sorted by range; a partition's running
    counts start from the totals of those before it, so no task holds a whole feature.
    """
    y = [f"n{c}" for c in range(num_classes)]
    rows = df.select(F.posexplode(features).alias("feature", "x"), F.col(label).alias("y"))
    by = rows.groupBy("feature", "x").agg(*(F.sum((F.col("y") == c).cast("bigint")).alias(y[c]) for c in range(num_classes)))
    ordered = cut(by.orderBy("feature", "x").withColumn("part_", F.spark_partition_id()))
    whole = ordered.groupBy("feature").agg(*(F.sum(c).alias(f"all_{c}") for c in y))  # as many as features
    ends = ordered.groupBy("part_").agg(F.min(F.struct("feature", "x")).alias("first_"), F.max("feature").alias("last_"))  # as many as partitions
    later = ends.select(F.col("part_"), F.lead("first_").over(Window.orderBy("part_")).alias("next_"))
    sums = ordered.groupBy("feature", "part_").agg(*(F.sum(c).alias(c) for c in y))  # as many as features and partitions
    w = Window.partitionBy("feature").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("feature", "part_", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in y))
    own = Window.partitionBy("part_", "feature").orderBy("x")
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ordered.join(F.broadcast(later), "part_").join(F.broadcast(before), ["feature", "part_"]).join(F.broadcast(whole), "feature")
    following = F.coalesce(F.struct(F.lead("x").over(own).alias("x"), *(F.lead(c).over(own).alias(c) for c in y)).getField("x"), F.when(F.col("next_.feature") == F.col("feature"), F.col("next_.x")))
    left = [F.col(f"before_{c}") + F.sum(c).over(running) for c in y]
    met = met.select("feature", "x", following.alias("nx"), F.array(*left).alias("left"), F.array(*(F.col(f"all_{c}") for c in y)).alias("all"))
    met = met.filter(F.col("nx") - F.col("x") >= LEAST_GAP).withColumn("right", F.zip_with("all", "left", lambda a, b: a - b))
    size = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda t, v: t + v)
    impure = lambda c: size(c) * (1 - F.aggregate(F.transform(c, lambda v: F.pow(v / size(c), F.lit(2.0))), F.lit(0.0), lambda t, v: t + v))
    scored = met.select("feature", ((F.col("x") + F.col("nx")) / 2).alias("threshold"), ((impure(F.col("left")) + impure(F.col("right"))) / size(F.col("all"))).alias("gini"))
    return scored.groupBy("feature").agg(F.min(F.struct(F.round("gini", 12).alias("k"), "threshold", "gini")).alias("b")).select("feature", "b.threshold", "b.gini")
