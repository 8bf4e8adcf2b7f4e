"""Random forests with out-of-bag estimates.

Trees are numpy arrays of nodes. Forests on tables are grown by ``growth``; here are
the model, its use, and the plain form of growing on a matrix of checked size, whose
trees Spark tasks grow side by side. Splits are Gini sweeps at midpoints between
different neighbours.

By default leaves hold one-hot majorities, as the models this follows have always
voted; ``leaf='histogram'`` keeps the label distribution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: A training matrix of more bytes isn't broadcast.
MAX_MATRIX_BYTES = 512 << 20
#: Neighbouring values that differ by less aren't split.
LEAST_GAP = 1e-6


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    hist: np.ndarray

    @classmethod
    def of(cls, nodes: list[list]) -> Tree:
        f, t, a, b, h = zip(*nodes, strict=True)
        return cls(np.array(f, np.int32), np.array(t, float), np.array(a, np.int32), np.array(b, np.int32), np.array(h, float))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.nonzero(f >= 0)[0]
            if not len(inner):
                return at
            k = at[inner]
            at[inner] = np.where(x[inner, f[inner]] < self.threshold[k], self.left[k], self.right[k])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.hist[self.leaves(x)]


@dataclass
class Forest:
    trees: list[Tree]
    num_classes: int
    dim: int
    in_bag: list[np.ndarray] = field(default_factory=list)
    seeds: list[int] = field(default_factory=list)  # what the trees' draws follow from, if they were grown on a table

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sum((t.probabilities(x) for t in self.trees), np.zeros((len(x), self.num_classes))) / max(1, len(self.trees))

    def classify(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(1)

    def out_of_bag(self, x: np.ndarray) -> np.ndarray:
        """Of the training rows, by the trees that haven't seen them; zeros where all have."""
        total, n = np.zeros((len(x), self.num_classes)), np.zeros(len(x))
        for t, seen in zip(self.trees, self.in_bag, strict=True):
            out = np.ones(len(x), bool)
            out[seen] = False
            total[out] += t.probabilities(x[out])
            n += out
        return total / np.maximum(n, 1)[:, None]


def gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    return 1 - (p * p).sum(-1)


def best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, num_classes: int) -> tuple[int, float] | None:
    """(feature, threshold) of the least weighted Gini; the first of equals, features in the order given."""
    best, found = np.inf, None
    hot = np.eye(num_classes)[y]
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, labels = x[order, f], y[order]
        can = np.nonzero((labels[1:] != labels[:-1]) & (np.abs(v[1:] - v[:-1]) >= LEAST_GAP))[0]
        if not len(can):
            continue
        left = np.cumsum(hot[order], 0)[can]
        right = hot.sum(0) - left
        n = len(y)
        score = (left.sum(1) * gini(left) + right.sum(1) * gini(right)) / n
        i = int(score.argmin())
        if score[i] < best - 1e-12:
            best, found = score[i], (int(f), float((v[can[i]] + v[can[i] + 1]) / 2))
    return found


def best_splits(spark: SparkSession, x: np.ndarray, y: np.ndarray, num_classes: int) -> DataFrame:
    """(feature, threshold, gini): the best split of each feature that has one, a feature to a row of the work that tasks share."""
    verify(x, y, num_classes)
    check_size(x)
    shared = spark.sparkContext.broadcast((x, y))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value
        hot = np.eye(num_classes)[b]
        for batch in batches:
            rows = []
            for f in batch["id"]:
                if split := best_split(a, b, np.array([f]), num_classes):
                    less = a[:, split[0]] < split[1]
                    sides = np.stack([hot[less].sum(0), hot[~less].sum(0)])
                    rows.append((*split, float((sides.sum(1) * gini(sides)).sum() / len(b))))
            yield pd.DataFrame(rows, columns=["feature", "threshold", "gini"]).astype({"feature": "int32", "threshold": float, "gini": float})

    width = max(1, min(x.shape[1], spark.sparkContext.defaultParallelism))
    return spark.range(0, x.shape[1], 1, width).mapInPandas(run, "feature int, threshold double, gini double")


def grow(x: np.ndarray, y: np.ndarray, num_classes: int, rng: np.random.Generator, max_depth: int = 15, leaf: str = "majority", mtry: int | None = None) -> Tree:
    """A tree on rows as they are; each node looks at ``mtry`` features chosen at random."""
    mtry = mtry or int(math.log2(x.shape[1])) + 1
    nodes, todo = [[-1, 0.0, -1, -1, None]], [(0, np.arange(len(y)), 0)]
    while todo:
        k, rows, depth = todo.pop()
        own = y[rows]
        split = None
        if depth < max_depth and len(rows) and (own != own[0]).any():
            split = best_split(x[rows], own, rng.permutation(x.shape[1])[:mtry], num_classes)
        counts = np.bincount(own, minlength=num_classes).astype(float)
        hist = counts / max(1.0, counts.sum())
        nodes[k][4] = hist if leaf == "histogram" else np.eye(num_classes)[hist.argmax()]
        if split:
            less = x[rows, split[0]] < split[1]
            nodes[k][:4] = [split[0], split[1], len(nodes), len(nodes) + 1]
            for side in (rows[less], rows[~less]):
                nodes.append([-1, 0.0, -1, -1, None])
                todo.append((len(nodes) - 1, side, depth + 1))
    return Tree.of(nodes)


def bootstrap(y: np.ndarray, num_classes: int, rng: np.random.Generator, balanced: bool = False) -> np.ndarray:
    """Row numbers with replacement; balanced: a class at random first, then one of its rows."""
    if not balanced:
        return rng.integers(0, len(y), len(y))
    by = [r for c in range(num_classes) if len(r := np.nonzero(y == c)[0])]
    return np.array([by[c][rng.integers(len(by[c]))] for c in rng.integers(0, len(by), len(y))])


def verify(x: np.ndarray, y: np.ndarray, num_classes: int) -> list[int]:
    """Check a training set; the classes without an example."""
    if not len(x) or len(x) != len(y):
        raise ValueError("no examples, or not a label for each")
    if not np.isfinite(x).all():
        raise ValueError("features hold NaN or infinity")
    return [c for c in range(num_classes) if not (y == c).any()]


def check_size(x: np.ndarray) -> None:
    if x.nbytes > MAX_MATRIX_BYTES:
        raise ValueError(f"a training matrix of {x.nbytes} bytes; sample it to {MAX_MATRIX_BYTES}")


def train_local(x: np.ndarray, y: np.ndarray, num_classes: int, trees: int, seed: int = 0, **options) -> Forest:
    """A forest grown in this process: what one task does, and what the per-class models nest."""
    verify(x, y, num_classes)
    balanced, out, bags = options.pop("balanced", False), [], []
    for t in range(trees):
        rng = np.random.default_rng((seed, t))
        rows = bootstrap(y, num_classes, rng, balanced)
        out.append(grow(x[rows], y[rows], num_classes, rng, **options))
        bags.append(np.unique(rows))
    return Forest(out, num_classes, x.shape[1], bags)


def train(spark: SparkSession, x: np.ndarray, y: np.ndarray, num_classes: int, trees: int, seed: int = 0, **options) -> Forest:
    """A forest whose trees are grown by Spark tasks; a tree follows from its number, so a lost task gives the same again."""
    import pickle

    verify(x, y, num_classes)
    check_size(x)
    shared = spark.sparkContext.broadcast((x, y))
    balanced = options.pop("balanced", False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value
        for batch in batches:
            for t in batch["id"]:
                rng = np.random.default_rng((seed, int(t)))
                rows = bootstrap(b, num_classes, rng, balanced)
                yield pd.DataFrame({"tree": [int(t)], "model": [pickle.dumps(grow(a[rows], b[rows], num_classes, rng, **options))], "bag": [pickle.dumps(np.unique(rows))]})

    width = max(1, min(trees, spark.sparkContext.defaultParallelism))
    rows = sorted(spark.range(0, trees, 1, width).mapInPandas(run, "tree long, model binary, bag binary").collect())
    return Forest([pickle.loads(r.model) for r in rows], num_classes, x.shape[1], [pickle.loads(r.bag) for r in rows])


def score(df: DataFrame, forest: Forest, features: str = "features") -> DataFrame:
    """The input with ``probabilities``: the forest is broadcast, rows stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    from pyspark.sql import functions as F

    @F.pandas_udf("array<double>")
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.probabilities(np.array(v.tolist(), float)))) if len(v) else pd.Series([], dtype=object)

    return df.withColumn("probabilities", of(F.col(features)))
