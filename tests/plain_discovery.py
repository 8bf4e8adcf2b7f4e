"""Plain forms of class discovery, on the arrays of one experiment: orders in which to look at bags so as to meet many classes early.

A method takes a ``Bags`` (numpy arrays of one experiment) and a number of picks and
returns places in it. ``METHODS`` names them; add to it to plug one in. Repetitions
are Spark tasks over a broadcast experiment whose size is checked. Where the
original methods could pick a bag twice, picks are excluded here, and a random
start is the first non-empty bag unless a generator is given. ``compat`` distances
add one for each dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators.forest import MAX_MATRIX_BYTES

#: Share of the bags in a repetition's subsample, drawn without replacement.
SUBSAMPLE = 0.63
CODEBOOK = 50


@dataclass
class Bags:
    """``bag`` says for each row of ``x`` which place of ``labels`` it belongs to."""

    ids: np.ndarray
    labels: list[set]
    bag: np.ndarray
    x: np.ndarray
    rng: np.random.Generator | None = None
    compat: bool = False
    near: tuple = ((), None)  # picks, and each instance's distance to the nearest of theirs

    def __len__(self) -> int:
        return len(self.labels)

    def of(self, i: int) -> np.ndarray:
        return self.x[self.bag == i]

    def filled(self) -> np.ndarray:
        return np.isin(np.arange(len(self)), self.bag)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)
        return d + a.shape[1] if self.compat else d

    def first(self) -> int:
        """The start of traversals: a non-empty bag, if there is one."""
        full = np.nonzero(self.filled())[0]
        if not len(full):
            return 0
        return int(self.rng.choice(full)) if self.rng is not None else int(full[0])

    def subset(self, keep: np.ndarray, rng: np.random.Generator | None = None) -> Bags:
        place = np.full(len(self), -1)
        place[keep] = np.arange(len(keep))
        on = place[self.bag] >= 0
        return Bags(self.ids[keep], [self.labels[i] for i in keep], place[self.bag[on]], self.x[on], rng, self.compat)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator | None = None, iterations: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(centers, assignment) by Lloyd's rounds; D² seeds, from the first row on without a generator."""
    k = min(k, len(x))
    if not k:
        return np.zeros((0, x.shape[1])), np.zeros(0, int)
    centers = [x[0 if rng is None else rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k and near.sum() > 0:
        i = int(near.argmax()) if rng is None else int(rng.choice(len(x), p=near / near.sum()))
        centers.append(x[i])
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
    c, before = np.array(centers), None
    for _ in range(iterations):
        d = _distances(x, c)
        at = d.argmin(1)
        mean = d.min(1).mean()
        if mean == before:
            break
        before = mean
        c = np.array([x[at == j].mean(0) if (at == j).any() else np.zeros(x.shape[1]) for j in range(len(c))])
    return c, _distances(x, c).argmin(1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances by (row, center), a center at a time: no array of rows by centers by dimensions is made."""
    return np.stack([((x - c) ** 2).sum(1) for c in centers], 1)


def _generator(b: Bags) -> np.random.Generator:
    return b.rng if b.rng is not None else np.random.default_rng(0)


def random(b: Bags, n: int) -> list[int]:
    return [int(i) for i in _generator(b).permutation(len(b))[:n]]


def random_non_empty(b: Bags, n: int) -> list[int]:
    order = _generator(b).permutation(len(b))
    full = b.filled()
    return [int(i) for i in [*order[full[order]], *order[~full[order]]]][:n]


def _greedy_sets(sets: list[set], n: int, tie: Callable[[list[int], list[int]], int] | None = None) -> list[int]:
    """Most new elements first; ties go to ``tie(tied, picks)`` or the first."""
    picks, known = [], set()
    while len(picks) < min(n, len(sets)):
        left = [i for i in range(len(sets)) if i not in picks]
        gains = [len(sets[i] - known) for i in left]
        tied = [i for i, g in zip(left, gains, strict=True) if g == max(gains)]
        i = tied[0] if tie is None or len(tied) == 1 else tie(tied, picks)
        picks.append(i)
        known |= sets[i]
    return picks


def coverage_oracle(b: Bags, n: int) -> list[int]:
    """By the true labels: the upper bound."""
    return _greedy_sets(b.labels, n)


def _cluster_sets(b: Bags, k: int) -> tuple[list[set], np.ndarray, np.ndarray]:
    c, at = kmeans(b.x, k, b.rng)
    return [set(at[b.bag == i].tolist()) for i in range(len(b))], c, at


def cluster_centers(b: Bags, n: int) -> list[int]:
    """The bag of the instance nearest to each of n centers, larger clusters first."""
    c, at = kmeans(b.x, n, b.rng)
    found = []
    for j in range(len(c)):
        own = np.nonzero(at == j)[0]
        if len(own):
            d = ((b.x[own] - c[j]) ** 2).sum(1)
            found.append((len(own), int(b.bag[own[len(own) - 1 - d[::-1].argmin()]])))
    order = [i for _, i in sorted(found, reverse=True)]
    return _completed(list(dict.fromkeys(order)), b, n)


def _completed(picks: list[int], b: Bags, n: int) -> list[int]:
    """Filled up to n with the first bags not yet picked."""
    return (picks + [i for i in range(len(b)) if i not in picks])[: min(n, len(b))]


def cluster_coverage(b: Bags, n: int, k: int = CODEBOOK) -> list[int]:
    return _greedy_sets(_cluster_sets(b, k)[0], n)


def _nearest(b: Bags, i: int, picks: list[int]) -> np.ndarray:
    """Distances from a bag's instances to the nearest of the picked bags; a running minimum, to which a step adds its own pick alone."""
    before, near = b.near
    if near is None or tuple(picks[: len(before)]) != before:
        before, near = (), np.full(len(b.x), np.inf)
    for p in picks[len(before) :]:
        if len(own := b.of(p)):
            near = np.minimum(near, b.distances(b.x, own).min(1))
    b.near = (tuple(picks), near)
    return near[b.bag == i]


def _far_score(b: Bags, i: int, picks: list[int], k: int) -> float:
    """Sum of the k largest distances from a bag's instances to the covered ones."""
    d = np.sort(_nearest(b, i, picks))[::-1][:k]
    return float(np.minimum(d, 3.4e38).sum()) if len(d) else -1.0


def greedy_within(b: Bags, i: int, picks: list[int], k: int) -> float:
    """As ``_far_score``, but an instance taken counts as covered for the next; the last of equals is taken."""
    x = b.of(i)
    if not len(x):
        return -1.0
    near, total, left = _nearest(b, i, picks), 0.0, np.ones(len(x), bool)
    for _ in range(min(k, len(x))):
        d = np.where(left, near, -1)
        j = len(d) - 1 - int(d[::-1].argmax())
        total += min(float(d[j]), 3.4e38)
        left[j] = False
        near = np.minimum(near, b.distances(x, x[j : j + 1])[:, 0])
    return total


def _by_score(b: Bags, n: int, score: Callable[[int, list[int]], float], last: bool = False) -> list[int]:
    picks = [b.first()] if len(b) else []
    while len(picks) < min(n, len(b)):
        left = [i for i in range(len(b)) if i not in picks]
        s = np.array([score(i, picks) for i in left])
        picks.append(left[len(s) - 1 - int(s[::-1].argmax()) if last else int(s.argmax())])
    return picks


def cluster_coverage_tiebreak(b: Bags, n: int, k: int = CODEBOOK) -> list[int]:
    """Cluster coverage; ties go to the bag with the instance farthest from the covered."""
    sets = _cluster_sets(b, k)[0]
    return _greedy_sets(sets, n, lambda tied, picks: max(tied, key=lambda i: (_far_score(b, i, picks, 1), -i)))


def unified_coverage(b: Bags, n: int, k: int = CODEBOOK, depth: int = 2) -> list[int]:
    """Cluster coverage; ties go to the best greedy farthest score, then by chance."""
    sets, rng = _cluster_sets(b, k)[0], _generator(b)
    return _greedy_sets(sets, n, lambda tied, picks: max(tied, key=lambda i: greedy_within(b, i, picks, depth) if len(b.of(i)) else float(rng.uniform(-2, -1))))


def generalized_coverage(b: Bags, n: int, k: int = CODEBOOK) -> list[int]:
    """Adds the bag whose clusters raise the summed distance between covered clusters most; the last of equals."""
    sets, _, at = _cluster_sets(b, k)
    m = int(at.max()) + 1 if len(at) else 0
    groups = [b.x[at == j] for j in range(m)]
    apart = np.zeros((m, m))
    for i in range(m):
        for j in range(i):
            d = np.sqrt(b.distances(groups[i], groups[j]))
            apart[i, j] = apart[j, i] = (d.min(1).sum() + d.min(0).sum()) / sum(d.shape)
    picks, known = [], set()
    while len(picks) < min(n, len(b)):
        left = [i for i in range(len(b)) if i not in picks]
        gain = [apart[np.ix_(both, both)].sum() / 2 for both in (sorted(known | sets[i]) for i in left)]
        i = left[len(gain) - 1 - int(np.argmax(gain[::-1]))]
        picks.append(i)
        known |= sets[i]
    return picks


def instance_coverage(b: Bags, n: int) -> list[int]:
    """Adds the bag with the largest sum of distances to all covered instances; the last of equals."""
    return _by_score(b, n, lambda i, picks: float(np.sqrt(b.distances(b.of(i), b.x[np.isin(b.bag, picks)])).sum()) if len(b.of(i)) else 0.0, last=True)


def instance_farthest(b: Bags, n: int) -> list[int]:
    """Bags in the order that a farthest-first walk over instances, four times as long, meets them."""
    if not len(b.x):
        return _completed([], b, n)
    order, near = [0], b.distances(b.x, b.x[:1])[:, 0]
    while len(order) < min(4 * n, len(b.x)):
        i = int(near.argmax())
        order.append(i)
        near = np.minimum(near, b.distances(b.x, b.x[i : i + 1])[:, 0])
    return _completed(list(dict.fromkeys(int(b.bag[i]) for i in order)), b, n)


def bag_farthest(b: Bags, n: int, depth: int = 1) -> list[int]:
    return _by_score(b, n, lambda i, picks: _far_score(b, i, picks, depth))


def miff(b: Bags, n: int, depth: int = 1) -> list[int]:
    """Multi-instance farthest first: the best greedy sum of ``depth`` distances; the last of equals."""
    return _by_score(b, n, lambda i, picks: greedy_within(b, i, picks, depth), last=True)


def coverage_then_miff(b: Bags, n: int, k: int = CODEBOOK, depth: int = 2) -> list[int]:
    """Cluster coverage with tie-breaks until every cluster is covered, then farthest first."""
    sets = _cluster_sets(b, k)[0]
    every, picks, known = set().union(*sets) if sets else set(), [], set()
    for i in cluster_coverage_tiebreak(b, n, k):
        if known == every and picks:
            break
        picks.append(i)
        known |= sets[i]
    while len(picks) < min(n, len(b)):
        left = [i for i in range(len(b)) if i not in picks]
        s = np.array([greedy_within(b, i, picks, depth) for i in left])
        picks.append(left[len(s) - 1 - int(s[::-1].argmax())])
    return picks


METHODS: dict[str, Callable[[Bags, int], list[int]]] = {
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
    "farthest3": lambda b, n: bag_farthest(b, n, 2),
    "MIFF": miff,
    "MIFFk1": miff,
    "MIFFk2": lambda b, n: miff(b, n, 2),
    "CCMIFF": coverage_then_miff,
}


def curve(b: Bags, picks: list[int]) -> list[int]:
    """Known labels before the first pick and after each."""
    known, out = set(), [0]
    for i in picks:
        known |= b.labels[i]
        out.append(len(known))
    return out


def gather(bags: DataFrame, segments: DataFrame, compat: bool = False) -> Bags:
    """One experiment's arrays on the driver, after a check of their size."""
    n, d = segments.selectExpr("count(*)", "coalesce(max(size(features)), 0)").first()
    if n * d * 8 > MAX_MATRIX_BYTES:
        raise ValueError(f"{n} instances of {d} features don't fit one experiment; sample bags first")
    b = bags.select("bag_id", "labels").toPandas().sort_values("bag_id")
    s = segments.select("bag_id", "segment_id", "features").toPandas().sort_values(["bag_id", "segment_id"])
    place = {k: i for i, k in enumerate(b["bag_id"])}
    s = s[s["bag_id"].isin(place)]
    x = np.array(s["features"].tolist(), float).reshape(len(s), d)
    return Bags(b["bag_id"].to_numpy(), [set(y) if y is not None else set() for y in b["labels"]], s["bag_id"].map(place).to_numpy(int), x, None, compat)


def select_bags(bags: DataFrame, segments: DataFrame, method: str, n: int, seed: int | None = None) -> list:
    """Bag ids in the order of a method."""
    b = gather(bags, segments)
    b.rng = None if seed is None else np.random.default_rng(seed)
    return [b.ids[i].item() for i in METHODS[method](b, n)]


def experiment(bags: DataFrame, segments: DataFrame, methods: list[str], n: int, repetitions: int, bootstrap: bool = True, seed: int = 0) -> DataFrame:
    """(method, repetition, i, n_known): discovery curves. A repetition of a method is one task and follows from its numbers."""
    spark = bags.sparkSession
    shared = spark.sparkContext.broadcast(gather(bags, segments))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = shared.value
        for t in batches:
            for method, rep in zip(t["method"], t["repetition"], strict=True):
                rng = np.random.default_rng((seed, int(rep)))
                keep = np.sort(rng.permutation(len(whole))[: max(1, int(len(whole) * SUBSAMPLE))]) if bootstrap else np.arange(len(whole))
                b = whole.subset(keep, rng)
                c = curve(b, METHODS[method](b, min(n, len(b))))
                yield pd.DataFrame({"method": method, "repetition": rep, "i": range(len(c)), "n_known": c})

    tasks = spark.createDataFrame([(m, r) for m in methods for r in range(repetitions)], "method string, repetition int").repartition(len(methods) * repetitions)
    return tasks.mapInPandas(run, "method string, repetition int, i int, n_known int")
