"""Multi-label classifiers on forests, their calibration, measures and experiments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators import growth
from murmura.operators.forest import train_local
from murmura.session import cut

THRESHOLDS = np.arange(1, 1000) / 1000.0


# -- measures of one example: Y a label array, scores an array of c scores


def hamming_loss(predicted: Column, truth: Column, c: int) -> Column:
    """Labels that differ, over all labels."""
    return (F.size(F.array_except(predicted, truth)) + F.size(F.array_except(truth, predicted))) / F.lit(float(c))


def set01_loss(predicted: Column, truth: Column) -> Column:
    return F.when(F.array_sort(F.array_distinct(predicted)) == F.array_sort(F.array_distinct(truth)), 0.0).otherwise(1.0)


def rank_loss(scores: Column, truth: Column, compat: bool = False) -> Column:
    """Share of (label, non-label) pairs that aren't in order; null for an empty or full set (``compat``: NaN)."""
    yes = F.filter(scores, lambda s, i: F.array_contains(truth, i))
    no = F.filter(scores, lambda s, i: ~F.array_contains(truth, i))
    bad = F.aggregate(yes, F.lit(0), lambda t, s: t + F.size(F.filter(no, lambda o: s <= o)))
    pairs = F.size(yes) * F.size(no)
    return F.when(pairs > 0, bad / pairs).otherwise(F.lit(float("nan")) if compat else F.lit(None).cast("double"))


def one_error(scores: Column, truth: Column) -> Column:
    """Whether the first top-scored class is not a label."""
    return F.when(F.array_contains(truth, (F.array_position(scores, F.array_max(scores)) - 1).cast("int")), 0.0).otherwise(1.0)


def coverage(scores: Column, truth: Column) -> Column:
    """How deep, from 0, the ranking goes to the last label; of equal scores the higher class stands first."""
    depth = F.transform(truth, lambda y: F.size(F.filter(scores, lambda s, j: (s > F.get(scores, y)) | ((s == F.get(scores, y)) & (j > y)))))
    return F.coalesce(F.array_max(depth), F.lit(0))


def confusion(predicted: Column, truth: Column, c: int) -> Column:
    """struct<tp, fp, tn, fn> over the c labels."""
    tp, fp, fn = F.size(F.array_intersect(predicted, truth)), F.size(F.array_except(predicted, truth)), F.size(F.array_except(truth, predicted))
    return F.struct(tp.alias("tp"), fp.alias("fp"), (c - tp - fp - fn).alias("tn"), fn.alias("fn"))


def above(scores: Column, thresholds: Column) -> Column:
    """The classes whose score exceeds their threshold."""
    return F.filter(F.transform(F.zip_with(scores, thresholds, lambda s, t: s > t), lambda b, i: F.when(b, i)), lambda i: i.isNotNull())


def metric_means(df: DataFrame, scores: str, predicted: str, truth: str, c: int, by: list[str] | None = None) -> DataFrame:
    """Means of the five measures and the accuracy, over all examples."""
    s, p, y = F.col(scores), F.col(predicted), F.col(truth)
    return df.groupBy(*(by or [])).agg(
        F.avg(hamming_loss(p, y, c)).alias("hamming_loss"),
        F.avg(rank_loss(s, y)).alias("rank_loss"),
        F.avg(set01_loss(p, y)).alias("set01_loss"),
        F.avg(one_error(s, y)).alias("one_error"),
        F.avg(coverage(s, y)).alias("coverage"),
        (1 - F.avg(hamming_loss(p, y, c))).alias("accuracy"),
    )


def calibrated(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """For each group the first threshold of 0.001 … 0.999 with the fewest errors of ``score > threshold``.

    Only scores in thousandths matter: rows are counted by the number of
    thresholds they exceed, and errors are running sums of those counts, so a
    group is 1000 rows at most however many scores it has.
    """
    from pyspark.sql import Window

    over = F.least(F.greatest(F.ceil(F.round(F.col(score) * 1000, 9)) - 1, F.lit(0)), F.lit(999))  # thresholds i/1000 below the score
    counts = df.groupBy(*by, over.alias("k")).agg(F.sum(F.col(positive).cast("int")).alias("p"), F.sum(1 - F.col(positive).cast("int")).alias("n"))
    grid = df.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(999)).cast("array<bigint>")))
    full = grid.join(counts, [*by, "k"], "left").fillna(0, ["p", "n"])
    w = Window.partitionBy(*by).orderBy("k")
    # at threshold t/1000 a row is predicted positive if k >= t
    full = full.withColumn("missed", F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = full.withColumn("false", F.sum("n").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    best = full.filter("k > 0").groupBy(*by).agg(F.min(F.struct((F.col("missed") + F.col("false")).alias("errors"), "k")).alias("b"))
    return best.select(*by, (F.col("b.k") / 1000).alias("threshold"), F.col("b.errors").alias("errors"))


# -- classifiers on numpy arrays: the plain forms; labels by (row, class) of 0 and 1


def calibrate(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per class, the first threshold with the fewest errors."""
    errors = ((scores[:, :, None] > THRESHOLDS) != labels[:, :, None].astype(bool)).sum(0)
    return THRESHOLDS[errors.argmin(1)]


class BinaryRelevance:
    """A forest for each class, thresholds from out-of-bag scores."""

    def __init__(self, trees: int = 625, seed: int = 0, **options):
        self.trees, self.seed, self.options = trees, seed, options

    def fit(self, x: np.ndarray, labels: np.ndarray) -> BinaryRelevance:
        self.forests = [train_local(x, labels[:, c].astype(np.int64), 2, self.trees, self.seed * 1009 + c, **self.options) for c in range(labels.shape[1])]
        self.thresholds = calibrate(np.stack([f.out_of_bag(x)[:, 1] for f in self.forests], 1), labels)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([f.probabilities(x)[:, 1] for f in self.forests], 1)

    def classify(self, x: np.ndarray) -> np.ndarray:
        return (self.scores(x) > self.thresholds).astype(int)


class ClassifierChains:
    """Chains of forests in random class orders; a chain's later classes see its earlier ones.

    ``true_labels``: train on those; else on out-of-bag scores, as at prediction.
    """

    def __init__(self, chains: int = 25, trees: int = 25, true_labels: bool = False, seed: int = 0, **options):
        self.chains, self.trees, self.true_labels, self.seed, self.options = chains, trees, true_labels, seed, options

    def fit_chain(self, k: int, x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        order = np.random.default_rng((self.seed, k)).permutation(labels.shape[1])
        forests, oob, wide = [], np.zeros(labels.shape), x
        for c in order:
            f = train_local(wide, labels[:, c].astype(np.int64), 2, self.trees, self.seed * 7919 + k * 101 + int(c), **self.options)
            forests.append(f)
            oob[:, c] = f.out_of_bag(wide)[:, 1]
            wide = np.column_stack([wide, labels[:, c] if self.true_labels else oob[:, c]])
        return order, forests, oob

    def fit(self, x: np.ndarray, labels: np.ndarray) -> ClassifierChains:
        made = [self.fit_chain(k, x, labels) for k in range(self.chains)]
        self.parts = [(order, forests) for order, forests, _ in made]
        self.thresholds = calibrate(sum(oob for _, _, oob in made) / len(made), labels)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = 0
        for order, forests in self.parts:
            wide, own = x, np.zeros((len(x), len(order)))
            for c, f in zip(order, forests, strict=True):
                own[:, c] = f.probabilities(wide)[:, 1]
                wide = np.column_stack([wide, own[:, c]])
            total = total + own
        return total / len(self.parts)

    def classify(self, x: np.ndarray) -> np.ndarray:
        return (self.scores(x) > self.thresholds).astype(int)


#: Plain classifiers by name.
CLASSIFIERS: dict[str, Callable] = {
    "binary_relevance": BinaryRelevance,
    "ecc": lambda **o: ClassifierChains(true_labels=False, **o),
    "ecc_oob": lambda **o: ClassifierChains(true_labels=True, **o),
}


#: How many partitions an experiment may name.
MAX_PARTS = 250


def _seed(*numbers: int) -> int:
    return int(np.random.default_rng(numbers).integers(1 << 62))


def _relevance(rows: DataFrame, groups: list, num_classes: int, seed: int, trees: int = 625, **options) -> tuple[DataFrame, list[list[list[int]]]]:
    """``rows`` with ``scores`` of a forest for each group and class, and which places of it hold (group, class)."""
    specs = [growth.Spec(_seed(seed, rep, g, c, t), c, parts=train) for g, (rep, _, train, _) in enumerate(groups) for c in range(num_classes) for t in range(trees)]
    grown = growth.grow(rows, specs, 2, ["example_id"], targets="targets", part=F.col("part"), **options)
    forests = [(specs[i : i + trees], grown[i : i + trees]) for i in range(0, len(specs), trees)]
    scored = growth.unseen(rows, forests, 2, ["example_id"], part=F.col("part"), name="scores")
    return scored.withColumn("scores", _positive("scores")), [[[g * num_classes + c] for c in range(num_classes)] for g in range(len(groups))]


def _chains(rows: DataFrame, groups: list, num_classes: int, seed: int, chains: int = 25, trees: int = 25, true_labels: bool = False, **options) -> tuple[DataFrame, list[list[list[int]]]]:
    """The same for chains in random class orders: a link's forests see what the chain's earlier links say of a row.

    That is the score of the trees that haven't seen the row, or, with ``true_labels``
    and for rows of the group's own training parts, the label. All chains of all groups
    take a link at a time, each link's forests in the same passes.
    """
    links = [(g, k) for g in range(len(groups)) for k in range(chains)]
    orders = {(g, k): np.random.default_rng((seed, groups[g][0], k)).permutation(num_classes).tolist() for g, k in links}
    d, n = rows.agg(F.max(F.size("features"))).first()[0], len(links)
    rows = rows.withColumn("scores", F.array().cast("array<double>"))
    for s in range(num_classes):
        specs = []
        for at, (g, k) in enumerate(links):
            rep, _, train, _ = groups[g]
            own = (*range(d), *(d + j * n + at for j in range(s)))
            specs += [growth.Spec(_seed(seed, rep, g, k, s, t), orders[g, k][s], own, train) for t in range(trees)]
        grown = growth.grow(rows, specs, 2, ["example_id"], targets="targets", part=F.col("part"), **options)
        forests = [(specs[i : i + trees], grown[i : i + trees]) for i in range(0, len(specs), trees)]
        rows = growth.unseen(rows, forests, 2, ["example_id"], part=F.col("part"), name="link").withColumn("link", _positive("link"))
        seen = F.col("link")
        if true_labels:
            told = F.lit([orders[x][s] for x in links])
            learnt = F.lit([list(groups[g][2]) for g, _ in links])
            seen = F.transform("link", lambda v, i: F.when(F.array_contains(F.get(learnt, i), F.col("part")), F.get(F.col("targets"), F.get(told, i)).cast("double")).otherwise(v))
        rows = cut(rows.withColumn("features", F.concat("features", seen)).withColumn("scores", F.concat("scores", "link")).drop("link"))
    places = [[[orders[g, k].index(c) * n + g * chains + k for k in range(chains)] for c in range(num_classes)] for g in range(len(groups))]
    return rows, places


def _positive(scores: str) -> Column:
    """Of two-class probabilities end to end, those of class 1."""
    return F.filter(F.col(scores), lambda v, i: i % 2 == 1)


#: Classifiers on tables by name: (rows, groups, classes, seed, options) to scores and their places.
LEARNERS: dict[str, Callable] = {
    "binary_relevance": _relevance,
    "ecc": lambda *a, **o: _chains(*a, true_labels=False, **o),
    "ecc_oob": lambda *a, **o: _chains(*a, true_labels=True, **o),
}


def predictions(examples: DataFrame, classifier: str, num_classes: int, splits: list[tuple[str, list[str], list[str]]], repetitions: int = 1, seed: int = 0, **options) -> DataFrame:
    """(repetition, split, example_id, labels, scores, predicted) of every split's test rows.

    ``examples``: example_id, partition, labels, features; a split names the partitions
    it trains on and those it tests. The forests of all splits, repetitions and classes
    grow together on the table; thresholds are calibrated on training rows' scores by the
    trees that haven't seen them. Only models and thresholds come to the driver.
    """
    names = sorted({p for _, train, test in splits for p in (*train, *test)})
    if len(names) > MAX_PARTS:
        raise ValueError(f"{len(names)} partitions; {MAX_PARTS} at most")
    code = {p: i for i, p in enumerate(names)}
    groups = [(rep, name, tuple(code[p] for p in train), tuple(code[p] for p in test)) for rep in range(repetitions) for name, train, test in splits]
    part = F.coalesce(*(F.when(F.col("partition").cast("string") == p, F.lit(i)) for p, i in code.items()), F.lit(MAX_PARTS))
    targets = F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda c: F.array_contains("labels", c).cast("int"))
    rows = examples.select("example_id", part.alias("part"), F.col("labels").cast("array<int>").alias("labels"), F.col("features").cast("array<double>").alias("features")).withColumn("targets", targets)
    rows, places = LEARNERS[classifier](cut(rows), groups, num_classes, seed, **options)

    told = [(p, g, rep, name, p in train, p in test, places[g]) for g, (rep, name, train, test) in enumerate(groups) for p in {*train, *test}]
    told = F.broadcast(examples.sparkSession.createDataFrame(told, "part int, g int, repetition int, split string, learnt boolean, tested boolean, places array<array<int>>"))  # a row for each split and part
    mean = F.transform("places", lambda p: F.aggregate(p, F.lit(0.0), lambda t, i: t + F.get(F.col("scores"), i)) / F.size(p))
    met = cut(rows.join(told, "part").select("g", "repetition", "split", "example_id", "labels", mean.alias("scores"), "learnt", "tested"))
    scores = met.filter("learnt").select("g", F.posexplode("scores").alias("class", "score"), "labels").withColumn("positive", F.array_contains("labels", F.col("class")))
    best = calibrated(scores, "score", "positive", ["g", "class"])
    thresholds = best.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "threshold"))), lambda x: x["threshold"]).alias("thresholds"))  # a number for each split and class
    return met.filter("tested").join(F.broadcast(thresholds), "g").select("repetition", "split", "example_id", "labels", "scores", above(F.col("scores"), F.col("thresholds")).alias("predicted"))


def k_fold(folds: list[int]) -> list[tuple[str, list[str], list[str]]]:
    """Each fold tested on what the others train."""
    names = [str(f) for f in folds]
    return [(f, [x for x in names if x != f], [f]) for f in names]


def train_val_test() -> list[tuple[str, list[str], list[str]]]:
    """One split: ``train`` against ``test``. Validation rows are left out, as no parameter is tuned on them."""
    return [("test", ["train"], ["test"])]


def cross_validated(examples: DataFrame, classifier: str, num_classes: int, folds: list[int], repetitions: int = 1, seed: int = 0, **options) -> DataFrame:
    """(repetition, fold, example_id, labels, scores, predicted) of k-fold predictions. ``examples``: example_id, fold, labels, features."""
    got = predictions(examples.withColumnRenamed("fold", "partition"), classifier, num_classes, k_fold(folds), repetitions, seed, **options)
    return got.withColumn("split", F.col("split").cast("int")).withColumnRenamed("split", "fold")


#: The names of the two ways to partition an experiment.
MODES = ("k-fold", "train-val-test")


def experiment(examples: DataFrame, classifiers: list[str], num_classes: int, mode: str, folds: int | None = None, repetitions: int = 10, dataset: str = "", options: dict[str, dict] | None = None) -> DataFrame:
    """(dataset, classifier, repetition, hamming_loss, rank_loss, set01_loss, one_error, coverage, accuracy, tp, fp, tn, fn) by the partitioning that ``mode`` names.

    Means are over all tested rows of a repetition, whatever fold they are in.
    ``options``: of each classifier.
    """
    if mode not in MODES:
        raise ValueError(f"no partitioning {mode!r}; known: {', '.join(MODES)}")
    splits = k_fold(list(range(folds or 0))) if mode == "k-fold" else train_val_test()
    out = None
    for name in classifiers:
        p = predictions(examples, name, num_classes, splits, repetitions, **(options or {}).get(name, {}))
        p = p.withColumn("c", confusion(F.col("predicted"), F.col("labels"), num_classes))
        counts = p.groupBy("repetition").agg(*(F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "tn", "fn")))
        own = metric_means(p, "scores", "predicted", "labels", num_classes, ["repetition"]).join(counts, "repetition").select(F.lit(dataset).alias("dataset"), F.lit(name).alias("classifier"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def split_experiment(spark: SparkSession, train: tuple, test: tuple, classifier: str, **options) -> dict[str, float]:
    """One train/test run on numpy arrays: the measures' means on the test rows."""
    model = CLASSIFIERS[classifier](**options).fit(*train)
    s, hard, y = model.scores(test[0]), model.classify(test[0]), test[1]
    rows = [([float(v) for v in a], [int(i) for i in np.nonzero(b)[0]], [int(i) for i in np.nonzero(c)[0]]) for a, b, c in zip(s, hard, y, strict=True)]
    df = spark.createDataFrame(rows, "scores array<double>, predicted array<int>, labels array<int>")
    return metric_means(df, "scores", "predicted", "labels", y.shape[1]).first().asDict()
