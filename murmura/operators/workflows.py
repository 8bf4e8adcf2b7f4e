"""Whole analyses as compositions of the operators: what one command of the toolkit runs.

``WORKFLOWS`` names them, so that a command line or scheduler can look one up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators import audio, forest, growth, selection, traversal
from murmura.operators import bags as B
from murmura.operators import recordings as R
from murmura.session import cut
from murmura.sources import text, wav


def _dry(bags: DataFrame, segments: DataFrame, rain_below: float | None) -> tuple[DataFrame, DataFrame]:
    """Bags below a rain probability and their segments; all without a threshold. Keys stay as they are."""
    if rain_below is None:
        return bags, segments
    kept = R.without_rain(bags, rain_below)
    return kept, segments.join(kept.select("bag_id"), "bag_id", "left_semi")


def discover(bags: DataFrame, segments: DataFrame, method: str, n: int, rain_below: float | None = None, seed: int | None = None) -> list:
    """Bag ids to look at, by a discovery method on rescaled features, with or without the rain filter."""
    bags, segments = _dry(bags, B.rescaled(segments), rain_below)
    return selection.select_bags(bags, cut(segments), method, n, seed)


def discover_random_dawn(bags: DataFrame, n: int, ts: str = "ts", seed: int = 0) -> list:
    return [r.bag_id for r in R.random_rows(R.dawn(bags, ts), n, ["bag_id"], seed).select("bag_id").collect()]


def discover_segments(segments: DataFrame, method: str, n: int, seed: int = 0) -> list[tuple]:
    """(bag_id, segment_id) of n segments: at random, farthest first, or one nearest to each of n cluster centers."""
    key = ["bag_id", "segment_id"]
    if method == "random":
        return [tuple(r) for r in R.random_rows(segments.select(*key), n, key, seed).collect()]
    scaled = cut(B.rescaled(segments))
    if method == "farthest":
        return traversal.farthest_first(scaled, n, key)
    centers, _ = B.lloyd(scaled, B.parallel_seeds(scaled, n, key, seed=seed))
    return [(r.bag_id, r.segment_id) for r in B.representatives(B.nearest(scaled, centers), key).orderBy("cluster").collect()]


def discover_chunks(histograms: DataFrame, method: str, n: int, seed: int = 0) -> list:
    """Bag ids chosen on bag histograms: at random, farthest by mean distance, or nearest to cluster centers."""
    if method == "random":
        return [r.bag_id for r in R.random_rows(histograms.select("bag_id"), n, ["bag_id"], seed).collect()]
    if method == "farthest":
        return [p[0] for p in traversal.farthest_average(histograms, n, ["bag_id"])]
    centers, _ = B.lloyd(histograms, B.parallel_seeds(histograms, n, ["bag_id"], seed=seed))
    return [r.bag_id for r in B.representatives(B.nearest(histograms, centers), ["bag_id"]).orderBy("cluster").collect()]


def histogram_of_segments(bags: DataFrame, segments: DataFrame, k: int = 100, iterations: int = 100, seed: int = 0) -> DataFrame:
    """(bag_id, features): rescale, learn a codebook, count."""
    scaled = cut(B.rescaled(segments))
    centers, _ = B.lloyd(scaled, B.parallel_seeds(scaled, k, ["bag_id", "segment_id"], seed=seed), iterations)
    return B.bag_histograms(bags, B.nearest(scaled, centers), len(centers))


def cluster_segments(segments: DataFrame, k: int = 100, seed: int = 0) -> DataFrame:
    """(bag_id, segment_id, cluster)."""
    scaled = cut(B.rescaled(segments))
    centers, _ = B.lloyd(scaled, B.parallel_seeds(scaled, k, ["bag_id", "segment_id"], seed=seed))
    return B.nearest(scaled, centers).select("bag_id", "segment_id", "cluster")


def more_bag_features(histograms: DataFrame, bags: DataFrame, segments: DataFrame) -> DataFrame:
    """Histograms with the number of segments and the means and deviations of their features behind."""
    summary = B.summary_features(bags, segments, B.feature_dim(segments)).withColumnRenamed("features", "more")
    return histograms.join(summary, "bag_id").select("bag_id", F.concat("features", "more").alias("features"))


def rain_probabilities(bags: DataFrame, examples: DataFrame, trees: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(scores of all bags, examples whose filename no bag has). ``examples``: filename and class."""
    known = examples.join(bags.select("filename", "bag_id", "features"), "filename")
    model = growth.train(known, 2, trees, ["bag_id"], label="class", max_depth=15)
    scored = forest.score(bags, model).withColumn("rain_probability", F.get("probabilities", F.lit(1))).drop("probabilities")
    return R.rain_ranking(scored), examples.join(bags.select("filename"), "filename", "left_anti")


def spectrograms_of_folder(spark, path: str, whiten: bool = True) -> DataFrame:
    return audio.spectrograms(wav.read(spark, path), whiten=whiten)


def segments_of_folder(spark, path: str, model: forest.Forest) -> DataFrame:
    """From a folder of recordings to the segment table, in one narrow pass and one join by file."""
    images = spectrograms_of_folder(spark, path)
    return audio.segment_table(images, audio.masks(audio.probability_maps(images, model)))


def export_experiment(bags: DataFrame, classes: DataFrame, path: str, folds: int, num_classes: int, fold: str | None = None) -> None:
    """A self-contained experiment; folds are those given, or follow from a hash of the key."""
    f = F.col(fold) if fold else F.pmod(F.xxhash64("bag_id"), F.lit(folds)).cast("int")
    dim = B.feature_dim(bags)
    text.write_experiment(bags.select("bag_id", f.alias("fold"), "labels", "features"), classes, path, num_classes, dim, folds)


def discovery_curve_file(curves: DataFrame, path: str) -> None:
    """Method, picks and mean number of known classes, tab-separated with six decimals; one method's curve after the other."""
    text.write_table(selection.averaged(curves).select("method", "i", "mean"), path, ["method", "i"], sep="\t")


WORKFLOWS: dict[str, Callable] = {f.__name__: f for f in (discover, discover_random_dawn, discover_segments, discover_chunks, histogram_of_segments, cluster_segments, more_bag_features, rain_probabilities, spectrograms_of_folder, segments_of_folder, export_experiment, discovery_curve_file)}
