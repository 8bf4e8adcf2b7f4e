"""A command line over the folder steps and analyses: ``python -m murmura COMMAND ...`` or through spark-submit."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators import bags as B
from murmura.operators import folders, multilabel, selection
from murmura.operators import workflows as W
from murmura.session import cut
from murmura.sources import forest_text, text


def _bags(spark: SparkSession, data: str) -> DataFrame:
    return text.read_bags(spark, f"{data}/bags")


def _segments(spark: SparkSession, data: str) -> DataFrame:
    return text.read_segment_features(spark, f"{data}/segment_features")


def _histograms(spark: SparkSession, data: str) -> DataFrame:
    return text.read_bag_features(spark, f"{data}/histogram_of_segments")


def _labelled(spark: SparkSession, data: str) -> DataFrame:
    return _bags(spark, data).join(text.read_bag_labels(spark, f"{data}/bag_labels"), "bag_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


def split(spark, a):
    print(folders.split(spark, a.source, a.target, a.seconds), "chunks")


def spectrogram(spark, a):
    print(folders.spectrograms(spark, a.source, a.target, a.filter), "images")


def noise_filter(spark, a):
    print(folders.filter_noise(spark, a.source, a.target), "images")


def copy(spark, a):
    print(folders.copy_files(spark, a.source, a.target), "files")


def setup(spark, a):
    print(*folders.set_up(a.target), sep="\n")


def move(spark, a):
    print(folders.move_files(spark, a.source, a.target), "files")


def copy_supporting(spark, a):
    print(folders.copy_supporting(spark, a.examples, a.source, a.target), "files")


def copy_random(spark, a):
    print(folders.copy_random(spark, a.source, a.target, a.n, a.seed), "files")


def segmentation_train(spark, a):
    forest_text.save(spark, folders.train_segmentation(spark, a.source, a.examples, seed=a.seed), a.model)


def segmentation_run(spark, a):
    print(folders.run_segmentation(spark, forest_text.load(spark, a.model), a.source, a.target), "images")


def analyze_segments(spark, a):
    folders.analyze_segments(spark, a.source, a.masks, a.data, text.read_bags(spark, a.bags) if a.bags else None)


def segment_boxes(spark, a):
    """Each image with the boxes and numbers of its segments."""
    folders.visualize_boxes(spark, a.source, a.masks, a.target)


def segment_mosaic(spark, a):
    folders.write_images(folders.mosaics(folders.grey_images(spark, f"{a.data}/segments")), f"{a.data}/segment_mosaic")


def cluster_segments(spark, a):
    """Clusters of segments as a table, and mosaics of each."""
    got = W.cluster_segments(_segments(spark, a.data), a.n, a.seed)
    text.write_table(got, f"{a.data}/clusters", ["bag_id", "segment_id"], text.HEADERS["clusters"])
    own = text.read_clusters(spark, f"{a.data}/clusters").join(_bags(spark, a.data), "bag_id").select(F.concat_ws("_", folders.stem("filename"), "segment_id").alias("path"), "cluster")
    folders.write_images(folders.mosaics(folders.grey_images(spark, f"{a.data}/segments").join(own, "path"), by="cluster"), f"{a.data}/clustered_segments")


def discover(spark, a):
    """Bags in the order of a discovery method, optionally without those that are likely rain."""
    bags = _labelled(spark, a.data)
    if a.rain < 1:
        bags = bags.join(text.read_rain(spark, f"{a.data}/rain_probabilities"), "bag_id")
    order = W.discover(bags, _segments(spark, a.data), a.method, a.n, a.rain if a.rain < 1 else None, a.seed)
    names = {r.bag_id: r.filename for r in bags.filter(F.col("bag_id").isin(order)).select("bag_id", "filename").collect()}  # the picks
    for i in order:
        print(i, names[i], sep="\t")


def discovery_curves(spark, a):
    """Mean numbers of known classes by picks, over repeated parts of the bags."""
    curves = selection.experiment(_labelled(spark, a.data), cut(B.rescaled(_segments(spark, a.data))), a.methods, a.n, a.repetitions, seed=a.seed)
    W.discovery_curve_file(curves, a.target)


def discover_segments(spark, a):
    for r in W.discover_segments(_segments(spark, a.data), a.method, a.n, a.seed):
        print(*r, sep="\t")


def discover_chunks(spark, a):
    for i in W.discover_chunks(_histograms(spark, a.data), a.method, a.n, a.seed):
        print(i)


def histogram_of_segments(spark, a):
    h = W.histogram_of_segments(_bags(spark, a.data), _segments(spark, a.data), a.n, seed=a.seed)
    text.write_features(h, f"{a.data}/histogram_of_segments", ["bag_id"], text.HEADERS["histogram"])


def more_bag_features(spark, a):
    m = W.more_bag_features(_histograms(spark, a.data), _bags(spark, a.data), _segments(spark, a.data))
    text.write_features(m, f"{a.data}/more_bag_features", ["bag_id"], text.HEADERS["additional"])


def _printed(df):
    """All rows, a partition at a time."""
    print(*df.columns, sep="\t")
    for r in df.toLocalIterator():
        print(*r, sep="\t")


def unambiguous(spark, a):
    _printed(B.routed(_labelled(spark, a.data)).filter("route = 'one'").select("bag_id", "filename", F.get("labels", F.lit(0)).alias("label")).orderBy("bag_id"))


def segmentation_misses(spark, a):
    _printed(B.segmentation_misses(_labelled(spark, a.data), _segments(spark, a.data)).select("bag_id", "filename").orderBy("bag_id"))


def rain_classifier(spark, a):
    bags = _bags(spark, a.data).join(_histograms(spark, a.data), "bag_id")
    examples = spark.read.csv(a.examples, schema="filename string, class int")
    scored, unknown = W.rain_probabilities(bags, examples, a.trees)
    text.write_table(scored.select("bag_id", "rain_probability"), f"{a.data}/rain_probabilities", ["bag_id"], text.HEADERS["rain"])
    print(folders.copy_probably_rain(spark, scored, a.source, f"{a.data}/probably_rain"), "files with rain;", unknown.count(), "examples without a recording")


def export_experiment(spark, a):
    bags = _labelled(spark, a.data).join(_histograms(spark, a.data), "bag_id")
    W.export_experiment(bags, text.read_species(spark, f"{a.data}/species").select("class_id", F.col("code").alias("name")), a.target, a.folds, text.read_species(spark, f"{a.data}/species").count())


def experiment(spark, a):
    settings, _, examples = text.read_experiment(spark, a.source)
    got = multilabel.experiment(examples, a.classifiers, settings["num_classes"], settings["partition"], settings["folds"], a.repetitions, a.source)
    columns = ("dataset", "classifier", "repetition", "hamming_loss", "rank_loss", "set01_loss", "one_error", "coverage")
    print(*columns, sep="\t")
    for r in got.orderBy("classifier", "repetition").select(*columns).collect():  # a row for each repetition
        print(*r, sep="\t")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="murmura", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *places: str, **options):
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        c.set_defaults(run=f)
        for name in places:
            c.add_argument(name)
        for name, (kind, default) in options.items():
            if kind is bool:
                c.add_argument(f"--{name}", action="store_true")
            elif kind is list:
                c.add_argument(f"--{name}", nargs="+", default=default)
            else:
                c.add_argument(f"--{name}", type=kind, default=default)

    seed = {"seed": (int, 0)}
    command(split, "source", "target", seconds=(float, 10.0))
    command(spectrogram, "source", "target", filter=(bool, False))
    command(noise_filter, "source", "target")
    command(copy, "source", "target")
    command(setup, "target")
    command(move, "source", "target")
    command(copy_supporting, "examples", "source", "target")
    command(discover, "data", "method", n=(int, 10), rain=(float, 1.0), **seed)
    command(discovery_curves, "data", "target", methods=(list, ["random", "MIFF"]), n=(int, 10), repetitions=(int, 10), **seed)
    command(copy_random, "source", "target", n=(int, 10), **seed)
    command(segmentation_train, "source", "examples", "model", **seed)
    command(segmentation_run, "model", "source", "target")
    command(analyze_segments, "source", "masks", "data", bags=(str, None))
    command(segment_boxes, "source", "masks", "target")
    command(segment_mosaic, "data")
    command(cluster_segments, "data", n=(int, 100), **seed)
    command(discover_segments, "data", "method", n=(int, 10), **seed)
    command(discover_chunks, "data", "method", n=(int, 10), **seed)
    command(histogram_of_segments, "data", n=(int, 100), **seed)
    command(more_bag_features, "data")
    command(unambiguous, "data")
    command(segmentation_misses, "data")
    command(rain_classifier, "data", "examples", "source", trees=(int, 1000))
    command(export_experiment, "data", "target", folds=(int, 10))
    command(experiment, "source", classifiers=(list, list(multilabel.CLASSIFIERS)), repetitions=(int, 10))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    began = time.perf_counter()
    a.run(spark or SparkSession.builder.appName("murmura").getOrCreate(), a)
    print(f"{time.perf_counter() - began:.1f} seconds")
