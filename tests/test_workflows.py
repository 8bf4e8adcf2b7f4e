"""Whole analyses on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import selection
from murmura.operators import workflows as W
from murmura.plans import views
from murmura.sources import text


@pytest.fixture(scope="module")
def tables(spark, sf):
    b = views.bags(spark, sf).withColumn("labels", F.col("labels").cast("array<int>")).filter("bag_id < 20").cache()
    s = views.segments(spark, sf).filter("bag_id < 18").cache()
    return b, s


def test_discovery(tables):
    b, s = tables
    rained = b.withColumn("rain_probability", F.when(F.col("bag_id") < 5, 0.9).otherwise(0.0))
    for method in ("unified_CCMIFF", "MIFF", "cluster_centers"):
        assert len(set(W.discover(b, s, method, 4))) == 4
        assert all(i >= 5 for i in W.discover(rained, s, method, 4, rain_below=0.1))
    stamped = b.withColumn("ts", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.col("bag_id") % 24, F.lit(0), F.lit(0)))
    assert set(W.discover_random_dawn(stamped, 9)) == {5, 6, 7, 8}
    for method in ("random", "farthest", "cluster"):
        assert len(set(W.discover_segments(s, method, 3))) == 3


def test_features_and_files(spark, tables, tmp_path):
    b, s = tables
    h = W.histogram_of_segments(b, s, k=4, iterations=3).cache()
    sums = {r.bag_id: sum(r.features) for r in h.collect()}
    assert len(sums) == 20 and all(abs(v - (i < 18)) < 1e-9 for i, v in sums.items())
    for method in ("random", "farthest", "cluster"):
        assert len(set(W.discover_chunks(h, method, 3))) == 3
    assert W.cluster_segments(s, 3).select("cluster").distinct().count() <= 3
    more = W.more_bag_features(h, b, s)
    assert more.filter(F.size("features") == 4 + 1 + 2 * 64).count() == 20
    path = str(tmp_path / "mlc")
    classes = spark.range(10).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("c"), "id").alias("name"))
    W.export_experiment(h.join(b, "bag_id"), classes, path, 3, 10)
    assert text.read_experiment(spark, path)[2].count() == 20
    W.discovery_curve_file(selection.experiment(b, s, ["coverage_oracle"], 3, 2), str(tmp_path / "curve"))
    assert spark.read.text(str(tmp_path / "curve")).first().value.startswith("coverage_oracle\t0\t0.000000")


def test_rain(spark, tables):
    b, s = tables
    f = s.groupBy("bag_id").agg(F.first("features").alias("features")).withColumn("filename", F.concat(F.lit("f"), F.col("bag_id").cast("string")))
    examples = spark.createDataFrame([("f1", 1), ("f2", 0), ("f3", 1), ("f4", 0), ("gone", 1)], "filename string, class int")
    scores, missing = W.rain_probabilities(f, examples, trees=10)
    assert scores.count() == 18 and [r.filename for r in missing.collect()] == ["gone"]
    p = [r.rain_probability for r in scores.collect()]
    assert p == sorted(p, reverse=True)


def test_experiment_modes(spark):
    from murmura.operators import multilabel

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    rows = [(i, str(i % 3), [c for c in range(2) if x[i, c] > 0], [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "example_id bigint, partition string, labels array<int>, features array<double>")
    options = {"binary_relevance": {"trees": 5}, "ecc": {"chains": 2, "trees": 3}}
    got = multilabel.experiment(df, ["binary_relevance", "ecc"], 2, "k-fold", 3, 2, "d", options).collect()
    assert sorted((r.dataset, r.classifier, r.repetition) for r in got) == [("d", c, i) for c in ("binary_relevance", "ecc") for i in (0, 1)]
    assert all(r.tp + r.fp + r.tn + r.fn == 120 and r.accuracy > 0.7 and abs(r.hamming_loss - (r.fp + r.fn) / 120) < 1e-9 for r in got)
    split = df.withColumn("partition", F.when(F.col("example_id") < 40, "train").when(F.col("example_id") < 50, "test").otherwise("validation"))
    one = multilabel.experiment(split, ["ecc"], 2, "train-val-test", None, 1, "d", options).collect()
    assert len(one) == 1 and one[0].tp + one[0].fp + one[0].tn + one[0].fn == 20
    with pytest.raises(ValueError):
        multilabel.experiment(df, ["ecc"], 2, "leave-one-out")


def test_competition_files(spark, tables, tmp_path):
    from murmura.operators import recordings

    b, _ = tables
    scored = b.select("bag_id", F.array(F.lit(0.25), F.lit(0.5)).alias("scores"))
    recordings.write_competition(str(tmp_path), b, 10, F.col("bag_id") % 2 == 0, F.col("bag_id") % 3 == 0, scored)
    lines = lambda name: [r.value for r in spark.read.text(str(tmp_path / name)).collect()]
    assert lines("solution")[0] == "rec_id,species,probability,Usage" and len(lines("solution")) == 1 + 10 * 10
    assert lines("sample_submission")[:2] == ["bag_id,species,probability", "0,0,0"]
    assert lines("bag_labels_test_hidden")[1] == "0,?" and len(lines("folds")) == 21
    assert lines("baseline")[:3] == ["rec_id,species,probability", "0,0,0.250000", "0,1,0.500000"]


def test_presence_page(spark):
    from murmura.operators.recordings import html_presence

    df = spark.createDataFrame([("a<", "2024-01-01", h, h == 5) for h in range(24)], "site string, date string, hour int, present boolean")
    page = html_presence(df, "t")
    assert "a&lt;" in page and page.count("#468") == 1 and page.count("#eee") == 23
    with pytest.raises(ValueError):
        html_presence(df, "t", 20)


def test_command_line_from_recordings_to_segments(spark, tmp_path):
    from murmura import cli
    from murmura.sources import bmp, wav

    run = lambda *args: cli.main([str(a) for a in args], spark)
    t = np.arange(32000)
    tone = 0.002 * np.sin(t * t * 0.37) + np.where((t > 6000) & (t < 14000), 0.5 * np.sin(t * (900 + t * 0.1) * 2 * np.pi / 16000), 0)
    wav.write(spark.createDataFrame([(f"PC{i}.wav", 16000, tone.tolist()) for i in range(2)], "name string, sample_rate int, samples array<float>"), str(tmp_path / "wavs"))
    run("split", tmp_path / "wavs", tmp_path / "chunks", "--seconds", 1)
    assert sorted(p.name for p in (tmp_path / "chunks").glob("*.wav")) == ["PC0_0.wav", "PC0_1.wav", "PC1_0.wav", "PC1_1.wav"]
    run("spectrogram", tmp_path / "chunks", tmp_path / "spec", "--filter")
    run("spectrogram", tmp_path / "chunks", tmp_path / "raw")
    run("noise-filter", tmp_path / "raw", tmp_path / "filtered")
    assert (tmp_path / "spec" / "PC0_0.bmp").read_bytes() == (tmp_path / "filtered" / "PC0_0.bmp").read_bytes()
    run("copy-random", tmp_path / "spec", tmp_path / "some", "--n", 2)
    assert len(list((tmp_path / "some").glob("*.bmp"))) == 2
    marks = {}
    for i in (0, 1):
        grey = bmp.decode((tmp_path / "raw" / f"PC{i}_0.bmp").read_bytes())[:, :, 0]
        marked = np.stack([grey] * 3, 2)
        marked[grey > 120] = (255, 0, 0)
        marks[i] = marked
    (tmp_path / "marked").mkdir()
    for i, m in marks.items():
        (tmp_path / "marked" / f"PC{i}_0.bmp").write_bytes(bmp.encode(m))
    run("segmentation-train", tmp_path / "raw", tmp_path / "marked", tmp_path / "model")
    run("segmentation-run", tmp_path / "model", tmp_path / "raw", tmp_path / "segmented")
    for name in ("probabilities", "masks", "outlines"):
        assert len(list((tmp_path / "segmented" / name).glob("*.bmp"))) == 4
    run("analyze-segments", tmp_path / "raw", tmp_path / "segmented" / "masks", tmp_path / "data")
    n = text.read_segment_features(spark, str(tmp_path / "data" / "segment_features")).count()
    assert n == len(list((tmp_path / "data" / "segments").glob("*.bmp"))) > 0
    assert text.read_bags(spark, str(tmp_path / "data" / "bags")).count() == 4
    run("segment-mosaic", tmp_path / "data")
    run("cluster-segments", tmp_path / "data", "--n", 2)
    assert list((tmp_path / "data" / "segment_mosaic").glob("*.bmp")) and list((tmp_path / "data" / "clustered_segments").glob("*.bmp"))
    run("histogram-of-segments", tmp_path / "data", "--n", 2)
    run("discover-segments", tmp_path / "data", "random", "--n", 1)
    run("discover-chunks", tmp_path / "data", "farthest", "--n", 2)
    run("more-bag-features", tmp_path / "data")
    text.write_table(spark.createDataFrame([(0, "0"), (1, "")], "bag_id int, labels string"), str(tmp_path / "data" / "bag_labels"), ["bag_id"], text.HEADERS["bag_labels"])
    text.write_table(spark.createDataFrame([(0, "A", "a"), (1, "B", "b")], "class_id int, code string, species string"), str(tmp_path / "data" / "species"), ["class_id"], text.HEADERS["species"])
    run("unambiguous", tmp_path / "data")
    run("segmentation-misses", tmp_path / "data")
    run("export-experiment", tmp_path / "data", tmp_path / "mlc", "--folds", 2)
    run("experiment", tmp_path / "mlc", "--classifiers", "binary_relevance", "--repetitions", 1)
