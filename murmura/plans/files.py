"""Queries of sources and sinks: each table written by the library's own sink and read back by its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions import vector as V
from murmura.operators import growth, recordings
from murmura.operators.forest import Forest
from murmura.plans import views
from murmura.plans.models import TREE_LEVELS, tree_rows, tree_table
from murmura.plans.registry import query
from murmura.session import scratch_dir
from murmura.sources import bmp, files, forest_text, text, wav, wav_splits


def _bags(spark, sf_dir):
    """Bags with a made-up file name that follows from the key."""
    return views.bags(spark, sf_dir).withColumn("filename", F.concat(F.lit("rec_"), F.col("bag_id"), F.lit(".wav")))


def _summed(features: str = "features"):
    """A vector as its size, ends and sum."""
    f = F.col(features)
    return F.size(f).alias("n"), F.round(F.get(f, F.lit(0)), 6).alias("first"), F.round(F.element_at(f, -1), 6).alias("last"), F.round(V.total(f), 4).alias("total")


_SUMMED = "len({0})::INT AS n, round({0}[1], 6) AS first, round({0}[-1], 6) AS last, round(list_sum(list_transform({0}, lambda x: round(x, 6))), 4) AS total"


@query("bag_files", f"WITH {views.BAGS} SELECT bag_id::INT AS bag_id, 'rec_' || bag_id || '.wav' AS filename FROM bags")
def bag_files(spark, sf_dir):
    path = scratch_dir(spark, "bags")
    text.write_table(_bags(spark, sf_dir).select("bag_id", "filename"), path, ["bag_id"], text.HEADERS["bags"])
    return text.read_bags(spark, path)


@query("segment_feature_files", f"WITH {views.SEGMENTS} SELECT bag_id::INT AS bag_id, segment_id::INT AS segment_id, {_SUMMED.format('features')} FROM seg")
def segment_feature_files(spark, sf_dir):
    path = scratch_dir(spark, "features")
    text.write_features(views.segments(spark, sf_dir), path, ["bag_id", "segment_id"], text.HEADERS["segment_features"])
    return text.read_segment_features(spark, path).select("bag_id", "segment_id", *_summed())


@query("rectangle_files", "SELECT l_orderkey::INT AS bag_id, l_linenumber::INT AS segment_id, l_quantity::INT AS min_x, 2 * l_quantity::INT AS max_x, l_linenumber::INT AS min_y, l_linenumber::INT + 50 AS max_y FROM lineitem")
def rectangle_files(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    path = scratch_dir(spark, "rectangles")
    text.write_rectangles(views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bag_id"), n.alias("segment_id"), q.alias("min_x"), (2 * q).alias("max_x"), n.alias("min_y"), (n + 50).alias("max_y")), path)
    return text.read_segment_rectangles(spark, path)


@query("bag_label_files", f"WITH {views.LABELLED} SELECT bag_id::INT AS bag_id, array_to_string(labels, ';') AS labels FROM lab")
def bag_label_files(spark, sf_dir):
    """Label sets, most of them empty."""
    path = scratch_dir(spark, "labels")
    text.write_table(views.labelled(spark, sf_dir).select("bag_id", F.array_join("labels", ",").alias("labels")), path, ["bag_id"], text.HEADERS["bag_labels"])
    return text.read_bag_labels(spark, path).select("bag_id", F.array_join("labels", ";").alias("labels"))


@query("bag_feature_files", f"WITH {views.SEGMENTS}, m AS (SELECT bag_id, i, avg(x) AS x FROM (SELECT bag_id, unnest(range(1, 65)) AS i, unnest(features) AS x FROM seg) GROUP BY ALL), v AS (SELECT bag_id, list(x ORDER BY i) AS f FROM m GROUP BY bag_id) SELECT bag_id::INT AS bag_id, {_SUMMED.format('f')} FROM v")
def bag_feature_files(spark, sf_dir):
    path = scratch_dir(spark, "bag-features")
    means = views.segments(spark, sf_dir).groupBy("bag_id").agg(F.array(*(F.avg(F.get("features", F.lit(i))) for i in range(64))).alias("features"))
    text.write_features(means, path, ["bag_id"], text.HEADERS["histogram"])
    return text.read_bag_features(spark, path).select("bag_id", *_summed())


@query("cluster_files", f"WITH {views.SEGMENTS} SELECT bag_id::INT AS bag_id, segment_id::INT AS segment_id, label::INT AS cluster FROM seg")
def cluster_files(spark, sf_dir):
    path = scratch_dir(spark, "clusters")
    text.write_table(views.segments(spark, sf_dir).select("bag_id", "segment_id", "label"), path, ["bag_id", "segment_id"], text.HEADERS["clusters"])
    return text.read_clusters(spark, path)


@query("rain_and_fold_files", f"WITH {views.BAGS} SELECT bag_id::INT AS bag_id, round((bag_id % 97) / 97.0, 6) AS rain_probability, (bag_id % 5)::INT AS fold FROM bags")
def rain_and_fold_files(spark, sf_dir):
    b, path = views.bags(spark, sf_dir), scratch_dir(spark, "rain")
    text.write_table(b.select("bag_id", ((F.col("bag_id") % 97) / 97.0).alias("p")), f"{path}/rain", ["bag_id"], text.HEADERS["rain"])
    text.write_table(b.select("bag_id", F.col("bag_id") % 5), f"{path}/folds", ["bag_id"], text.HEADERS["folds"])
    return text.read_rain(spark, f"{path}/rain").join(text.read_folds(spark, f"{path}/folds"), "bag_id")


@query("species_files", "SELECT n_nationkey::INT AS class_id, upper(n_name[1:4]) AS code, n_name AS species FROM nation")
def species_files(spark, sf_dir):
    path = scratch_dir(spark, "species")
    text.write_table(views.read(spark, sf_dir, "nation").select("n_nationkey", F.upper(F.substring("n_name", 1, 4)), "n_name"), path, ["n_nationkey"], text.HEADERS["species"])
    return text.read_species(spark, path)


@query("expert_label_files", "SELECT 'rec_' || o_orderkey || '.wav' AS filename, o_orderstatus || ';' || o_orderpriority[1:1] AS codes FROM orders")
def expert_label_files(spark, sf_dir):
    """Lines of a file name and quoted codes."""
    path = scratch_dir(spark, "expert")
    o = views.read(spark, sf_dir, "orders")
    line = F.concat(F.lit("rec_"), "o_orderkey", F.lit('.wav,"'), "o_orderstatus", F.lit(","), F.substring("o_orderpriority", 1, 1), F.lit('"'))
    text.write_lines(o, line, ["o_orderkey"], None, path)
    return text.read_expert_labels(spark, path).select("filename", F.array_join("codes", ";").alias("codes"))


@query("experiment_files", f"WITH {views.BAGS}, m AS (SELECT bag_id, i, avg(x) AS x FROM (SELECT bag_id, unnest(range(1, 65)) AS i, unnest(features) AS x FROM seg) GROUP BY ALL), v AS (SELECT bag_id, list(x ORDER BY i) AS f FROM m GROUP BY bag_id) SELECT bag_id::INT AS example_id, (bag_id % 4)::VARCHAR AS partition, array_to_string(labels, ';') AS labels, {_SUMMED.format('f')}, 10 AS num_classes, 64 AS feature_dim, 4 AS folds FROM bags JOIN v USING (bag_id)")
def experiment_files(spark, sf_dir):
    """A self-contained experiment: settings, classes and examples."""
    path = scratch_dir(spark, "experiment")
    means = views.segments(spark, sf_dir).groupBy("bag_id").agg(F.array(*(F.avg(F.get("features", F.lit(i))) for i in range(64))).alias("features"))
    examples = views.bags(spark, sf_dir).join(means, "bag_id").select("bag_id", (F.col("bag_id") % 4).alias("fold"), "labels", "features")
    classes = spark.range(10).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("class "), "id").alias("name"))
    text.write_experiment(examples, classes, path, 10, 64, 4)
    settings, names, got = text.read_experiment(spark, path)
    return got.select("example_id", "partition", F.array_join("labels", ";").alias("labels"), *_summed(), F.lit(names.count()).cast("int").alias("num_classes"), F.lit(settings["feature_dim"]).alias("feature_dim"), F.lit(settings["folds"]).alias("folds"))


@query("forest_files", f"SELECT node, feature, threshold FROM ({TREE_LEVELS})")
def forest_files(spark, sf_dir):
    """A model written as text and read back: the splits of its first two levels (shares are written for leaves alone)."""
    trees = growth.grow(tree_table(spark, sf_dir), [growth.Spec(0)], 2, ["l_orderkey", "l_linenumber"], max_depth=2, mtry=3, bootstrap=False, leaf="histogram")
    path = scratch_dir(spark, "forest")
    forest_text.save(spark, Forest(trees, 2, 3), path)
    return tree_rows(spark, forest_text.load(spark, path).trees[0]).drop("share")


def _recordings(spark, sf_dir):
    """A recording for each bag: its vectors one after the other."""
    s = views.segments(spark, sf_dir).groupBy("bag_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "features"))).alias("s"))  # five to a bag
    return s.select(F.concat(F.lit("rec_"), F.col("bag_id"), F.lit(".wav")).alias("name"), F.lit(16000).alias("sample_rate"), F.flatten(F.transform("s", lambda x: x["features"])).alias("samples"))


_SAMPLES = f"{views.SEGMENTS}, smp AS (SELECT bag_id, (segment_id * 64 + i - 1)::BIGINT AS pos, trunc(least(greatest(features[i] * 32768, -32768), 32767))::BIGINT AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM seg))"


@query("wav_files", f"WITH {_SAMPLES} SELECT 'rec_' || bag_id || '.wav' AS name, 16000 AS sample_rate, 16 AS bits, 1 AS channels, count(*)::INT AS n, sum(v)::BIGINT AS total FROM smp GROUP BY bag_id")
def wav_files(spark, sf_dir):
    path = scratch_dir(spark, "wav")
    wav.write(_recordings(spark, sf_dir), path)
    whole = F.aggregate("samples", F.lit(0).cast("bigint"), lambda t, x: t + F.round(x * 32768).cast("bigint"))
    return wav.read(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sample_rate", "bits", "channels", F.size("samples").alias("n"), whole.alias("total"))


@query("wav_split_frames", f"WITH {_SAMPLES}, st AS (SELECT bag_id, unnest(range(0, max(pos) + 1 - 64, 48)) AS s FROM smp GROUP BY bag_id) SELECT 'rec_' || bag_id || '.wav' AS name, (s // 48)::BIGINT AS frame, sum(v)::BIGINT AS total FROM st JOIN smp USING (bag_id) WHERE pos >= s AND pos < s + 64 GROUP BY ALL")
def wav_split_frames(spark, sf_dir):
    """Frames of recordings that are read by ranges of 150 bytes."""
    path = scratch_dir(spark, "wav")
    wav.write(_recordings(spark, sf_dir), path)
    got = wav_splits.frames(wav_splits.read(spark, path, 150, 64, 48), 64, 48)
    whole = F.aggregate("samples", F.lit(0).cast("bigint"), lambda t, x: t + F.round(x * 32768).cast("bigint"))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "frame", whole.alias("total"))


@query("bmp_files", f"WITH {views.IMAGES} SELECT 'img_' || bag_id || '.bmp' AS name, max(x)::INT + 1 AS w, 64 AS h, 3 AS channels, 3 * sum(v)::BIGINT AS total, sum(v * (y + 1))::BIGINT AS moment FROM px GROUP BY bag_id")
def bmp_files(spark, sf_dir):
    """Grey images, written with one channel and read back with three."""
    import pandas as pd

    path = scratch_dir(spark, "bmp")

    def packed(batches):
        import numpy as np

        for b in batches:
            px = [np.stack([np.array(c, np.uint8) for c in columns], 1) for columns in b["columns"]]
            yield pd.DataFrame({"name": [f"img_{i}.bmp" for i in b["bag_id"]], "w": [p.shape[1] for p in px], "h": [p.shape[0] for p in px], "channels": 1, "data": [p.tobytes() for p in px]})

    bmp.write(views.images(spark, sf_dir).mapInPandas(packed, "name string, w int, h int, channels int, data binary"), path)

    def summed(batches):
        import numpy as np

        for b in batches:
            px = [np.frombuffer(d, np.uint8).reshape(h, w, 3).astype(np.int64) for d, w, h in zip(b["data"], b["w"], b["h"], strict=True)]
            yield b[["path", "w", "h", "channels"]].assign(total=[int(p.sum()) for p in px], moment=[int((p[:, :, 0].sum(1) * np.arange(1, len(p) + 1)).sum()) for p in px])

    got = bmp.read(spark, path).mapInPandas(summed, "path string, w int, h int, channels int, total bigint, moment bigint")
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "w", "h", "channels", "total", "moment")


@query("file_listing", f"WITH {views.BAGS} SELECT 'rec_' || bag_id || '.wav' AS name, (44 + 2 * 64 * count(*))::BIGINT AS length FROM seg GROUP BY bag_id")
def file_listing(spark, sf_dir):
    path = scratch_dir(spark, "wav")
    wav.write(_recordings(spark, sf_dir), path)
    return files.listing(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("competition_files", f"WITH {views.BAGS} SELECT bag_id::INT AS rec_id, c::INT AS species, contains(array_to_string(labels, ','), c::VARCHAR)::INT AS probability, CASE WHEN bag_id % 3 = 0 THEN 'PublicTest' ELSE 'PrivateTest' END AS usage FROM bags, range(10) g(c) WHERE bag_id % 2 = 1")
def competition_files(spark, sf_dir):
    """The solution file of a competition, read back."""
    path = scratch_dir(spark, "competition")
    b = views.bags(spark, sf_dir).withColumn("labels", F.col("labels").cast("array<int>"))
    recordings.write_competition(path, b, 10, F.col("bag_id") % 2 == 1, F.col("bag_id") % 3 == 0)
    cell = F.split("line", ",")
    return text.lines(spark, f"{path}/solution", "rec_id,species,probability,Usage").select(*(F.get(cell, F.lit(i)).cast("int").alias(c) for i, c in enumerate(("rec_id", "species", "probability"))), F.get(cell, F.lit(3)).alias("usage"))
