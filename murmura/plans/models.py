"""Queries of the forests, multi-label classifiers and recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.operators import forest, growth, multilabel
from murmura.plans import views
from murmura.plans.registry import query


def _examples(spark, sf_dir):
    """Bags with the mean of their vectors."""
    f = views.segments(spark, sf_dir).groupBy("bag_id").agg(F.array(*(F.avg(F.get("features", F.lit(i))) for i in range(64))).alias("features"))
    return f.join(views.bags(spark, sf_dir), "bag_id").withColumn("labels", F.col("labels").cast("array<int>"))


@query(
    "decision_stump",
    f"""WITH {views.SEGMENTS}, v AS (SELECT bag_id, segment_id, i - 1 AS f, features[i] AS x, (label < 5)::INT AS y FROM (SELECT *, unnest(range(1, 65)) AS i FROM seg)),
o AS (SELECT f, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER w AS n, sum(y) OVER w AS p, count(*) OVER (PARTITION BY f) AS nn, sum(y) OVER (PARTITION BY f) AS pp FROM v WINDOW w AS (PARTITION BY f ORDER BY x, bag_id, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT f, (x + nx) / 2 AS t, (n * (1 - pow(p / n, 2) - pow((n - p) / n, 2)) + (nn - n) * (1 - pow((pp - p) / (nn - n), 2) - pow((nn - n - pp + p) / (nn - n), 2))) / nn AS s FROM o WHERE nx - x >= 1e-6 AND y <> ny)
SELECT f::INT AS feature, round(t, 6) AS threshold, round(s, 6) AS gini FROM g ORDER BY round(s, 9), f, t LIMIT 1""",
)
def decision_stump(spark, sf_dir):
    """The best first split of all features, from running counts over ranges of their values."""
    s = views.segments(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("int"))
    best = growth.exact_splits(s, 2, label="y").select(F.struct(F.round("gini", 9).alias("k"), "feature", "threshold", "gini").alias("b")).agg(F.min("b").alias("b"))
    return best.select("b.feature", F.round("b.threshold", 6).alias("threshold"), F.round("b.gini", 6).alias("gini"))


def _best(counts: str) -> str:
    """SQL of each node's best split from (node, f, x, n, p): rows and positive rows by value."""
    score = "(ln * (1 - pow(lp / ln, 2) - pow(1 - lp / ln, 2)) + (n_all - ln) * (1 - pow((p_all - lp) / (n_all - ln), 2) - pow(1 - (p_all - lp) / (n_all - ln), 2))) / n_all"
    return f"""SELECT node, f, (x + nx) / 2 AS t, p_all / n_all AS share FROM (
  SELECT *, lead(x) OVER w AS nx, sum(n) OVER w AS ln, sum(p) OVER w AS lp, sum(n) OVER (PARTITION BY node, f) AS n_all, sum(p) OVER (PARTITION BY node, f) AS p_all
  FROM {counts} WINDOW w AS (PARTITION BY node, f ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE nx - x >= 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round({score}, 12), f, x) = 1"""


TREE_LEVELS = f"""WITH r AS (SELECT [l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE] AS v, (l_returnflag = 'R')::INT AS y FROM lineitem),
h0 AS (SELECT 0 AS node, f, v[f + 1] AS x, count(*) AS n, sum(y) AS p FROM (SELECT *, unnest([0, 1, 2]) AS f FROM r) GROUP BY ALL),
s0 AS ({_best("h0")}),
r1 AS (SELECT CASE WHEN v[s0.f + 1] < t THEN 1 ELSE 2 END AS node, v, y FROM r, s0),
h1 AS (SELECT node, f, v[f + 1] AS x, count(*) AS n, sum(y) AS p FROM (SELECT *, unnest([0, 1, 2]) AS f FROM r1) GROUP BY ALL),
s1 AS ({_best("h1")})
SELECT node::INT AS node, f::INT AS feature, round(t, 6) AS threshold, round(share, 6) AS share FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)"""


def tree_table(spark, sf_dir):
    """All lines of all orders as examples."""
    return views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))).alias("features"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def tree_rows(spark, tree):
    """A row for each split of a model, numbered level by level: its feature, threshold and the share of the class at it."""
    order = [0]
    for k in order:
        order += [int(tree.left[k]), int(tree.right[k])] if tree.feature[k] >= 0 else []
    rows = [(i, int(tree.feature[k]), round(float(tree.threshold[k]), 6), round(float(tree.hist[k][1]), 6)) for i, k in enumerate(order) if tree.feature[k] >= 0]
    return spark.createDataFrame(rows, "node int, feature int, threshold double, share double")


@query("tree_levels", TREE_LEVELS)
def tree_levels(spark, sf_dir):
    """The first two levels of a tree on all lines of all orders."""
    (tree,) = growth.grow(tree_table(spark, sf_dir), [growth.Spec(0)], 2, ["l_orderkey", "l_linenumber"], max_depth=2, mtry=3, bootstrap=False, leaf="histogram")
    return tree_rows(spark, tree)


@query("forest_oob")
def forest_oob(spark, sf_dir):
    """(bag_id, segment_id, label, probability): out-of-bag estimates of a forest over all segments."""
    s = views.segments(spark, sf_dir).withColumn("label", (F.col("label") < 5).cast("int"))
    f = growth.train(s, 2, 16, ["bag_id", "segment_id"], seed=1, max_depth=8)
    return growth.out_of_bag(s, f, ["bag_id", "segment_id"]).select("bag_id", "segment_id", "label", F.round(F.get("probabilities", F.lit(1)), 6).alias("probability"))


@query("forest_scores")
def forest_scores(spark, sf_dir):
    """Every segment with a broadcast forest's class probabilities."""
    s = views.segments(spark, sf_dir).withColumn("label", (F.col("label") < 5).cast("int"))
    f = growth.train(s, 2, 8, ["bag_id", "segment_id"], seed=2, max_depth=6, leaf="histogram")
    return forest.score(s, f).select("bag_id", "segment_id", F.round(F.get("probabilities", F.lit(1)), 6).alias("probability"))


@query("rain_classifier")
def rain_classifier(spark, sf_dir):
    """Bags with the chance of a class, from a forest on bag features."""
    e = _examples(spark, sf_dir).withColumn("label", F.array_contains("labels", 0).cast("int"))
    return forest.score(e, growth.train(e, 2, 20, ["bag_id"], max_depth=15)).select("bag_id", F.round(F.get("probabilities", F.lit(1)), 6).alias("rain_probability"))


def _validated(spark, sf_dir, classifier, **options):
    e = _examples(spark, sf_dir).select(F.col("bag_id").alias("example_id"), (F.col("bag_id") % 3).cast("int").alias("fold"), "labels", "features")
    got = multilabel.cross_validated(e, classifier, 10, [0, 1, 2], **options)
    m = multilabel.metric_means(got, "scores", "predicted", "labels", 10, ["repetition"])
    return m.select("repetition", *(F.round(c, 6).alias(c) for c in m.columns if c != "repetition"))


@query("binary_relevance")
def binary_relevance(spark, sf_dir):
    return _validated(spark, sf_dir, "binary_relevance", trees=5, max_depth=4)


@query("classifier_chains")
def classifier_chains(spark, sf_dir):
    return _validated(spark, sf_dir, "ecc", chains=2, trees=3, max_depth=4)


def _signals(spark, sf_dir):
    """A rising tone over faint noise for each vector, which gives its pitch: recordings of half a second, few to a partition."""
    from murmura.operators import audio

    own = F.concat_ws("-", F.lit("rec"), "bag_id", "segment_id").alias("path")
    s = audio.dealt(views.segments(spark, sf_dir).select(own, (600 + F.floor(F.abs(F.get("features", F.lit(0))) * 4000)).alias("pitch")))
    pitch = F.col("pitch")
    t = F.sequence(F.lit(0), F.lit(7999))
    tone = F.transform(t, lambda i: F.when((i > 2000) & (i < 5500), 0.5 * F.sin(i * (pitch + i * 0.3) * (2 * 3.141592653589793 / 16000))).otherwise(0.002 * F.sin(i * i * 0.37)).cast("float"))
    return s.select("path", F.lit(16000).alias("sample_rate"), tone.alias("samples"))


@query("spectrogram_images")
def spectrogram_images(spark, sf_dir):
    """Noise-filtered spectrogram images of made-up recordings."""
    from murmura.operators import audio

    return audio.spectrograms(_signals(spark, sf_dir), whiten=True).select("path", "w", "h", F.sha2("data", 256).alias("sha256"))


@query("segment_table")
def segment_table(spark, sf_dir):
    """Segments of those images, cut at half of full brightness, with their 38 features."""
    from murmura.operators import audio

    return audio.bright_segments(audio.spectrograms(_signals(spark, sf_dir)), 0.35).select("path", "segment_id", "rect.*", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query("competition_baseline")
def competition_baseline(spark, sf_dir):
    """(rec_id, species, probability): what a forest for each class says of the bags that it hasn't learnt from."""
    from murmura.operators import recordings

    e = _examples(spark, sf_dir).select(F.col("bag_id").alias("example_id"), F.when(F.col("bag_id") % 2 == 0, "train").otherwise("test").alias("partition"), "labels", "features")
    got = multilabel.predictions(e, "binary_relevance", 10, multilabel.train_val_test(), trees=5, max_depth=4)
    return recordings.long_scores(got, key="example_id").withColumn("probability", F.round("probability", 6))
