"""Roles that the test tables play: the same derivations in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five embeddings to a bag."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id DIV 5").alias("bag_id"), F.expr("vec_id % 5").alias("segment_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


SEGMENTS = "seg AS (SELECT vec_id // 5 AS bag_id, vec_id % 5 AS segment_id, list_transform(embedding, lambda x: x::DOUBLE) AS features, label FROM embeddings)"


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy("bag_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


BAGS = f"{SEGMENTS}, bags AS (SELECT bag_id, list_sort(list_distinct(list(label))) AS labels FROM seg GROUP BY bag_id)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey image of 64 rows and 5 columns for each bag: sizes of its vectors' elements in thousandths, at most 255."""
    px = F.transform("features", lambda x: F.least(F.floor(F.abs(x) * 1000), F.lit(255)).cast("int"))
    columns = segments(spark, sf_dir).groupBy("bag_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", px.alias("px")))).alias("c"))
    return columns.select("bag_id", F.transform("c", lambda x: x["px"]).alias("columns"))


IMAGES = f"{SEGMENTS}, px AS (SELECT bag_id, segment_id AS x, i - 1 AS y, least(floor(abs(features[i]) * 1000), 255)::INT AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM seg))"


def order_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bags, segments) of varying size and four features: orders and their lines."""
    b = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bag_id"))
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bag_id"), F.col("l_linenumber").alias("segment_id"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"))
    return b, s


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.expr("user_id % 13").alias("site"), "ts", F.col("event_type").alias("cluster"), "value", "user_id")


RECORDINGS = "rec AS (SELECT event_id, user_id % 13 AS site, ts, event_type AS cluster, value, user_id FROM events)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bags: class 0 is good quality, class 1 toxic; most have no label at all."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("bag_id"))
    x = read(spark, sf_dir, "labels")
    sets = F.filter(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)), lambda y: y.isNotNull())
    return d.join(x.select(F.col("doc_id").alias("bag_id"), sets.alias("labels")), "bag_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


LABELLED = "lab AS (SELECT d.doc_id AS bag_id, list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda y: y IS NOT NULL) AS labels FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def part_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bags of the sizes of their parts: some classes are rare."""
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bag_id"), F.expr("CAST(l_quantity AS INT)").alias("y"))
    return x.groupBy("bag_id").agg(F.array_sort(F.collect_set("y")).alias("labels"))


PART_BAGS = "pb AS (SELECT l_orderkey AS bag_id, list_sort(list_distinct(list(l_quantity::INT))) AS labels FROM lineitem GROUP BY l_orderkey)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags with ten made-up scores that follow from the key, and the classes they predict."""
    b = bags(spark, sf_dir)
    s = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.pmod(F.col("bag_id") * 37 + c * 53, F.lit(101)) / F.lit(101.0))
    return b.withColumn("scores", s).withColumn("predicted", F.filter(F.transform("scores", lambda x, i: F.when(x > 0.8, i)), lambda i: i.isNotNull())).withColumn("labels", F.col("labels").cast("array<int>"))


SCORED = f"""{BAGS}, sc AS (SELECT bag_id, labels, list_transform(range(0, 10), lambda c: ((bag_id * 37 + c * 53) % 101) / 101.0) AS scores FROM bags),
scored AS (SELECT *, list_filter(range(0, 10), lambda c: scores[c + 1] > 0.8) AS predicted FROM sc)"""
