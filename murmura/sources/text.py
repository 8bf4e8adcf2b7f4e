"""Delimited text tables: readers and writers.

Every reader is ``spark.read.text`` with native parsing, so files may be of any
number and size; blank lines are skipped and header lines are checked where the
format fixes them. Floats are written with six decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header lines.
HEADERS = {
    "bags": "bag_id,filename",
    "segment_features": "bag_id,segment_id,[feature vector]",
    "segment_rectangles": "bag_id,segment_id,min_x,max_x,min_y,max_y",
    "bag_labels": "bag_id,[labels]",
    "species": "class_id,code,species",
    "clusters": "bag_id,segment_id,cluster_assignment",
    "rain": "bag_id,rain_probability",
    "folds": "bag_id,fold",
    "histogram": "bag_id,[histogram of segment features]",
    "additional": "bag_id,[features]",
    "predictions": "rec_id,species,probability",
}


def lines(spark: SparkSession, path: str, header: str | None = None, strict: bool = True) -> DataFrame:
    """Column ``line``: non-blank lines without the header. ``strict`` fails on files that lack it."""
    raw = spark.read.text(path).select(F.rtrim(F.col("value")).alias("line")).filter(F.length("line") > 0)
    if header is None:
        return raw
    if strict and not raw.filter(F.col("line") == header).limit(1).count() and raw.limit(1).count():
        raise ValueError(f"{path} has no header {header!r}")
    return _only(raw, F.col("line") != header if strict else ~F.col("line").startswith(header.split(",")[0]))


def _only(raw: DataFrame, wanted: Column) -> DataFrame:
    """The lines that are wanted. Others become null before they are left out, so that no cast meets one, in whatever order a plan tests its conditions."""
    return raw.select(F.when(wanted, F.col("line")).alias("line")).filter("line IS NOT NULL")


def _parts() -> Column:
    return F.filter(F.split("line", ","), lambda x: x != "")


def _cell(i: int, kind: str) -> Column:
    return F.get(F.split("line", ","), F.lit(i)).cast(kind)


def _vector(start: int) -> Column:
    p = _parts()
    return F.slice(p, start + 1, F.size(p)).cast("array<double>")


def read_bags(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, HEADERS["bags"]).select(_cell(0, "int").alias("bag_id"), _cell(1, "string").alias("filename"))


def read_segment_features(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, HEADERS["segment_features"]).select(_cell(0, "int").alias("bag_id"), _cell(1, "int").alias("segment_id"), _vector(2).alias("features"))


def read_segment_rectangles(spark: SparkSession, path: str) -> DataFrame:
    names = ("bag_id", "segment_id", "min_x", "max_x", "min_y", "max_y")
    return lines(spark, path, HEADERS["segment_rectangles"]).select(*(_cell(i, "int").alias(n) for i, n in enumerate(names)))


def read_bag_features(spark: SparkSession, path: str) -> DataFrame:
    """Any header that starts with the key's name."""
    return lines(spark, path, "bag_id", strict=False).select(_cell(0, "int").alias("bag_id"), _vector(1).alias("features"))


def read_bag_labels(spark: SparkSession, path: str) -> DataFrame:
    """A bag's label set may be empty."""
    p = _parts()
    return lines(spark, path, HEADERS["bag_labels"]).select(_cell(0, "int").alias("bag_id"), F.slice(p, 2, F.size(p)).cast("array<int>").alias("labels"))


def read_species(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, HEADERS["species"]).select(_cell(0, "int").alias("class_id"), _cell(1, "string").alias("code"), _cell(2, "string").alias("species"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, HEADERS["clusters"]).select(*(_cell(i, "int").alias(n) for i, n in enumerate(("bag_id", "segment_id", "cluster"))))


def read_rain(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, HEADERS["rain"]).select(_cell(0, "int").alias("bag_id"), _cell(1, "double").alias("rain_probability"))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, HEADERS["folds"]).select(_cell(0, "int").alias("bag_id"), _cell(1, "int").alias("fold"))


def read_expert_labels(spark: SparkSession, path: str) -> DataFrame:
    """(filename, codes) of lines split at commas and quotes; the line number keeps their order."""
    p = F.filter(F.split("line", '[,"]'), lambda x: x != "")
    return lines(spark, path).select(F.get(p, F.lit(0)).alias("filename"), F.slice(p, 2, F.size(p)).alias("codes"))


#: The settings that an experiment file names.
SETTINGS = ("num classes", "feature dim", "partition")


def read_experiment(spark: SparkSession, path: str, compat: bool = False) -> tuple[dict, DataFrame, DataFrame]:
    """(settings, classes, examples) of a self-contained experiment file.

    Examples have (example_id, partition, labels, features). An empty label set is
    empty; ``compat`` reads it as the set of class 0.
    """
    raw = lines(spark, path)
    kv = {r.k.strip(): r.v.strip() for r in raw.filter("line NOT LIKE '%;%' AND line LIKE '%=%'").select(F.trim(F.substring_index("line", "=", 1)).alias("k"), F.expr("substr(line, instr(line, '=') + 1)").alias("v")).filter(F.col("k").isin(*SETTINGS)).dropDuplicates(["k"]).collect()}
    mode, _, k = kv.get("partition", "").partition(",")
    settings = {"num_classes": int(kv["num classes"]), "feature_dim": int(kv["feature dim"]), "partition": mode.strip(), "folds": int(k) if k.strip() else None}
    classes = _only(raw, F.col("line").rlike("^[0-9]+,[^;]*$")).select(_cell(0, "int").alias("class_id"), _cell(1, "string").alias("name"))
    p = F.split("line", ";", -1)
    labels = F.filter(F.split(F.get(p, F.lit(2)), ","), lambda x: x != "").cast("array<int>")
    if compat:
        labels = F.when(F.size(labels) == 0, F.array(F.lit(0))).otherwise(labels)
    examples = _only(raw, F.col("line").rlike("^[0-9]+;")).select(
        F.get(p, F.lit(0)).cast("int").alias("example_id"), F.get(p, F.lit(1)).alias("partition"), labels.alias("labels"), F.filter(F.split(F.get(p, F.lit(3)), ","), lambda x: x != "").cast("array<double>").alias("features")
    )
    return settings, classes, examples


# -- writers


def number(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def vector_text(v: Column) -> Column:
    return F.array_join(F.transform(v, number), ",")


def write_lines(rows: DataFrame, line: Column, order: list, header: str | None, path: str, one_file: bool = False) -> None:
    """Text files whose lines, taken file by file, stand in order behind one header.

    Rows are sorted by range over many tasks, and each range becomes a file; the
    header is the first line of the first. ``one_file``: for readers that take no
    folder, one task writes them all.
    """
    body = rows.select(F.lit(1).alias("part"), *(F.col(c) for c in order), line.alias("line")) if order else rows.select(F.lit(1).alias("part"), line.alias("line"))
    if header is not None:
        head = rows.sparkSession.range(1).select(F.lit(0).alias("part"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order), F.lit(header).alias("line"))
        body = head.unionByName(body)
    _write_ordered(body, ["part", *order], path, one_file)


def _write_ordered(body: DataFrame, order: list, path: str, one_file: bool) -> None:
    body = body.orderBy(*order).select("line")
    (body.coalesce(1) if one_file else body).write.mode("overwrite").text(path)


def write_features(df: DataFrame, path: str, keys: list[str], header: str, vector: str = "features") -> None:
    """Keys and a vector to a line, in key order."""
    write_lines(df, F.concat_ws(",", *keys, vector_text(F.col(vector))), keys, header, path)


def write_rectangles(df: DataFrame, path: str) -> None:
    """Data lines end in a comma."""
    cols = ("bag_id", "segment_id", "min_x", "max_x", "min_y", "max_y")
    write_lines(df, F.concat(F.concat_ws(",", *cols), F.lit(",")), ["bag_id", "segment_id"], HEADERS["segment_rectangles"], path)


def write_table(df: DataFrame, path: str, order: list[str], header: str | None = None, sep: str = ",") -> None:
    """Columns joined by ``sep``; doubles with six decimals."""
    cells = [number(F.col(c)) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]
    write_lines(df, F.concat_ws(sep, *(F.coalesce(c, F.lit("")) for c in cells)), order, header, path)


def write_experiment(examples: DataFrame, classes: DataFrame, path: str, num_classes: int, feature_dim: int, folds: int, one_file: bool = False) -> None:
    """A self-contained k-fold experiment from (bag_id, fold, labels, features)."""
    head = ["# self-contained multi-label experiment", "# example lines: index;partition;labelset;featurevector", f"num classes = {num_classes}", f"feature dim = {feature_dim}", f"partition = k-fold, {folds}", "---"]
    tail = ["***", "index;partition;labelset;featurevector"]
    spark = examples.sparkSession
    top = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, i, x) for i, x in enumerate(tail)], "part int, i int, line string")
    names = classes.select(F.lit(1).alias("part"), F.col("class_id").cast("int").alias("i"), F.concat_ws(",", "class_id", "name").alias("line"))
    body = examples.select(F.lit(3).alias("part"), F.col("bag_id").cast("int").alias("i"), F.concat_ws(";", "bag_id", "fold", F.array_join("labels", ","), vector_text(F.col("features"))).alias("line"))
    _write_ordered(top.union(names).union(body), ["part", "i"], path, one_file)
