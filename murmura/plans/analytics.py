"""Queries of the bag, recording, vector and label operators on the test tables.

Floats are rounded to six decimals on both sides: sums over tasks come in no fixed
order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from murmura.functions import image, scalar, signal, strings
from murmura.functions import vector as V
from murmura.operators import bags as B
from murmura.operators import multilabel as M
from murmura.operators import recordings as R
from murmura.operators import traversal as T
from murmura.plans import views
from murmura.plans.registry import query
from murmura.session import cut

DIM, K, STEPS = 64, 8, 3


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def each6(v: Column | str) -> Column:
    return F.transform(V.vec(v), lambda x: F.round(x, 6))


# -- rescaling, codebooks, histograms

_FLAT = f"WITH {views.SEGMENTS}, flat AS (SELECT bag_id, segment_id, i AS pos, features[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM seg)), lim AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM flat GROUP BY pos), sc AS (SELECT bag_id, segment_id, pos, CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END AS x FROM flat JOIN lim USING (pos))"


def _lloyd_sql(points: str, dim: int, k: int, steps: int) -> str:
    """CTEs c0, a1, c1, …: rounds from the first k keys, distances and centers rounded to nine decimals."""
    out = [f"ids AS (SELECT bag_id, segment_id, row_number() OVER (ORDER BY bag_id, segment_id) - 1 AS c FROM (SELECT DISTINCT bag_id, segment_id FROM {points})), c0 AS (SELECT c, pos, x FROM {points} JOIN ids USING (bag_id, segment_id) WHERE c < {k})"]
    for s in range(1, steps + 2):
        out.append(f"d{s} AS (SELECT p.bag_id, p.segment_id, c.c, round(sum((p.x - c.x) * (p.x - c.x)), 9) AS d FROM {points} p JOIN c{s - 1} c USING (pos) GROUP BY ALL), a{s} AS (SELECT bag_id, segment_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY bag_id, segment_id ORDER BY d, c) AS r FROM d{s}) WHERE r = 1)")
        out.append(f"c{s} AS (SELECT g.c, q.pos, coalesce(m, 0) AS x FROM (SELECT DISTINCT c FROM c0) g CROSS JOIN (SELECT DISTINCT pos FROM c0) q LEFT JOIN (SELECT c, pos, round(avg(x), 9) AS m FROM {points} JOIN a{s} USING (bag_id, segment_id) GROUP BY c, pos) n ON n.c = g.c AND n.pos = q.pos)")
    return ", ".join(out)


@query(
    "bag_histogram_of_segments",
    _FLAT + ", " + _lloyd_sql("sc", DIM, K, STEPS) + f", n AS (SELECT bag_id, c, count(*) AS n FROM a{STEPS + 1} GROUP BY ALL), t AS (SELECT bag_id, sum(n) AS t FROM n GROUP BY bag_id) SELECT t.bag_id, j AS cluster, round(coalesce(n.n, 0) / t.t, 6) AS share FROM t CROSS JOIN range({K}) g(j) LEFT JOIN n ON n.bag_id = t.bag_id AND n.c = j",
)
def bag_histogram_of_segments(spark, sf_dir):
    seg = cut(B.rescaled(views.segments(spark, sf_dir).select("bag_id", "segment_id", "features")))
    centers, _ = B.lloyd(seg, B.first_by_key(seg, K, ["bag_id", "segment_id"]), STEPS, digits=9)
    hist = B.bag_histograms(seg.select("bag_id").distinct(), B.nearest(seg, centers, digits=9), K)
    return hist.select("bag_id", F.posexplode("features").alias("cluster", "share")).select("bag_id", F.col("cluster").cast("bigint").alias("cluster"), r6("share").alias("share"))


@query("kmeans_representatives", _FLAT + ", " + _lloyd_sql("sc", DIM, K, STEPS) + f" SELECT c AS cluster, bag_id, segment_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, bag_id, segment_id) AS r FROM a{STEPS + 1}) WHERE r = 1")
def kmeans_representatives(spark, sf_dir):
    seg = cut(B.rescaled(views.segments(spark, sf_dir).select("bag_id", "segment_id", "features")))
    centers, _ = B.lloyd(seg, B.first_by_key(seg, K, ["bag_id", "segment_id"]), STEPS, digits=9)
    got = B.representatives(B.nearest(seg, centers, digits=9), ["bag_id", "segment_id"])
    return got.select(F.col("cluster").cast("bigint").alias("cluster"), "bag_id", "segment_id", r6("distance").alias("distance"))


@query("minmax_rescale", _FLAT + " SELECT bag_id, segment_id, (pos - 1)::INT AS pos, round(x, 6) AS x FROM sc")
def minmax_rescale(spark, sf_dir):
    return B.rescaled(views.segments(spark, sf_dir)).select("bag_id", "segment_id", F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


@query(
    "bag_mean_std_features",
    "WITH f AS (SELECT l_orderkey AS bag_id, unnest([0, 1, 2, 3]) AS pos, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem), g AS (SELECT bag_id, pos, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM f GROUP BY ALL) SELECT o_orderkey AS bag_id, r.pos::INT AS pos, coalesce(n, 0)::BIGINT AS n_segments, round(coalesce(m, 0), 6) AS mean, round(coalesce(s, 0), 6) AS std FROM orders CROSS JOIN range(4) r(pos) LEFT JOIN g ON g.bag_id = o_orderkey AND g.pos = r.pos",
)
def bag_mean_std_features(spark, sf_dir):
    bags, seg = views.order_bags(spark, sf_dir)
    f = B.summary_features(bags, seg, 4)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("pos"), F.get("features", 1 + 2 * i).alias("mean"), F.get("features", 2 + 2 * i).alias("std")))
    return f.select("bag_id", F.get("features", F.lit(0)).cast("bigint").alias("n_segments"), F.explode(pairs).alias("p")).select("bag_id", "p.pos", "n_segments", r6("p.mean").alias("mean"), r6("p.std").alias("std"))


# -- recordings


@query("segments_per_hour", f"WITH {views.RECORDINGS} SELECT h::INT AS hour, count(event_id)::BIGINT AS n FROM range(24) g(h) LEFT JOIN rec ON hour(ts) = h GROUP BY h")
def segments_per_hour(spark, sf_dir):
    return R.per_hour(views.recordings(spark, sf_dir))


@query("segments_per_hour_by_cluster", f"WITH {views.RECORDINGS} SELECT c.cluster, h::INT AS hour, count(event_id)::BIGINT AS n FROM (SELECT DISTINCT cluster FROM rec) c CROSS JOIN range(24) g(h) LEFT JOIN rec ON hour(ts) = h AND rec.cluster = c.cluster GROUP BY ALL")
def segments_per_hour_by_cluster(spark, sf_dir):
    r = views.recordings(spark, sf_dir)
    return R.per_hour_by_cluster(r, r.select("cluster").distinct())


@query(
    "segments_per_day_by_site",
    f"WITH {views.RECORDINGS} SELECT s.site, s.cluster, d::INT AS day, count(event_id)::BIGINT AS n FROM (SELECT DISTINCT site, cluster FROM rec) s CROSS JOIN (SELECT unnest(range(0, date_diff('day', min(ts::DATE), max(ts::DATE)) + 1)) AS d, min(ts::DATE) AS first FROM rec) g LEFT JOIN rec ON rec.site = s.site AND rec.cluster = s.cluster AND date_diff('day', first, ts::DATE) = d GROUP BY ALL",
)
def segments_per_day_by_site(spark, sf_dir):
    r = views.recordings(spark, sf_dir)
    first, days = r.select(F.to_date("ts").alias("d")).agg(F.min("d"), F.datediff(F.max("d"), F.min("d")) + 1).first()
    return R.per_day_by_site(r, r.select("site", "cluster"), str(first), days or 0, by=["cluster"])


@query("recording_coverage_counts", f"WITH {views.RECORDINGS}, k AS (SELECT 'hour' AS kind, hour(ts)::VARCHAR AS key FROM rec UNION ALL SELECT 'date', month(ts) || '/' || day(ts) || '/' || strftime(ts, '%y') FROM rec UNION ALL SELECT 'site', site::VARCHAR FROM rec) SELECT kind, key, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def recording_coverage_counts(spark, sf_dir):
    return R.coverage_counts(views.recordings(spark, sf_dir))


@query("distinct_stamps", f"WITH {views.RECORDINGS} SELECT DISTINCT site, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour FROM rec")
def distinct_stamps(spark, sf_dir):
    return R.stamps(views.recordings(spark, sf_dir))


@query("presence_matrix", f"WITH {views.RECORDINGS}, d AS (SELECT unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY))::DATE AS date FROM rec) SELECT s.site, d.date, h::INT AS hour, count(event_id) > 0 AS present FROM (SELECT DISTINCT site FROM rec) s CROSS JOIN d CROSS JOIN range(24) g(h) LEFT JOIN rec ON rec.site = s.site AND ts::DATE = d.date AND hour(ts) = h GROUP BY ALL")
def presence_matrix(spark, sf_dir):
    r = views.recordings(spark, sf_dir)
    days = r.select(F.to_date("ts").alias("d")).agg(F.sequence(F.min("d"), F.max("d")).alias("d")).select(F.explode("d").alias("date"))
    return R.presence(r, r.select("site").distinct(), days)


@query("dawn_filter", f"WITH {views.RECORDINGS} SELECT event_id, site, hour(ts)::INT AS hour FROM rec WHERE hour(ts) BETWEEN 5 AND 8")
def dawn_filter(spark, sf_dir):
    return R.dawn(views.recordings(spark, sf_dir)).select("event_id", "site", F.hour("ts").alias("hour"))


@query("random_dawn_sample", f"WITH {views.RECORDINGS} SELECT event_id, site FROM rec WHERE hour(ts) BETWEEN 5 AND 8 ORDER BY md5(event_id || '-0'), event_id LIMIT 20")
def random_dawn_sample(spark, sf_dir):
    return R.random_rows(R.dawn(views.recordings(spark, sf_dir)), 20, ["event_id"]).select("event_id", "site")


@query("rain_filter_ranking", f"WITH {views.RECORDINGS} SELECT event_id, round(p, 6) AS rain_probability FROM (SELECT event_id, abs(value) - floor(abs(value)) AS p FROM rec) WHERE p < 0.1")
def rain_filter_ranking(spark, sf_dir):
    r = views.recordings(spark, sf_dir).withColumn("rain_probability", F.abs("value") - F.floor(F.abs("value"))).withColumn("filename", F.col("event_id").cast("string"))
    return R.rain_ranking(R.without_rain(r, 0.1)).select("event_id", r6("rain_probability").alias("rain_probability"))


@query("recording_names", f"WITH {views.RECORDINGS} SELECT event_id, 'PC' || site AS site, year(ts)::INT AS year, ts::DATE AS date, hour(ts)::INT AS hour FROM rec")
def recording_names(spark, sf_dir):
    name = F.concat(F.lit("PC"), F.col("site").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_0.wav"))
    r = views.recordings(spark, sf_dir).select("event_id", name.alias("f"))
    return r.select("event_id", strings.site(F.col("f")).alias("site"), strings.year(F.col("f")).alias("year"), strings.date(F.col("f")).alias("date"), strings.hour(F.col("f")).alias("hour"))


# -- label sets


@query("unambiguous_routing", f"WITH {views.LABELLED} SELECT CASE len(labels) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS route, count(*)::BIGINT AS n FROM lab GROUP BY ALL")
def unambiguous_routing(spark, sf_dir):
    return B.routed(views.labelled(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@query("segmentation_false_negatives", "SELECT d.doc_id AS bag_id, quality + 2 * toxic AS labels FROM labels d LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON d.doc_id = p.page_id WHERE quality + toxic > 0 AND p.page_id IS NULL")
def segmentation_false_negatives(spark, sf_dir):
    seg = views.read(spark, sf_dir, "pages").select(F.col("page_id").alias("bag_id"))
    got = B.segmentation_misses(views.labelled(spark, sf_dir), seg)
    return got.select("bag_id", F.aggregate("labels", F.lit(0), lambda t, y: t + y + 1).alias("labels"))


@query(
    "rare_class_filter",
    f"WITH {views.PART_BAGS}, l AS (SELECT bag_id, unnest(labels) AS y FROM pb), k AS (SELECT * FROM l WHERE y NOT IN (21, 22, 23, 24, 26)), n AS (SELECT y, count(*) AS n FROM k GROUP BY y), lim AS (SELECT quantile_disc(n, 0.1) AS q FROM n), c AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS new_id FROM n WHERE n > (SELECT q FROM lim)), bad AS (SELECT DISTINCT bag_id FROM k JOIN n USING (y) WHERE n <= (SELECT q FROM lim)) SELECT p.bag_id, coalesce(string_agg(new_id::VARCHAR, ',' ORDER BY new_id), '') AS labels FROM pb p LEFT JOIN k USING (bag_id) LEFT JOIN c USING (y) WHERE p.bag_id NOT IN (SELECT bag_id FROM bad) GROUP BY p.bag_id",
)
def rare_class_filter(spark, sf_dir):
    kept, _ = B.without_rare(views.part_bags(spark, sf_dir), (21, 22, 23, 24, 26), share=0.1)
    return kept.select("bag_id", F.array_join("labels", ",").alias("labels"))


@query("class_counts", f"WITH {views.BAGS} SELECT c::INT AS class_id, count(y)::BIGINT AS n FROM range(12) g(c) LEFT JOIN (SELECT unnest(labels) AS y FROM bags) ON y = c GROUP BY c")
def class_counts(spark, sf_dir):
    return B.class_counts(views.bags(spark, sf_dir), 12)


@query("selection_histogram_join", f"WITH {views.SEGMENTS} SELECT coalesce(a.class, b.class) AS class, coalesce(a.n, 0)::BIGINT AS first, coalesce(b.n, 0)::BIGINT AS second FROM (SELECT label::VARCHAR AS class, count(*) AS n FROM seg WHERE bag_id % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT label::VARCHAR AS class, count(*) AS n FROM seg WHERE bag_id % 2 <> 0 GROUP BY ALL) b ON a.class = b.class")
def selection_histogram_join(spark, sf_dir):
    """Classes in two selections that share out all bags: those of even number and the others."""
    s = views.segments(spark, sf_dir).select("bag_id", F.col("label").cast("string").alias("class"))
    own = lambda cond: s.filter(cond).groupBy("class").count()
    return B.selection_histograms({"first": own("bag_id % 2 = 0"), "second": own("bag_id % 2 <> 0")})


@query("first_seen_discovery_curve", f"WITH {views.BAGS}, f AS (SELECT y, min(bag_id) AS since FROM (SELECT bag_id, unnest(labels) AS y FROM bags) GROUP BY y) SELECT bag_id, (SELECT count(*) FROM f WHERE since <= bag_id)::BIGINT AS n_known FROM bags")
def first_seen_discovery_curve(spark, sf_dir):
    return R.discovery_curve(views.bags(spark, sf_dir), ["bag_id"]).select("bag_id", "n_known")


@query("label_count_results", f"WITH {views.SEGMENTS} SELECT 'C' || label AS code, count(*)::BIGINT AS n FROM (SELECT DISTINCT bag_id, label FROM seg) WHERE label <> 3 GROUP BY ALL")
def label_count_results(spark, sf_dir):
    b = views.bags(spark, sf_dir).withColumn("codes", F.transform("labels", lambda y: F.concat(F.lit("C"), y.cast("string"))))
    return R.code_counts(b, skipped=(*R.SKIPPED_CODES, "C3"))


@query("class_code_remap", f"WITH {views.BAGS}, p AS (SELECT bag_id, unnest(labels) AS y FROM bags) SELECT b.bag_id, coalesce(string_agg((y // 2)::VARCHAR, ',' ORDER BY y // 2) FILTER (y % 2 = 0), '') AS labels FROM bags b LEFT JOIN p USING (bag_id) GROUP BY b.bag_id")
def class_code_remap(spark, sf_dir):
    b = views.bags(spark, sf_dir).withColumn("codes", F.transform("labels", lambda y: F.concat(F.lit("C"), y.cast("string"))))
    classes = spark.range(5).select(F.concat(F.lit("C"), (F.col("id") * 2).cast("string")).alias("code"), F.col("id").cast("int").alias("class_id"))
    return B.remapped_labels(b, classes).select("bag_id", F.array_join("labels", ",").alias("labels"))


@query("compact_ids", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier")
def compact_ids(spark, sf_dir):
    return B.compact_ids(views.read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", "place")


@query("hidden_labels", f"WITH {views.LABELLED} SELECT bag_id, CASE WHEN bag_id % 10 = 0 THEN '?' ELSE array_to_string(labels, ',') END AS labels FROM lab")
def hidden_labels(spark, sf_dir):
    return R.hidden_labels(views.labelled(spark, sf_dir), F.col("bag_id") % 10 == 0)


@query("kaggle_solution", f"WITH {views.LABELLED} SELECT bag_id AS rec_id, c::INT AS species, list_contains(labels, c::INT)::INT AS probability, CASE WHEN bag_id % 3 = 0 THEN 'PublicTest' ELSE 'PrivateTest' END AS usage FROM lab CROSS JOIN range(2) g(c)")
def kaggle_solution(spark, sf_dir):
    return R.solution(views.labelled(spark, sf_dir), 2, F.col("bag_id") % 3 == 0)


@query("sample_submission", f"WITH {views.BAGS} SELECT bag_id AS rec_id, c::INT AS species, 0 AS probability FROM bags CROSS JOIN range(10) g(c)")
def sample_submission(spark, sf_dir):
    return R.sample_submission(views.bags(spark, sf_dir), 10)


@query("train_test_split", f"WITH {views.BAGS} SELECT bag_id, contains('13579bdf', right(md5(bag_id || '-0'), 1))::INT AS half FROM bags")
def train_test_split(spark, sf_dir):
    return R.halves(views.bags(spark, sf_dir).select("bag_id"), ["bag_id"])


@query("fold_split", "SELECT doc_id % 10 AS fold, count(*)::BIGINT AS test, (SELECT count(*) FROM labels)::BIGINT - count(*)::BIGINT AS train FROM labels GROUP BY ALL")
def fold_split(spark, sf_dir):
    x = views.read(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 10).alias("fold")).agg(F.count("*").alias("test"))
    return x.crossJoin(F.broadcast(x.agg(F.sum("test").alias("all")))).select("fold", "test", (F.col("all") - F.col("test")).alias("train"))


# -- joins by distance

_PAIRS = "pr AS (SELECT a.bag_id AS a, a.bag_id + 1 AS b FROM (SELECT DISTINCT bag_id FROM seg) a JOIN (SELECT DISTINCT bag_id FROM seg) b ON b.bag_id = a.bag_id + 1), pd AS (SELECT a, b, x.segment_id AS i, y.segment_id AS j, list_sum(list_transform(list_zip(x.features, y.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM pr JOIN seg x ON x.bag_id = a JOIN seg y ON y.bag_id = b)"


def _pairs(spark, sf_dir):
    seg = views.segments(spark, sf_dir)
    ids = seg.select("bag_id").distinct()
    return ids.select(F.col("bag_id").alias("a"), (F.col("bag_id") + 1).alias("b")).join(ids.select(F.col("bag_id").alias("b")), "b").select("a", "b"), seg


@query("bag_hausdorff_avg", f"WITH {views.SEGMENTS}, {_PAIRS}, m AS (SELECT a, b, min(sqrt(d)) AS m FROM pd GROUP BY a, b, i UNION ALL SELECT a, b, min(sqrt(d)) FROM pd GROUP BY a, b, j) SELECT a, b, round(sum(m) / count(*), 6) AS distance FROM m GROUP BY ALL")
def bag_hausdorff_avg(spark, sf_dir):
    return B.average_hausdorff(*_pairs(spark, sf_dir)).withColumn("distance", r6("distance"))


@query("bag_min_max_pair", f"WITH {views.SEGMENTS}, {_PAIRS} SELECT a, b, round(min(d), 6) AS closest, round(max(d), 6) AS farthest FROM pd GROUP BY ALL")
def bag_min_max_pair(spark, sf_dir):
    return B.extreme_pairs(*_pairs(spark, sf_dir)).select("a", "b", r6("closest").alias("closest"), r6("farthest").alias("farthest"))


@query("nearest_centroid", f"WITH {views.SEGMENTS}, c AS (SELECT row_number() OVER (ORDER BY bag_id, segment_id) - 1 AS c, features AS f FROM seg ORDER BY bag_id, segment_id LIMIT 10), d AS (SELECT bag_id, segment_id, c, round(list_sum(list_transform(list_zip(features, f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM seg CROSS JOIN c) SELECT bag_id, segment_id, c::INT AS cluster, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY bag_id, segment_id ORDER BY d, c) AS r FROM d) WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    seg = views.segments(spark, sf_dir)
    return B.nearest(seg, B.first_by_key(seg, 10, ["bag_id", "segment_id"]), digits=9).select("bag_id", "segment_id", "cluster", r6("distance").alias("distance"))


@query("nearest_neighbor_distance", f"WITH {views.SEGMENTS}, c AS (SELECT features AS f FROM seg ORDER BY bag_id, segment_id LIMIT 5) SELECT bag_id, segment_id, round(min(list_sum(list_transform(list_zip(features, f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM seg CROSS JOIN c GROUP BY ALL")
def nearest_neighbor_distance(spark, sf_dir):
    seg = views.segments(spark, sf_dir)
    return seg.select("bag_id", "segment_id", r6(B.nearest_in_set(seg, B.first_by_key(seg, 5, ["bag_id", "segment_id"]))).alias("distance"))


# -- vectors

_PDF = f"WITH {views.SEGMENTS}, p AS (SELECT bag_id, segment_id, list_transform(features, lambda x: abs(x) + 0.001) AS v FROM seg), q AS (SELECT bag_id, segment_id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM p)"
_NEXT = f"{_PDF}, e AS (SELECT x.bag_id, x.segment_id, x.p AS p, y.p AS q FROM q x JOIN q y ON x.bag_id = y.bag_id AND y.segment_id = x.segment_id + 1)"


def _pdfs(spark, sf_dir):
    return views.segments(spark, sf_dir).select("bag_id", "segment_id", V.to_pdf(F.transform("features", lambda x: F.abs(x) + 0.001)).alias("p"))


def _neighbours(spark, sf_dir):
    """Each segment's distribution with that of the next one of its bag."""
    w = Window.partitionBy("bag_id").orderBy("segment_id")
    return _pdfs(spark, sf_dir).withColumn("q", F.lead("p").over(w)).filter("q IS NOT NULL")


for _name, _f, _sql in (
    ("dist_l1", V.l1, "abs(z[1] - z[2])"),
    ("dist_l2", V.squared_l2, "(z[1] - z[2]) * (z[1] - z[2])"),
    ("dist_hellinger", V.hellinger, "pow(sqrt(z[1]) - sqrt(z[2]), 2)"),
    ("dist_kl", V.kullback_leibler, "z[1] * ln(z[1] / z[2])"),
):
    query(_name, f"{_NEXT} SELECT bag_id, segment_id, round(list_sum(list_transform(list_zip(p, q), lambda z: {_sql})), 6) AS distance FROM e")(lambda spark, sf_dir, f=_f: _neighbours(spark, sf_dir).select("bag_id", "segment_id", r6(f("p", "q")).alias("distance")))


@query("gini_and_moments", f"{_PDF}, m AS (SELECT bag_id, segment_id, p, list_sum(list_transform(range(0, 64), lambda i: p[i + 1] * i / 63)) AS mu FROM q) SELECT bag_id, segment_id, round(1 - list_sum(list_transform(p, lambda x: x * x)), 6) AS gini, round(mu, 6) AS mean, round(list_sum(list_transform(range(0, 64), lambda i: pow(i / 63 - mu, 2) * p[i + 1])), 6) AS variance, round(list_sum(list_transform(range(0, 64), lambda i: pow(i / 63 - mu, 3) * p[i + 1])), 6) AS skewness, round(list_sum(list_transform(range(0, 64), lambda i: pow(i / 63 - mu, 4) * p[i + 1])), 6) AS kurtosis FROM m")
def gini_and_moments(spark, sf_dir):
    moment = lambda k: r6(V.relative_central_moment("p", k))
    return _pdfs(spark, sf_dir).select("bag_id", "segment_id", r6(V.gini("p")).alias("gini"), r6(V.relative_mean("p")).alias("mean"), moment(2).alias("variance"), moment(3).alias("skewness"), moment(4).alias("kurtosis"))


@query("argmax_and_norms", f"WITH {views.SEGMENTS} SELECT bag_id, segment_id, (list_position(features, list_max(features)) - 1)::INT AS top, (list_position(features, list_min(features)) - 1)::INT AS bottom, round(sqrt(list_sum(list_transform(features, lambda x: x * x))), 6) AS length, round(list_aggregate(features, 'var_samp'), 6) AS variance FROM seg")
def argmax_and_norms(spark, sf_dir):
    return views.segments(spark, sf_dir).select("bag_id", "segment_id", V.argmax("features").alias("top"), V.argmin("features").alias("bottom"), r6(V.length("features")).alias("length"), r6(V.sample_variance("features")).alias("variance"))


@query("multi_hot_sets", f"WITH {views.BAGS} SELECT bag_id, array_to_string(list_transform(range(0, 10), lambda j: list_contains(labels, j)::INT), '') AS hot, len(list_distinct(list_concat(labels, [0, 1]))) AS n_union, len(list_filter(labels, lambda y: y NOT IN (0, 1))) AS n_new FROM bags")
def multi_hot_sets(spark, sf_dir):
    two = F.array(F.lit(0), F.lit(1)).cast("array<int>")
    y = F.col("labels").cast("array<int>")
    return views.bags(spark, sf_dir).select("bag_id", F.array_join(V.multi_hot(y, 10).cast("array<string>"), "").alias("hot"), F.size(F.array_union(y, two)).alias("n_union"), F.size(F.array_except(y, two)).alias("n_new"))


@query("string_functions", "SELECT doc_id, source, array_to_string(list_filter(string_split_regex(source, '[rc]'), lambda x: x <> ''), '-') AS parts, coalesce(try_cast(nullif(regexp_extract(substr(source, 4), '^[ ]*([+-]?[0-9]+)', 1), '') AS INT), 0) AS number, replace(source, 's', '') AS removed, substr(printf('%.6f', n_chars / 7.0), 1, strpos(printf('%.6f', n_chars / 7.0), '.') + 2) AS cut FROM documents")
def string_functions(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents")
    s = F.col("source")
    return d.select("doc_id", "source", F.array_join(strings.split_non_empty(s, "rc"), "-").alias("parts"), strings.to_int(F.substring("source", 4, 100)).alias("number"), strings.remove_char(s, "s").alias("removed"), strings.float_text(F.col("n_chars") / 7.0, 2).alias("cut"))


@query("unit_conversions", "SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, round(700 * (pow(10, p_size / 2595) - 1), 6) AS hz, round(p_size * 16000 / 512, 6) AS bin_hz, least(greatest((p_size - 10) * 8, 0), 255)::INT AS clamped FROM part")
def unit_conversions(spark, sf_dir):
    p = views.read(spark, sf_dir, "part")
    return p.select("p_partkey", r6(scalar.mel(F.col("p_retailprice"))).alias("mel"), r6(scalar.mel_to_hz(F.col("p_size"))).alias("hz"), r6(scalar.bin_to_hz(F.col("p_size"), 0, 16000, 512)).alias("bin_hz"), scalar.clamp255((F.col("p_size") - 10) * 8).alias("clamped"))


# -- signals


def _of_vectors(kind, f):
    """A Column function from a function of one vector: the library's numpy functions run in Arrow batches."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([f(np.asarray(x, float)) for x in v], dtype=object)

    return run


@query("uniform_blur", f"WITH {views.SEGMENTS} SELECT bag_id, segment_id, i::INT AS pos, round(CASE WHEN i < 2 OR i > 61 THEN features[i + 1] ELSE list_avg(features[i - 1:i + 3]) END, 6) AS blurred FROM (SELECT *, unnest(range(0, 64)) AS i FROM seg)")
def uniform_blur(spark, sf_dir):
    blurred = _of_vectors("array<double>", lambda x: signal.uniform_blur(x, 2))
    return views.segments(spark, sf_dir).select("bag_id", "segment_id", F.posexplode(blurred("features")).alias("pos", "blurred")).withColumn("blurred", r6("blurred"))


@query("frame_windows", f"WITH {views.SEGMENTS} SELECT bag_id, segment_id, s::INT AS start, round(list_sum(features[s + 1:s + 16]), 6) AS total FROM (SELECT *, unnest(range(0, 48, 4)) AS s FROM seg)")
def frame_windows(spark, sf_dir):
    frames = _of_vectors("array<struct<start:int,frame:array<double>>>", lambda x: [{"start": int(s), "frame": signal.extract_frame(x, s, 16)} for s in signal.frame_starts(len(x), 16, 4)])
    return views.segments(spark, sf_dir).select("bag_id", "segment_id", F.explode(frames("features")).alias("f")).select("bag_id", "segment_id", "f.start", r6(V.total("f.frame")).alias("total"))


@query("hamming_dft_magnitude", f"WITH {views.SEGMENTS}, w AS (SELECT bag_id, segment_id, i, features[i + 1] * (0.54 - 0.46 * cos(2 * pi() * i / 63)) AS x FROM (SELECT *, unnest(range(0, 64)) AS i FROM seg)), f AS (SELECT bag_id, segment_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im, sum(x * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) AS ny FROM w CROSS JOIN range(32) g(k) GROUP BY ALL) SELECT bag_id, segment_id, k::INT AS bin, round(sqrt(re * re + CASE WHEN k = 0 THEN ny * ny ELSE im * im END), 6) AS magnitude FROM f")
def hamming_dft_magnitude(spark, sf_dir):
    @F.pandas_udf("array<double>")
    def magnitudes(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(signal.power_spectrum(np.array(v.tolist()) * signal.hamming(64))))) if len(v) else pd.Series([], dtype=object)

    return views.segments(spark, sf_dir).select("bag_id", "segment_id", F.posexplode(magnitudes("features")).alias("bin", "magnitude")).withColumn("magnitude", r6("magnitude"))


# -- images: one for each bag, 64 rows by 5 columns; a mask is what has half of full brightness


def _of_images(kind, f):
    @F.pandas_udf(kind)
    def run(columns: pd.Series) -> pd.Series:
        return pd.Series([f(np.stack([np.asarray(c) for c in x], 1).astype(np.uint8)) for x in columns], dtype=object)

    return run


def _mask(img):
    return np.where(img >= 128, 255, 0).astype(np.uint8)


@query("mask_area_perimeter", f"WITH {views.IMAGES}, m AS (SELECT bag_id, x, y, (v >= 128)::INT AS v FROM px) SELECT a.bag_id, count(*) FILTER (a.v > 0)::BIGINT AS area, count(*) FILTER (coalesce(l.v, 0) <> a.v OR coalesce(t.v, 0) <> a.v OR coalesce(d.v, 0) <> a.v)::BIGINT AS perimeter FROM m a LEFT JOIN m l ON l.bag_id = a.bag_id AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN m t ON t.bag_id = a.bag_id AND t.x = a.x AND t.y = a.y - 1 LEFT JOIN m d ON d.bag_id = a.bag_id AND d.x = a.x - 1 AND d.y = a.y - 1 GROUP BY a.bag_id")
def mask_area_perimeter(spark, sf_dir):
    both = _of_images("array<bigint>", lambda img: [image.mask_area(_mask(img)), image.mask_perimeter(_mask(img))])
    return views.images(spark, sf_dir).select("bag_id", both("columns").alias("m")).select("bag_id", *(F.get("m", F.lit(i)).alias(c) for i, c in enumerate(("area", "perimeter"))))


_PROFILES = ("freq_gini", "time_gini", "freq_mean", "time_mean", "freq_variance", "time_variance", "freq_skewness", "time_skewness", "freq_kurtosis", "time_kurtosis", "freq_top", "time_top", "mask_mean", "mask_std")


def _profile_sql() -> str:
    """Both profiles as lists, then the same figures for each."""
    prof = lambda a, b: f"{a}s AS (SELECT bag_id, {b}, sum(u) AS s FROM un GROUP BY ALL), {a}p AS (SELECT bag_id, list(s ORDER BY {b}) AS l FROM {a}s GROUP BY bag_id), {a} AS (SELECT bag_id, list_transform(l, lambda z: z / list_sum(l)) AS p, len(l) - 1 AS n FROM {a}p), {a}m AS (SELECT *, list_sum(list_transform(range(0, n + 1), lambda i: p[i + 1] * i / n)) AS mu FROM {a})"
    moment = lambda a, k: f"list_sum(list_transform(range(0, {a}m.n + 1), lambda i: pow(i / {a}m.n - {a}m.mu, {k}) * {a}m.p[i + 1]))"
    one = lambda a: (f"1 - list_sum(list_transform({a}m.p, lambda z: z * z))", f"{a}m.mu", moment(a, 2), moment(a, 3), moment(a, 4), f"(list_position({a}m.p, list_max({a}m.p)) - 1) / {a}m.n")
    figures = [x for pair in zip(one("f"), one("t"), strict=True) for x in pair] + ["coalesce(i.m, 0)", "coalesce(i.d, 0)"]
    return f"WITH {views.IMAGES}, un AS (SELECT *, (v::FLOAT / 255::FLOAT)::DOUBLE AS u FROM px), {prof('f', 'y')}, {prof('t', 'x')}, i AS (SELECT bag_id, avg(u) AS m, stddev_pop(u) AS d FROM un WHERE v >= 128 GROUP BY bag_id) SELECT fm.bag_id, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in zip(_PROFILES, figures, strict=True)) + " FROM fm JOIN tm USING (bag_id) LEFT JOIN i USING (bag_id)"


@query("profile_features", _profile_sql())
def profile_features(spark, sf_dir):
    figures = _of_images("array<double>", lambda img: image.profile_features(img, _mask(img)))
    return views.images(spark, sf_dir).select("bag_id", figures("columns").alias("f")).select("bag_id", *(r6(F.coalesce(F.get("f", F.lit(i)), F.lit(float("nan")))).alias(c) for i, c in enumerate(_PROFILES)))  # pandas takes NaN for null


@query("whitening_filter", f"WITH {views.IMAGES}, un AS (SELECT bag_id, x, y, v::FLOAT / 255::FLOAT AS u FROM px), e AS (SELECT bag_id, x, list_reduce(list(u * u ORDER BY y), lambda a, b: (a + b)::FLOAT) / 64::FLOAT AS e FROM un GROUP BY ALL), q AS (SELECT bag_id, x FROM (SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY e, x) AS r FROM e) WHERE r = 1), s AS (SELECT bag_id, y, sqrt((u * u + 1e-11::FLOAT)::DOUBLE)::FLOAT AS s FROM un JOIN q USING (bag_id, x)) SELECT bag_id, y::INT AS y, x, floor((least(u / s, 1::FLOAT) * 255::FLOAT)::DOUBLE)::INT AS v FROM un JOIN s USING (bag_id, y)")
def whitening_filter(spark, sf_dir):
    rows = _of_images("array<array<int>>", lambda img: [r.astype(np.int32) for r in signal.whitening_filter(img)])
    out = views.images(spark, sf_dir).select("bag_id", F.posexplode(rows("columns")).alias("y", "r"))
    return out.select("bag_id", "y", F.posexplode("r").alias("x", "v")).select("bag_id", "y", F.col("x").cast("bigint").alias("x"), "v")


@query("spectrogram_normalizations", f"WITH {views.SEGMENTS}, v AS (SELECT bag_id, segment_id, i - 1 AS bin, abs(features[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM seg)) SELECT bag_id, segment_id, bin::INT AS bin, round(x / max(x) OVER (PARTITION BY bag_id), 6) AS unit, round(x / sum(x) OVER (PARTITION BY bag_id, segment_id), 6) AS pdf, round(greatest(0, x - avg(x) OVER (PARTITION BY bag_id, bin)), 6) AS over FROM v")
def spectrogram_normalizations(spark, sf_dir):
    """A bag's vectors as the frames of a spectrogram."""
    kinds = {"unit": signal.normalized_01, "pdf": signal.as_pdfs, "over": signal.minus_average}

    @F.pandas_udf("array<struct<segment_id:bigint,bin:int,unit:double,pdf:double,over:double>>")
    def normalised(frames: pd.Series) -> pd.Series:
        out = []
        for bag in frames:
            s = np.abs(np.stack([np.asarray(f["features"], float) for f in bag]))
            made = {k: f(s) for k, f in kinds.items()}
            out.append([{"segment_id": f["segment_id"], "bin": j, **{k: m[i, j] for k, m in made.items()}} for i, f in enumerate(bag) for j in range(s.shape[1])])
        return pd.Series(out, dtype=object)

    bags = views.segments(spark, sf_dir).groupBy("bag_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "features"))).alias("frames"))  # five to a bag
    return bags.select("bag_id", F.explode(normalised("frames")).alias("e")).select("bag_id", "e.segment_id", "e.bin", *(r6(f"e.{k}").alias(k) for k in kinds))


# -- greedy selections


def _farthest_sql(k: int, mean: bool) -> str:
    d = "round(list_sum(list_transform(list_zip(s.features, p{i}.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"
    if mean:
        d = d.replace("round(", "sqrt(").replace(", 9)", ")")
    out = [f"WITH {views.SEGMENTS}, p0 AS (SELECT bag_id, segment_id, features FROM seg ORDER BY bag_id, segment_id LIMIT 1)"]
    for n in range(1, k):
        picked = ", ".join(f"p{i}" for i in range(n))
        scores = [d.format(i=i) for i in range(n)]
        score = f"round({' + '.join(scores)}, 9)" if mean else f"least({', '.join(scores)})" if n > 1 else scores[0]
        taken = " AND ".join(f"NOT (s.bag_id = p{i}.bag_id AND s.segment_id = p{i}.segment_id)" for i in range(n))
        out.append(f"p{n} AS (SELECT s.bag_id, s.segment_id, s.features FROM seg s, {picked} WHERE {taken} ORDER BY {score} DESC, s.bag_id, s.segment_id LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {i} AS place, bag_id, segment_id FROM p{i}" for i in range(k))


@query("farthest_first_maxmin", _farthest_sql(5, False))
def farthest_first_maxmin(spark, sf_dir):
    got = T.farthest_first(views.segments(spark, sf_dir), 5, ["bag_id", "segment_id"], digits=9)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(got)], "place int, bag_id bigint, segment_id bigint")


@query("farthest_first_maxavg", _farthest_sql(5, True))
def farthest_first_maxavg(spark, sf_dir):
    got = T.farthest_average(views.segments(spark, sf_dir), 5, ["bag_id", "segment_id"], digits=9)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(got)], "place int, bag_id bigint, segment_id bigint")


def _coverage_sql(k: int) -> str:
    out = [f"WITH {views.BAGS}, p0 AS (SELECT bag_id, labels AS known FROM bags ORDER BY len(labels) DESC, bag_id LIMIT 1)"]
    for n in range(1, k):
        taken = " AND ".join(f"b.bag_id <> p{i}.bag_id" for i in range(n))
        out.append(f"p{n} AS (SELECT b.bag_id, list_distinct(list_concat(p{n - 1}.known, b.labels)) AS known FROM bags b, {', '.join(f'p{i}' for i in range(n))} WHERE {taken} ORDER BY len(list_distinct(list_concat(p{n - 1}.known, b.labels))) DESC, b.bag_id LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {i} AS place, bag_id FROM p{i}" for i in range(k))


@query("coverage_oracle", _coverage_sql(4))
def coverage_oracle(spark, sf_dir):
    got = T.greedy_coverage(views.bags(spark, sf_dir), 4)
    return spark.createDataFrame(list(enumerate(got)), "place int, bag_id bigint")


# -- multi-label measures


@query(
    "multilabel_losses",
    f"WITH {views.SCORED}, x AS (SELECT bag_id, labels, scores, predicted, len(list_filter(range(0, 10), lambda c: list_contains(labels, c) <> list_contains(predicted, c))) AS wrong, len(labels) AS k FROM scored), yes AS (SELECT bag_id, unnest(labels) AS y, scores, labels FROM scored), rl AS (SELECT bag_id, sum(len(list_filter(range(0, 10), lambda c: NOT list_contains(labels, c) AND scores[y + 1] <= scores[c + 1]))) AS bad, max(len(list_filter(range(0, 10), lambda c: scores[c + 1] > scores[y + 1] OR (scores[c + 1] = scores[y + 1] AND c > y)))) AS depth FROM yes GROUP BY bag_id) SELECT bag_id, round(wrong / 10.0, 6) AS hamming, CASE WHEN wrong = 0 THEN 0.0 ELSE 1.0 END AS set01, CASE WHEN k BETWEEN 1 AND 9 THEN round(bad / (k * (10 - k)), 6) END AS rank_loss, CASE WHEN list_contains(labels, list_position(scores, list_max(scores)) - 1) THEN 0.0 ELSE 1.0 END AS one_error, coalesce(depth, 0)::BIGINT AS coverage FROM x LEFT JOIN rl USING (bag_id)",
)
def multilabel_losses(spark, sf_dir):
    s = views.scored(spark, sf_dir)
    y, p, x = F.col("labels"), F.col("predicted"), F.col("scores")
    return s.select("bag_id", r6(M.hamming_loss(p, y, 10)).alias("hamming"), M.set01_loss(p, y).alias("set01"), r6(M.rank_loss(x, y)).alias("rank_loss"), M.one_error(x, y).alias("one_error"), M.coverage(x, y).cast("bigint").alias("coverage"))


@query("confusion_counts", f"WITH {views.SCORED}, c AS (SELECT list_contains(labels, c) AS y, list_contains(predicted, c) AS p FROM scored CROSS JOIN range(10) g(c)) SELECT count(*) FILTER (y AND p)::BIGINT AS tp, count(*) FILTER (p AND NOT y)::BIGINT AS fp, count(*) FILTER (NOT y AND NOT p)::BIGINT AS tn, count(*) FILTER (y AND NOT p)::BIGINT AS fn FROM c")
def confusion_counts(spark, sf_dir):
    s = views.scored(spark, sf_dir).select(M.confusion(F.col("predicted"), F.col("labels"), 10).alias("c"))
    return s.agg(*(F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "tn", "fn")))


@query("kfold_metric_means", f"WITH {views.SCORED}, x AS (SELECT bag_id % 5 AS fold, len(list_filter(range(0, 10), lambda c: list_contains(labels, c) <> list_contains(predicted, c))) / 10.0 AS h FROM scored) SELECT fold, round(avg(h), 6) AS hamming_loss, round(avg(CASE WHEN h = 0 THEN 0 ELSE 1 END), 6) AS set01_loss, round(1 - avg(h), 6) AS accuracy FROM x GROUP BY fold")
def kfold_metric_means(spark, sf_dir):
    m = M.metric_means(views.scored(spark, sf_dir).withColumn("fold", F.col("bag_id") % 5), "scores", "predicted", "labels", 10, ["fold"])
    return m.select("fold", r6("hamming_loss").alias("hamming_loss"), r6("set01_loss").alias("set01_loss"), r6("accuracy").alias("accuracy"))


@query("baseline_long_scores", f"WITH {views.SCORED} SELECT bag_id AS rec_id, c::INT AS species, round(scores[c + 1], 6) AS probability FROM scored CROSS JOIN range(10) g(c)")
def baseline_long_scores(spark, sf_dir):
    return R.long_scores(views.scored(spark, sf_dir)).withColumn("probability", r6("probability"))


@query("oob_threshold_calibration", f"WITH {views.SCORED}, l AS (SELECT c, round(scores[c + 1], 9) AS s, list_contains(labels, c) AS y FROM scored CROSS JOIN range(10) g(c)), e AS (SELECT c, t, count(*) FILTER ((s > t / 1000.0) <> y) AS errors FROM l CROSS JOIN range(1, 1000) h(t) GROUP BY ALL) SELECT c::INT AS class_id, t / 1000.0 AS threshold, errors::BIGINT AS errors FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY errors, t) AS r FROM e) WHERE r = 1")
def oob_threshold_calibration(spark, sf_dir):
    long = R.long_scores(views.scored(spark, sf_dir).select("bag_id", "scores")).join(views.scored(spark, sf_dir).select(F.col("bag_id").alias("rec_id"), "labels"), "rec_id")
    long = long.select(F.col("species").alias("class_id"), "probability", F.array_contains("labels", F.col("species")).alias("positive"))
    return M.calibrated(long, "probability", "positive", ["class_id"])
