"""Queries of class discovery, seeding and nearest bags on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.operators import bags as B
from murmura.operators import selection
from murmura.plans import views
from murmura.plans.registry import query


def _d(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _unrolled(n: int, start: str, step) -> str:
    """SQL of n picks one after the other: ``start`` gives the first bag, ``step(k1)`` the next one after those in table ``k1``."""
    out = [f"p1 AS ({start})", "k1 AS (SELECT 1 AS place, bag_id FROM p1)"]
    for i in range(2, n + 1):
        out += [f"p{i} AS ({step(f'k{i - 1}')})", f"k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT {i}, bag_id FROM p{i})"]
    return ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out) + f" SELECT place::INT AS place, bag_id FROM k{n}"


def _near(known: str) -> str:
    return f"SELECT s.bag_id, s.segment_id, s.features, min({_d('s.features', 'c.features')}) AS near FROM seg s, seg c WHERE c.bag_id IN (SELECT bag_id FROM {known}) AND s.bag_id NOT IN (SELECT bag_id FROM {known}) GROUP BY ALL"


def _farthest3(known: str) -> str:
    return f"SELECT bag_id FROM (SELECT bag_id, list_sum(list(near ORDER BY near DESC)[:2]) AS score FROM ({_near(known)}) GROUP BY bag_id) ORDER BY round(score, 9) DESC, bag_id LIMIT 1"


def _miff2(known: str) -> str:
    return f"""SELECT bag_id FROM (
  SELECT bag_id, max(b.near) + coalesce(max(least(n.near, {_d("n.features", "b.features")})) FILTER (n.segment_id <> b.segment_id), 0) AS score
  FROM ({_near(known)}) n JOIN (SELECT bag_id, segment_id, features, near FROM ({_near(known)}) QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY near DESC, segment_id DESC) = 1) b USING (bag_id)
  GROUP BY bag_id) ORDER BY round(score, 9) DESC, bag_id DESC LIMIT 1"""


def _sums(known: str) -> str:
    return f"SELECT bag_id FROM (SELECT s.bag_id, sum(sqrt({_d('s.features', 'c.features')})) AS score FROM seg s, seg c WHERE c.bag_id IN (SELECT bag_id FROM {known}) AND s.bag_id NOT IN (SELECT bag_id FROM {known}) GROUP BY s.bag_id) ORDER BY round(score, 9) DESC, bag_id DESC LIMIT 1"


_FIRST = "SELECT min(bag_id) AS bag_id FROM seg"
_CLUSTERS = f"""c AS (SELECT row_number() OVER (ORDER BY bag_id, segment_id) - 1 AS c, features AS f FROM seg ORDER BY bag_id, segment_id LIMIT 10),
near AS MATERIALIZED (SELECT bag_id, segment_id, features, c AS cluster FROM (SELECT bag_id, segment_id, features, c, row_number() OVER (PARTITION BY bag_id, segment_id ORDER BY round({_d("features", "f")}, 9), c) AS r FROM seg CROSS JOIN c) WHERE r = 1),
touch AS MATERIALIZED (SELECT DISTINCT bag_id, cluster FROM near)"""


def _covers(known: str | None) -> str:
    met = f"cluster NOT IN (SELECT cluster FROM touch JOIN {known} USING (bag_id))" if known else "true"
    rest = f"WHERE bag_id NOT IN (SELECT bag_id FROM {known})" if known else ""
    return f"SELECT bag_id FROM (SELECT bag_id, count(*) FILTER ({met}) AS gain FROM touch {rest} GROUP BY bag_id) ORDER BY gain DESC, bag_id LIMIT 1"


_APART = f"""least AS (SELECT a.cluster AS a, b.cluster AS b, a.bag_id, a.segment_id, min(sqrt({_d("a.features", "b.features")})) AS m FROM near a, near b GROUP BY ALL),
one AS (SELECT a, b, sum(m) AS s, count(*) AS n FROM least GROUP BY ALL),
apart AS MATERIALIZED (SELECT x.a, x.b, CASE WHEN x.a = x.b THEN 0 ELSE (x.s + y.s) / (x.n + y.n) END AS d FROM one x JOIN one y ON x.a = y.b AND x.b = y.a)"""


def _reach(known: str | None) -> str:
    own = "SELECT bag_id, cluster FROM touch" + (f" WHERE bag_id NOT IN (SELECT bag_id FROM {known}) UNION SELECT t.bag_id, k.cluster FROM (SELECT DISTINCT bag_id FROM touch WHERE bag_id NOT IN (SELECT bag_id FROM {known})) t, (SELECT DISTINCT cluster FROM touch JOIN {known} USING (bag_id)) k" if known else "")
    return f"SELECT bag_id FROM (SELECT x.bag_id, sum(d) / 2 AS score FROM ({own}) x JOIN ({own}) y USING (bag_id) JOIN apart ON a = x.cluster AND b = y.cluster GROUP BY x.bag_id) ORDER BY round(score, 9) DESC, bag_id DESC LIMIT 1"


def _experiment(spark, sf_dir):
    seg = views.segments(spark, sf_dir)
    return selection.Experiment(views.bags(spark, sf_dir), seg, B.nearest(seg, B.first_by_key(seg, 10, ["bag_id", "segment_id"]), digits=9).select("bag_id", "segment_id", "cluster"))


def _picked(spark, sf_dir, method, n):
    picks = selection.METHODS[method](_experiment(spark, sf_dir), n)
    return spark.createDataFrame([(i, p) for i, p in enumerate(picks, 1)], "place int, bag_id bigint")  # a row for each pick


@query("farthest_bag_picks", f"WITH {views.SEGMENTS}, {_unrolled(5, _FIRST, _farthest3)}")
def farthest_bag_picks(spark, sf_dir):
    """Bags by the sum of their two largest distances to covered instances."""
    return _picked(spark, sf_dir, "farthest3", 5)


@query("miff_picks", f"WITH {views.SEGMENTS}, {_unrolled(5, _FIRST, _miff2)}")
def miff_picks(spark, sf_dir):
    """Multi-instance farthest first: two distances to a bag, the first taken instance covering the second."""
    return _picked(spark, sf_dir, "MIFFk2", 5)


@query("instance_coverage_picks", f"WITH {views.SEGMENTS}, {_unrolled(4, _FIRST, _sums)}")
def instance_coverage_picks(spark, sf_dir):
    return _picked(spark, sf_dir, "instance_coverage", 4)


@query("cluster_coverage_picks", f"WITH {views.SEGMENTS}, {_CLUSTERS}, {_unrolled(6, _covers(None), _covers)}")
def cluster_coverage_picks(spark, sf_dir):
    """Bags that touch most clusters not yet covered."""
    return _picked(spark, sf_dir, "cluster_coverage", 6)


@query("generalized_coverage_picks", f"WITH {views.SEGMENTS}, {_CLUSTERS}, {_APART}, {_unrolled(4, _reach(None), _reach)}")
def generalized_coverage_picks(spark, sf_dir):
    """Bags whose clusters add most distance between covered clusters."""
    return _picked(spark, sf_dir, "generalized_coverage", 4)


@query("discovery_selections")
def discovery_selections(spark, sf_dir):
    """The first picks of every method on one experiment."""
    e, out = _experiment(spark, sf_dir), []
    for name, f in selection.METHODS.items():
        if name != "cluster_centers":  # makes clusters of its own
            out += [(name, i, p) for i, p in enumerate(f(e, 3), 1)]
    return spark.createDataFrame(out, "method string, place int, bag_id bigint")  # a row for each pick


@query("discovery_experiment")
def discovery_experiment(spark, sf_dir):
    """Mean discovery curves of several methods over repeated subsamples."""
    names = ["random", "coverage_oracle", "cluster_centers", "MIFF"]
    return selection.averaged(selection.experiment(views.bags(spark, sf_dir), views.segments(spark, sf_dir), names, 4, 2))


@query("nearest_bags", f"WITH {views.SEGMENTS}, pd AS (SELECT a.bag_id AS a, b.bag_id AS b, a.segment_id AS i, b.segment_id AS j, sqrt({_d('a.features', 'b.features')}) AS d FROM seg a JOIN seg b ON a.bag_id <> b.bag_id), m AS (SELECT a, b, min(d) AS m FROM pd GROUP BY a, b, i UNION ALL SELECT a, b, min(d) FROM pd GROUP BY a, b, j), h AS (SELECT a, b, round(sum(m) / count(*), 9) AS d FROM m GROUP BY a, b) SELECT a, b, round(d, 6) AS distance FROM h QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1")
def nearest_bags(spark, sf_dir):
    """Every bag's nearest other one; pairs that pivots rule out aren't made."""
    return B.nearest_bags(views.segments(spark, sf_dir)).select("a", "b", F.round("distance", 6).alias("distance"))


@query("kmeans_parallel")
def kmeans_parallel(spark, sf_dir):
    """All segments with the nearest of twenty seeds drawn by oversampling."""
    seg, key = views.segments(spark, sf_dir), ["bag_id", "segment_id"]
    return B.nearest(seg, B.parallel_seeds(seg, 20, key)).select(*key, "cluster", F.round("distance", 6).alias("distance"))
