"""Time and site analyses of recordings, and selection over time.

``recordings(site, ts, …)``: hours, days and sites are dense where a report needs
every one of them, by a left join from a short generated calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators.bags import running_total
from murmura.sources import text

#: Codes that are no species, in label reports.
SKIPPED_CODES = ("UNWA", "UNTH", "UNKN", *(f"UNKN{i}" for i in range(1, 38)))


def hours(spark) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def per_hour(df: DataFrame, ts: str = "ts", value: Column | None = None) -> DataFrame:
    """(hour, n) for all 24 hours."""
    n = df.groupBy(F.hour(ts).alias("hour")).agg(F.sum(value if value is not None else F.lit(1)).alias("n"))
    return hours(df.sparkSession).join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def per_hour_by_cluster(df: DataFrame, clusters: DataFrame, ts: str = "ts", cluster: str = "cluster") -> DataFrame:
    """(cluster, hour, n) for every cluster and hour. ``clusters``: the short list of them."""
    n = df.groupBy(cluster, F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    grid = clusters.select(cluster).crossJoin(hours(df.sparkSession))
    return grid.join(n, [cluster, "hour"], "left").select(cluster, "hour", F.coalesce("n", F.lit(0)).alias("n"))


def per_day_by_site(df: DataFrame, sites: DataFrame, first_day: str, days: int, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """(site, …, day, n): counts by day offset from ``first_day``, for every site and day."""
    keys = ["site", *(by or [])]
    day = F.datediff(F.to_date(ts), F.to_date(F.lit(first_day)))
    n = df.withColumn("day", day).filter((F.col("day") >= 0) & (F.col("day") < days)).groupBy(*keys, "day").agg(F.count("*").alias("n"))
    grid = sites.select(*keys).distinct().crossJoin(df.sparkSession.range(days).select(F.col("id").cast("int").alias("day")))
    return grid.join(n, [*keys, "day"], "left").select(*keys, "day", F.coalesce("n", F.lit(0)).alias("n"))


def coverage_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(kind, key, n): recordings by hour, by date (m/d/yy) and by site, in one pass."""
    h, d, s = F.hour(ts).cast("string"), F.date_format(ts, "M/d/yy"), F.col("site").cast("string")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("hour", h), ("date", d), ("site", s))))
    return df.select(F.explode(kinds).alias("e")).groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def stamps(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct (site, month, day, hour)."""
    return df.select("site", F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour")).distinct()


def presence(df: DataFrame, sites: DataFrame, days: DataFrame, ts: str = "ts") -> DataFrame:
    """(site, date, hour, present) for every site, date and hour."""
    have = df.select("site", F.to_date(ts).alias("date"), F.hour(ts).alias("hour")).distinct().withColumn("present", F.lit(True))
    grid = sites.select("site").crossJoin(days.select("date")).crossJoin(hours(df.sparkSession))
    return grid.join(have, ["site", "date", "hour"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def dawn(df: DataFrame, ts: str = "ts", first: int = 5, last: int = 8) -> DataFrame:
    """Recordings of the hours ``first`` to ``last``, both included."""
    return df.filter(F.hour(ts).between(first, last))


def without_rain(df: DataFrame, threshold: float, probability: str = "rain_probability") -> DataFrame:
    return df.filter(F.col(probability) < threshold)


def rain_ranking(df: DataFrame, probability: str = "rain_probability", name: str = "filename") -> DataFrame:
    return df.orderBy(F.desc(probability), F.desc(name))


def _shuffled(key: list[str], seed: int) -> Column:
    """Digits that stand in no order of the key: an MD5 of key and seed."""
    return F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in key), F.lit(str(seed))))


def random_rows(df: DataFrame, k: int, key: list[str], seed: int = 0) -> DataFrame:
    """``k`` rows in an order that a hash of key and seed gives: random, and the same in every run."""
    return df.orderBy(_shuffled(key, seed), *key).limit(k)


def halves(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """The input with ``half`` 0 or 1: by the parity of a hash of the key, so about equal and without a sort."""
    return df.withColumn("half", (F.instr(F.lit("13579bdf"), F.right(_shuffled(key, seed), F.lit(1))) > 0).cast("int"))


def training_examples(bags: DataFrame, test: Column, n: int = 20, seed: int = 0) -> DataFrame:
    """``n`` bags of the training half to mark by hand, in an order that a hash gives."""
    return random_rows(bags.filter(~test), n, ["bag_id"], seed)


def reordered(order: DataFrame, labels: DataFrame, key: str = "filename") -> DataFrame:
    """``order`` (place, key) with each key's labels, null where there are none."""
    return order.join(labels, key, "left").orderBy("place")


def discovery_curve(df: DataFrame, order: list[str], labels: str = "labels") -> DataFrame:
    """(…, n_known): distinct labels seen up to and including each row; rows without a label count.

    Each label counts at its first row, so the running sum is over one number a row; it
    is made range by range, so no task sorts all rows.
    """
    first = df.select(F.explode(labels).alias("label"), F.struct(*order).alias("at")).groupBy("label").agg(F.min("at").alias("at"))
    new = first.groupBy("at").agg(F.count("*").alias("new"))
    out = df.withColumn("at", F.struct(*order)).join(new, "at", "left")
    return running_total(out, order, F.coalesce("new", F.lit(0)), "n_known").drop("at", "new")


def code_counts(selections: DataFrame, codes: str = "codes", skipped: tuple[str, ...] = SKIPPED_CODES) -> DataFrame:
    """(code, n) without the skipped codes."""
    return selections.select(F.explode(codes).alias("code")).filter(~F.col("code").isin(*skipped)).groupBy("code").agg(F.count("*").alias("n"))


# -- competition files


def hidden_labels(bags: DataFrame, test: Column, labels: str = "labels") -> DataFrame:
    """(bag_id, labels): as text, ``?`` for test bags."""
    return bags.select("bag_id", F.when(test, F.lit("?")).otherwise(F.array_join(labels, ",")).alias("labels"))


def solution(bags: DataFrame, num_classes: int, public: Column, labels: str = "labels") -> DataFrame:
    """(rec_id, species, probability, usage): 1 for a label and 0 else, for every bag and class."""
    wide = bags.select("bag_id", labels, F.when(public, "PublicTest").otherwise("PrivateTest").alias("usage"), F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))).alias("species"))
    return wide.select(F.col("bag_id").alias("rec_id"), "species", F.array_contains(labels, F.col("species")).cast("int").alias("probability"), "usage")


def write_competition(path: str, bags: DataFrame, num_classes: int, test: Column, public: Column, scored: DataFrame | None = None) -> None:
    """The files of a competition, as folders of ``path``: solution and sample submission of the test bags, labels with those hidden, the two folds, and a baseline's scores."""
    own = bags.withColumn("test_", test)
    tested = own.filter("test_").drop("test_")
    order = ["rec_id", "species"]
    text.write_table(solution(tested, num_classes, public), f"{path}/solution", order, "rec_id,species,probability,Usage")
    text.write_table(sample_submission(tested, num_classes).withColumnRenamed("rec_id", "bag_id"), f"{path}/sample_submission", ["bag_id", "species"], "bag_id,species,probability")
    text.write_table(hidden_labels(own, F.col("test_")), f"{path}/bag_labels_test_hidden", ["bag_id"], text.HEADERS["bag_labels"])
    text.write_table(own.select("bag_id", F.col("test_").cast("int").alias("fold")), f"{path}/folds", ["bag_id"], text.HEADERS["folds"])
    if scored is not None:
        text.write_table(long_scores(scored), f"{path}/baseline", order, "rec_id,species,probability")


def sample_submission(bags: DataFrame, num_classes: int) -> DataFrame:
    return bags.select(F.col("bag_id").alias("rec_id"), F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))).alias("species"), F.lit(0).alias("probability"))


def long_scores(scored: DataFrame, scores: str = "scores", key: str = "bag_id") -> DataFrame:
    """(rec_id, species, probability) of score arrays."""
    return scored.select(F.col(key).alias("rec_id"), F.posexplode(scores).alias("species", "probability"))


# -- reports


def html_bars(counts: DataFrame, label: str, value: str, title: str, most: int = 1000) -> str:
    """A page of bars of a short report table: more than ``most`` rows are refused."""
    rows = counts.select(label, value).orderBy(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    from html import escape

    top = max((r[1] for r in rows), default=0) or 1
    bars = "".join(f'<tr><td>{escape(str(r[0]))}</td><td><div style="background:#468;height:12px;width:{400 * r[1] / top:.0f}px"></div></td><td>{r[1]}</td></tr>' for r in rows)
    return f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{bars}</table></body></html>"


def html_presence(presence: DataFrame, title: str, most: int = 100_000) -> str:
    """A page with a row for each site and date and a cell for each hour, filled where there is a recording. More than ``most`` rows and hours are refused."""
    days = presence.groupBy("site", "date").agg(F.array_sort(F.collect_list(F.when(F.col("present"), F.col("hour")))).alias("hours")).orderBy("site", "date").limit(most // 24 + 1).collect()  # 24 to a day
    if len(days) > most // 24:
        raise ValueError(f"a report of more than {most} cells")
    from html import escape

    cell = lambda on: f'<td style="width:10px;background:{"#468" if on else "#eee"}"></td>'
    rows = "".join(f"<tr><td>{escape(str(r.site))}</td><td>{r.date}</td>{''.join(cell(h in set(r.hours)) for h in range(24))}</tr>" for r in days)
    head = "".join(f"<th>{h}</th>" for h in range(24))
    return f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr><th>site</th><th>date</th>{head}</tr>{rows}</table></body></html>"


def unpivoted(wide: DataFrame, key: str = "class") -> DataFrame:
    return wide.unpivot([key], [c for c in wide.columns if c != key], "method", "count")
