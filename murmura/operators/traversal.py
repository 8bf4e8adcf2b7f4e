"""Greedy selections over distances: farthest-first traversals and coverage.

One pick is one pass: a running column (minimum or sum of distances to the picks so
far) is compared with the picks that it doesn't know yet, ``CUT_EVERY`` at most, and the
best row found by aggregation. Then the column is brought up to date and written, without
the rows picked. Only the picked rows come to the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators.bags import compared
from murmura.session import cut

#: Picks between checkpoints.
CUT_EVERY = 16


def _traverse(df: DataFrame, k: int, key: list[str], features: str, total: bool, digits: int | None) -> list:
    rows = df.select(*key, F.col(features).cast("array<double>").alias("features")).withColumn("near", F.lit(0.0 if total else float("inf")))
    first = rows.agg(F.min(F.struct(*key, "features")).alias("s")).first().s
    picks = [first] if first else []
    pending = list(picks)  # those that the column near doesn't know yet
    update = (lambda near, d, *_: near + np.sqrt(d).sum(1)) if total else (lambda near, d, *_: np.minimum(near, d.min(1)))
    while picks and len(picks) < k:
        met = compared(rows, [list(p.features) for p in pending], update)
        for p in pending:
            met = met.filter(~reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(p[c])) for c in key)))
        if len(pending) == CUT_EVERY:
            rows, pending = cut(met), []
            met = rows
        score = F.round("near", digits) if digits is not None else F.col("near")
        found = met.agg(F.min(F.struct((-score).alias("n"), *key, "features")).alias("s")).first().s
        if found is None:
            break
        picks.append(found)
        pending.append(found)
    return picks


def farthest_first(df: DataFrame, k: int, key: list[str], features: str = "features", digits: int | None = None) -> list:
    """Keys in order: the smallest key first, then always the row whose nearest pick is farthest; ties go to the smallest key."""
    return [tuple(p[c] for c in key) for p in _traverse(df, k, key, features, False, digits)]


def farthest_average(df: DataFrame, k: int, key: list[str], features: str = "features", digits: int | None = None) -> list:
    """As ``farthest_first``, by the largest mean distance (not squared) to the picks."""
    return [tuple(p[c] for c in key) for p in _traverse(df, k, key, features, True, digits)]


def greedy_coverage(bags: DataFrame, k: int, key: str = "bag_id", sets: str = "labels") -> list:
    """Bag keys in order: always the one that adds most to the union of sets so far; ties go to the smallest key.

    The union is bounded by the number of classes and travels as a literal.
    """
    picks: list = []
    known: list = []
    kind = bags.schema[sets].dataType
    rows = bags.select(key, sets)
    while len(picks) < k:
        gain = F.size(F.array_except(sets, F.lit(known).cast(kind) if known else F.array().cast(kind)))
        left = rows.filter(~F.col(key).isin(picks)) if picks else rows
        found = left.agg(F.min(F.struct((-gain).alias("n"), key, sets)).alias("s")).first().s
        if found is None:
            break
        picks.append(found[key])
        known = sorted({*known, *(found[sets] or [])})
    return picks
