"""Queries against their SQL on tables that the plain ones don't look like: bags cut short, copies, wide values."""

import duckdb
import numpy as np
import pytest

from compare import assert_same
from murmura.plans import registry


def check(spark, tmp_path, name, vectors, size=5):
    """A query on these vectors, numbered from 0, and its SQL."""
    spark.createDataFrame([(i, [float(x) for x in v], i % 10) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert_same(registry.queries()[name](spark, str(tmp_path)), c.sql(registry.oracle_sql()[name]))


def vectors(n, seed=0, spread=0.15):
    return np.random.default_rng(seed).normal(size=(n, 64)).astype(np.float32) * np.float32(spread)


@pytest.mark.parametrize("n", [11, 13])
def test_chunks_of_a_recording_cut_short(spark, tmp_path, n):
    check(spark, tmp_path, "recording_chunks", vectors(n))


@pytest.mark.parametrize("n", [11, 12])
def test_profiles_of_a_single_column(spark, tmp_path, n):
    """An image of one column has no moments along it: NaN on both sides."""
    check(spark, tmp_path, "profile_features", vectors(n))


@pytest.mark.parametrize("n", [12, 13])
def test_cepstra_of_loud_samples(spark, tmp_path, n):
    """Samples are cut to 16 bits before frames are made of them."""
    check(spark, tmp_path, "cepstra", vectors(n, spread=1.5))
