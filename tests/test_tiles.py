"""Tiles of pairs of blocks."""

from collections import Counter

import pyarrow as pa
import pytest

from murmura.operators import tiles


@pytest.mark.parametrize("number, rows", [(1, 5), (3, 9), (11, 40), (11, 10_000_000)])
def test_every_pair_once(spark, monkeypatch, number, rows):
    monkeypatch.setattr(tiles, "GROUPS", 4)
    monkeypatch.setattr(tiles, "GROUP", 1_500_000)
    blocks = spark.range(number).select(tiles.F.col("id").cast("int").alias("block"))

    def pairs(met):
        yield pa.RecordBatch.from_pydict({"a": pa.array([x["block"] for x, _ in met], pa.int32()), "b": pa.array([y["block"] for _, y in met], pa.int32())})

    got = Counter(tuple(sorted(r)) for r in tiles.paired(blocks, rows, number, pairs, "a int, b int").collect())
    assert got == {(i, j): 1 for i in range(number) for j in range(i, number)}


def test_nearest_bags_across_blocks(spark, monkeypatch):
    """Spread-out bags of many sizes, some of them copies, in blocks of a few instances: equal to brute force."""
    import numpy as np

    from murmura.operators import bags as B

    monkeypatch.setattr(B, "BLOCK", 7)
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(rng.integers(1, 12), 16)) for _ in range(30)]
    bags += [bags[4], bags[4], bags[9] + 1e-7]
    df = spark.createDataFrame([(i, s, v.tolist()) for i, b in enumerate(bags) for s, v in enumerate(b)], "bag_id bigint, segment_id int, features array<double>")
    got = {r.a: r for r in B.nearest_bags(df).collect()}

    def h(a, b):
        d = np.sqrt(np.square(a[:, None] - b[None]).sum(2))
        return (d.min(1).sum() + d.min(0).sum()) / sum(d.shape)

    for i, b in enumerate(bags):
        d = min((round(h(b, o), 9), j) for j, o in enumerate(bags) if j != i)
        assert (got[i].b, got[i].distance) == (d[1], pytest.approx(d[0], abs=2e-9))
