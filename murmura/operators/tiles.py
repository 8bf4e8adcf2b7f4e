"""All pairs of blocks of rows, each pair in one task.

Blocks are dealt to groups, and a task takes a tile: two groups, or one with itself.
So a block is shuffled once for each group, a task holds two groups at most, and
there are as many tasks as pairs of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows to a group, about, and how many groups there are at least (where there are as many blocks).
GROUP, GROUPS = 49_152, 8


def paired(blocks: DataFrame, rows: int, number: int, f: Callable[[list[tuple[dict, dict]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``f`` makes of the pairs of blocks of each tile: every pair once, and every block with itself.

    ``blocks``: a column ``block`` from 0 to ``number`` - 1 and others, one row to a block; ``rows``: how many rows they hold in all.
    """
    groups = max(1, min(number, max(GROUPS, -(-rows // GROUP))))
    own = F.pmod("block", F.lit(groups))
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    low, high = F.least("own_", "other_"), F.greatest("own_", "other_")
    tile = (low * groups - (low * (low - 1) / 2).cast("int") + high - low).cast("int")
    dealt = blocks.withColumn("own_", own.cast("int")).withColumn("other_", other).withColumn("tile_", tile).drop("other_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}  # the blocks of two groups
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["own_"], []).append(r)
        if len(held) == 2:
            one, two = held.values()
            yield from f([(x, y) for x in one for y in two])
        elif held:
            (one,) = held.values()
            yield from f([(x, y) for i, x in enumerate(one) for y in one[i:]] if next(iter(one))["tile_"] in diagonal else [])

    diagonal = {g * groups - g * (g - 1) // 2 for g in range(groups)}
    return dealt.repartitionById(groups * (groups + 1) // 2, "tile_").mapInArrow(run, schema)
