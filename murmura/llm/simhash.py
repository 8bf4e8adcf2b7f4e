"""Near duplicates by SimHash fingerprints: exact comparison of tiles.

1. One pass makes a fingerprint of each text; rows with equal fingerprints are one
   node, named by its smallest id.
2. Nodes are ordered by the population counts of the four quarters of their
   fingerprint and cut into tiles: a tile holds nodes whose first two counts are equal
   and whose last two lie in a small range. How the counts are spread is a table of at
   most 17**4 rows; a count that many nodes share is split among tiles by hash, so a
   tile holds about ``TILE`` nodes whatever the table's size.
3. Every bit in which two fingerprints differ changes one quarter's count by one, so
   pairs of tiles whose counts differ by more than the radius in all are skipped.
4. The other pairs are compared exactly with numpy: exclusive-or and bit counts of
   one run of equal counts against the ranges that the radius allows. A pair of tiles
   hands on a spanning forest of the links it finds, at most one link for each node,
   so that a group of thousands of near copies makes no list of all its pairs.
5. Connected components of these links, named by smallest ids, come back to the rows.

Comparing all tiles within reach is quadratic in the number of distinct fingerprints,
less what counts rule out: of random pairs some six in a hundred are compared.

Defined results: a null or blank text has fingerprint 0, which links like any other;
fewer words than a shingle has make one shingle; rows that repeat an id are each taken
by their own text; a component's name is its smallest id that isn't null, or null if it
has none; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from murmura.llm.common import parts
from murmura.operators.links import components
from murmura.session import scratch_dir, tidy_shuffles

WIDTH, SEED, RADIUS = 4, 42, 4
TILE = 1 << 14
QUARTERS, SIDE = 4, 17
#: Fingerprint pairs that one numpy step compares, hits that are held before they are merged, and pairs for each task, about.
BLOCK, HITS, TASK = 1 << 18, 1 << 20, 1 << 34
#: Shingles that are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64 bits, each set where more than half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes only A-Z change, and the six blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, CHUNK):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)), "<u8", min(CHUNK, n - i))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, print): each row's fingerprint as a signed integer."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64), pa.int64())], names=["id", "print"])

    return rows.mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), StructField("print", LongType())]))


def _quarter(i: int) -> Column:
    """Population count of a quarter, the highest bits first."""
    return F.bit_count(F.shiftrightunsigned("print", 16 * (QUARTERS - 1 - i)).bitwiseAND(0xFFFF)).cast("int")


def packed(cells: list[tuple[int, int, int, int, int]], tile: int = TILE) -> list[tuple[int, int, int, int, int, int]]:
    """(four counts, first tile, number of tiles) from (four counts, nodes): tiles of about ``tile`` nodes that share the first two counts."""
    out, at, filled, row = [], -1, 0, None
    for *q, n in sorted(cells):
        if q[:2] != row or filled + n > tile:
            at, filled, row = at + 1, 0, q[:2]
        k = -(-n // tile)
        out.append((*q, at, k))
        at, filled = at + k - 1, filled + n
    return out


def _counts(prints: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((prints >> np.uint64(16 * (QUARTERS - 1 - i))) & np.uint64(0xFFFF)) for i in range(QUARTERS)], 1).astype(np.int64)


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j in a forest whose nodes point at their smallest member."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, whose first two counts are each the same throughout."""
    qa, qb = _counts(a), _counts(b)
    ka, kb = qa[:, 2] * SIDE + qa[:, 3], qb[:, 2] * SIDE + qb[:, 3]
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    a, b, ka, kb = a[oa], b[ob], ka[oa], kb[ob]
    left = radius - int(np.abs(qa[0, :2] - qb[0, :2]).sum())
    every, root = np.concatenate([a, b]), np.arange(len(a) + len(b))
    rows, columns, held = [], [], 0
    keys, starts = np.unique(ka, return_index=True)
    for key, start, end in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        c3, c4 = divmod(key, SIDE)
        for e3 in range(max(0, c3 - left), min(SIDE - 1, c3 + left) + 1):
            r = left - abs(e3 - c3)
            low, high = np.searchsorted(kb, e3 * SIDE + max(0, c4 - r)), np.searchsorted(kb, e3 * SIDE + min(SIDE - 1, c4 + r), "right")
            if low == high:
                continue
            step = max(1, BLOCK // int(high - low))
            for s in range(start, end, step):
                i, j = np.nonzero(np.bitwise_count(a[s : min(s + step, end), None] ^ b[None, low:high]) <= radius)
                if len(i):
                    rows.append(i + s)
                    columns.append(j + low + len(a))
                    held += len(i)
                    if held > HITS:
                        _merged(root, np.concatenate(rows), np.concatenate(columns))
                        rows, columns, held = [], [], 0
    if rows:
        _merged(root, np.concatenate(rows), np.concatenate(columns))
    moved = np.flatnonzero(root != np.arange(len(root)))
    u, v = every[moved], every[root[moved]]
    return u[u != v], v[u != v]


def _compared(radius: int):
    def run(rows) -> Iterator[tuple[int, int]]:
        for a, b in rows:
            u, v = tile_links(np.frombuffer(a, np.int64).view(np.uint64), np.frombuffer(b, np.int64).view(np.uint64), radius)
            yield from zip(u.view(np.int64).tolist(), v.view(np.int64).tolist(), strict=True)

    return run


def _joined(prints) -> bytes:
    return np.sort(np.asarray(prints, np.int64)).tobytes()


def links(nodes: DataFrame, path: str, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) links that connect all of ``nodes`` (column ``print``, distinct) within the radius, written under ``path``."""
    spark = nodes.sparkSession
    q = [f"q{i}" for i in range(QUARTERS)]
    counted = nodes.select("print", *(_quarter(i).alias(q[i]) for i in range(QUARTERS)))
    cells = [tuple(r) for r in counted.groupBy(*q).count().collect()]  # at most 17**4 rows
    if not cells:
        return spark.createDataFrame([], "a bigint, b bigint")
    where = F.broadcast(spark.createDataFrame(packed(cells, tile), ", ".join(f"{c} int" for c in [*q, "first", "k"])))
    placed = counted.join(where, q).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("print"), F.col("k")).cast("int"))

    def packs(t: pa.Table) -> pa.Table:
        return pa.table({"tile": t.column("tile")[:1], "prints": pa.array([_joined(t.column("print").to_numpy())], pa.binary())})

    placed.groupBy("tile").agg(F.first("q0").alias("q0"), F.first("q1").alias("q1"), F.min("q2").alias("low2"), F.max("q2").alias("high2"), F.min("q3").alias("low3"), F.max("q3").alias("high3"), F.count("*").alias("n")).write.parquet(f"{path}/boxes")
    placed.select("tile", "print").groupBy("tile").applyInArrow(packs, "tile int, prints binary").write.parquet(f"{path}/tiles")
    boxes, tiles = spark.read.parquet(f"{path}/boxes"), spark.read.parquet(f"{path}/tiles")

    near = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    other = boxes.select(*(F.col(c).alias(f"o_{c}") for c in boxes.columns))
    here = boxes.withColumn("at", F.explode(F.array(*(F.struct((F.col("q0") + x).alias("q0"), (F.col("q1") + y).alias("q1")) for x, y in near))))
    gap = lambda i: F.greatest(F.lit(0), F.col(f"low{i}") - F.col(f"o_high{i}"), F.col(f"o_low{i}") - F.col(f"high{i}"))
    within = (F.abs(F.col("q0") - F.col("o_q0")) + F.abs(F.col("q1") - F.col("o_q1")) + gap(2) + gap(3)) <= radius
    here.join(other, (F.col("at.q0") == F.col("o_q0")) & (F.col("at.q1") == F.col("o_q1"))).filter(within & (F.col("tile") <= F.col("o_tile"))).select(F.col("tile").alias("a"), F.col("o_tile").alias("b"), (F.col("n") * F.col("o_n")).alias("work")).write.parquet(f"{path}/pairs")
    pairs = spark.read.parquet(f"{path}/pairs")
    work = pairs.agg(F.sum("work")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(work // TASK, 100_000))
    first = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("prints").alias("prints_a")), "a")
    both = first.repartition(n, "b").join(tiles.select(F.col("tile").alias("b"), F.col("prints").alias("prints_b")).repartition(n, "b"), "b")
    found = both.select("prints_a", "prints_b").rdd.mapPartitions(_compared(radius))  # pickled by size, not by number of rows
    spark.createDataFrame(found, StructType([StructField("a", LongType()), StructField("b", LongType())]), verifySchema=False).write.parquet(f"{path}/links")
    return spark.read.parquet(f"{path}/links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """(id, print, fingerprint, component_id) for each input row."""
    spark = df.sparkSession
    path = scratch_dir(spark, "simhash")
    with tidy_shuffles(spark):
        fingerprints(df, id_col, text_col, width).write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        rows.groupBy("print").agg(F.min("id").alias("least")).write.parquet(f"{path}/nodes")
        nodes = spark.read.parquet(f"{path}/nodes")
        linked = components(links(nodes.select("print"), path, radius, tile)).withColumnRenamed("node", "print").join(nodes, "print")
        linked.write.parquet(f"{path}/linked")
        linked = spark.read.parquet(f"{path}/linked")
        names = linked.groupBy("component").agg(F.min("least").alias("name"))
        nodes.join(linked.join(names, "component").select("print", "name"), "print", "left").select("print", F.coalesce("name", "least").alias("component_id")).write.parquet(f"{path}/named")
    return rows.join(spark.read.parquet(f"{path}/named"), "print").select("id", "print", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
