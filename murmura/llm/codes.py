"""Vector codes: each part of a vector becomes the index of its codebook's nearest entry.

Components become integers, so that all sums and distances are exact and results
don't depend on how rows are dealt to tasks. The nearest entry is found by annular
norm pruning: entries lie sorted by norm; those next to a part in norm give a
first distance d; an entry whose norm differs by more than d can't be nearer, so two
binary searches cut the annulus of those that can, bounds included, and only these
are compared exactly.

Each round is one pass over the vectors. A task hands on sums and counts for each
entry, so that what is shuffled and what reaches the driver is of the codebooks' size
and not of the table's. The last pass writes codes; errors are then summed by label and
joined back, by broadcast where the labels are few and small, else over salted keys.

Defined results: rows whose vector is null or holds a null or non-finite component are
dropped; so are vectors of another length than the commonest (ties: the longest), which
have no parts to compare; a length that isn't a multiple of the number of parts is cut
as evenly as possible; with fewer rows than entries the codebooks are as small as the
table; rows that repeat an id count each, null ids come last, ties among seeds go to the
lesser vector; components too large for exact 64-bit sums (over 2**19 at 64 dimensions)
saturate, as does an error sum; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from murmura.llm.common import parts as sliced
from murmura.session import scratch_dir

#: Rows that a worker compares at a time.
ROWS = 2048
#: Entries on either side of a part, in order of norm, that give its first distance.
NEXT = 4
#: Labels and bytes of labels up to which their sums are broadcast.
MAX_LABELS, MAX_LABEL_BYTES = 100_000, 16 << 20
SALTS = 64
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


class Codebook:
    """The entries of one part, with an index by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        squares = (entries * entries).sum(1)
        self.order = np.argsort(squares, kind="stable")
        self.by_norm = entries[self.order]
        self.norms = np.sqrt(squares[self.order].astype(float))

    def annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to which place in order of norm the entries lie that may be nearest."""
        norm = np.sqrt((x * x).sum(1).astype(float))
        at = np.searchsorted(self.norms, norm)
        around = np.clip(at[:, None] + np.arange(-NEXT, NEXT), 0, len(self.norms) - 1)
        best = ((x[:, None] - self.by_norm[around]) ** 2).sum(2).min(1)
        reach = np.sqrt(best.astype(float))
        reach += 1e-9 * (reach + norm) + 1e-6  # bounds are inclusive, rounding included
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and exact squared distance of the nearest entry, ties to the lower index."""
        low, high = self.annulus(x)
        width = high - low
        starts = np.cumsum(width) - width
        row = np.repeat(np.arange(len(x)), width)
        place = np.arange(len(row)) - np.repeat(starts - low, width)
        distance = ((x[row] - self.by_norm[place]) ** 2).sum(1)
        least = np.minimum.reduceat(distance, starts)
        index = np.where(distance == least[row], self.order[place], len(self.order))
        return np.minimum.reduceat(index, starts), least


class Codebooks:
    """One codebook for each part of vectors of ``dimensions`` components."""

    def __init__(self, entries: list[np.ndarray], dimensions: int, scale: int):
        self.books, self.dimensions, self.scale = [Codebook(e) for e in entries], dimensions, scale

    @property
    def limit(self) -> int:
        """The largest component whose squared distances can be summed up in 64 bits."""
        return isqrt((1 << 62) // max(self.dimensions, 1)) // 2

    def bounds(self) -> list[tuple[int, int]]:
        n, d = len(self.books), self.dimensions
        return [(i * d // n, (i + 1) * d // n) for i in range(n)]

    def whole(self, values: np.ndarray) -> np.ndarray:
        """Integer components of float vectors."""
        return np.clip(np.floor(values * float(self.scale)), -self.limit, self.limit).astype(np.int64)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for e in b.entries.tolist() for v in e).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        return [v / self.scale for b, i in zip(self.books, bytes.fromhex(code), strict=True) for v in b.entries[i].tolist()]

    def moved(self, sums: dict[tuple[int, int], int]) -> Codebooks:
        """Entries replaced by the floor of their parts' means; sums by (slot, position), position -1 for the count."""
        new = []
        for i, b in enumerate(self.books):
            entries = b.entries.copy()
            for j in range(len(entries)):
                slot = i * len(entries) + j
                if n := sums.get((slot, -1), 0):
                    entries[j] = [sums.get((slot, k), 0) // n for k in range(entries.shape[1])]
            new.append(entries)
        return Codebooks(new, self.dimensions, self.scale)


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity


def _kept(df: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), vector.alias("vector"), *others).filter(F.col("vector").isNotNull() & _finite(F.col("vector")))


def _values(vectors: pa.Array, dimensions: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dimensions)


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> Codebooks | None:  # noqa: B008
    """Codebooks from all vectors; None where none is fit for use."""
    kept = _kept(df, id_col, vector_col)
    sizes = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    same = kept.filter(F.size("vector") == sizes["size"])
    first = same.orderBy(F.asc_nulls_last("id"), "vector").limit(settings.entries).select("vector").collect()  # a codebook's size
    books = Codebooks([np.empty((0, 0), np.int64)] * settings.parts, sizes["size"], settings.scale)
    seeds = books.whole(np.array([r.vector for r in first], float).reshape(len(first), sizes["size"]))
    books = Codebooks([seeds[:, a:b] for a, b in books.bounds()], sizes["size"], settings.scale)
    for _ in range(settings.rounds):
        sums = same.select("vector").mapInArrow(_summed(books), "slot int, position int, total bigint").groupBy("slot", "position").agg(F.sum("total").alias("total"))
        books = books.moved({(r.slot, r.position): r.total for r in sums.collect()})  # of the codebooks' size
    return books


def _summed(books: Codebooks):
    """A task's sums of parts by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books.books[0].entries)
        totals = [np.zeros((k, b - a + 1), np.int64) for a, b in books.bounds()]
        for batch in sliced(batches, ROWS):
            x = books.whole(_values(batch.column(0), books.dimensions))
            for total, book, (a, b) in zip(totals, books.books, books.bounds(), strict=True):
                index, _ = book.nearest(x[:, a:b])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    total[used, 0] += np.diff(np.append(starts, len(order)))
                    total[used, 1:] += np.add.reduceat(x[order, a:b], starts, axis=0)
        for i, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            slots = np.repeat(i * k + used, total.shape[1])
            positions = np.tile(np.arange(-1, total.shape[1] - 1), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(positions, pa.int32()), pa.array(total[used].ravel(), pa.int64())], names=["slot", "position", "total"])

    return run


def encode(df: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", *others: Column) -> DataFrame:
    """(id, *others, code, error): each vector's code and its squared distance from what the code stands for."""
    kept = _kept(df, id_col, vector_col, *others).filter(F.size("vector") == books.dimensions)
    names = [c for c in kept.columns if c != "vector"]
    kept = kept.select(*names, "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            x = books.whole(_values(batch.column(len(names)), books.dimensions))
            codes, errors = np.empty((len(x), len(books.books)), np.uint8), np.zeros(len(x), np.int64)
            for i, (book, (a, b)) in enumerate(zip(books.books, books.bounds(), strict=True)):
                index, distance = book.nearest(x[:, a:b])
                codes[:, i] = index
                errors += distance
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    schema = StructType([kept.schema[c] for c in names])
    return kept.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]).add("code", "string").add("error", "long"))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(id, label, code, error, label_error, codebooks_sha256) for each vector fit for use."""
    if settings.entries > 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    spark = df.sparkSession
    books = fit(df, id_col, vector_col, settings)
    if books is None:
        empty = df.limit(0).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        return empty.select("*", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    path = scratch_dir(spark, "codes")
    encode(df, books, id_col, vector_col, F.col(label_col).alias("label")).write.parquet(f"{path}/codes")
    codes = spark.read.parquet(f"{path}/codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    codes.groupBy("label").agg(total.alias("label_error")).write.parquet(f"{path}/labels")
    sums = spark.read.parquet(f"{path}/labels").withColumnRenamed("label", "of")
    n, size = sums.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("of").cast("string"))), F.lit(0))).first()
    if n <= MAX_LABELS and size <= MAX_LABEL_BYTES:
        joined = codes.join(F.broadcast(sums), codes["label"].eqNullSafe(sums["of"]))
    else:
        salted = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        spread = sums.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, salted["label"].eqNullSafe(spread["of"]) & (salted["salt"] == spread["at"]))
    return joined.select("id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
