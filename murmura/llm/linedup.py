"""Line deduplication across documents with two Bloom filters.

1. Every task hashes the keys of its documents' lines and hands each distinct
   hash to the slice of the key space that it falls in.
2. A slice's task builds a once-seen and a twice-seen Bloom filter: a hash that
   the once-seen filter already has goes into the twice-seen filter.
3. The twice-seen filters, folded to ``MAX_FILTER_BYTES`` in all, are broadcast.
   Only lines that they have are suspects, and only suspects shuffle with their
   text: an exact aggregation by key confirms repeats and picks the first holder.
4. Documents without a suspect line pass straight through. The others are joined
   with the keys that they lose themselves, by a hash of their id and text.

False positives of a filter cost a shuffled row and never a wrong result; a filter
has no false negatives. A hot key is one row for each task in steps 1 and 2 and is
combined before the shuffle in step 3; the join of its suspects with its single
confirmed row is one that adaptive execution can split.

Defined results: a null or empty text is one empty line; keys under ``least_chars``
code points are never dropped; a document keeps all its lines with a key it is the
first to hold, repeats included; rows with the same id count as one document; a
null id counts as one document above all others; ids are integers, or text that casts
to them; further columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.bloom import Bloom, masks, mix
from murmura.llm.common import BLANKS, parts
from murmura.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All twice-seen filters together, as they are broadcast.
MAX_FILTER_BYTES = 64 << 20
#: Lines to a slice, about; it bounds the memory of step 2.
SLICE_LINES = 1 << 20
NO_ID = (1 << 63) - 1
#: Line hashes that a task of step 1 holds before it hands them on.
HELD = 1 << 21


def keys_of(text: str, least_chars: int) -> dict[bytes, None]:
    """The distinct keys of a text's lines that are long enough, as UTF-8.

    Of bytes, lower() changes A-Z alone and strip() takes the six blanks alone.
    """
    out = {}
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip()
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
            out[key] = None
    return out


def key_of(line: str, table: dict[int, int] = str.maketrans(UPPER, LOWER)) -> str:  # noqa: B006
    return line.strip(BLANKS).translate(table)


def hashes_of(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def _slices(mixed: np.ndarray, n: int) -> np.ndarray:
    return ((mixed >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _partials(n_slices: int, least_chars: int):
    """Step 1 on (ord, text) rows: the distinct hashes of a task, and those it saw in two documents, by slice."""

    def handed(docs: list, hashes: list) -> Iterator[pa.RecordBatch]:
        pairs = np.empty((sum(map(len, docs)),), dtype=[("h", np.uint64), ("d", np.int64)])
        pairs["h"], pairs["d"] = mix(np.concatenate(hashes)), np.concatenate(docs)
        pairs = np.unique(pairs)
        h, first, count = np.unique(pairs["h"], return_index=True, return_counts=True)
        for twice, keys in ((False, h), (True, h[count > 1])):
            s = _slices(keys, n_slices)
            order = np.argsort(s, kind="stable")
            keys, s = keys[order], s[order]
            found, starts = np.unique(s, return_index=True)
            ends = np.append(starts[1:], len(keys))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([twice] * len(found), pa.bool_()), pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["slice", "twice", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, hashes, held = [], [], 0
        for b in parts(batches):
            for ord_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = hashes_of(keys_of(text, least_chars))
                docs.append(np.full(len(h), ord_, np.int64))
                hashes.append(h)
                held += len(h)
            if held >= HELD:
                yield from handed(docs, hashes)
                docs, hashes, held = [], [], 0
        if held:
            yield from handed(docs, hashes)

    return run


def _filters(most_words: int):
    """Step 2: a slice's twice-seen filter from the partials of all tasks."""

    def run(t: pa.Table) -> pa.Table:
        given = t.column("keys").to_pylist()
        once = Bloom.sized(sum(len(p) // 8 for p in given))
        twice = Bloom(np.zeros_like(once.words))
        for p, seen in zip(given, t.column("twice").to_pylist(), strict=True):
            keys = np.frombuffer(p, np.uint64)
            if seen:
                twice.add(keys)
            else:
                twice.add(keys[once.has(keys)])
                once.add(keys)
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int64()), "words": pa.array([twice.folded(most_words).words.tobytes()], pa.binary())})

    return run


class Suspects:
    """The broadcast filters as one array."""

    def __init__(self, n_slices: int, found: dict[int, bytes]):
        self.n = n_slices
        sizes = np.array([len(found.get(i, b"")) // 8 for i in range(n_slices)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.sizes = sizes
        self.words = np.concatenate([np.frombuffer(found.get(i, b""), np.uint64) for i in range(n_slices)])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mixed = mix(hashes)
        s = _slices(mixed, self.n)
        size = self.sizes[s]
        at = self.starts[s] + (mixed & (np.maximum(size, 1) - 1).astype(np.uint64)).astype(np.int64)
        m = masks(mixed)
        out = np.zeros(len(mixed), bool)
        ok = size > 0
        out[ok] = (self.words[at[ok]] & m[ok]) == m[ok]
        return out


def build_filters(docs: DataFrame, n_lines: int, least_chars: int) -> Suspects:
    """Steps 1 to 3 on (ord, text) rows."""
    n = max(1, -(-n_lines // SLICE_LINES))
    found = (
        docs.mapInArrow(_partials(n, least_chars), "slice bigint, twice boolean, keys binary")
        .groupBy("slice")
        .applyInArrow(_filters(max(1, MAX_FILTER_BYTES // 8 // n)), "slice bigint, words binary")
    )
    return Suspects(n, {r.slice: bytes(r.words) for r in found.collect()})


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10) -> DataFrame:
    """One row per input row: ``row`` (the input row as a struct), ``kept`` (its remaining text), ``n_lines`` and ``n_dropped``."""
    spark = df.sparkSession
    docs = df.select(F.struct("*").alias("row"), F.coalesce(df[id_col].cast("bigint"), F.lit(NO_ID)).alias("ord"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    docs = docs.withColumn("node", F.xxhash64("ord", "text"))  # tells rows apart that share an id or have none
    text = docs.select("ord", "text")
    n_lines = docs.agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    shared = spark.sparkContext.broadcast(build_filters(text, n_lines, least_chars))  # at most MAX_FILTER_BYTES

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ids, nodes, keys = [], [], []
            for ord_, node, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = keys_of(t, least_chars)
                ids += [ord_] * len(own)
                nodes += [node] * len(own)
                keys += own
            hit = pa.array(shared.value.has(hashes_of(keys)), pa.bool_())
            found = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], names=["ord", "node", "key"])
            yield found.filter(hit)

    path = scratch_dir(spark, "lines")
    docs.select("ord", "node", "text").mapInArrow(suspect, "ord bigint, node bigint, key binary").write.parquet(f"{path}/suspects")
    suspects = spark.read.parquet(f"{path}/suspects")
    suspects.groupBy("key").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").write.parquet(f"{path}/repeats")
    repeats = spark.read.parquet(f"{path}/repeats")  # written, so that the join's sides are plain shuffles and a hot key can be split
    losses = suspects.join(repeats, "key").filter("ord > first").groupBy("ord", "node").agg(F.collect_set("key").alias("drop"))

    @F.pandas_udf("boolean")
    def suspicious(texts):
        keys = [keys_of(t, least_chars) for t in texts]
        hit = shared.value.has(hashes_of([k for own in keys for k in own]))
        ends = np.cumsum([len(own) for own in keys])
        return pd.Series([bool(hit[e - len(own) : e].any()) for own, e in zip(keys, ends, strict=True)], dtype=bool)

    flagged = docs.withColumn("suspicious", suspicious("text"))
    clear = flagged.filter("NOT suspicious").select("row", F.col("text").alias("kept"), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"))
    others = flagged.filter("suspicious").select("row", "ord", "node", "text").join(losses, ["ord", "node"], "left").select("row", "text", "drop")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            kept, n, dropped = [], [], []
            for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, gone = text.split("\n"), {k.decode("utf-8", "surrogatepass") for k in drop or ()}
                left = [x for x in lines if key_of(x) not in gone] if gone else lines
                kept.append("\n".join(left) if gone else text)
                n.append(len(lines))
                dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.large_string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])

    return clear.unionByName(others.mapInArrow(rebuild, clear.schema))


def deduplicated_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated lines taken out; ``n_chars``, where there is such a column, follows the new text."""
    new = {text_col: F.col("kept"), **({"n_chars": F.char_length("kept").cast(df.schema["n_chars"].dataType)} if "n_chars" in df.columns else {})}
    return dedup_lines(df, id_col, text_col).select(*(new.get(c, F.col("row")[c]).alias(c) for c in df.columns))
