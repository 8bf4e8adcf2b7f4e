"""Token counts from an exact histogram of document lengths.

Every whole text is encoded once, by a public byte-level BPE vocabulary. A task
counts its documents by encoded length, so that what is shuffled is one row for
each length and task. Suffix sums over the lengths then answer, for every
context limit, how many documents and tokens lie beyond it, what truncation at
it keeps, and which quantile it is.

Defined results: a null or empty text is a document of 0 tokens; repeated rows
count each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.common import parts
from murmura.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before merging, as the vocabulary's own encoder has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths to a block of the two-level suffix sums.
BLOCK = 256

_encoders: dict[bytes, object] = {}


def load_vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file's bytes. Read on the driver: executors needn't have the file."""
    with open(path, "rb") as f:
        return f.read()


def encoder(data: bytes, pattern: str = PATTERN):
    """A tiktoken encoding of a rank file, made once in each Python worker."""
    import tiktoken

    key = (len(data), hash(data), pattern)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("murmura", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def length_histogram(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): documents by encoded length."""
    ranks = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))  # a vocabulary file: under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = encoder(ranks.value), Counter()
        for b in parts(batches):
            counts.update(len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n_docs"])

    return df.select(df[text_col].alias("text")).mapInArrow(run, "length bigint, n_docs bigint").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length, as a context limit: what lies beyond it and what truncation at it keeps.

    Two levels: sums over blocks of lengths, few enough for one window, are
    added to the suffix sums inside each block, so that no task sorts all lengths.
    Both read the histogram, which is written first: a few rows for many texts.
    """
    h = cut(histogram).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("length") * F.col("n_docs")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after")
    tokens_over = F.coalesce(F.sum(F.col("length") * F.col("n_docs")).over(inside), F.lit(0)) + F.col("tokens_after")
    return (
        h.join(blocks, "block")
        .select("length", "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "total_docs", "total_tokens")
        .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over"))
        .withColumn("quantile", (F.col("total_docs") - F.col("docs_over")) / F.col("total_docs"))
    )


def quantile_length(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents doesn't exceed."""
    row = sums.filter(F.col("quantile") >= q).agg(F.min("length")).first()
    return row[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, whether or not some document has that length."""
    over = sums.filter(F.col("length") > limit).agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("n_docs") * F.col("length")), F.lit(0))).first()
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0))).first()[0]
    return total - over[1] + limit * over[0]
