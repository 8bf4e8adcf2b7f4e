"""How filters over documents interact: what each removes, alone, in every order and by Shapley value.

Five filters judge each document on its own (A to D) or against all others (E, a text
that a smaller id has too). A document's verdicts are a mask of five bits, and all
counts follow from how many documents of a part have which mask.

1. Each task judges its texts. It keeps a chain of full texts for each xxhash
   fingerprint; of the rows with one text only those under the smallest id can still
   be first, and all others are settled at once. So a text that a third of all rows
   share is one row for each task from here on.
2. What is settled is dealt out evenly, without texts. What isn't is routed to a partition by its fingerprint and sorted there by
   fingerprint and id, which spills. The partition walks through one chain at a time:
   a text it hasn't met belongs to its smallest id, every later id is not the smallest.
3. Verdicts, without texts, meet labels by id, counted before they are shuffled.
4. ``combineByKey`` merges count vectors (mask by all, good, toxic) by part, and each
   part's vector is unfolded into all orders and steps, in tasks.

Defined results: a null text is empty; a null part is the empty string; a null id
counts as one id above all others, without labels; rows that repeat an id and a text
don't fail E by each other; an id with several label rows is good, or toxic, if one
row says so; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, IntegerType, StringType, StructField, StructType

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of text that a task of step 1 holds before it hands them on.
HELD = 32 << 20
#: Bytes of text to a partition of step 2, at most about.
ROUTED = 256 << 20
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@dataclass(frozen=True)
class Rules:
    min_words: int = 200
    min_distinct_percent: int = 50
    max_upper_percent: int = 3
    marks: bytes = b"#$%&*|"

    def mask(self, text: str) -> int:
        """Bits of the filters A to D that a text fails."""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # of bytes, split() takes the six blanks alone
        n = len(words)
        upper = len(data) - len(data.translate(None, UPPER))
        return (n < self.min_words) | (100 * len(set(words)) < self.min_distinct_percent * n) << 1 | (100 * upper > self.max_upper_percent * len(text)) << 2 | (len(data.translate(None, self.marks)) < len(data)) << 3


def _rank(id_) -> tuple:
    return (id_ is None, id_)


def _before(a, b) -> bool:
    return a is not None and (b is None or a < b)


def judged(rules: Rules):
    """Step 1 on (id, text, part) rows: ((fingerprint, rank of id), (text or None where E is settled, mask, part, count))."""

    def handed(chains: dict) -> Iterator:
        for h, chain in chains.items():
            for text, mask, id_, counts in chain:
                for part, n in counts.items():
                    yield (h, *_rank(id_)), (text, mask, part, n)

    def run(rows) -> Iterator:
        chains, held, settled = {}, 0, 0
        for id_, text, part in rows:
            h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
            chain = chains.setdefault(h, [])
            entry = next((e for e in chain if e[0] == text), None)
            if entry is None:
                chain.append([text, rules.mask(text), id_, {part: 1}])
                held += len(text) + 200
                if held > HELD:
                    yield from handed(chains)
                    chains, held = {}, 0
            elif id_ == entry[2]:
                entry[3][part] = entry[3].get(part, 0) + 1
            elif _before(entry[2], id_):
                settled += 1
                yield (h + settled, *_rank(id_)), (None, entry[1] | COPY, part, 1)
            else:
                for p, n in entry[3].items():
                    settled += 1
                    yield (h + settled, *_rank(entry[2])), (None, entry[1] | COPY, p, n)
                entry[2], entry[3] = id_, {part: 1}
        yield from handed(chains)

    return run


def chained(rows) -> Iterator:
    """Step 2 on a partition sorted by fingerprint and id: (id, part, mask, count), E decided."""
    at, chain = None, []
    for (h, _, id_), (text, mask, part, n) in rows:
        if h != at:
            at, chain = h, []
        if text is not None:
            first = next((i for t, i in chain if t == text), chain)
            if first is chain:
                chain.append((text, id_))
            elif first != id_:
                mask |= COPY
        yield id_, part, mask, n


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(id, part, mask, n): how many rows of an id and a part have which verdicts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    routed = rows.rdd.mapPartitions(judged(rules)).repartitionAndSortWithinPartitions(n, lambda key: key[0])
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("part", StringType()), StructField("mask", IntegerType()), StructField("n", LongType())])
    return spark.createDataFrame(routed.mapPartitions(chained), schema, verifySchema=False)


def _vector() -> list[int]:
    return [0] * (3 * MASKS)


def _add(vector: list[int], row: tuple) -> list[int]:
    mask, n, good, toxic = row
    vector[mask] += n
    vector[MASKS + mask] += n * good
    vector[2 * MASKS + mask] += n * toxic
    return vector


def _merge(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def unfolded(part: str, vector: list[int]) -> Iterator[tuple]:
    """Step 4: a part's rows for all orders and steps from its count vector."""
    every, good, toxic = vector[:MASKS], vector[MASKS : 2 * MASKS], vector[2 * MASKS :]

    def removed(counts: list[int], bit: int, before: int) -> int:
        return sum(c for m, c in enumerate(counts) if m & bit and not m & before)

    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            here = removed(every, bit, before)
            shapley[f] += here
            steps.append(("".join(order), i, f, sum(c for m, c in enumerate(every) if not m & (before | bit)), here, sum(c for m, c in enumerate(every) if m & bit and m & before), every[bit], removed(good, bit, before), removed(toxic, bit, before)))
            before |= bit
    for order, i, f, *counts in steps:
        yield part, order, i, *counts, shapley[f]


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row for each part, order of the filters and step, zeros included."""
    spark = docs.sparkSession
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    found = labels.groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    seen = verdicts(docs, id_col, text_col, part_col, rules).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    rows = seen.join(found, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: _add(_vector(), row), _add, _merge)
    schema = StructType([StructField("part", StringType()), StructField("filter_order", StringType()), StructField("step", IntegerType()), *(StructField(c, LongType()) for c in COUNTS)])
    return spark.createDataFrame(vectors.flatMap(lambda kv: unfolded(*kv)), schema, verifySchema=False)
