"""Benchmark decontamination by spaced-seed hashing, on DataFrame functions only.

A seed is a mask over token positions: the positions it ignores may hold anything.
Every benchmark item is hashed under every mask at every position, every text
likewise, and equal hashes give hits. Around a hit the text and the item are laid
side by side along the hit's diagonal and compared token by token: a text is
contaminated if some window of ``window`` tokens differs in at most
``substitutions`` of them. The masks are chosen so that any such window holds a
hit, wherever its substitutions are, so the result is that of comparing all
windows (``covers`` checks this for other parameters).

Items are tokenised once and written. The join against the texts never shuffles
these: items' hashes are broadcast, in blocks of ``MAX_SEEDS`` at most. With several
blocks each is a job of its own, which reads the texts and writes its hits, so that
one block is in memory at a time however many items there are. Only hits shuffle,
combined by diagonal before they do.

Items shorter than ``window`` count only as a whole and unchanged. Tokens are runs
of letters and digits, lower-cased.

Items are told apart by their tokens and get their ids back last, so ids need be
neither unique nor there at all.

Defined results: null and empty texts, and items without a token, match nothing;
rows that share an id are judged each for itself and reported together under the
id, equal ones once; a null id, of a text or of an item, is reported as null; items
of equal tokens are reported by each of their ids, an id that repeats one once;
items of different tokens under one id add up; other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.session import scratch_dir

WINDOW = 13
SUBSTITUTIONS = 2
#: Masks of six tokens that between them hit every window of 13 with two substitutions.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Seed hashes of items to a broadcast: at some 40 bytes each it stays under 64 MB.
MAX_SEEDS = 1_500_000


def covers(masks, window: int, substitutions: int) -> bool:
    """Whether every window with so many substitutions holds a whole mask without one."""
    placed = [{o + s for o in m} for m in masks for s in range(window - max(m))]
    return all(any(not p & set(bad) for p in placed) for bad in combinations(range(window), substitutions))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null or none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seed(h: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    """The hash of a mask laid at a position (from 0); null where it runs over the end."""
    return F.when(at + max(mask) < F.size(h), F.xxhash64(F.lit(number), *(F.get(h, at + o) for o in mask)))


def itemised(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, ih, item), written once: the hashes ``ih`` of an item's tokens, and a hash ``item`` of these; items without a token are left out."""
    cut = items.select(items[item_id].alias("item_id"), hashed(tokens(items[item_text])).alias("ih"))
    path = scratch_dir(items.sparkSession, "items")
    cut.filter(F.size("ih") > 0).withColumn("item", F.xxhash64("ih")).write.parquet(path)
    return items.sparkSession.read.parquet(path)


def diagonals(docs: DataFrame, cut: DataFrame, id_col: str, text_col: str, window: int, substitutions: int, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(doc_id, of, item, good) of each diagonal that overlaps an item of ``cut``: ``of`` is the text's hash, ``item`` that of the item's tokens, ``good`` the matches in each window that passes."""
    if not covers(masks, window, substitutions):
        raise ValueError("these masks miss some windows")
    bench = cut.select("item", "ih").dropDuplicates(["item"])
    n = F.size("ih")
    facts = bench.agg(F.count_if(n < window) + len(masks) * F.coalesce(F.sum(F.when(n >= window, n)), F.lit(0)), F.collect_set(F.when(n < window, n))).first()
    blocks, short = max(1, -(-facts[0] // MAX_SEEDS)), sorted(facts[1])  # at most window - 1 lengths
    long_seeds = bench.filter(F.size("ih") >= window).select("item", "ih", F.explode(F.sequence(F.lit(0), F.size("ih") - 1)).alias("j"))
    long_seeds = long_seeds.select("item", "j", F.size("ih").alias("len"), F.explode(F.array_compact(F.array(*(seed(F.col("ih"), F.col("j"), k, m) for k, m in enumerate(masks))))).alias("key"))
    every = [(k, m) for k, m in enumerate(masks)] + [(len(masks) + n, tuple(range(n))) for n in short]
    short_key = F.coalesce(*(F.when(F.size("ih") == n, seed(F.col("ih"), F.lit(0), len(masks) + n, tuple(range(n)))) for n in short)) if short else F.lit(None).cast("bigint")
    seeds = long_seeds.unionByName(bench.filter(F.size("ih") < window).select("item", F.lit(0).alias("j"), F.size("ih").alias("len"), short_key.alias("key")))

    texts = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("of"), tokens(docs[text_col]).alias("words"))
    texts = texts.select("doc_id", "of", hashed(F.col("words")).alias("h")).filter(F.size("h") > 0)
    at = texts.select("doc_id", "of", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("i"))
    laid = at.select("doc_id", "of", "h", "i", F.explode(F.array(*(seed(F.col("h"), F.col("i"), k, m) for k, m in every))).alias("key")).filter("key IS NOT NULL")

    path = scratch_dir(docs.sparkSession, "hits") if blocks > 1 else None
    for b in range(blocks):
        own = seeds.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        hits = laid.join(F.broadcast(own), "key").withColumn("diagonal", F.col("i") - F.col("j"))
        start, end = F.greatest(F.col("diagonal"), F.lit(0)), F.least(F.col("diagonal") + F.col("len"), F.size("h"))
        hits = hits.select("doc_id", "of", "item", "diagonal", F.slice("h", start + 1, end - start).alias("side"))
        hits = hits.groupBy("doc_id", "of", "item", "diagonal").agg(F.first("side").alias("side"))
        if path:
            hits.write.mode("append").parquet(path)
    met = (docs.sparkSession.read.parquet(path) if path else hits).join(bench, "item")
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))
    same = F.zip_with("side", F.slice("ih", skipped + 1, F.size("side")), lambda a, b: F.when(a == b, 1).otherwise(0))
    met = met.select("doc_id", "of", "item", same.alias("same"), F.least(F.lit(window), F.size("ih")).alias("w"), F.when(F.size("ih") < window, 0).otherwise(substitutions).alias("s"))
    met = met.filter(F.size("same") >= F.col("w"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("w") + 1), lambda p: F.aggregate(F.slice("same", p, F.col("w")), F.lit(0), lambda t, x: t + x))
    return met.select("doc_id", "of", "item", F.filter(sums, lambda x: x >= F.col("w") - F.col("s")).alias("good")).filter(F.size("good") > 0)


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """One row per (doc_id, item_id) that overlaps: n_windows that pass, best_matches in one of them."""
    cut = itemised(items, item_id, item_text)
    met = diagonals(docs, cut, id_col, text_col, window, substitutions, masks)
    found = met.groupBy("doc_id", "item").agg(F.sum(F.size("good")).cast("bigint").alias("n"), F.max(F.array_max("good")).cast("bigint").alias("best"))
    return found.join(cut.select("item_id", "item").distinct(), "item").groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_windows"), F.max("best").alias("best_matches"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """The documents whose own text overlaps no item, with all their columns."""
    met = diagonals(docs, itemised(items, item_id, item_text), id_col, text_col, window, substitutions, MASKS)
    bad = met.select(F.col("doc_id").alias("murmura_id"), F.col("of").alias("murmura_of")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["murmura_id"]) & (F.xxhash64(docs[text_col]) == bad["murmura_of"]), "left_anti")
