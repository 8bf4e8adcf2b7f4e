"""Grouped prefix join: documents whose shingle sets have a Jaccard similarity of 0.8 or more.

1. A sketch counts shingles by hash bucket over all documents. (bucket count,
   hash) is the global order: passages shared by many documents come last and so
   stay out of prefixes. Its size is fixed: on a large corpus it tells only what
   stands out from the mean of its buckets, which is what matters.
2. Each document's set gives a size, a class (its whole set) and a group (its
   prefix and size). Equal sets become one class, represented by one of its rows'
   nodes; classes of equal prefix and size become one group. Prefixes are emitted
   once for a group and task, and prefix shingles that no second group has are
   dropped.
3. Two groups are candidates where they share a prefix shingle that can be the
   first one that they share: what follows it in either set must leave room for the
   overlap that a link takes. Candidates are expanded to classes, and a pair of
   classes is verified on whole sets.
4. Links are found in rounds. In a star round each shingle has a pivot, the member
   of its largest component with the fewest shingles before it, which is the one
   nearest to what its copies have in common; all others are compared with pivots
   only, which is linear. Groups whose classes didn't all come together are then
   treated as step 2 treats documents, by the shingles that follow the prefix they
   share. While what is still in different components would make many more pairs
   than there are rows, further star rounds follow, with other pivots. The last round
   compares all that is left. Pairs inside a component need no look: they can't
   change it. Hence a group of thousands of copies costs about one comparison for
   each copy, and still every link between components is found.

Shingle hashes are of 64 bits, classes and groups of 128; candidates meet by the
first 64 bits of a group, which can only lose a link between two groups that share
these by chance. A row's node is a 63-bit hash of its id and text, so that rows that
share an id, or have none, are told apart by their texts.

A shingle that the sketch finds hot is taken as shared without a look; any other
one has a bounded number of rows, so that no window gathers a hot key. What is
joined on shingles and nodes has been written before, so that both sides of a join
are plain shuffles and adaptive execution can split a hot key.

Defined results: a null or empty text has an empty set and is linked with nothing;
with fewer than five words the whole sequence is the one shingle; rows with equal
texts are of one component; rows that repeat an id are each compared by their own
text, so that one may be a copy and another not; a component is named by its smallest
id; a null id counts as one above all others, 2**63 - 1; ids are integers, or text that
casts to them; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.common import BLANKS, parts
from murmura.operators.links import components
from murmura.session import remove, scratch_dir, tidy_shuffles

WIDTH = 5
PERCENT = 80
NO_ID = (1 << 63) - 1
SKETCH_BITS = 20
SLICES = 16
#: Bucket counts this far above the mean make a shingle hot.
HOT = 10_000
#: Nodes whose texts are looked up by a broadcast join: some 50 MB.
MAX_IDS = 1_000_000
#: Pairs for each row from which on further star rounds come before the last one, and how many at most.
CROWD = 4
ROUNDS = 3
#: Odd multipliers of the words in a shingle.
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


#: A random word for each byte value, and an odd one for each place in a word.
_BYTES = np.random.default_rng(20240501).integers(0, 1 << 64, 256, np.uint64)
_PLACES = np.random.default_rng(20240502).integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS.encode(), np.uint8))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xE9846AF9B1A615D7)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word: its bytes' random words, weighted by place and summed."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_BLANK[b])
    if not len(at):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    value = _BYTES[b[at]] * _PLACES[place % len(_PLACES)]
    if sizes.max() > len(_PLACES):  # the places start anew, turned by the round
        value *= (place // len(_PLACES)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return _mixed(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes only A-Z change
    h = word_hashes(data)
    if len(h) < width:
        return _mixed(np.array([xxhash.xxh64_intdigest(b" ".join(data.split()), seed=len(h))], np.uint64)) if len(h) else h
    total = h[: len(h) - width + 1] * FACTORS[0]
    for i in range(1, width):
        total += h[i : len(h) - width + 1 + i] * FACTORS[i]
    return distinct(_mixed(total))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many first shingles hold one of any partner's prefix."""
    return n - -(-percent * n // 100) + 1


def index_size(n: int, percent: int = PERCENT) -> int:
    """The same for the smaller set of a pair."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _pair(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _sketch(df: DataFrame) -> np.ndarray:
    """Shingle counts by bucket: a task hands on its own sums, in slices that are added up side by side."""
    size = 1 << SKETCH_BITS
    part = size // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in parts(batches):
            found = np.concatenate([np.empty(0, np.uint64), *map(shingles, b.column(0).to_pylist())])
            total += np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([np.minimum(total[i * part : (i + 1) * part], 0xFFFFFFFF).astype(np.uint32).tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(s, np.zeros(part, np.int64))
                sums[s] += np.frombuffer(c, np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    rows = df.select("text").mapInArrow(count, "slice bigint, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice bigint, counts binary").collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.slice * part : (r.slice + 1) * part] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def ordered(u: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the global order: by bucket count, ties by hash."""
    c = counts[(u & np.uint64(len(counts) - 1)).astype(np.int64)]
    return u[np.argsort(c, kind="stable")]


def hot_count(counts: np.ndarray) -> int:
    """From which bucket count on a shingle is hot: well above the mean, which other shingles account for."""
    mean = float(counts.mean()) if len(counts) else 0.0
    return int(mean + 6 * math.sqrt(mean)) + HOT


def _described(counts, percent: int):
    """(ord, node, n, class, group, and where this task hasn't given that group's: the prefix, and how many of it aren't hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, given = counts.value, set()
        limit = hot_count(table)
        for b in parts(batches):
            texts = b.column(2).to_pylist()
            n, cls, grp, cold, pre = [], [], [], [], []
            for t in texts:
                u = shingles(t)
                n.append(len(u))
                cls.append(_pair(xxhash.xxh128_digest(u.tobytes())))
                p = ordered(u, table)[: prefix_size(len(u), percent)] if len(u) >= 100 // (100 - percent) - 1 else u[:0]
                g = _pair(xxhash.xxh128_digest(p.tobytes(), seed=len(u)) if len(p) else xxhash.xxh128_digest(u.tobytes()))
                grp.append(g)
                new = len(p) and g not in given
                pre.append(p.view(np.int64) if new else None)
                cold.append(int((table[(p & np.uint64(len(table) - 1)).astype(np.int64)] < limit).sum()) if new else None)
                given.add(g)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.array([x[i] for x in y], pa.int64()) for y in (cls, grp) for i in (0, 1)), pa.array(cold, pa.int64()), pa.array(pre, pa.list_(pa.int64()))],
                names=["ord", "node", "n", "c1", "c2", "g1", "g2", "cold", "prefix"],
            )

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, take=None) -> DataFrame:
    """(node, set) of the rows in ``ids``, and perhaps of a few others, which joins on ``node`` leave out.

    Up to ``MAX_IDS`` nodes are broadcast. Of more, a bitmap of 16 bits to a node, 64 MB
    at most, keeps most other texts from the work. ``take``: what to keep of a set, else
    all of it. Of rows that repeat a node a task gives one.
    """
    n, shared = ids.count(), None
    if n <= MAX_IDS:
        docs = docs.join(F.broadcast(ids), "node", "left_semi")
    else:
        bits = min(29, math.ceil(math.log2(16 * n + 1)))
        place = F.pmod(F.xxhash64("node"), F.lit(1 << bits))
        docs = docs.withColumn("place", place)
        found = ids.select(F.shiftrightunsigned(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {1 << bits}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for b in batches:
            if shared is not None:
                h = b.column(2).to_numpy()
                b = b.filter(pa.array((shared.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1))
            b = b.filter(pa.array([not (x in given or given.add(x)) for x in b.column(0).to_pylist()], pa.bool_()))
            for b in parts([b]):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(take(u) if take else u).view(np.int64) for u in map(shingles, b.column(1).to_pylist())], pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select("node", "text", *([] if shared is None else ["place"])).mapInArrow(run, "node bigint, set array<bigint>")


class Join:
    """The state of one run: texts, classes, prefix shingles, links so far.

    A vertex ``v`` stands for a group, or for a class of a group whose classes are
    compared one by one. ``before``: how many shingles vertices of one shingle share
    in front of it, which is none but for such classes.
    """

    def __init__(self, docs: DataFrame, percent: int):
        self.docs, self.percent, self.spark = docs, percent, docs.sparkSession
        self.home = scratch_dir(self.spark, "jaccard")
        self.links = self.comp = self.seen = None
        self.step, self.paths = 0, {}

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        self.paths[name] = f"{self.home}/{self.step}-{name}"
        df.write.parquet(self.paths[name])
        return self.spark.read.parquet(self.paths[name])

    def done_with(self, *names: str) -> None:
        for path in filter(None, (self.paths.pop(name, None) for name in names)):
            remove(self.spark, path)

    def describe(self) -> None:
        counts = self.counts = self.spark.sparkContext.broadcast(_sketch(self.docs))  # 4 MB
        schema = "ord bigint, node bigint, n bigint, c1 bigint, c2 bigint, g1 bigint, g2 bigint, cold bigint, prefix array<bigint>"
        every = self.kept(self.docs.select("ord", "node", "text").mapInArrow(_described(counts, self.percent), schema), "sets")
        self.members = self.kept(every.select("ord", "node", "n", "c1", "c2"), "members")
        self.classes = self.kept(every.filter("n > 0").groupBy("c1", "c2", "n", "g1", "g2").agg(F.min("node").alias("rep"), F.min("ord").alias("least")), "classes")
        self.vertices = self.classes.select(F.col("g1").alias("v"), "rep")
        tokens = lambda df: df.select(F.col("g1").alias("v"), F.col("n").cast("int").alias("n"), "cold", F.posexplode("prefix").alias("pos", "token"))
        same = Window.partitionBy("token")
        cold = tokens(every.filter("cold > 0")).filter("pos < cold").drop("cold").withColumn("lo", F.min("v").over(same)).withColumn("hi", F.max("v").over(same)).filter("lo < hi").drop("lo", "hi")
        hot = tokens(every.filter("cold < size(prefix)")).filter("pos >= cold").drop("cold")
        self.tokens = self.kept(cold.dropDuplicates(["token", "v"]).union(hot.dropDuplicates(["token", "v"])), "tokens")
        self.done_with("sets")

    def verify(self, pairs: DataFrame) -> None:
        """Add the links among (a, b) pairs of class representatives."""
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = self.kept(pairs, "pairs")
        self.seen = pairs if self.seen is None else self.seen.union(pairs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = self.kept(_sets_of(self.docs, ids), "whole")
        if not sets.groupBy("node").count().filter("count > 1").isEmpty():  # rows repeat an id and a text
            sets = self.kept(sets.dropDuplicates(["node"]), "once")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        linked = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u")).filter(F.col("i") * 100 >= F.col("u") * self.percent)
        found = self.kept(linked.select("a", "b"), "links")
        self.done_with("whole", "once")
        self.links = found if self.links is None else self.links.union(found)
        self.comp = components(self.links)

    def with_comp(self, df: DataFrame, node: str, name: str = "comp") -> DataFrame:
        c = self.comp.select(F.col("node").alias(node), F.col("component").alias(name))
        return df.join(c, node, "left").withColumn(name, F.coalesce(name, node))

    def band(self, offset: float) -> Column:
        """Bands of size are twice as wide as a link allows; shifted by half they join the pairs that bands without a shift part."""
        return F.floor(F.log("n") / (2 * math.log(100 / self.percent)) + offset)

    def room(self, k: str, i: str, j: str, x_n: str, y_n: str, before: str) -> str:
        """Whether k shared shingles up to places i and j, and those before, leave room for the overlap that a link takes."""
        return f"({before} + {k} + least({x_n} - 1 - {i}, {y_n} - 1 - {j})) * {100 + self.percent} >= ({x_n} + {y_n}) * {self.percent} AND least({x_n}, {y_n}) * 100 >= greatest({x_n}, {y_n}) * {self.percent}"

    def leads(self) -> DataFrame:
        return self.vertices.groupBy("v").agg(F.min("rep").alias("rep"))

    def expanded(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs of vertices (a, b) as pairs of their representatives."""
        for end in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("v").alias(end), F.col("rep").alias(f"{end}_rep")), end)
        return pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))

    def first_stars(self) -> None:
        """In each shingle's groups of like size, all others against the one that has it first; in each group, all classes against one."""
        t = self.tokens.withColumn("band", self.band(0.0))
        pivots = t.groupBy("token", "band").agg(F.min(F.struct("pos", "v", "n")).alias("p"), F.count("*").alias("k")).filter("k > 1").select("token", "band", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("pos", "v", "n")))
        pivots = self.kept(pivots, "pivots")
        met = t.join(pivots, ["token", "band"]).filter(f"v <> p_v AND {self.room('1', 'pos', 'p_pos', 'n', 'p_n', '0')}")
        leads = self.leads()
        pairs = self.expanded(met.select(F.col("p_v").alias("a"), F.col("v").alias("b")).distinct(), leads)
        inner = self.vertices.join(leads.select("v", F.col("rep").alias("a")), "v").select("a", F.col("rep").alias("b")).filter("a <> b")
        self.verify(pairs.union(inner))
        self.done_with("pivots")

    def mixed(self, t: DataFrame, name: str) -> DataFrame:
        """The rows of shingles whose vertices are in more than one component, with ``comp``; a group whose own classes are in several may meet any."""
        own = self.with_comp(self.vertices, "rep").groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        own = own.select("v", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1 - F.shiftrightunsigned("v", 1)).alias("comp"))
        t = self.kept(t.join(own, "v"), "located")
        open_ = self.kept(t.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token"), "open")
        out = self.kept(t.join(open_, "token", "left_semi"), name)
        self.done_with("located", "open")
        return out

    def apart(self) -> DataFrame | None:
        """Vertices for the classes of groups whose classes are in several components, by the shingles that follow their common prefix."""
        inside = self.with_comp(self.vertices, "rep")
        split = inside.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("v")
        inside = self.kept(self.vertices.join(split, "v", "left_semi"), "apart")
        if inside.isEmpty():
            return None
        percent, counts = self.percent, self.counts

        def following(u: np.ndarray) -> np.ndarray:
            first = prefix_size(len(u), percent)
            return np.concatenate([np.array([len(u), first], np.uint64), ordered(u, counts.value)[first : first + index_size(len(u), percent)]])

        sets = _sets_of(self.docs, inside.select(F.col("rep").alias("node")).distinct(), following).groupBy("node").agg(F.max("set").alias("set"))
        t = inside.join(sets.withColumnRenamed("node", "rep"), "rep").select(F.col("v").alias("g"), F.col("rep").alias("v"), *(F.element_at("set", i).cast("int").alias(c) for i, c in ((1, "n"), (2, "before"))), F.posexplode(F.slice("set", 3, F.size("set"))).alias("at", "token"))
        self.vertices = self.vertices.union(inside.select(F.col("rep").alias("v"), "rep"))
        return t.select("v", "n", (F.col("before") + F.col("at")).alias("pos"), F.xxhash64("g", "token").alias("token"), "before")

    def crowded(self, t: DataFrame) -> bool:
        """Whether comparing all that meet in a shingle and are in different components would take many more rows than there are."""
        t = t.filter(self.room("1", "pos", "0", "n", "n", "before"))
        each = t.groupBy("token", "comp").agg(F.count("*").cast("double").alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
        met = each.agg(F.sum((F.col("k") * F.col("k") - F.col("own")) / 2).alias("pairs"), F.sum("k").alias("rows")).first()
        return bool(met.rows) and met.pairs > CROWD * met.rows

    def more_stars(self, t: DataFrame, salts: tuple[int, ...], offset: float) -> None:
        """In each shingle's vertices of like size, all outside its largest component against members of it.

        The member that has the shingle first and one for each salt are tried; bands are
        shifted against those of the first stars. What shares too little here is left to
        ``rest``.
        """
        t = t.withColumn("band", self.band(offset))
        row = ("v", "n", "pos")
        tried = F.array(F.min(F.struct(F.col("pos").cast("bigint").alias("h"), *row)), *(F.min(F.struct(F.xxhash64("v", F.lit(x)).alias("h"), *row)) for x in salts))
        each = t.groupBy("token", "band", "comp").agg(F.count("*").alias("k"), tried.alias("tried"))
        big = each.groupBy("token", "band").agg(F.max_by(F.struct("comp", "tried"), F.struct("k", -F.col("comp"))).alias("big"), F.count("*").alias("comps")).filter("comps > 1")
        big = self.kept(big.select("token", "band", "big"), "pivots")
        met = t.join(big, ["token", "band"]).filter("comp <> big.comp").select(*row, "before", F.explode(F.array_distinct(F.transform("big.tried", lambda x: x.dropFields("h")))).alias("p")).filter(self.room("1", "pos", "p.pos", "n", "p.n", "before"))
        self.verify(self.expanded(met.select(F.col("p.v").alias("a"), F.col("v").alias("b")).distinct(), self.leads()))
        self.done_with("pivots")

    def rest(self, t: DataFrame) -> None:
        """All candidates whose ends are still in different components."""
        x = t.filter(self.room("1", "pos", "0", "n", "n", "before")).select("token", "before", *(F.col(c).alias(f"x_{c}") for c in ("v", "n", "pos", "comp")))
        y = t.select("token", *(F.col(c).alias(f"y_{c}") for c in ("v", "n", "pos", "comp")))
        met = x.join(y, "token").filter(f"x_comp <> y_comp AND (x_n < y_n OR x_n = y_n AND x_v < y_v) AND {self.room('1', 'x_pos', 'y_pos', 'x_n', 'y_n', 'before')}")
        met = met.groupBy("x_v", "y_v").agg(F.count("*").alias("k"), F.max("x_pos").alias("i"), F.max("y_pos").alias("j"), F.first("x_n").alias("x_n"), F.first("y_n").alias("y_n"), F.max("before").alias("before"))
        met = met.filter(self.room("k", "i", "j", "x_n", "y_n", "before"))
        pairs = self.expanded(met.select(F.col("x_v").alias("a"), F.col("y_v").alias("b")), self.vertices)
        pairs = self.with_comp(self.with_comp(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
        self.verify(pairs)

    def run(self) -> None:
        with tidy_shuffles(self.spark):
            self.describe()
            self.first_stars()
            following = self.apart()
            t = self.tokens.withColumn("before", F.lit(0))
            t = t if following is None else t.unionByName(following)
            t = self.mixed(t, "round-0")
            self.done_with("tokens")
            for i in range(1, ROUNDS + 1):
                if not self.crowded(t):
                    break
                self.more_stars(t, salts=(2 * i, 2 * i + 1), offset=i / (ROUNDS + 1))
                t = self.mixed(t.drop("comp"), f"round-{i}")
                self.done_with(f"round-{i - 1}")
            self.rest(t)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """(ord, node) of a row."""
    ord_ = F.coalesce(df[id_col].cast("bigint"), F.lit(NO_ID))
    return ord_, F.shiftrightunsigned(F.xxhash64(ord_, df[text_col]), 1)


def _components_of(df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(ord, node, n_shingles, component_id) for each input row."""
    ord_, node = _keyed(df, id_col, text_col)
    docs = df.select(ord_.alias("ord"), node.alias("node"), df[text_col].alias("text"))
    j = Join(docs, percent)
    j.run()
    least = j.comp.join(j.classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = j.comp.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    reps = j.classes.join(linked, "rep", "left").select("c1", "c2", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = j.members.join(reps, ["c1", "c2", "n"], "left")
    return out.select("ord", "node", F.col("n").alias("n_shingles"), F.coalesce("component_id", "ord").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(ord, n_shingles, component_id) for each input row; ``ord`` is the id, or 2**63 - 1 for none."""
    return _components_of(df, id_col, text_col, percent).drop("node")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows whose id is the smallest of their own text's component, with all their columns.

    Of a component's rows under its smallest id, or all without one, all stay: nothing
    tells them apart.
    """
    gone = _components_of(df, id_col, text_col, percent).filter("component_id < ord").select(F.col("ord").alias("murmura_gone"), F.col("node").alias("murmura_node")).distinct()
    ord_, node = _keyed(df, id_col, text_col)
    return df.join(gone, (ord_ == gone["murmura_gone"]) & (node == gone["murmura_node"]), "left_anti")
