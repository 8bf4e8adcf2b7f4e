"""Vector codes, filter audit and SimHash: brute force, and nulls, ties, repeated rows, hot keys and empty tables."""

import hashlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash

from murmura.llm import audit, codes, queries, simhash

# -- vector codes


def plain_codes(vectors, k=64, parts=16, rounds=2):
    """Codes and errors by comparing every part with every entry."""
    ids = sorted(vectors)
    whole = {i: [int(np.floor(256 * v)) for v in vectors[i]] for i in ids}
    d = len(whole[ids[0]])
    bounds = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[whole[i][a:b] for i in ids[:k]] for a, b in bounds]

    def nearest(book, x):
        return min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(bounds):
            own = {}
            for i in ids:
                own.setdefault(nearest(books[p], whole[i][a:b])[1], []).append(whole[i][a:b])
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else e for j, e in enumerate(books[p])]
    out = {}
    for i in ids:
        met = [nearest(books[p], whole[i][a:b]) for p, (a, b) in enumerate(bounds)]
        out[i] = ("".join(f"{j:02x}" for _, j in met), sum(s for s, _ in met))
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_annulus_holds_the_nearest():
    rng = np.random.default_rng(1)
    for spread in (3, 200, 1 << 24):
        entries = rng.integers(-spread, spread, (64, 4))
        entries[40] = entries[3]  # a tie
        book = codes.Codebook(entries)
        x = np.concatenate([rng.integers(-spread, spread, (500, 4)), entries])
        index, least = book.nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (least == every.min(1)).all() and (index == every.argmin(1)).all()
    low, high = codes.Codebook(rng.normal(0, 20, (64, 4)).astype(int)).annulus(rng.normal(0, 20, (500, 4)).astype(int))
    assert (high - low).mean() < 48  # it prunes


@pytest.mark.parametrize("n, d", [(150, 32), (40, 16), (90, 20), (3, 5)])
def test_codes_against_brute_force(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = {i: (rng.normal(0, 0.5, d).round(1) if i % 3 else np.full(d, 0.25)).tolist() for i in range(n)}  # a third are equal
    df = spark.createDataFrame([(i, v, None if i % 4 == 0 else i % 2) for i, v in vectors.items()], "vec_id bigint, embedding array<double>, label int").repartition(5)
    want, digest = plain_codes(vectors)
    got = codes.compress(df).collect()
    assert {r.id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got)


def test_codes_of_odd_tables(spark, monkeypatch):
    schema = "vec_id bigint, embedding array<float>, label string, code string, error string, id string, vector string, total string"
    none = spark.createDataFrame([], schema)
    assert codes.compress(none).count() == 0 and codes.compress(none).columns == ["id", "label", "code", "error", "label_error", "codebooks_sha256"]
    v = [0.5] * 32
    odd = [(1, v), (1, v), (None, v), (2, None), (3, [None, *v[1:]]), (4, [float("nan"), *v[1:]]), (5, [float("-inf"), *v[1:]]), (6, [0.5]), (7, []), (8, [3e38, *v[1:]]), (9, [-0.001, *v[1:]])]
    df = spark.createDataFrame([(i, x, None if i == 1 else "a", "c", "e", "i", "v", "t") for i, x in odd], schema).repartition(3)
    got = codes.compress(df).collect()
    assert Counter(r.id for r in got) == Counter([1, 1, None, 8, 9])
    assert all(r.error >= 0 and r.label_error >= r.error for r in got)
    books = codes.fit(df)
    first = next(r for r in got if r.id == 9)
    assert len(books.decode(first.code)) == 32 and books.decode(first.code)[0] == pytest.approx(-1 / 256)
    monkeypatch.setattr(codes, "MAX_LABELS", 0)  # the way for many labels
    key = lambda r: tuple(map(str, r))
    assert sorted(codes.compress(df).collect(), key=key) == sorted(got, key=key)


# -- filter audit


def plain_audit(docs, labels, rules):
    """Every filter on every row, every order applied in turn."""
    first = {}
    for i, t, _ in docs:
        rank = (i is None, i)
        first[t or ""] = min(first.get(t or "", rank), rank)
    fails, parts = [], {}
    for n, (i, t, p) in enumerate(docs):
        words, text = (t or "").encode().split(), t or ""
        f = {"A": len(words) < rules.min_words, "B": 100 * len(set(words)) < rules.min_distinct_percent * len(words)}
        f["C"] = 100 * sum("A" <= c <= "Z" for c in text) > rules.max_upper_percent * len(text)
        f["D"], f["E"] = any(c in "#$%&*|" for c in text), first[text] != (i is None, i)
        fails.append({k for k, v in f.items() if v})
        parts.setdefault(p or "", []).append(n)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part, own in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [n for n in left if f in fails[n]]
                left = [n for n in left if f not in fails[n]]
                shapley[f] += len(gone)
                redundant = sum(f in fails[n] for n in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(fails[n] == {f} for n in own), sum(docs[n][0] in good for n in gone), sum(docs[n][0] in toxic for n in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def audited(spark, docs, labels, rules, slices):
    schema = "doc_id bigint, text string, lang string, part string, mask string, n string, id string"
    d = spark.createDataFrame([(*x, "p", "m", "n", "i") for x in docs], schema).repartition(slices)
    found = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in audit.interactions(d, found, rules=rules).collect()}


@pytest.mark.parametrize("held", [1 << 25, 300])
def test_audit_against_every_order(spark, monkeypatch, held):
    """Copies with and without ids, in several parts; a third of all rows is one text. With little held, a task hands on many chains."""
    monkeypatch.setattr(audit, "HELD", held)
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "GAMMA", "#tag", "delta", "x", "50%"]
    rules = audit.Rules(min_words=6)
    docs = [(i if i % 7 else None, " ".join(rng.choice(words[: 2 + i % 6], 1 + i % 9)), [None, "", "en", "fr"][i % 4]) for i in range(120)]
    docs += [(1000 - i, "one text that very many rows of the table share", "en") for i in range(60)]
    docs += [(None, None, "fr"), (3, "", "en"), (3, "", "de"), (5, "twice the same row", "en"), (5, "twice the same row", "en"), (5, "twice the same row", "fr"), (9, "äöü 日本語 \x0b\x1c\x85 A", "en")]
    labels = [(i, i % 2, i % 3) for i in range(0, 1000, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, labels, rules, 6) == plain_audit(docs, labels, rules)


def test_audit_of_colliding_fingerprints(spark, monkeypatch):
    """Texts of one fingerprint are told apart by their full text."""

    class Same:
        xxh64_intdigest = staticmethod(lambda data: 7)

    monkeypatch.setattr(audit, "xxhash", Same)
    docs = [(i, f"text {i % 5}", "en") for i in range(40)]
    out = list(audit.chained(sorted(audit.judged(audit.Rules())(docs[:20]), key=lambda x: x[0])))
    assert {i for i, _, m, _ in out if not m & audit.COPY} == set(range(5))
    both = sorted([*audit.judged(audit.Rules())(docs[:20]), *audit.judged(audit.Rules())(docs[20:])], key=lambda x: x[0])
    assert {i for i, _, m, _ in audit.chained(both) if not m & audit.COPY} == set(range(5))


def test_audit_settles_a_hot_text_in_its_task():
    rows = list(audit.judged(audit.Rules())((i, "hot", "en") for i in range(1000, 0, -1)))
    assert sum(text is not None for _, (text, *_) in rows) == 1 and len({k[0] for k, _ in rows}) == 1000  # dealt out evenly
    assert sum(n for _, (*_, n) in rows) == 1000
    same = list(audit.judged(audit.Rules())((None, "hot", "en") for _ in range(1000)))
    assert len(same) == 1 and same[0][1][3] == 1000


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], [], audit.Rules(), 2) == {}
    docs = [(1, None, None), (2, "a", "en")]
    assert audited(spark, docs, [], audit.Rules(), 2) == plain_audit(docs, [], audit.Rules())


# -- SimHash


def plain_print(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " \t".join(rng.choice(["Wort", "größe", "WORD", "été", "a", "b"], n)) + "\n"
        assert simhash.fingerprint(text) == plain_print(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = "lorem ipsum dolor sit amet " * 50_000
    assert simhash.fingerprint(long) == simhash.fingerprint("lorem ipsum dolor sit amet " * 50_000)


def test_whole_query_against_brute_force(spark, sf, duck):
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    prints = [plain_print(t) for _, t in docs]
    names = plain_components(prints, [i for i, _ in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, names, strict=True)}


def near(rng, base, bits):
    for b in rng.choice(64, bits, replace=False):
        base ^= 1 << int(b)
    return base


@pytest.mark.parametrize("tile", [1 << 14, 7])
def test_links_connect_what_brute_force_connects(spark, tmp_path, tile):
    """Random prints, chains at the radius, and a large group of near copies, in large and in many small tiles."""
    rng = np.random.default_rng(11)
    prints = [int(x) for x in rng.integers(0, 1 << 64, 120, np.uint64)]
    centre = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    prints += [near(rng, centre, int(k)) for k in rng.integers(0, 3, 150)]
    for p in prints[:20]:
        prints += [near(rng, p, 4), near(rng, p, 5)]
    prints += [0, 1, 0xF, 0x1F, (1 << 64) - 1, (1 << 64) - 2]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(4)
    from murmura.operators.links import components

    links = simhash.links(nodes, str(tmp_path), tile=tile)
    found = {r.node: r.component for r in components(links).collect()}
    want = plain_components(prints, signed)
    assert [found.get(p, p) for p in signed] == want


def test_two_tiles_of_near_copies_give_a_forest():
    """Prints of equal counts, all within the radius of each other: one link each, not all pairs."""
    base = 0x0F0F_0F0F_0F0F_0F0F
    a = np.array([base ^ (1 << i) ^ (1 << j) for i in range(4) for j in range(4, 8)], np.uint64)
    b = np.array([base ^ (1 << i) ^ (1 << j) for i in range(8, 12) for j in range(12, 16)], np.uint64)
    u, v = simhash.tile_links(a, b)
    assert len(u) == len(a) + len(b) - 1 and set(v.tolist()) == {v[0]}
    u, v = simhash.tile_links(a, a)
    assert set(u.tolist()) == set(a.tolist()) - {v[0]} and len(u) < 2 * len(a)


def test_tile_packing():
    cells = [(8, 8, q, 8, 3 + q) for q in range(17)] + [(8, 9, 8, 8, 100), (8, 9, 8, 9, 2), (9, 9, 1, 1, 1)]
    placed = simhash.packed(cells, 10)
    sizes, owner = Counter(), {}
    for (*q, at, k), (*_, n) in zip(placed, sorted(cells), strict=True):
        for t in range(at, at + k):
            sizes[t] += n / k
            assert owner.setdefault(t, q[:2]) == q[:2]
    assert max(sizes.values()) <= 20 and sorted(sizes) == list(range(len(sizes)))
    assert simhash.packed([]) == []


def test_simhash_of_odd_tables(spark):
    schema = "doc_id string, text string, id string, print string, component_id string, n bigint"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = "Lorem wort größe palabra été. " * 40_000
    texts = [("a", None), ("b", ""), (None, " \n\x0b"), (None, "only here without an id, in any row"), ("c", long), ("d", long), ("c", "another text under the same id"), ("e", "Upper CASE words"), ("f", "upper case WORDS"), ("e", "Upper CASE words")]
    df = spark.createDataFrame([(i, t, "x", "x", "x", 1) for i, t in texts], schema).repartition(3)
    got = Counter((r.id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == Counter([("a", "a"), ("b", "a"), (None, "a"), (None, None), ("c", "c"), ("d", "c"), ("c", "c"), ("e", "e"), ("f", "e"), ("e", "e")])
