"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import decontam, jaccard, langid, linedup, pii, quality, spiece, tokens, urls, warc

LONG = "Lorem wort größe palabra été. " * 40_000  # over a million characters
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, ord string, row string, kept string, key string, token string"


def rows(*texts, ids=None):
    return [(ids[i] if ids else i, t, None if i % 2 else "en", None, None, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """With nulls, an empty, a blank and a very long text, repeated rows, a null id, and columns that clash."""
    data = rows(None, "", " \t\n", LONG, "one two three four five six seven.", "one two three four five six seven.") + rows("Some text without an id. More of it here.", ids=[None])
    return spark.createDataFrame(data + data[4:5], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(odd, none):
    got = {(r.doc_id, r.n_words): r for r in quality.assess(odd).collect()}
    assert got[0, 0].base_failed and not got[0, 0].kept and got[2, 0].n_lines == 0
    assert quality.assess(odd).count() == odd.count()
    assert quality.assess(none).count() == 0
    assert quality.clean_documents(odd).columns == odd.columns and quality.clean_documents(none).count() == 0


def test_quality_rules():
    j = quality.LineJudge(quality.LineRules())
    fails = lambda s: j.fails(s, len(s.split()))
    assert fails("This is a sentence that ends.") is None
    assert fails("A heading without an end") == "punctuation"
    assert fails("WORD!! WORD!! WORD!! WORD!!") == "punctuation"
    assert fails("Home | News | Sport | Contact.") == "navigation"
    assert fails("This page uses a cookie policy.") == "boilerplate"
    assert quality.repeated_words(b"a b c d e x a b c d e".split()) == 10
    assert quality.repeated_words(b"a a a a a a".split()) == 6
    assert quality.repeated_words(b"a b c d e".split()) == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "..."), (4, LONG[:400])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(odd, items).collect()}
    assert got == {(4, 1), (5, 1), (3, 4)}
    assert decontam.find_overlaps(none, items).count() == 0 and decontam.find_overlaps(odd, items.limit(0)).count() == 0
    left = decontam.decontaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 4


def test_decontamination_by_content_of_items(spark):
    """Null, repeated and shared item ids: each item counts by its own tokens, once."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    item_rows = [(None, a), (1, b), (1, b), (2, b), (3, "some other words"), (3, c)]
    items = spark.createDataFrame(item_rows, "item_id bigint, text string").repartition(3)
    docs = spark.createDataFrame([(1, f"x y {a} z"), (2, b), (3, f"q {c}"), (None, a), (5, "clean"), (2, b)], "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.item_id, r.n_windows, r.best_matches) for r in decontam.find_overlaps(docs, items).collect()), key=str)
    assert got == sorted([(1, None, 8, 13), (2, 1, 8, 13), (2, 2, 8, 13), (3, 3, 8, 13), (None, None, 8, 13)], key=str)
    assert [r.doc_id for r in decontam.decontaminated(docs, items).collect()] == [5]


def test_decontamination_tolerates_substitutions(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(5000)]
    item = [words[i] for i in rng.integers(0, 5000, 40)]
    assert decontam.covers(decontam.MASKS, decontam.WINDOW, decontam.SUBSTITUTIONS)
    docs, want = [], set()
    for d in range(60):
        text = [words[i] for i in rng.integers(0, 5000, 30)]
        part = item[d % 20 : d % 20 + 13]
        n = d % 4
        for k in rng.choice(13, n, replace=False):
            part[k] = "changed"
        docs.append((d, " ".join(text[:15] + part + text[15:])))
        if n <= 2:
            want.add(d)
    got = decontam.find_overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string"))
    found = {r.doc_id for r in got.collect()}
    assert want <= found and not [d for d in found - want if d % 4 <= 2]


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_SEEDS", 10)
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(4)], "item_id bigint, text string")
    assert decontam.find_overlaps(items.withColumnRenamed("item_id", "doc_id"), items).count() == 4


def test_tokens(odd, none):
    h = {r.length: r.n_docs for r in tokens.length_histogram(odd).collect()}
    assert sum(h.values()) == odd.count() and h[0] == 2
    assert tokens.suffix_sums(tokens.length_histogram(none)).count() == 0
    plan = tokens.suffix_sums(tokens.length_histogram(odd))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # texts are encoded once, before the sums


def test_urls(spark):
    rules = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "a.b", "/x/y"), ("allow", "a.b", "/x/y"), ("allow", "a.b", "/x/yz/"))
    t = urls.UrlTrie(rules)
    want = {"http://com/en/1": "com/en/", "http://x.Example.com/en/70?q": "example.com/en/7", "https://a.b/x/yes": "a.b/x/y", "https://a.b/x/yz/1": "a.b/x/yz/", "https://xa.b/x/y": None, "http://example.com/de/": None, "com/en/1": None}
    for u, rule in want.items():
        assert (t.find(*urls.split_url(u)) or (None, None))[1] == rule, u
    assert t.find("a.b", "/x/y")[0] == "block"
    assert urls.split_url(None) == urls.split_url("no mark") == ("", "") and urls.split_url("http://H?x") == ("h", "")
    df = spark.createDataFrame([(1, None, "z"), (1, None, "z"), (None, "http://com/en/", "z")], "page_id bigint, url string, host string")
    got = urls.judge_urls(df, rules).collect()
    assert len(got) == 3 and [r.verdict for r in got if r.rule] == ["block"]
    assert urls.judge_urls(df.limit(0), rules).count() == 0 and urls.judge_urls(df, ()).filter("verdict <> 'allow'").count() == 0


def test_sentencepiece(odd, none, spark):
    got = spiece.encode_column(odd)
    assert got.filter("NOT round_trip").count() == 0 and got.filter("doc_id < 2 AND n_ids <> 0").count() == 0
    assert spiece.encode_column(none).count() == 0
    back = spiece.decode_column(got.filter("doc_id = 3").select("doc_id", "ids"))
    assert back.first().text == LONG
    assert spiece.decode_column(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first().text == ""


def test_streaming_keeps_a_bounded_window():
    import sentencepiece

    m = spiece.Model.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    rng = np.random.default_rng(1)
    s = "".join(rng.choice(list("abcdeghinorst"), 5000))  # one word without an end
    held = []
    real = m.met
    m.met = lambda last: held.append(len(last)) or real(last)
    assert list(m.encode(s)) == sp.encode(s)
    assert max(held) < 400
    for _ in range(300):
        t = "".join(rng.choice(["a", "th", "  ", " ", "\n", "日", "é", "ing", "<s>", "\t", "0", "==", "🙂"]) for _ in range(30))
        assert list(m.encode(t)) == sp.encode(t)


def test_unigram_is_the_best_sum():
    from itertools import product

    pieces = [("<unk>", 0.0, spiece.UNKNOWN), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("ba", -2.9, 1), ("aba", -5.0, 1), ("▁", -1.0, 1), ("▁a", -1.5, 1)]
    m = spiece.Model(pieces, bpe=False)

    def best(s):
        score = {0: (0.0, [])}
        for i in range(1, len(s) + 1):
            score[i] = max(((score[i - n][0] + m.score.get(s[i - n : i], m.unknown_score), score[i - n][1] + [s[i - n : i]]) for n in range(1, min(3, i) + 1) if s[i - n : i] in m.score or n == 1), key=lambda x: x[0])
        return score[len(s)][0]

    for w in product("ab c", repeat=6):
        s = "".join(w)
        marked = "▁" + s.replace(" ", "▁")
        assert sum(m.score.get(p, m.unknown_score) for own in m.stream(marked) for p in own) == pytest.approx(best(marked))
    long = "abba" * 500
    assert sum(m.pieces[i][1] for i in m.encode(long)) == pytest.approx(best("▁" + long))


def _proto(kind, pieces, **rules):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, type_ in pieces:
        m.pieces.add(piece=piece, score=score, type=type_)
    m.trainer_spec.model_type = kind
    m.trainer_spec.vocab_size = len(pieces)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, True
    for k, v in rules.items():
        setattr(m.normalizer_spec, k, v)
    return m.SerializeToString()


def test_unigram_against_the_library():
    """A unigram model made of the public vocabulary's pieces, scored by their length and place."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    public = [x[0] for x in spiece.Model.load().pieces if x[2] == spiece.NORMAL]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, -(1 + i / 1024 + len(p) / 4), 1) for i, p in enumerate(public[:3000]))]
    data = _proto(pb.TrainerSpec.UNIGRAM, pieces)
    m, sp = spiece.Model.of_proto(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = np.random.default_rng(5)
    for n in (1, 3, 12, 40, 400):
        for _ in range(12):
            t = "".join(rng.choice(["a", "the", "ing", " ", "s", "tion", "er", "  ", "on", "q", "e", "日"], n))
            assert list(m.encode(t)) == sp.encode(t), t


@pytest.mark.parametrize("rules", [{"precompiled_charsmap": b"x"}, {"remove_extra_whitespaces": True}, {"escape_whitespaces": False}])
def test_models_that_normalise_are_refused(rules):
    from sentencepiece import sentencepiece_model_pb2 as pb

    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1)]
    assert list(spiece.Model.of_proto(_proto(pb.TrainerSpec.UNIGRAM, pieces)).encode("a"))
    with pytest.raises(ValueError):
        spiece.Model.of_proto(_proto(pb.TrainerSpec.UNIGRAM, pieces, **rules))
    with pytest.raises(ValueError):
        spiece.Model.of_proto(_proto(pb.TrainerSpec.UNIGRAM, [*pieces, ("<x>", 0.0, 4)]))
    with pytest.raises(ValueError):
        spiece.Model.of_proto(_proto(pb.TrainerSpec.WORD, pieces))


def test_language(spark, odd, none):
    net = langid.fit(odd)
    got = {r.doc_id: r for r in langid.predict(odd, net).collect()}
    assert got[0].lang_pred == got[2].lang_pred == "und" and got[0].score == 0 and got[3].lang_pred == "en"
    assert langid.fit(none) is None and langid.predict(odd, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, net).count() == 0


def test_language_gradients():
    s = langid.Settings(hidden=3)
    net = langid.Network(["a", "b", "c"], s)
    for g in (net.cells[0].p, net.cells[1].p, net.out):
        for k in g:
            g[k] = g[k].astype(np.float64)
    x, y = np.array([[65, 66, 200], [97, 32, 99], [100, 98, 101], [256, 120, 121]]), np.array([0, 1, 2])
    _, grads = net.gradients(x, y)
    for group, g in zip((net.cells[0].p, net.cells[1].p, net.out), grads, strict=True):
        for k, at in (("table", (98, 4)), ("gates", (1, 2)), ("state", (0, 1)), ("w", (2, 1)), ("b", (1,))):
            if k in group:
                group[k][at] += 1e-2
                up = net.gradients(x, y)[0]
                group[k][at] -= 2e-2
                down = net.gradients(x, y)[0]
                group[k][at] += 1e-2
                assert (up - down) / 2e-2 == pytest.approx(float(g[k][at]), abs=2e-4)


def test_windows_change_little():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], langid.Settings())
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (5, 700, 3000)]
    whole = langid.Network(["a", "b"], langid.Settings(window=4000))
    assert np.allclose(net.documents(texts), whole.documents(texts), atol=2e-3)


def test_line_dedup(odd, none, spark):
    got = linedup.dedup_lines(odd)
    assert got.count() == odd.count() and linedup.dedup_lines(none).count() == 0
    by = {(r.row.doc_id, r.n_dropped): r for r in got.collect()}
    assert by[0, 0].kept == "" and by[0, 0].n_lines == 1 and by[5, 1].kept == "" and (4, 0) in by and (None, 0) in by
    out = linedup.deduplicated_documents(odd)
    assert out.columns == odd.columns
    d = spark.createDataFrame([(3, "  A LINE of it \nshort\nÉTÉ est là bas\n"), (1, "a line of it\nshort\na line of it"), (2, "ÉTé est là bas\nété est là bas")], "doc_id bigint, text string")
    got = {r.row.doc_id: r for r in linedup.dedup_lines(d).collect()}
    assert got[1].kept == "a line of it\nshort\na line of it" and got[3].kept == "short\nÉTÉ est là bas\n" and got[2].n_dropped == 0
    assert got[3].n_lines == 4 and got[3].n_dropped == 1


def test_bloom_filters_lose_nothing():
    from murmura.llm.bloom import Bloom, mix

    keys = mix(np.random.default_rng(0).integers(0, 1 << 63, 50_000, np.uint64))
    b = Bloom.sized(len(keys))
    b.add(keys)
    assert b.has(keys).all()
    other = mix(np.random.default_rng(1).integers(0, 1 << 63, 50_000, np.uint64))
    assert b.has(other).mean() < 0.02
    assert b.folded(64).has(keys).all() and len(b.folded(64).words) <= 64


def brute(texts, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for base in range(30):
        words = list(rng.choice(vocab, int(rng.integers(1, 120))))
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 9))):
            w = list(words)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            texts.append(" ".join(w[: len(w) - int(rng.integers(0, 3))]) if len(w) > 5 else " ".join(w).upper())
    passage = " ".join(rng.choice(vocab, 60))
    texts += [f"{passage} {' '.join(rng.choice(vocab, int(rng.integers(5, 60))))}" for _ in range(40)] + [None, "", "  "]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.ord: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_jaccard_links_inside_a_group(spark, monkeypatch):
    """Sets that share prefix and size but not enough of the rest, with a chain of links among them."""
    from murmura.llm import jaccard as J

    monkeypatch.setattr(J, "prefix_size", lambda n, percent=80: 1)
    monkeypatch.setattr(J, "ordered", lambda u, counts: np.sort(u))
    head = "p q r s t"
    texts = [f"{head} " + " ".join(f"x{i}" for i in range(40)), f"{head} " + " ".join(f"x{i}" if i != 39 else "y" for i in range(40)), f"{head} " + " ".join(f"z{i}" for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.ord: r.component_id for r in J.near_duplicates(df).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2


def test_jaccard_edges(odd, none):
    got = [(r.ord, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    assert (0, 0, 0) in got and (2, 0, 2) in got and sorted(x for x in got if x[0] in (4, 5)) == [(4, 3, 4), (4, 3, 4), (5, 3, 4)]
    assert (jaccard.NO_ID, 5, jaccard.NO_ID) in got
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_jaccard_tells_rows_without_an_own_id_apart(spark):
    """Of rows that share an id or have none, one is a copy, one a near copy and one unique."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    near = lambda x: text(x) + " end"
    data = [(3, text("a")), (5, text("b")), (None, text("a")), (None, near("b")), (None, text("c")), (None, text("d")), (None, near("d")), (7, text("a")), (7, text("e")), (7, near("f")), (9, text("f")), (-2, text("g")), (8, near("g")), (None, "")]
    none = jaccard.NO_ID
    want = [3, 5, 3, 5, none, none, none, 3, 7, 7, 7, -2, -2, none]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    sizes = [36 + t.endswith("end") if t else 0 for _, t in data]
    got = sorted((r.ord, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == sorted((none if i is None else i, n, c) for (i, _), n, c in zip(data, sizes, want, strict=True))
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=str)
    assert kept == sorted((x for x, c in zip(data, want, strict=True) if c == (none if x[0] is None else x[0])), key=str)


def test_word_hashes():
    a = "Über  ein\tWort\nx" + " " + "y" * 9000 + " " + "y" * 9001
    h = jaccard.word_hashes(a.encode().lower())
    assert len(h) == len(set(h.tolist())) == len(a.split())
    assert (jaccard.word_hashes(b"x  y x") == jaccard.word_hashes(b"\nx y\tx ")).all()
    assert len(jaccard.word_hashes(b" \t")) == 0


def test_components(spark):
    from murmura.operators.links import components

    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: find(i) for i in {x for a, b in links if a != b for x in (a, b)}}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/\r\nX: y", "one", 1), (2, None, "one", 1), (3, "http://c/", None, 1), (4, "http://d/", "", 1), (5, "http://e/", "größe", 1), (2, None, "one", 1), (None, "http://n/", "solo", 1)], "page_id bigint, url string, html string, digest int")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    assert warc.payloads(spark, path).count() == 4
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_index(spark, path).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 3), (2, "response", None, 3), (2, "response", None, 3), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 7), (-1, "response", None, 4)], key=str)
    kinds = []
    for r in warc.read_records(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = body[:-4]
        kinds.append((r.page_id or -1, fields["WARC-Type"]))
        assert body.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block)
        assert "X" not in fields and ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
        assert block.endswith(bytes(r.payload)) or fields["WARC-Type"] == "revisit"
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    assert sorted(kinds) == sorted((x[0], x[1]) for x in got)
    warc.write_archive(df, str(tmp_path / "b"), least_bytes=4)
    assert warc.read_index(spark, str(tmp_path / "b")).filter("record_type = 'revisit'").count() == 0
    warc.write_archive(df.limit(0), str(tmp_path / "c"))
    assert warc.read_index(spark, str(tmp_path / "c")).count() == 0


def test_warc_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "one")], "page_id bigint, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    warc.payloads(spark, str(tmp_path / "a")).withColumn("payload", F.lit(b"two")).write.parquet(str(tmp_path / "z/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "z/records"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_index(spark, str(tmp_path / "z")).collect()


@pytest.mark.parametrize("old, new", [("WARC-Type: revisit", "WARC-Type: response"), ("Content-Length: ", "Content-Length: 1"), ("sha1:", "sha1:A"), ("WARC/1.1", "WORC/1.1"), ("WARC-Refers-To: <urn:uuid:", "WARC-Refers-To: <urn:uuid:0"), ("WARC-Record-ID", "X-Record-ID")])
def test_warc_false_headers_are_found(spark, tmp_path, old, new):
    df = spark.createDataFrame([(1, "u", "one"), (2, "v", "one"), (3, "w", "two")], "page_id bigint, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    assert warc.read_index(spark, str(tmp_path / "a")).filter("refers_to = 2").count() == 1
    spark.read.parquet(str(tmp_path / "a/payloads")).write.parquet(str(tmp_path / "z/payloads"))
    header = F.replace(F.col("header").cast("string"), F.lit(old), F.lit(new)).cast("binary")
    spark.read.parquet(str(tmp_path / "a/records")).withColumn("header", header).write.parquet(str(tmp_path / "z/records"))
    with pytest.raises(Exception, match="not a sound record|does not match its payload|nothing has the id"):
        warc.read_index(spark, str(tmp_path / "z")).collect()


def test_warc_files_round_trip(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", b"one\r\n\r\n\xff\x00"), (2, "v", b"one\r\n\r\n\xff\x00"), (3, "w", b""), (4, None, bytes(range(256)) * 99), (5, "x", None)], "page_id bigint, url string, html binary")
    warc.write_archive(df.repartition(2), str(tmp_path / "a"))
    warc.export_files(spark, str(tmp_path / "a"), str(tmp_path / "files"))
    got = warc.read_files(spark, str(tmp_path / "files")).collect()
    assert not any(r.problem for r in got)
    assert sorted(bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in got) == sorted(bytes(r.record) for r in warc.read_records(spark, str(tmp_path / "a")).collect())
    raw = b"".join(bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in got)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "whole.warc").write_bytes(raw)
    (tmp_path / "odd" / "many.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.header) + bytes(r.block) + b"\r\n\r\n") for r in got))
    (tmp_path / "odd" / "cut.warc").write_bytes(raw[:-9])
    (tmp_path / "odd" / "none.warc").write_bytes(b"")
    (tmp_path / "odd" / "text.warc").write_bytes(b"not one\r\n\r\n")
    (tmp_path / "odd" / "cut.warc.gz").write_bytes(gzip.compress(raw)[:-40])
    rows = {}
    for r in warc.read_files(spark, str(tmp_path / "odd")).collect():
        rows.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    sizes = {k: (sum(r.problem is None for r in v), sum(r.problem is not None for r in v)) for k, v in rows.items()}
    assert sizes["whole.warc"] == sizes["many.warc.gz"] == (5, 0) and sizes["cut.warc"] == (4, 1) and sizes["text.warc"] == (0, 1) and "none.warc" not in sizes
    assert sizes["cut.warc.gz"][1] == 1


def test_base32(spark):
    data = [bytes([i] * 20) for i in (0, 7, 255)]
    got = spark.createDataFrame([(d.hex(),) for d in data], "h string").select(warc.base32_of_hex(F.col("h")).alias("b")).collect()
    assert [r.b for r in got] == [base64.b32encode(d).decode() for d in data]


def test_personal_data(odd, none):
    assert pii.scan(odd).count() == odd.count() and pii.scan(none).count() == 0
    t = "write to a.b@c.de or x@y, call +1 (555) 010-9999; 4111 1111 1111 1111, 4111 1111 1111 1112; 1.2.3.256 10.0.0.1; DE89 3704 0044 0532 0130 00; ssn 123-45-6789"
    s = pii.find_spans(t)
    assert [k for _, k, _, _ in s] == ["email", "phone", "card", "ip", "iban", "ssn"]
    assert pii.redact(t, s).startswith("write to [EMAIL] or x@y, call [PHONE]; [CARD]")
    assert [k for _, k, _, _ in pii.find_spans("part 123-45-6789 of it")] == []  # no word nearby speaks for it
    a, b = pii.find_spans("my card 4111 1111 1111 1111")[0], pii.find_spans("4111 1111 1111 1111 example")[0]
    assert a[3] > b[3]


DE, GB, AE, SA, BR = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "AE07 0331 2345 6789 0123 456", "SA03 8000 0000 6080 1016 7519", "BR18 0036 0305 0000 1000 9795 493C 1"


@pytest.mark.parametrize("behind", ["", ";", " Please pay", " I am", " 2024", " A", " 7 days", " 2024 AND MORE 123", ", next"])
@pytest.mark.parametrize("number", [DE, GB, AE, SA, BR])
def test_account_numbers_end_by_country(number, behind):
    for n in (number, number.replace(" ", "")):
        text = f"IBAN {n}{behind}"
        assert [(s, e) for s, k, e, _ in pii.find_spans(text) if k == "iban"] == [(5, 5 + len(n))]


def test_account_numbers_side_by_side():
    for a in (DE, GB, AE, SA, BR):
        for b in (DE, GB, AE, SA, BR):
            for gap in (" ", "\n", "/"):
                text = a.replace(" ", "") + gap + b
                assert [text[s:e] for s, k, e, _ in pii.find_spans(text) if k == "iban"] == [a.replace(" ", ""), b]
    for text in (DE[:-1] + "1 Please", DE + "a", DE.replace(" ", "") + "X", DE[:-3] + " Please"):
        assert not [x for x in pii.find_spans(text) if x[1] == "iban"]


def test_account_numbers_of_unlisted_countries():
    for n in (15, 23, 34):
        rest = ("5" * 30)[: n - 4]
        number = next(x for x in (f"ZZ{k:02}{rest}" for k in range(2, 99)) if pii.mod97_lengths(x)[-1:] == [n])
        assert [(s, e) for s, k, e, _ in pii.find_spans(f"IBAN {number} Please") if k == "iban"] == [(5, 5 + n)]


def test_account_numbers_take_long_runs():
    import time

    began = time.time()
    pii.find_spans("AA00 " * 60_000)
    assert time.time() - began < 10


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 100_000, "+" * 100_000, "+1" + " " * 200_000, "@" * 100_000, "A0" * 100_000, "a@" * 100_000, "DE00" + "A1 " * 60_000])
def test_personal_data_takes_long_runs(text):
    import time

    began = time.time()
    pii.find_spans(text)
    assert time.time() - began < 10


def test_jaccard_looks_texts_up_by_a_bitmap_too(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_IDS", 0)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:30], "x", *words[30:]]), " ".join(words[::-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted((r.ord, r.component_id) for r in jaccard.near_duplicates(df).collect()) == [(0, 0), (1, 0), (2, 2)]


def test_decontamination_tokens(spark):
    """Runs of letters and digits, whatever stands at a text's ends."""
    import regex

    texts = ["", "  ", "a", " a b ", "--x--y", "x--", "ÀÉ 漢字 ١٢", "𝒜b 𐐀", "áb", "\n\tA1\x00B", "w, " * 50_000, "z" * 200_000]
    got = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string").select("i", decontam.tokens(F.col("text")).alias("t"))
    assert dict((r.i, r.t) for r in got.collect()) == {i: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for i, t in enumerate([*texts, None])}
