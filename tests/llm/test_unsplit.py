"""Inputs that once made a task gather, search or repeat without bound."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmura.llm import langid, linedup, spiece, urls, warc


def test_a_url_with_an_endless_segment():
    trie = urls.UrlTrie([("block", "com", "/en/"), ("allow", "example.com", "/en/7")])
    began = time.perf_counter()
    assert trie.find("example.com", "/en/" + "x" * 1_000_000) == ("block", "com/en/")
    assert trie.find("example.com", "/en/7" + "x" * 1_000_000) == ("allow", "example.com/en/7")
    assert time.perf_counter() - began < 0.1


def test_line_dedup_gathers_only_what_a_row_loses(spark, monkeypatch):
    """A third of the rows have no id: each still loses its own lines only, and no gathered row holds another's."""
    held = []
    real = F.collect_set

    texts = [f"shared line number {i % 7} of all\nown line number {i} of this text\nshared tail of every text" for i in range(90)]
    df = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(linedup.F, "collect_set", lambda c: (held.append(c), real(c))[1])
    got = linedup.dedup_lines(df).select("row.*", "kept", "n_dropped").collect()
    assert held == ["key"]
    first = {}
    for i, t in enumerate(texts):
        rank = (i % 3 == 0, 0 if i % 3 == 0 else i)  # all rows without an id are one document, the last
        for line in t.split("\n"):
            first[line] = min(first.get(line, rank), rank)
    want = Counter()
    for i, t in enumerate(texts):
        rank = (i % 3 == 0, 0 if i % 3 == 0 else i)
        want[None if i % 3 == 0 else i, t, "\n".join(x for x in t.split("\n") if first[x] == rank)] += 1
    assert Counter((r.doc_id, r.text, r.kept) for r in got) == want


def test_a_word_whose_paths_never_meet():
    model = spiece.Model([("<unk>", 0.0, spiece.UNKNOWN), ("a", -1.0, spiece.NORMAL), ("aa", -2.0000001, spiece.NORMAL)], bpe=False, dummy_prefix=False)
    took = []
    for n in (50_000, 100_000):
        began = time.perf_counter()
        assert len(model.encode("a" * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 5
    model = spiece.Model([("<unk>", 0.0, spiece.UNKNOWN), ("a", -2.0, spiece.NORMAL), ("aa", -2.5, spiece.NORMAL)], bpe=False, dummy_prefix=False)
    assert list(model.encode("a" * 100_001)) == [2] * 50_000 + [1] or sorted(Counter(model.encode("a" * 100_001)).items()) == [(1, 1), (2, 50_000)]


def test_paths_meet_where_they_all_pass():
    model = spiece.Model([("a", -1.0, spiece.NORMAL), ("b", -1.0, spiece.NORMAL), ("abab", -9.0, spiece.NORMAL)], bpe=False, dummy_prefix=False)
    for last in (["", "a", "b", "ab", "a", "ba"], ["", "a", "b", "a", "abab", "a"], ["", "a"], [""]):
        paths = []
        for k in range(max(0, len(last) - model.longest), len(last)):
            path = {0}
            while k:
                path.add(k)
                k -= len(last[k])
            paths.append(path)
        assert model.met(last) == max(set.intersection(*paths))


def test_language_sample_is_bounded_without_ids(spark):
    s = langid.Settings(per_language=50)
    texts = [f"Ein kurzer Text mit der Nummer {i} und noch etwas mehr." for i in range(600)]
    for seed in range(4):
        s = langid.Settings(per_language=50, seed=seed)
        df = spark.createDataFrame([(None, t, "de") for t in texts] + [(None, "the same row again and again", "en")] * 600, "doc_id bigint, text string, lang string")
        got = Counter(k for k, _ in langid.sample(df, "doc_id", "text", "lang", s))
        assert 20 <= got["de"] <= 100 and got["en"] <= 1


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (1, "http://a/", "y"), (1, "http://b/", "x"), (None, "http://c/", "z"), (None, None, "w"), (2, "http://d/", "x"), (None, "http://c/", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    warc.write_archive(df, str(tmp_path))
    records = warc.parsed(warc.read_records(spark, str(tmp_path)))
    assert records.select("record_id").distinct().count() == len(rows)
    index = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_index(spark, str(tmp_path)).collect())
    assert index == Counter([(1, "revisit", 2), (1, "response", None), (1, "revisit", 2), (None, "response", None), (None, "response", None), (2, "response", None), (None, "revisit", 2)])


@pytest.mark.parametrize("ids", [[1, 1, 1], [None, None, None]])
def test_rows_equal_in_all_share_a_record(spark, tmp_path, ids):
    df = spark.createDataFrame([(i, "http://a/", "x") for i in ids], "page_id bigint, url string, html string")
    warc.write_archive(df, str(tmp_path))
    assert warc.read_index(spark, str(tmp_path)).filter("record_type = 'response'").count() == 3
