"""The pipeline's stages on the smallest table, each against a plain version of it."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from murmura.llm import jaccard, quality, spiece, sql
from murmura.session import scratch_count


@pytest.fixture(scope="module")
def steps(spark, sf):
    """What goes into each stage and what comes out, as lists of dicts by doc_id."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    # near copies: another last word on every line, so that line dedup leaves them
    near = docs.filter("doc_id % 5 = 0 AND n_chars BETWEEN 800 AND 4000").withColumn("text", F.regexp_replace("text", "(?m)(\\S+)$", "$1x $1.")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    docs = docs.union(near.withColumn("doc_id", F.col("doc_id") + 1_000_000).select(docs.columns))
    for name, stage in P.STAGES:
        got = stage(spark, docs, sf)
        rows = got.collect()
        out.append((name, docs.columns, {r.doc_id: r.asDict() for r in docs.collect()}, got.columns, {r.doc_id: r.asDict() for r in rows}))
        assert len(out[-1][4]) == len(rows)
        docs = spark.createDataFrame(rows, got.schema)
    return {x[0]: x[1:] for x in out}


def table(rows, name="documents"):
    c = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame([(i, r["text"]) for i, r in rows.items()], columns=["doc_id", "text"])  # noqa: F841  read by name
    c.execute(f"CREATE TABLE {name} AS SELECT * FROM frame")
    return c


def unchanged(before, after, but=("text", "n_chars")):
    for i, r in after.items():
        assert {k: v for k, v in r.items() if k not in but} == {k: v for k, v in before[i].items() if k not in but}
        assert r["n_chars"] == len(r["text"] or "") or r == before[i]


def test_quality_stage(steps):
    columns, before, names, after = steps["quality"]
    assert names == columns
    kept = dict(table(before).sql(f"SELECT doc_id, kept FROM ({sql.OP1})").fetchall())
    assert set(after) == {i for i, k in kept.items() if k}
    unchanged(before, after)
    r = quality.LineRules()
    for i, d in after.items():
        lines = []
        for line in before[i]["text"].split("\n"):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            noise, parts = (sum(c in marks for c in line) for marks in (r.noise, r.separators))
            bad = noise >= r.noise_least and 2 * noise > n or not re.search(r.sentence_end, line) or parts >= r.separators_least and n <= r.words_per_part * (parts + 1) or any(p in line.lower() for p in r.boilerplate)
            if not (n and bad):
                lines.append(line)
        assert d["text"] == "\n".join(lines)


def test_line_dedup_stage(steps):
    columns, before, names, after = steps["line_dedup"]
    assert names == columns and set(after) == set(before)
    unchanged(before, after)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")
    first = {}
    for i in sorted(before):
        for line in (before[i]["text"] or "").split("\n"):
            first.setdefault(key(line), i)
    for i, d in after.items():
        lines = (before[i]["text"] or "").split("\n")
        assert d["text"] == "\n".join(x for x in lines if len(key(x)) < 10 or first[key(x)] == i)


def test_near_duplicate_stage(steps):
    columns, before, names, after = steps["near_duplicates"]
    assert names == columns
    unchanged(before, after, ())
    sets = {}
    for i, d in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j > i}:
            n = len(s & sets[j])
            if 100 * n >= jaccard.PERCENT * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in sets if find(i) == i}
    assert len(after) < len(before)


def test_decontamination_stage(steps, sf):
    columns, before, names, after = steps["decontaminate"]
    assert names == columns
    unchanged(before, after, ())
    c = table(before)
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    bad = {r[0] for r in c.sql(f"SELECT doc_id FROM ({sql.OP2})").fetchall()}
    assert set(after) == set(before) - bad


def test_encode_stage(steps):
    import sentencepiece

    _, before, _, after = steps["encode"]
    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    assert {i: list(d["ids"]) for i, d in after.items()} == {i: sp.encode(d["text"] or "") for i, d in before.items()}


def test_run(spark, sf):
    n = scratch_count()
    got = P.run(spark, sf)
    assert scratch_count() == n + 1  # its own folder with the last stage; all else is deleted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame((rows := stage(spark, docs, sf)).collect(), rows.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
