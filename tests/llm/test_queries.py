"""The registered queries on the smallest tables: against SQL, or against brute force."""

import hashlib

import pytest

from compare import assert_same
from murmura.llm import queries, spiece, tokens

NAMES = sorted(queries.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    if name in queries.oracle_sql():
        assert_same(df, duck.sql(queries.oracle_sql()[name]))
    else:
        assert df.count() > 0


def test_token_counts_against_brute_force(spark, sf, duck):
    import bisect

    enc = tokens.encoder(tokens.load_vocabulary())
    sizes = sorted(len(enc.encode_ordinary(t or "")) for (t,) in duck.sql("SELECT text FROM documents").fetchall())
    got = queries.op3_token_counts(spark, sf).collect()
    assert [r.length for r in sorted(got)] == sorted(set(sizes))
    for r in got:
        over = len(sizes) - bisect.bisect_right(sizes, r.length)
        assert (r.n_docs, r.docs_over, r.tokens_over) == (sizes.count(r.length), over, sum(s for s in sizes if s > r.length))
        assert (r.total_docs, r.total_tokens, r.truncated_total) == (len(sizes), sum(sizes), sum(min(s, r.length) for s in sizes))
        assert r.quantile == pytest.approx((len(sizes) - over) / len(sizes))
    sums = queries.op3_token_counts(spark, sf).cache()
    assert tokens.truncated_total(sums, 100) == sum(min(s, 100) for s in sizes)
    assert tokens.quantile_length(sums, 0.5) == sizes[(len(sizes) + 1) // 2 - 1]


def test_sentencepiece_against_the_library(spark, sf, duck):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    want = {i: sp.encode(t or "") for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    rows = queries.op5_sentencepiece(spark, sf).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == want
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows)


def test_language_held_out(spark, sf, duck):
    import zlib

    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op6_language_id(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.9


def test_personal_data_against_brute_force(spark, sf, duck):
    import re

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub(r"[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
    )
    got = {r.doc_id: r for r in queries.op10_pii(spark, sf).collect()}
    total = 0
    for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        spans = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m.group())]
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, _, _ in kinds] == [sum(x[2] == k for x in spans) for k, _, _ in kinds]
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
        total += len(spans)
    assert total > 10


def test_added_personal_data_against_brute_force(spark, sf, duck):
    """Account numbers and nine-digit numbers by trying every place in turn."""
    import re

    from murmura.llm import pii

    def sound(s):
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    def account_at(t, i):
        if i and re.match(r"[A-Z0-9]", t[i - 1]) or not re.match(r"[A-Z]{2}[0-9]{2}", t[i : i + 4]):
            return None
        own = pii.IBAN_LENGTHS.get(t[i : i + 2])
        best, chars, j = None, "", i
        while j < len(t):
            if not re.match(r"[A-Z0-9]", t[j]):
                if t[j] != " " or not chars or j + 1 >= len(t) or not re.match(r"[A-Z0-9]", t[j + 1]):
                    break
                j += 1
                continue
            chars += t[j]
            j += 1
            follows = t[j : j + 1]
            if 15 <= len(chars) <= 34 and len(chars) == (own or len(chars)) and sound(chars) and not re.match(r"[A-Za-z0-9]", follows):
                best = j
        return best

    def spans(t):
        out, i = [], 0
        while i < len(t):
            end = account_at(t, i)
            if end:
                out.append((i, "iban", end))
            i = end or i + 1
        for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", t):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                out.append((m.start(), "ssn", m.end()))
        policy = pii.Policy()
        return {f"{k}:{s}:{e}" for s, k, e in out if pii.score(t, s, k, e, policy) >= policy.least_score}

    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    made = ["IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 OK", "account ZZ GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789, not 000-12-3456 nor 123-00-4567", "bank NO9386011117947 X1", "DE89370400440532013000DE89370400440532013000"]
    df = spark.createDataFrame([*texts.items(), *((-1 - i, t) for i, t in enumerate(made))], "doc_id bigint, text string")
    every = {**texts, **{-1 - i: t for i, t in enumerate(made)}}
    total = 0
    for r in pii.scan(df, with_text=False).collect():
        want = spans(every[r.doc_id] or "")
        assert {x for x in r.spans.split(",") if x.startswith(("iban:", "ssn:"))} == want, r.doc_id
        total += len(want)
    assert total >= 4


def test_language_prediction_against_plain_steps(spark, sf):
    """Documents whose windows are labelled one position at a time, in float64 and without batches."""
    import numpy as np

    from murmura.llm import langid

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.fit(docs, settings=langid.Settings(hidden=8, window=40, margin=8, per_language=30))
    s = net.s

    def states(cell, data):
        h, out = np.zeros(s.hidden), []
        for byte in data:
            row = cell.p["table"][byte].astype(float)
            g = 1 / (1 + np.exp(-(row[: 2 * s.hidden] + h @ cell.p["gates"])))
            z, r = g[: s.hidden], g[s.hidden :]
            h = h + z * (np.tanh(row[2 * s.hidden :] + (r * h) @ cell.p["state"]) - h)
            out.append(h)
        return out

    def plain(text):
        t, total, n = text.encode("utf-8", "replace"), np.zeros(len(net.languages)), 0
        for a in range(0, len(t), s.window):
            low = max(0, a - s.margin)
            w = t[low : a + s.window + s.margin]
            f, b = states(net.cells[0], w), states(net.cells[1], w[::-1])[::-1]
            for i in range(a - low, min(a - low + s.window, len(w))):
                if langid.VOTES[w[i]]:
                    z = np.concatenate([f[i], b[i]]) @ net.out["w"] + net.out["b"]
                    total += z - np.log(np.exp(z).sum())
                    n += 1
        p = np.exp(total / n - (total / n).max())
        return p / p.sum()

    short = docs.filter("length(text) BETWEEN 30 AND 600").orderBy("doc_id").limit(15).cache()
    got = {r.doc_id: r for r in langid.predict(short, net).collect()}
    for d in short.collect():
        p = plain(d.text)
        assert got[d.doc_id].score == pytest.approx(p.max(), abs=1e-4) and got[d.doc_id].lang_pred == net.languages[int(p.argmax())]
