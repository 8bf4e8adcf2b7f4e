"""Personal data: patterns propose spans, checksums confirm them, context scores them.

For each kind a pattern proposes spans from left to right without overlap. A
validator then confirms or drops each: Luhn for cards, mod-97 for account
numbers, ranges for addresses, digit counts for phones. Words in the ``window``
code points on either side raise or lower a confirmed span's score. Base kinds
(email, ip, card, phone) are kept whatever their score; kinds that the method
adds (iban; nine-digit personal numbers) must also reach ``Policy.least_score``.

One narrow pass over Arrow batches without a shuffle. Each pattern is anchored
so that it scans a text in time proportional to its length, however long a run
of digits or letters in it is.

Defined results: a null or empty text has no spans; offsets are code points with
an exclusive end; spans of different kinds may overlap and all are reported;
redaction replaces the union of overlapping spans once, by the first one's kind;
each row is judged for itself and other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from murmura.llm.common import parts

#: In order of ties.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: An address from its @ on; what stands before is found by stepping back, so that no run is scanned twice.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What an account number can reach at most; ``account_end`` cuts it.
IBAN = re.compile(r"(?=(?<![A-Z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+))")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Length of an account number by country; others are tried from 15 to 34.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Words that speak for a kind, and words that speak against any.
FOR = {
    "email": ("email", "e-mail", "mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "expires"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer", "security number"),
}
AGAINST = ("example", "sample", "version", "dummy", "test")
STRENGTH = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}


@dataclass(frozen=True)
class Policy:
    window: int = 40
    bonus: float = 0.2
    malus: float = 0.2
    least_score: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97_lengths(s: str) -> list[int]:
    """The lengths from 15 on at which a start of ``s`` is a sound account number, by one running remainder."""
    head = int("".join(str(int(c, 36)) for c in s[:4]))  # of six digits
    found, rest = [], 0
    for i, c in enumerate(s[4:], 5):
        v = int(c, 36)
        rest = (rest * (10 if v < 10 else 100) + v) % 97
        if i >= 15 and (rest * 1_000_000 + head) % 97 == 1:
            found.append(i)
    return found


def account_end(text: str, start: int, reach: str) -> int | None:
    """Where the account number that starts here ends, or None: at its country's length, or at the longest that is sound where the country isn't listed."""
    length = IBAN_LENGTHS.get(reach[:2])
    places = [i for i, c in enumerate(reach, start + 1) if c != " "]
    if length and length > len(places):
        return None
    for n in reversed(mod97_lengths(reach.replace(" ", "")[:length])):
        follows = text[places[n - 1] : places[n - 1] + 1]
        if n == (length or n) and not (follows.isascii() and follows.isalnum()):
            return places[n - 1]
    return None


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in AT_DOMAIN.finditer(text):
        start = at = m.start()
        while start > last:  # back by growing steps to the start of the run
            step = max(last, start - 64)
            rest = text[step:start].rstrip(LOCAL)
            start = step + len(rest)
            if rest:
                break
        if start < at:
            yield start, m.end()
            last = m.end()


def ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def proposals(text: str) -> Iterator[tuple[int, str, int]]:
    """Confirmed spans as (start, kind, end), kind by kind."""
    if "@" in text:
        yield from ((s, "email", e) for s, e in emails(text))
    for m in IP.finditer(text) if "." in text else ():
        if ip_ok(m.group()):
            yield m.start(), "ip", m.end()
    for m in CARD.finditer(text):
        d = digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            yield m.start(), "card", m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m.group())) <= 15:
                yield m.start(), "phone", m.end()
    last = 0
    for m in IBAN.finditer(text):
        if m.start() >= last and (end := account_end(text, m.start(), m.group(1))):
            yield m.start(), "iban", end
            last = end
    if "-" in text:
        for m in SSN.finditer(text):
            area, group, serial = m.group().split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield m.start(), "ssn", m.end()


CONTEXT = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b", re.IGNORECASE) for k, v in FOR.items()}
CONTEXT_AGAINST = re.compile(r"\b(?:" + "|".join(AGAINST) + r")\b", re.IGNORECASE)


def score(text: str, start: int, kind: str, end: int, policy: Policy) -> float:
    """The kind's strength, raised or lowered by words nearby."""
    near = text[max(0, start - policy.window) : start] + "\n" + text[end : end + policy.window]
    s = STRENGTH[kind] + policy.bonus * bool(CONTEXT[kind].search(near)) - policy.malus * bool(CONTEXT_AGAINST.search(near))
    return min(1.0, max(0.0, s))


def find_spans(text: str | None, policy: Policy | None = None) -> list[tuple[int, str, int, float]]:
    """All spans of a text as (start, kind, end, score), by start and then kind."""
    if not text:
        return []
    policy = policy or Policy()
    spans = [(s, k, e, score(text, s, k, e, policy)) for s, k, e in proposals(text)]
    spans = [x for x in spans if x[1] in BASE_KINDS or x[3] >= policy.least_score]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[1])))


def redact(text: str | None, spans: list[tuple[int, str, int, float]]) -> str | None:
    """The text with each union of overlapping spans replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, str, int, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy | None = None, with_text: bool = True) -> DataFrame:
    """One row per input row: counts by base kind, the digest of base spans, all spans, their scores and, if asked for, the redacted text."""
    policy = policy or Policy()
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = b.column(1).to_pylist()
            found = [find_spans(t, policy) for t in texts]
            base = [[x for x in f if x[1] in BASE_KINDS] for f in found]
            cols = {"doc_id": b.column(0)}
            for k in BASE_KINDS:
                cols[f"n_{k}"] = pa.array([sum(x[1] == k for x in f) for f in base], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string())
            cols["spans"] = pa.array([joined(f) for f in found], pa.string())
            cols["scores"] = pa.array([[round(x[3], 3) for x in f] for f in found], pa.list_(pa.float64()))
            if with_text:
                cols["redacted"] = pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.large_string())
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores array<double>" + ", redacted string" * with_text
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, schema)
