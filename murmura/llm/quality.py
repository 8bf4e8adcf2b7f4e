"""Line-first quality rules.

Every line with a word is judged on its own by a punctuation, a navigation and
a boilerplate rule. Lines that fail are removed; a document that loses too much
of its text that way is rejected, as is one that fails the document-wide base
rules. The work is one narrow pass over Arrow batches: no shuffle, and memory
is bounded by a batch and its longest document.

Defined results: a null text counts as empty; an empty text has no words and so
fails the base rule; lines without a word are never removed and never count;
repeated rows are judged each for itself; other columns of the input are left
alone, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from murmura.llm.common import BLANKS, parts

SYMBOLS = "#*$%&|<>"

#: Phrases of site furniture, matched without case. Licence notices are left in: they say what may be done with a text.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "subscribe to our",
    "lorem ipsum",
    "powered by",
    "copyright (c)",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "hier klicken",
    "accepter les cookies",
    "cliquez ici",
    "todos los derechos reservados",
    "aceptar las cookies",
    "haga clic",
)


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the document verdict."""

    #: A line must hold a sentence end: one of these, closing marks, then a blank or the line's end.
    sentence_end: str = r"[.!?:;…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
    #: Marks of shouting and decoration; a line fails at this many and more than one to two words.
    noise: str = SYMBOLS + "!"
    noise_least: int = 6
    #: Separators of menus; a line fails at this many with at most so many words to each part.
    separators: str = "|»›>•·"
    separators_least: int = 3
    words_per_part: int = 4
    boilerplate: tuple[str, ...] = BOILERPLATE
    #: A document is rejected when more than this percentage of its word characters is removed.
    max_loss_percent: int = 30
    #: Base rules.
    min_words: int = 10
    max_repeat_percent: int = 20

    def boilerplate_pattern(self) -> str:
        return "|".join(re.escape(x).replace("\\ ", " ") for x in self.boilerplate)


class LineJudge:
    """The compiled rules."""

    def __init__(self, rules: LineRules):
        self.rules = rules
        self.end = re.compile(rules.sentence_end)
        self.boiler = tuple(x.encode().lower() for x in rules.boilerplate)

    def fails(self, line: str, n_words: int, raw: bytes | None = None) -> str | None:
        """The name of the first rule that a line with words fails, or None. ``raw``: the line in UTF-8, if it is at hand."""
        r = self.rules
        noise = sum(map(line.count, r.noise))
        if noise >= r.noise_least and 2 * noise > n_words or not self.end.search(line):
            return "punctuation"
        parts = sum(map(line.count, r.separators))
        if parts >= r.separators_least and n_words <= r.words_per_part * (parts + 1):
            return "navigation"
        low = (line.encode("utf-8", "surrogatepass") if raw is None else raw).lower()  # of bytes only A-Z change
        return "boilerplate" if any(x in low for x in self.boiler) else None


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = reach = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + width - max(i, reach)
            reach = i + width
    return total


def judge_text(text: str | None, judge: LineJudge) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed, chars_removed, clean_text)"""
    text, r = text or "", judge.rules
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six blanks
    n, chars, repeats = len(words), word_chars(text), repeated_words(words)
    seen: set[str] = set()
    kept_lines, dup, n_lines, removed, lost = [], 0, 0, 0, 0
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        size = len(raw.split())
        if not size:
            kept_lines.append(line)
            continue
        n_lines += 1
        dup += line in seen
        seen.add(line)
        if judge.fails(line, size, raw):
            removed += 1
            lost += word_chars(line)
        else:
            kept_lines.append(line)
    base_failed = n < r.min_words or 100 * repeats > r.max_repeat_percent * n
    kept = not base_failed and 100 * lost <= r.max_loss_percent * chars
    clean = "\n".join(kept_lines) if removed else text
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, base_failed, kept, n_lines, removed, lost, clean


FIELDS = (
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("n_lines", T.LongType()),
    ("n_lines_removed", T.LongType()),
    ("chars_removed", T.LongType()),
    ("clean_text", T.StringType()),
)
ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.large_string()}


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, with_text: bool = True) -> DataFrame:
    """One row per input row: the id, the measures, the verdict and, if asked for, the cleaned text."""
    rules = rules or LineRules()
    fields = FIELDS if with_text else FIELDS[:-1]
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)])
    names = ["doc_id", *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = LineJudge(rules)
        for b in parts(batches):
            rows = [judge_text(t, judge) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], ARROW[t.simpleString()]) for i, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, schema)


def clean_documents(df: DataFrame, text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """The documents that pass, all their columns kept, with failing lines taken out of the text.

    ``n_chars``, where there is such a column, follows the new text.
    """
    rules = rules or LineRules()
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = LineJudge(rules)
        at = names.index(text_col)
        for b in parts(batches):
            rows = [judge_text(t, judge) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([r[10] for r in rows], cols[at].type)
            i = names.index("n_chars") if "n_chars" in names else -1
            if i >= 0 and pa.types.is_integer(cols[i].type):
                cols[i] = pa.array([len(r[10]) for r in rows], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array([r[6] for r in rows], pa.bool_()))

    return df.mapInArrow(run, schema)
