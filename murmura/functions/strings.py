"""Text functions: splitting, parsing and the recording-name convention."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_class(delimiters: str) -> str:
    return "[" + "".join(re.escape(c) for c in delimiters) + "]"


def split(s: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters, empty ones kept; an empty text is one empty part."""
    return F.split(s, char_class(delimiters), -1)


def split_non_empty(s: Column, delimiters: str) -> Column:
    return F.filter(split(s, delimiters), lambda x: x != "")


def part(s: Column, delimiters: str, n: int) -> Column:
    """The n-th part (from 0), or null."""
    return F.get(split(s, delimiters), F.lit(n))


def remove_char(s: Column, c: str) -> Column:
    return F.translate(s, c, "")


def replace_chars(s: Column, chars: str, by: str) -> Column:
    return F.translate(s, chars, by * len(chars))


def to_int(s: Column) -> Column:
    """The leading integer, 0 where there is none."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def to_float(s: Column) -> Column:
    """The leading number, 0 where there is none."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def float_text(x: Column, digits: int | None = None) -> Column:
    """Six decimals, of which ``digits`` are kept without rounding again."""
    s = F.format_string("%.6f", x)
    return s if digits is None else F.regexp_extract(s, rf"^-?\d+\.\d{{{digits}}}" if digits else r"^-?\d+", 0)


def is_blank(s: Column) -> Column:
    return s.rlike(r"^[ \t\n]*$")


def pack(s: Column) -> Column:
    """Without spaces, tabs and line feeds at the ends."""
    return F.btrim(s, F.lit(" \t\n"))


# Recordings are named <site>_<yyyymmdd>_<hhmmss>_<other>.<ext>


def name_parts(name: Column) -> Column:
    return split(name, "_.")


def site(name: Column) -> Column:
    return F.when(F.size(name_parts(name)) > 4, F.get(name_parts(name), F.lit(0)))


def recorded_at(name: Column) -> Column:
    """Time of recording, null where the name doesn't follow the convention."""
    p = name_parts(name)
    text = F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(2)))
    return F.when((F.size(p) > 4) & text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def hour(name: Column) -> Column:
    return F.hour(recorded_at(name))


def year(name: Column) -> Column:
    return F.year(recorded_at(name))


def date(name: Column) -> Column:
    return F.to_date(recorded_at(name))
