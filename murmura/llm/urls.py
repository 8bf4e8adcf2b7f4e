"""URL filter: one trie over reversed host labels, then path segments.

Allow and block entries sit in the same trie and the longest one that fits a url
decides, whichever list it comes from. The trie is built on the driver from the
rule list and is broadcast; ``MAX_RULES`` bounds it.
Looking a url up walks at most as many nodes as the url has labels and segments, and
tries no more of a segment than the longest entry there has.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; an empty rule list gives the default verdict everywhere; of
two equal rules the block entry wins; each row is judged for itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from murmura.llm.common import parts

#: Entries that a trie may hold: at some 200 bytes each it stays under 200 MB.
MAX_RULES = 1_000_000


class Node:
    """``next``: the following labels or segments. ``ends``: partial segments that end a rule here, ``longest`` of so many characters."""

    __slots__ = ("ends", "longest", "next", "path", "verdict", "rule")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.longest = 0
        self.path: Node | None = None
        self.verdict: str | None = None
        self.rule: str | None = None


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the rules see them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return ascii_lower(host), slash + path


#: A-Z to a-z and nothing else.
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def ascii_lower(s: str) -> str:
    return s.translate(LOWER)


class UrlTrie:
    """Rules are (verdict, host, path): the path is a prefix, with its first slash."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; a broadcast trie takes {MAX_RULES}")
        self.root = Node()
        for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):
            node = self.root
            for label in reversed(ascii_lower(host).split(".")):
                node = node.next.setdefault(label, Node())
            node.path = node.path or Node()
            node = node.path
            *whole, last = path.split("/")
            for segment in whole:
                node = node.next.setdefault(segment, Node())
            node.ends[last] = (verdict, host + path)
            node.longest = max(node.longest, len(last))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits: the most labels, then the longest path."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.path is not None:
                found = self.along(node.path, path) or found
        return found

    @staticmethod
    def along(node: Node, path: str) -> tuple[str, str] | None:
        found = None
        for segment in path.split("/"):
            if node.ends:
                for size in range(min(len(segment), node.longest), -1, -1):
                    if hit := node.ends.get(segment[:size]):
                        found = hit
                        break
            node = node.next.get(segment)
            if node is None:
                break
        return found


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null where none fits) and verdict."""
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))  # of at most MAX_RULES rules
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in parts(batches, 4096):
            split = [split_url(u) for u in b.column(1).to_pylist()]
            hits = [trie.find(*x) if x[0] else None for x in split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in split], [p for _, p in split], [h and h[1] for h in hits], [h[0] if h else default for h in hits]))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return df.select(df[id_col].alias("page_id"), df[url_col].alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
