"""SentencePiece encoding and decoding by a streaming Viterbi search.

A trellis runs over the characters of a normalised text; the arcs into a position
are the pieces that end there. Only positions that a piece can still start from
survive, at most the longest piece's length of them, and each has one best arc
back. Whenever the paths back from all survivors meet in one boundary, the pieces
before it are committed and forgotten, so memory follows the longest piece and not
the text, as long as paths do meet. A unigram model can have two that never do (pieces
``a`` and ``aa`` on a run of that letter): then both are kept until the run ends, and
looked at ever less often, so that time stays linear. Every segment, short or long,
takes this one search; survivors are looked at when twice as many characters have come
in as the longest piece has, and where their paths didn't meet, when half as many more
have as are kept.

What makes an arc best depends on the model:

* unigram: the highest sum of piece scores;
* BPE: the order of merges. A sequence of pieces is what merging produces exactly
  if each neighbouring pair, taken alone, is; and every prefix has just one such
  sequence. So the best arc into a position is the one whose piece is compatible
  with the best piece before it. Ids equal those of merging, in one pass; adding
  up scores instead would not give a merging model's ids.

A boundary that no piece of the vocabulary can span is met by every path, so texts
are committed there at once: before a word mark that follows another character,
and around characters that no piece has. What lies between is looked up in a
bounded memo before it is searched.

Defined results: a null or empty text has no ids and decodes to empty; characters
without a piece become their UTF-8 bytes where the model has byte pieces, else a run
of them becomes one unknown id; a model with a normaliser or with user-defined symbols is refused when it
is loaded; lone surrogates are encoded as the replacement character; a word mark in the text
is taken as a space; very long
texts and very long words are streamed; each row is encoded for itself and other
columns aren't read.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from murmura.llm.common import parts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segments that a Python worker remembers: those of the last one to two fillings of a table of this size.
MEMO = 500_000
#: Characters of a long text to a stretch that is cut into segments at a time.
STRETCH = 1 << 16
#: Compatible pairs that a Python worker remembers.
PAIRS = 1_000_000
#: Piece types of the model format; what an unknown character costs below the lowest score.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


class Model:
    """A vocabulary: (piece, score, type) by id, and whether it merges."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True, reachable: set[str] | None = None):
        self.pieces, self.bpe, self.dummy_prefix = pieces, bpe, dummy_prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.reachable = {p for p in self.ids if not bpe or self.merged(p) == [p]} if reachable is None else reachable
        self.walk = None
        self.inner = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}  # neighbours that some piece spans
        chars = {c for p in self.ids for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in chars)
        marked = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.segments = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+") if marked else re.compile(r"(?s).+")
        self.table = [self._decoded(p, t) for p, _, t in pieces]
        self.packed: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        """From a model file that the driver can read; executors get the object."""
        import sentencepiece

        return cls.of_proto(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())

    @classmethod
    def of_proto(cls, data: bytes) -> Model:
        """From a serialised model; one whose texts would have to be changed or cut otherwise first is refused."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        rules, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the model normalises its texts: only an identity normaliser that keeps all spaces is supported")
        if kind not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with leading word marks are supported")
        if any(x.type == USER for x in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        return cls([(x.piece, x.score, x.type) for x in proto.pieces], bpe=kind == pb.TrainerSpec.BPE, dummy_prefix=rules.add_dummy_prefix)

    def __reduce__(self):
        return Model, (self.pieces, self.bpe, self.dummy_prefix, self.reachable)

    @staticmethod
    def _decoded(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b" \xe2\x81\x87 " if kind == UNKNOWN else b""

    # -- merging on a few characters: the definition that pairs are tested by

    def merged(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    # -- the trellis

    def stream(self, s: str) -> Iterator[list[str]]:
        """The pieces of a segment, as soon as they are certain.

        Positions are counted from the last commitment on; ``last`` holds the best arc
        into each that isn't committed yet. The automaton gives the arcs into a position
        from the longest piece to the shortest.
        """
        last: list[str] = [""]
        best = [0.0]
        done, check, bpe, pairs, score = 0, 2 * self.longest, self.bpe, self.pairs, self.score
        n, top = 0, None  # positions with an arc; unigram: the best sum into the next one
        for e, p in self.automaton().iter(s):
            if e < n:
                continue  # has its arc
            while n < e:  # a character that no arc was found for, or whose best sum is known now
                self.close(last, best, s[n], top)
                n, top = n + 1, None
                if n - done == check:
                    if at := self.met(last):
                        yield self.back(last, at)
                        del last[:at], best[: 0 if bpe else at]  # what ends at the boundary stays, as the left neighbour of what follows
                        done += at
                    check = 2 * self.longest if at else check + max(self.longest, check // 2)
            k = e + 1 - len(p)
            if k < done:
                continue
            if bpe:
                if k and len(p) > 1:
                    key = (last[k - done], p)
                    fits = pairs.get(key)
                    if not (fits if fits is not None else self.compatible(*key)):
                        continue
                last.append(p)
                n = e + 1
                if n - done == check:
                    if at := self.met(last):
                        yield self.back(last, at)
                        del last[:at]
                        done += at
                    check = 2 * self.longest if at else check + max(self.longest, check // 2)
            else:
                v = best[k - done] + score[p]
                if top is None or v > top[0]:  # of equal sums the longer piece
                    top = v, p
        for c in s[n:]:
            self.close(last, best, c, top)
            top = None
        yield self.back(last, len(s) - done)

    def close(self, last: list[str], best: list[float], c: str, top: tuple[float, str] | None) -> None:
        """The arc into the next position: the best one found, or the character alone where it is no piece."""
        if not self.bpe:
            v = best[-1] + self.unknown_score
            if top is None or c not in self.score and v > top[0]:
                top = v, c
            best.append(top[0])
        last.append(top[1] if top else c)

    def automaton(self):
        """Of all pieces that a text can hold, made once in each process."""
        if self.walk is None:
            import ahocorasick

            self.walk = ahocorasick.Automaton()
            for p in self.reachable:
                self.walk.add_word(p, p)
            if len(self.walk):
                self.walk.make_automaton()
            else:
                self.walk.add_word("\ue000" * 2, "")
                self.walk.make_automaton()
        return self.walk

    def met(self, last: list[str]) -> int:
        """The last boundary that the paths back from all survivors share; 0 if none but the committed one."""
        k = len(last) - 1
        heads = set(range(max(0, k - self.longest + 1), k + 1))
        while len(heads) > 1:  # the one furthest on goes a piece back, until all stand at one boundary
            if k in heads:
                heads.remove(k)
                heads.add(k - len(last[k]))
            k -= 1
        return heads.pop()

    @staticmethod
    def back(last: list[str], i: int) -> list[str]:
        out = []
        while i > 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    # -- texts

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        raw = piece.encode("utf-8", "replace") if not "\ud800" <= piece <= "\udfff" else "�".encode()
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def segment_ids(self, s: str) -> bytes:
        """The ids of a segment, as 32-bit words; from the memo, or by searching it between boundaries that no piece spans."""
        inner = self.inner
        cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in inner]
        if not cuts:
            return self.searched(s)
        known = self.memo.get
        found = b"".join([known(x) or self.searched(x) for x in [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]])
        if len(cuts) == 1 and len(s) - cuts[0] == 1:  # a word with one mark after it is worth its own entry
            self.remember(s, found)
        return found

    def searched(self, s: str) -> bytes:
        found = self.older.get(s)
        if found is None:
            packed = self.packed
            found = b"".join([packed.get(p) or self.pack(p) for pieces in self.stream(s) for p in pieces])
        self.remember(s, found)
        return found

    def remember(self, s: str, found: bytes) -> None:
        if len(s) <= 64:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[s] = found

    def pack(self, piece: str) -> bytes:
        out = array("i", self.piece_ids(piece)).tobytes()
        if piece in self.ids:
            self.packed[piece] = out
        return out

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        at, n = 0, len(marked)
        while at < n:
            end = self.boundary(marked, at + STRETCH) if n - at > 2 * STRETCH else n
            parts = self.segments.findall(marked, at, end)
            found = list(map(self.memo.get, parts))
            if None in found:
                older = self.older.get
                found = [f if f is not None else older(p) or self.segment_ids(p) for f, p in zip(found, parts, strict=True)]
            out.frombytes(b"".join(found))
            at = end
        if not self.bytes and self.unknown in out:  # a run of unknown characters counts once
            out = array("i", [x for i, x in enumerate(out) if x != self.unknown or not i or out[i - 1] != x])
        return out

    def boundary(self, s: str, i: int) -> int:
        """The first place from ``i`` on that no piece spans, or the end."""
        while i < len(s) and s[i - 1 : i + 1] in self.inner:
            i += 1
        return i

    def decode(self, ids) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) for each input row: the ids, and whether they decode to the text again."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(Model.load(model))  # a vocabulary: some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value  # made once in each Python worker, with its memo
        if m.walk is None:
            m.automaton()
            gc.freeze()  # the vocabulary stays: no use in looking through it for garbage
        for b in parts(batches):
            flat, ends, same = array("i"), array("i", [0]), []
            for t in b.column(1).to_pylist():
                ids = m.encode(t)
                flat.extend(ids)
                ends.append(len(flat))
                same.append(m.decode(ids) == (t or ""))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            sizes = pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, ids, pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids bigint, ids array<int>, round_trip boolean")


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) for each input row of ids; null ids decode to an empty text."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(Model.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value  # made once in each Python worker, with its memo
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or ()) for x in b.column(1).to_pylist()], pa.large_string())], names=["doc_id", "text"])

    return df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
