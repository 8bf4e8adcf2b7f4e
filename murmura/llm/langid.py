"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read a text's UTF-8 bytes, one forwards and one
backwards. Their joint state labels every byte position with a language
distribution; a document's probabilities are the mean of its positions' log
probabilities, normalised. Bytes of no letter (ASCII digits, marks and blanks) are
read as context and don't vote.

Training is in numpy, by backpropagation through time with Adam, on a bounded
sample: ``per_language`` labelled documents of each language, one window of each.
Prediction covers whole texts: a text is cut into windows of ``window`` bytes that
are read with ``margin`` bytes of context on either side, so that many windows go
through the network side by side and memory doesn't follow the longest text.

A byte's input weights are a table row, so no product over inputs is needed.

Defined results: a null text, and one without a letter, is ``und`` with score 0;
ties go to the alphabetically first language; without any labelled row all is
``und``; each row is predicted for itself from its text alone, and other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.llm.common import parts

UNDETERMINED = "und"
PAD = 256  # after a window's end, where it stands beside longer ones
#: The update gate's input at padding: it shuts, so a state passes unchanged and a window's result doesn't depend on its neighbours.
CLOSED = -30.0


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    per_language: int = 400
    train_window: int = 64
    epochs: int = 8
    least_steps: int = 120
    batch: int = 128
    rate: float = 0.02
    seed: int = 7
    window: int = 512
    margin: int = 24
    side_by_side: int = 2048


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Cell:
    """A gated recurrent unit over bytes: update gate, reset gate, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.p = {
            "table": rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32),
            "gates": rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(np.float32),
            "state": rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32),
        }
        self.p["table"][PAD, :hidden] = CLOSED

    def forward(self, x: np.ndarray, keep: bool = False):
        """States after each step for bytes by (time, row); with ``keep``, also what backpropagation needs."""
        k, p = self.h, self.p
        h, out, trace = np.zeros((x.shape[1], k), np.float32), np.empty((*x.shape, k), np.float32), []
        for t in range(len(x)):
            row = p["table"].take(x[t], axis=0)
            g = row[:, : 2 * k] + h @ p["gates"]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :k], g[:, k:]
            c = row[:, 2 * k :] + (r * h) @ p["state"]
            np.tanh(c, out=c)
            if keep:
                trace.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return (out, trace) if keep else out

    def backward(self, x: np.ndarray, trace: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, from those of the states, back through time."""
        k, p = self.h, self.p
        g = {n: np.zeros_like(v) for n, v in p.items()}
        d_h = np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = trace[t]
            d_h = d_h + d_out[t]
            d_c = d_h * z * (1 - c * c)
            d_z = d_h * (c - h) * z * (1 - z)
            d_rh = d_c @ p["state"].T
            d_r = d_rh * h * r * (1 - r)
            d_g = np.concatenate([d_z, d_r], 1)
            g["state"] += (r * h).T @ d_c
            g["gates"] += h.T @ d_g
            np.add.at(g["table"], x[t], np.concatenate([d_g, d_c], 1))
            d_h = d_h * (1 - z) + d_rh * r + d_g @ p["gates"].T
        return g


class Network:
    def __init__(self, languages: list[str], settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.languages, self.s = languages, settings
        self.cells = [Cell(rng, settings.hidden), Cell(rng, settings.hidden)]
        self.out = {"w": rng.normal(0, 0.3, (2 * settings.hidden, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(time, row, language) for bytes by (time, row)."""
        f, b = self.cells[0].forward(x), self.cells[1].forward(x[::-1])[::-1]
        k = self.s.hidden
        return f @ self.out["w"][:k] + b @ self.out["w"][k:] + self.out["b"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        """Mean cross entropy of all voting positions against their text's language."""
        (f, tf), (b, tb) = self.cells[0].forward(x, True), self.cells[1].forward(x[::-1], True)
        s = np.concatenate([f, b[::-1]], 2)
        p = s @ self.out["w"] + self.out["b"]
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        votes = VOTES[x].astype(np.float32)
        total = max(1.0, votes.sum())
        rows = np.arange(x.shape[1])
        loss = -(np.log(p[:, rows, y] + 1e-9) * votes).sum() / total
        p[:, rows, y] -= 1
        p *= (votes / total)[:, :, None]
        d_s = p @ self.out["w"].T
        k = self.s.hidden
        g_out = {"w": np.einsum("trs,trl->sl", s, p), "b": p.sum((0, 1))}
        return float(loss), [self.cells[0].backward(x, tf, d_s[:, :, :k]), self.cells[1].backward(x[::-1], tb, d_s[::-1, :, k:]), g_out]

    def train(self, windows: list[bytes], labels: list[int]) -> float:
        """Fit to labelled windows; the last epoch's mean loss."""
        s, rng = self.s, np.random.default_rng(self.s.seed)
        x = np.full((s.train_window, len(windows)), PAD, np.int64)
        for i, w in enumerate(windows):
            w = w[: s.train_window]
            x[: len(w), i] = np.frombuffer(w, np.uint8)
        y = np.array(labels)
        groups = [self.cells[0].p, self.cells[1].p, self.out]
        m, v = ([{n: np.zeros_like(a) for n, a in g.items()} for g in groups] for _ in range(2))
        step, loss = 0, 0.0
        for _ in range(max(s.epochs, -(-s.least_steps // -(-len(y) // s.batch)))):
            order, losses = rng.permutation(len(y)), []
            for i in range(0, len(y), s.batch):
                own = order[i : i + s.batch]
                loss, grads = self.gradients(x[:, own], y[own])
                losses.append(loss)
                step += 1
                for group, g, mm, vv in zip(groups, grads, m, v, strict=True):
                    for n in group:
                        d = np.clip(g[n], -1, 1)
                        mm[n] = 0.9 * mm[n] + 0.1 * d
                        vv[n] = 0.999 * vv[n] + 0.001 * d * d
                        group[n] -= (s.rate * (mm[n] / (1 - 0.9**step)) / (np.sqrt(vv[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(document, language) probabilities: every position of every whole text is labelled."""
        s, n = self.s, len(self.languages)
        sums, counts = np.zeros((len(texts), n)), np.zeros(len(texts))
        whole = s.window + 2 * s.margin
        held: list[tuple[int, bytes, int]] = []  # (document, bytes with context, offset of the window's own first byte)
        for i, t in enumerate(texts):
            for a in range(0, len(t), s.window):
                low = max(0, a - s.margin)
                held.append((i, t[low : a + s.window + s.margin], a - low))
        held.sort(key=lambda w: len(w[1]))  # windows of like length go side by side
        for a in range(0, len(held), s.side_by_side):
            part = held[a : a + s.side_by_side]
            x = np.full((min(whole, max(len(w) for _, w, _ in part)), len(part)), PAD, np.int64)
            own = np.zeros(x.shape, bool)
            for j, (_, w, offset) in enumerate(part):
                x[: len(w), j] = np.frombuffer(w, np.uint8)
                own[offset : offset + s.window, j] = True
            own &= VOTES[x]
            z = self.logits(x)
            z -= z.max(2, keepdims=True)
            z -= np.log(np.exp(z).sum(2, keepdims=True))
            docs = np.array([i for i, _, _ in part])
            np.add.at(sums, docs, (z * own[:, :, None]).sum(0))
            np.add.at(counts, docs, own.sum(0))
        mean = sums / np.maximum(counts, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[counts == 0] = 0
        return p


#: Positions that vote: ASCII letters and all bytes of other characters.
VOTES = np.array([65 <= b <= 90 or 97 <= b <= 122 or 128 <= b < 256 for b in range(257)])


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning, by the checksum of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)) == 0, F.lit(False))


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, s: Settings) -> list[tuple[str, bytes]]:
    """At most about ``per_language`` windows of each language, from all over the table.

    Rows are chosen by a hash of their id and text against a share that follows from
    the language's row count, so that no row is favoured by its place, and rows that
    share an id, or have none, are chosen each for itself. Rows equal in both are taken
    once. A window starts at a place in the text that the same hash gives.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(s.seed)).alias("h")).filter("lang IS NOT NULL AND length(text) > 0")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return []
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, s.per_language / n))) for k, n in sorted(counts.items())))
    chosen = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    room = F.greatest(F.length("text") - s.train_window, F.lit(1))
    start = (F.pmod(F.shiftright("h", 20), room) + 1).cast("int")
    got = chosen.select("lang", "h", F.substring("text", start, F.lit(s.train_window)).alias("w")).distinct().collect()
    return sorted((r.lang, r.w.encode("utf-8", "replace")) for r in got)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> Network | None:
    """A network from a bounded sample of labelled rows, or None without any."""
    settings = settings or Settings()
    windows = sample(labelled, id_col, text_col, lang_col, settings)
    languages = sorted({k for k, _ in windows})
    if not languages:
        return None
    net = Network(languages, settings)
    net.train([w for _, w in windows], [languages.index(k) for k, _ in windows])
    return net


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, lang_pred and score."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(net)  # some 100 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in parts(batches):
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for a in range(0, len(known), 512):
                part = known[a : a + 512]
                p = model.documents([texts[i].encode("utf-8", "replace") for i in part])
                for i, k, v in zip(part, p.argmax(1), p.max(1), strict=True):
                    if v > 0:
                        langs[i], scores[i] = model.languages[k], float(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
