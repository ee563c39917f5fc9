"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. A line's evidence is its own features
and those of the lines before and after it (shares of symbols, capitals, lone
symbols and repeated words, word lengths, and so on); a 2 x 2 table scores
neighbouring labels. The score of a document is the mean of its lines'
forward-backward marginals of being good, weighted by line length in bytes.

Only documents are labelled, so lines start with the label of their document;
after a first fit, lines of bad documents that the model finds good are
relabelled good, but for each document's worst line, and the model is fitted again.

Fitting takes a bounded sample (SAMPLE documents of each label, SAMPLE_BYTES of text)
in one task of an executor. Scoring is one pass without a shuffle, a block of
texts at a time.

Edge cases: a null, empty or blank text has no lines and gets the share of
good documents in the sample. Without labels every score is that share's
default, 0.5. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import BLOCK_BYTES, Words, labelled_sample, lean, remainder, text_blocks, train_remotely

SAMPLE = {0: 3000, 1: 3000}
THRESHOLD = 0.3
HELD_OUT = (5, 0)  # divisor and remainder of the rows that training leaves out

_LOWER, _UPPER, _DIGIT, _PLAIN, _SYMBOL, _WHITE = range(6)
_CLASS = np.full(256, _SYMBOL, np.int8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = _WHITE
_CLASS[list(b".,;:'\"()-?")] = _PLAIN
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[0x80:] = _LOWER  # bytes of letters beyond ASCII, for nearly all text
N_OWN = 16


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines that have words, their lengths, and the number of the first line of each text."""
    w = Words(texts)
    stops = np.flatnonzero(w.data == 10)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
    lo = np.searchsorted(w.begin, begins)
    hi = np.concatenate([lo[1:], [len(w.begin)]]) if len(lo) else lo
    held = hi > lo
    begins, stops, lo, hi = begins[held], stops[held], lo[held], hi[held]
    first = np.searchsorted(begins, w.offset)
    n = len(begins)
    if not n:
        return np.zeros((0, 3 * N_OWN), np.float32), np.zeros(0), first
    kinds = _CLASS[w.data]

    def per_line(marks: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        return (run[stops] - run[begins]).astype(np.float64)

    def per_line_words(marks: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        return (run[hi] - run[lo]).astype(np.float64)

    upper, digit, symbol, white = (per_line(kinds == k) for k in (_UPPER, _DIGIT, _SYMBOL, _WHITE))
    size = (stops - begins).astype(np.float64)
    solid = np.maximum(size - white, 1)
    words = (hi - lo).astype(np.float64)
    lengths = w.end - w.begin
    last = kinds[w.end - 1]
    lone = per_line_words((lengths == 1) & (last == _SYMBOL))
    tail = per_line_words((lengths > 1) & (last == _SYMBOL))
    again = np.zeros(len(w.hash), bool)
    for back in (1, 2, 3):
        again[back:] |= w.hash[back:] == w.hash[:-back]
    again[lo] = False
    repeat = per_line_words(again)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash)])
    content = run[hi] - run[lo]
    same = np.zeros(n)
    same[1:] = content[1:] == content[:-1]
    inner = np.ones(n, bool)
    inner[first[:-1][first[:-1] < n]] = False
    same *= inner
    share = np.stack([upper / solid, digit / solid, symbol / solid, lone / words, tail / words, repeat / words], 1)
    own = np.concatenate(
        [share, np.minimum(1, 4 * share[:, [0, 2, 3, 4, 5]]), np.stack([np.log1p(words) / 5, size / words / 20, per_line_words(lengths <= 3) / words, same, np.ones(n)], 1)], 1
    ).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * inner[1:, None]
    after[:-1] = own[1:] * inner[1:, None]
    return np.concatenate([own, before, after], 1), size, first


@dataclass
class Chain:
    """Weights of the label good, and scores of neighbouring labels (bad, good)."""

    weights: np.ndarray
    edges: np.ndarray
    prior: float

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(good) of each line; with ``pairs`` also the expected counts of neighbouring labels."""
        s = np.clip(x @ self.weights, -30, 30)
        good = 1 / (1 + np.exp(-s))
        node = np.stack([1 - good, good], 1)
        table = np.exp(self.edges)
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        start, lengths = first[:-1][order], lengths[order]
        ahead, behind = node.copy(), np.ones_like(node)
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts with more than t lines
        for t in range(1, steps):
            at = start[: active[t]] + t
            a = (ahead[at - 1] @ table) * node[at]
            ahead[at] = a / a.sum(1, keepdims=True)
        for t in range(steps - 1, 0, -1):
            at = start[: active[t]] + t
            b = (node[at] * behind[at]) @ table.T
            behind[at - 1] = b / b.sum(1, keepdims=True)
        both = ahead * behind
        out = both[:, 1] / both.sum(1)
        if not pairs:
            return out
        later = np.ones(len(x), bool)
        later[first[:-1][lengths_of(first) > 0]] = False
        at = np.flatnonzero(later)
        xi = ahead[at - 1][:, :, None] * table * (node[at] * behind[at])[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        return out, at, xi.sum(0)


def lengths_of(first: np.ndarray) -> np.ndarray:
    return np.diff(first)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 120) -> Chain:
    """Maximum likelihood by Adam, lines relabelled between rounds. ``label``: of each text."""
    prior = float(label.mean()) if len(label) else 0.5
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)), prior)
    counts = np.diff(first)
    if not len(x) or label.min() == label.max():
        return Chain(chain.weights, chain.edges, prior)
    of = np.repeat(np.arange(len(counts)), counts)
    y = label[of].astype(np.float64)
    # each text weighs alike, and both labels together alike
    weight = (1 / np.maximum(counts, 1))[of] * np.where(y > 0, 0.5 / max(prior, 1e-3), 0.5 / max(1 - prior, 1e-3))
    weight = np.minimum(weight / weight.mean(), 10)
    for r in range(rounds):
        m = [np.zeros_like(chain.weights), np.zeros((2, 2))]
        v = [np.zeros_like(chain.weights), np.zeros((2, 2))]
        for k in range(1, steps + 1):
            p, at, expected = chain.marginals(x, first, pairs=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
            g = [x.T @ (weight * (y - p)) / len(x) - 1e-4 * chain.weights, (seen - expected) / len(x) - 1e-3 * chain.edges]
            for i, name in enumerate(("weights", "edges")):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
                setattr(chain, name, getattr(chain, name) + 0.1 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8))
        if r + 1 < rounds:
            p = chain.marginals(x, first)
            worst = np.full(len(counts), np.inf)
            np.minimum.at(worst, of, p)
            y = np.where(label[of] > 0, 1.0, ((p > 0.6) & (p > worst[of])).astype(np.float64))
    return chain


def scores(chain: Chain, texts: list[bytes]) -> np.ndarray:
    x, size, first = line_features(texts)
    p = chain.marginals(x, first) if len(x) else np.zeros(0)
    top, under = (np.concatenate([[0.0], np.cumsum(v)]) for v in (p * size, size))
    total = under[first[1:]] - under[first[:-1]]
    return np.where(total > 0, (top[first[1:]] - top[first[:-1]]) / np.where(total > 0, total, 1), chain.prior)


def fit_texts(texts: list[bytes], label: np.ndarray) -> Chain:
    """A chain from whole texts; their features are made a block at a time."""
    xs, counts, at = [], [], 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK_BYTES):
            held += len(texts[end])
            end += 1
        x, _, first = line_features(texts[at:end])
        xs.append(x.astype(np.float32))
        counts.append(np.diff(first))
        at = end
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)
    return fit(np.concatenate([np.zeros((0, 3 * N_OWN), np.float32), *xs]).astype(np.float64), first, label)


def train(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] = SAMPLE) -> Chain:
    return train_remotely(labelled_sample(docs, labels, "quality", *HELD_OUT, bounds), fit_texts)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            s = np.clip(scores(chain, texts), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = rows.mapInArrow(lean(run), "doc_id bigint, score double, predicted int")
    return out.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", "predicted")
