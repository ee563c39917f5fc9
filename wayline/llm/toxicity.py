"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is a row of words (runs of letters and digits, A-Z folded). A word's
input joins a word embedding, the mean of the embeddings of its four-byte
character sequences, and how over-represented the worst of these is
in toxic documents. Windows of WINDOW words, each overlapping the next by
half, run through a gated recurrent unit in both directions; attention pools
the states, one output unit gives the window's logit. A document's logit is
the largest of its windows', turned into a probability by a fitted scale.

Only documents are labelled. Training starts from the windows of toxic
documents whose words are the most over-represented there, and then takes the
windows that the network itself finds worst; windows of other documents are all
negative, the hard ones are kept. Everything is numpy. Training takes a
bounded sample (SAMPLE documents of each label, SAMPLE_BYTES of text) in one task; scoring is one
pass without a shuffle over every window of every text.

Edge cases: null texts, and texts without words, get the score of an empty
window. Without labels of both kinds every score is the sample's share of
toxic documents, or 0. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import WHITE, Words, labelled_sample, lean, remainder, text_blocks, train_remotely

SAMPLE = {0: 1800, 1: 900}
THRESHOLD = 0.7
HELD_OUT = (3, 1)
WINDOW, STEP = 24, 12
CHAR_BITS = 20  # of the codes of character sequences
MIN_TEXTS = 3  # in so many texts of the sample a word or sequence must stand to get a row of its own
WORD_DIM, CHAR_DIM, HIDDEN = 6, 4, 6
STEPS, BATCH = 120, 192
REPEATS = 400  # windows added to the sample
CHANCE = 3.0  # deviations that counts of many words reach by themselves
TABLE_RATE = 0.05  # embedding tables learn slower than the network, as each row sees few texts

_BETWEEN = WHITE.copy()
_BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Vocabulary:
    """Distinct words of some texts: hashes, codes of each one's character sequences, and which word stands where.

    A network's ``index`` turns hashes and codes into rows of its tables."""

    word: np.ndarray
    grams: np.ndarray  # of all character sequences, word after word
    cuts: np.ndarray  # where each word's sequences begin, and the end
    which: np.ndarray  # the distinct word at each place of the texts
    first: np.ndarray  # first place of each text


def vocabulary(texts: list[bytes]) -> Vocabulary:
    w = Words(texts, _BETWEEN)
    distinct, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
    begin, size = w.begin[at], (w.end - w.begin)[at]
    cuts = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], size)
    data = np.concatenate([[32], _FOLD[np.where(_BETWEEN, 32, np.arange(256))[w.data]], [32, 32]]).astype(np.uint32)
    gram = data[place] * np.uint32(0x9E3779B1) + data[place + 1] * np.uint32(0x85EBCA6B) + data[place + 2] * np.uint32(0xC2B2AE35)
    # the word with a space on either side; what follows it is no part of it
    gram += np.where(place + 2 <= np.repeat(begin + size, size), data[place + 3], 0).astype(np.uint32) * np.uint32(0x27D4EB2F)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x2C1B3C6D)
    return Vocabulary(distinct, (gram >> np.uint32(32 - CHAR_BITS)).astype(np.int32), cuts, which, w.first)


def whole_vocabulary(texts: list[bytes], block: int = 1 << 20) -> Vocabulary:
    """The same for many texts, made of a block of them at a time."""
    parts, at, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= block or i + 1 == len(texts):
            parts.append(vocabulary(texts[at : i + 1]))
            at, held = i + 1, 0
    if not parts:
        return vocabulary([])
    word = np.concatenate([p.word for p in parts])
    distinct, index, which = np.unique(word, return_index=True, return_inverse=True)
    starts = np.cumsum([0] + [len(p.word) for p in parts])
    places = np.cumsum([0] + [p.first[-1] for p in parts])
    size = np.concatenate([np.diff(p.cuts) for p in parts])
    begin = np.cumsum(size) - size
    grams, cuts = _spread(np.concatenate([p.grams for p in parts]), begin[index], size[index])
    first = np.concatenate([p.first[:-1] + k for p, k in zip(parts, places, strict=False)] + [places[-1:]])
    return Vocabulary(distinct, grams, cuts, np.concatenate([which[s + p.which] for p, s in zip(parts, starts, strict=False)]), first)


def _spread(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values (begin, size) one after another, and where they begin."""
    cuts = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], size)], cuts


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each window (-1: none), and the text of each window; a text without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    of = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(nth * STEP, np.maximum(n[of] - WINDOW, 0))
    place = start[:, None] + np.arange(WINDOW)
    return np.where(place < n[of][:, None], place + first[:-1][of][:, None], -1), of


@dataclass
class Network:
    known: np.ndarray  # sorted hashes of the words with rows; row 0 is for all others
    gram_row: np.ndarray  # row of each code; 0 for all others
    word: np.ndarray  # (rows, WORD_DIM)
    char: np.ndarray  # (rows, CHAR_DIM)
    gram_excess: np.ndarray  # (rows,), fixed
    w: np.ndarray  # (WORD_DIM + CHAR_DIM + 1, 6 * HIDDEN): update, reset, candidate; forward then backward
    b: np.ndarray
    u: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    attend: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    NAMES = ("word", "char", "w", "b", "u", "attend", "out", "bias")

    def index(self, v: Vocabulary) -> Vocabulary:
        at = np.searchsorted(self.known, v.word)
        at[at == len(self.known)] = 0
        rows = np.where(self.known[at] == v.word, at + 1, 0) if len(self.known) else np.zeros(len(v.word), np.int64)
        return Vocabulary(rows, self.gram_row[v.grams], v.cuts, v.which, v.first)

    def inputs(self, v: Vocabulary) -> np.ndarray:
        if not len(v.word):
            return np.zeros((0, WORD_DIM + CHAR_DIM + 1), np.float32)
        sums = np.add.reduceat(self.char[v.grams], v.cuts[:-1], axis=0)
        worst = np.maximum.reduceat(self.gram_excess[v.grams], v.cuts[:-1])
        return np.concatenate([self.word[v.word], sums / np.diff(v.cuts)[:, None].astype(np.float32), worst[:, None]], 1)

    def run(self, gates: np.ndarray, there: np.ndarray, keep: bool = False):
        """Logits of windows. ``gates``: (WINDOW, 2, n, 3H) inputs of the gates, the second direction reversed; ``there``: (WINDOW, 2, n, 1)."""
        n, h = gates.shape[2], HIDDEN
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((WINDOW, 2, n, h), np.float32)
        kept = []
        full = bool(there.all())
        for t in range(WINDOW):
            z = gates[t]
            r = state @ self.u
            s = z[..., : 2 * h] + r[..., : 2 * h]
            np.clip(s, -30, 30, out=s)
            np.negative(s, out=s)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            update, reset = s[..., :h], s[..., h:]
            candidate = np.tanh(z[..., 2 * h :] + reset * r[..., 2 * h :])
            new = candidate + update * (state - candidate)
            if not full:
                new = np.where(there[t], new, state)
            if keep:
                kept.append((state, update, reset, candidate, r[..., 2 * h :]))
            state = states[t] = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # (WINDOW, n, 2H)
        energy = both @ self.attend
        mask = there[:, 0, :, 0]
        energy = np.where(mask, np.clip(energy, -30, 30), -60)
        weight = np.exp(energy)
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        logit = pooled @ self.out + self.bias[0]
        return (logit, both, weight, pooled, kept) if keep else logit

    def gather(self, projected: np.ndarray, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h3 = 3 * HIDDEN
        there = place >= 0
        word = np.where(there, which[place] if len(which) else 0, 0).T
        gates = np.empty((WINDOW, 2, len(place), h3), np.float32)
        if len(projected):
            gates[:, 0] = projected[:, :h3][word]
            gates[:, 1] = projected[:, h3:][word[::-1]]
        else:
            gates[:] = 0
        mask = np.empty((WINDOW, 2, len(place), 1), bool)
        mask[:, 0, :, 0], mask[:, 1, :, 0] = there.T, there.T[::-1]
        return gates, mask

    def logits(self, v: Vocabulary, place: np.ndarray) -> np.ndarray:
        projected = self.inputs(v) @ self.w + self.b
        out = np.empty(len(place), np.float32)
        for at in range(0, len(place), 2048):
            gates, there = self.gather(projected, place[at : at + 2048], v.which)
            out[at : at + 2048] = self.run(gates, there)
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """The largest logit of each text's windows."""
        v = self.index(vocabulary(texts))
        place, of = windows(v.first)
        logit = self.logits(v, place)
        return np.maximum.reduceat(logit, np.searchsorted(of, np.arange(len(texts)))) if len(texts) else np.zeros(0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * logit.astype(np.float64) + self.scale[1])

    def adam(self, g: dict, m: dict, s: dict, step: int, rate: float) -> None:
        """One step; of the embedding tables only the rows that have a gradient move."""
        for k in self.NAMES:
            rows, x = g[k] if isinstance(g[k], tuple) else (slice(None), g[k])
            m[k][rows] += 0.1 * (x - m[k][rows])
            s[k][rows] += 0.01 * (x**2 - s[k][rows])
            move = rate * (TABLE_RATE if isinstance(g[k], tuple) else 1) * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(s[k][rows] / (1 - 0.99**step)) + 1e-7)
            getattr(self, k)[rows] -= move.astype(np.float32)

    def gradients(self, v: Vocabulary, place: np.ndarray, y: np.ndarray, weight_y: np.ndarray) -> dict:
        """Of the weighted mean cross-entropy, by back-propagation through time."""
        h, h3 = HIDDEN, 3 * HIDDEN
        there_at = place >= 0
        words, small = np.unique(np.where(there_at, v.which[place], v.which[place[there_at][0]]), return_inverse=True)
        small = small.reshape(place.shape)
        sub = Vocabulary(v.word[words], *_pick(v, words), words, v.first)
        x = self.inputs(sub)
        gates, there = self.gather(x @ self.w + self.b, np.where(there_at, np.arange(place.size).reshape(place.shape), -1), small.ravel())
        logit, both, attention, pooled, kept = self.run(gates, there, keep=True)
        d = (weight_y * (_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"bias": np.array([d.sum()]), "out": pooled.T @ d}
        d_pooled = d[:, None] * self.out
        d_both = attention[:, :, None] * d_pooled
        d_energy = attention * (np.einsum("tnh,nh->tn", both, d_pooled) - (pooled * d_pooled).sum(1))
        d_both += d_energy[:, :, None] * self.attend
        g["attend"] = np.einsum("tn,tnh->h", d_energy, both)
        d_states = np.stack([d_both[..., :h], d_both[::-1, :, h:]], 1)
        d_gates = np.zeros_like(gates)
        g["u"] = np.zeros_like(self.u)
        carry = np.zeros_like(d_states[0])
        back = self.u.transpose(0, 2, 1)
        for t in range(WINDOW - 1, -1, -1):
            state, update, reset, candidate, from_state = kept[t]
            total = d_states[t] + carry
            live = there[t]
            dn = np.where(live, total, 0)
            d_update = dn * (state - candidate) * update * (1 - update)
            d_candidate = dn * (1 - update) * (1 - candidate**2)
            d_reset = d_candidate * from_state * reset * (1 - reset)
            d_gates[t] = np.concatenate([d_update, d_reset, d_candidate], -1)
            into = np.concatenate([d_update, d_reset, d_candidate * reset], -1)
            g["u"] += state.transpose(0, 2, 1) @ into
            carry = np.where(live, dn * update + into @ back, total)
        flat = np.zeros((len(words), 2 * h3), np.float32)
        word, ok = small.T, there_at.T
        for direction, order in ((0, slice(None)), (1, slice(None, None, -1))):
            dg = d_gates[:, direction][order]
            np.add.at(flat[:, direction * h3 : (direction + 1) * h3], word[ok], dg[ok])
        g["w"], g["b"] = x.T @ flat, flat.sum(0)
        dx = flat @ self.w.T
        sizes = np.diff(sub.cuts)
        g["word"] = _by_row(sub.word, dx[:, :WORD_DIM])
        g["char"] = _by_row(sub.grams, np.repeat(dx[:, WORD_DIM:-1] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        return g


def _by_row(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a gradient, and its sum for each."""
    order = np.argsort(rows, kind="stable")
    distinct, at = np.unique(rows[order], return_index=True)
    return distinct, np.add.reduceat(g[order], at, axis=0)


def _pick(v: Vocabulary, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _spread(v.grams, v.cuts[:-1][words], np.diff(v.cuts)[words])


def over_represented(both: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Of counts of texts: a third of the standard deviations, over CHANCE, that the toxic count is above chance."""
    excess = (toxic - both * share) / np.sqrt(both * share * (1 - share) + 1)
    return (np.clip(excess - CHANCE, 0, 9) / 3).astype(np.float32)


def count_texts(v: Vocabulary, label: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts, and toxic ones, with each word and each code, of those that are counted."""
    out = [np.zeros(len(v.word)), np.zeros(len(v.word)), np.zeros(1 << CHAR_BITS), np.zeros(1 << CHAR_BITS)]
    for i in np.flatnonzero(counted):
        words = np.unique(v.which[v.first[i] : v.first[i + 1]])
        codes = np.unique(_pick(v, words)[0])
        for k, seen in ((0, words), (2, codes)):
            out[k][seen] += 1
            if label[i] > 0:
                out[k + 1][seen] += 1
    return tuple(out)


def fresh(known: np.ndarray, excess: np.ndarray, codes: np.ndarray, gram_excess: np.ndarray, seed: int = 7) -> Network:
    """Random weights; the first word dimension starts as how over-represented the word is in toxic documents."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    word = draw(len(known) + 1, WORD_DIM, by=0.05)
    word[:, 0] = np.concatenate([[0], excess])
    gram_row = np.zeros(1 << CHAR_BITS, np.int32)
    gram_row[codes] = np.arange(1, len(codes) + 1)
    h = HIDDEN
    b = np.zeros(6 * h, np.float32)
    b[:h] = b[3 * h : 4 * h] = 0.5
    char, worst = draw(len(codes) + 1, CHAR_DIM, by=0.1), np.concatenate([[0], gram_excess]).astype(np.float32)
    return Network(known, gram_row, word, char, worst, draw(WORD_DIM + CHAR_DIM + 1, 6 * h, by=0.4), b, draw(2, h, 3 * h, by=0.3), draw(2 * h, by=0.3), draw(2 * h, by=0.3), np.array([-2.0], np.float32))


def _sketch(words: np.ndarray) -> int:
    low = np.unique(words)[:3]
    return hash(tuple(low.tolist()))


def fit(texts: list[bytes], label: np.ndarray, rounds: int = 2, seed: int = 7) -> Network:
    label = np.asarray(label)
    if len(label) == 0 or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        none = np.zeros(0, np.float32)
        net = fresh(none.astype(np.uint64), none, none.astype(np.int64), none)
        net.scale = np.array([0.0, 30.0 if share == 1 else -30.0])
        return net
    rng = np.random.default_rng(seed)
    v = whole_vocabulary(texts)
    # near copies count once: texts whose smallest word hashes agree
    once = np.unique([_sketch(v.word[v.which[v.first[i] : v.first[i + 1]]]) for i in range(len(texts))], return_index=True)[1]
    counted = np.zeros(len(texts), bool)
    counted[once] = True
    share = label[counted].mean()
    both, toxic, both_codes, toxic_codes = count_texts(v, label, counted)
    often, codes = np.flatnonzero(both >= MIN_TEXTS), np.flatnonzero(both_codes >= MIN_TEXTS)
    excess, gram_excess = over_represented(both, toxic, share), over_represented(both_codes, toxic_codes, share)
    net = fresh(v.word[often], excess[often], codes, gram_excess[codes], seed)
    v = net.index(v)
    place, of = windows(v.first)
    worst_of = np.maximum(net.word[v.word, 0], np.maximum.reduceat(net.gram_excess[v.grams], v.cuts[:-1])) if len(v.word) else excess[:0]
    worst = np.where(place >= 0, worst_of[v.which[place]] if len(worst_of) else 0, -1).max(1)
    # clean words said over and over, which few texts show, are windows of their own
    spoken = np.flatnonzero(np.repeat(label == 0, np.diff(v.first)))
    if len(spoken):
        said = np.sort(rng.integers(0, 3, (REPEATS, WINDOW)), 1)
        place = np.concatenate([place, np.take_along_axis(rng.choice(spoken, (REPEATS, 3)), said, 1)])
        of = np.concatenate([of, np.full(REPEATS, np.flatnonzero(label == 0)[0])])
    extra = np.arange(len(place) - (REPEATS if len(spoken) else 0), len(place))
    worst = np.concatenate([worst, np.zeros(len(extra))])
    bad = label[of] > 0
    m = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    s = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    step = 0
    for r in range(rounds):
        by_text = np.full(len(texts), -np.inf)
        np.maximum.at(by_text, of, worst)
        chosen = np.flatnonzero(bad & (worst >= by_text[of] - 1e-6))
        chosen = rng.choice(chosen, min(len(chosen), int(bad[chosen].sum())), replace=False)
        clean = np.flatnonzero(~bad)
        hard = clean[np.argsort(-worst[clean], kind="stable")[: 2 * len(chosen)]]
        some = rng.choice(clean, min(len(clean), 4 * len(chosen) + 256), replace=False)
        use = np.concatenate([chosen, hard, some, extra])
        y = np.concatenate([np.ones(len(chosen)), np.zeros(len(hard) + len(some) + len(extra))])
        for _ in range(max(3, min(16, STEPS * BATCH // max(len(use), 1)))):
            order = rng.permutation(len(use))
            for at in range(0, len(order), BATCH):
                take = order[at : at + BATCH]
                if (place[use[take]] < 0).all():
                    continue
                g = net.gradients(v, place[use[take]], y[take], np.where(y[take] > 0, 2.0, 1.0))
                step += 1
                net.adam(g, m, s, step, 0.01 if r + 1 < rounds else 0.004)
        worst = net.logits(v, place)
    by_text = np.full(len(texts), -np.inf)
    np.maximum.at(by_text, of[: extra[0]] if len(extra) else of, worst[: extra[0]] if len(extra) else worst)
    net.scale = _calibrate(by_text, label.astype(float))
    return net


def _calibrate(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve by Newton's method, drawn a little towards the identity."""
    x = np.stack([np.clip(logit, -20, 20), np.ones(len(y))], 1)
    a = np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(x @ a)
        g = x.T @ (p - y) + 0.5 * (a - [1.0, 0.0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        a = a - np.linalg.solve(hessian, g)
        a[0] = np.clip(a[0], 0.05, 5)
    return a


def train(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] = SAMPLE) -> Network:
    return train_remotely(labelled_sample(docs, labels, "toxic", *HELD_OUT, bounds), fit)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            p = np.clip(shared.value.probability(shared.value.texts(texts)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = rows.mapInArrow(lean(run), "doc_id bigint, score double, predicted int")
    return out.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.select([at]).rename_columns(["text"])
            low, parts = 0, []
            for block, texts in text_blocks([named]):
                parts.append(shared.value.probability(shared.value.texts(texts)) < threshold)
                low += block.num_rows
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(lean(run), docs.schema)
