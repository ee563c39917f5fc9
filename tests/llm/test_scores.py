"""The two classifiers: gradients, brute force, held-out accuracy and odd rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from wayline.llm import quality, toxicity

from .conftest import as_table, prose


def held_out(doc_id, divisor, remainder):
    return zlib.crc32(str(doc_id).encode()) % divisor == remainder


def labelled(spark, name, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"doc_id bigint, {name} int, text string")


# ----------------------------------------------------------------- toxicity


def toxic_rows(n=240, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        words = prose(5000 + i, r.randint(20, 160)).split(" ")
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(["blorf", "Snazzle,", "grumpf" + r.choice("aeiou") + r.choice("klm")])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_gradients_are_the_slope():
    texts = [t.encode() for _, t, _ in toxic_rows(12)]
    v = toxicity.vocabulary(texts)
    net = toxicity.fresh(np.sort(np.unique(v.word))[:40], np.ones(40, np.float32), np.arange(50), np.ones(50, np.float32), 3)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    v = net.index(v)
    place, _ = toxicity.windows(v.first)
    place = place[:9].copy()
    place[3, 10:] = -1
    y, w = np.array([1, 0, 1, 0, 0, 1, 0, 1, 0.0]), np.ones(9)

    def loss():
        out = net.logits(v, place).astype(np.float64)
        return float((w * (np.logaddexp(0, out) - y * out)).mean())

    g = net.gradients(v, place, y, w)
    for k in ("w", "b", "u", "attend", "out", "bias"):
        x = getattr(net, k)
        i = np.unravel_index(np.abs(g[k]).argmax(), x.shape)
        kept, step = x[i], 1e-2
        x[i] = kept + step
        up = loss()
        x[i] = kept - step
        down = loss()
        x[i] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[k][i], rel=0.05, abs=2e-4), k


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 5 + toxicity.WINDOW, 5 + toxicity.WINDOW + 100])
    place, of = toxicity.windows(first)
    assert set(place[place >= 0]) == set(range(first[-1])) and sorted(set(of)) == [0, 1, 2, 3]
    for row, text in zip(place, of, strict=True):
        held = row[row >= 0]
        assert all(first[text] <= p < first[text + 1] for p in held)
    inner = place[of == 3]
    assert all(b[0] - a[0] <= toxicity.STEP for a, b in itertools.pairwise(inner))


def test_scores_do_not_depend_on_batching():
    rows = toxic_rows(40)
    net = toxicity.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = [t.encode() for _, t, _ in rows]
    alone = np.array([net.texts([t])[0] for t in texts])
    assert np.allclose(net.texts(texts), alone, atol=1e-4)


def plain_logit(net, v, text):
    """One text's score by loops: a cell at a time, attention by a plain softmax, the largest window."""
    h, sigmoid = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    places = list(range(v.first[text], v.first[text + 1]))
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(places):
        starts.append(min(starts[-1] + toxicity.STEP, len(places) - toxicity.WINDOW))
    best = -np.inf
    for start in starts:
        x = []
        for p in places[start : start + toxicity.WINDOW]:
            w = v.which[p]
            rows = v.grams[v.cuts[w] : v.cuts[w + 1]]
            x.append(np.concatenate([net.word[v.word[w]], np.mean([net.char[r] for r in rows], 0), [max(net.gram_excess[r] for r in rows)]]).astype(float))
        sides = []
        for d, order in ((0, x), (1, x[::-1])):
            state, states = np.zeros(h), []
            for at in order:
                z, r = at @ net.w[:, 3 * h * d : 3 * h * (d + 1)] + net.b[3 * h * d : 3 * h * (d + 1)], state @ net.u[d]
                update, reset = sigmoid(z[:h] + r[:h]), sigmoid(z[h : 2 * h] + r[h : 2 * h])
                candidate = np.tanh(z[2 * h :] + reset * r[2 * h :])
                state = update * state + (1 - update) * candidate
                states.append(state)
            sides.append(states[::-1] if d else states)
        pooled = np.zeros(2 * h)
        if x:
            both = np.array([np.concatenate(s) for s in zip(*sides, strict=True)])
            weight = np.exp(both @ net.attend)
            pooled = weight @ both / weight.sum()
        best = max(best, float(pooled @ net.out + net.bias[0]))
    return best


def test_scores_equal_plain_loops():
    rows = toxic_rows(40)
    net = toxicity.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = [t.encode() for _, t, _ in rows[:15]] + [b"", b"one", b" ".join(b"blorf %d" % i for i in range(60))]
    v = net.index(toxicity.vocabulary(texts))
    assert np.allclose(net.texts(texts), [plain_logit(net, v, i) for i in range(len(texts))], atol=1e-3)


def test_toxicity(spark, docs, empty):
    rows = toxic_rows()
    table = as_table(spark, [(i, t) for i, t, _ in rows])
    labels = labelled(spark, "toxic", [(i, y) for i, _, y in rows] + [(None, 1), (999_999, 1), (3, None)])
    net = toxicity.train(table, labels)
    got = {r["doc_id"]: r for r in toxicity.score(table, net).collect()}
    out = [i for i, _, _ in rows if held_out(i, 3, 1)]
    assert {i for i, r in got.items() if r["held_out"]} == set(out)
    right = [got[i]["predicted"] == y for i, _, y in rows if i in set(out)]
    assert np.mean(right) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    odd = toxicity.score(docs, net).collect()
    assert len(odd) == docs.count() and all(r["score"] is not None for r in odd)
    blank = {r["score"] for r in odd if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    kept = toxicity.keep(table, net)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score(empty, net).count() == toxicity.keep(empty, net).count() == 0
    none = toxicity.train(table, labels.limit(0))
    assert toxicity.score(table, none).where("predicted = 1").count() == 0


# ------------------------------------------------------------------ quality


def quality_rows(n=200):
    r, rows = random.Random(4), []
    for i in range(n):
        good = [prose(9000 + 20 * i + k, r.randint(8, 30)).replace("\n", " ") + "." for k in range(r.randint(1, 6))]
        bad = i % 4 == 0
        if bad:
            kind = i // 4 % 3
            junk = [" ".join(w + r.choice(["%%%", "###"]) for w in x.split()) if kind == 0 else " | ".join(x.split()) if kind == 1 else (x.split()[0] + " ") * 30 for x in good]
            good = [good[0], *junk * 3]
        rows.append((i, "\n".join(good), int(not bad)))
    return rows


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 1, 5, 8])
    x = rng.normal(size=(8, 3))
    chain = quality.Chain(rng.normal(size=3), rng.normal(size=(2, 2)), 0.5)
    got, at, xi = chain.marginals(x, first, pairs=True)
    want, pair = np.zeros(8), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total, weights = 0.0, []
        for labels in itertools.product((0, 1), repeat=b - a):
            s = sum(x[a + k] @ chain.weights for k, v in enumerate(labels) if v) + sum(chain.edges[p, q] for p, q in itertools.pairwise(labels))
            weights.append((labels, np.exp(s)))
            total += np.exp(s)
        for labels, v in weights:
            for k, y in enumerate(labels):
                want[a + k] += y * v / total
            for p, q in itertools.pairwise(labels):
                pair[p, q] += v / total
    assert np.allclose(got, want) and np.allclose(xi, pair) and at.tolist() == [2, 3, 4, 6, 7]


def test_quality(spark, docs, empty):
    rows = quality_rows()
    table = as_table(spark, [(i, t) for i, t, _ in rows])
    chain = quality.train(table, labelled(spark, "quality", [(i, y) for i, _, y in rows] + [(None, 0), (5, None)]))
    got = {r["doc_id"]: r for r in quality.score(table, chain).collect()}
    out = {i for i, _, _ in rows if held_out(i, 5, 0)}
    assert {i for i, r in got.items() if r["held_out"]} == out
    assert np.mean([got[i]["predicted"] == y for i, _, y in rows if i in out]) >= 0.9
    odd = {r["doc_id"]: r["score"] for r in quality.score(docs, chain).collect()}
    assert odd[1] == odd[2] == odd[3] == pytest.approx(chain.prior)
    assert quality.score(docs, chain).count() == docs.count() and quality.score(empty, chain).count() == 0
    assert all(0 <= s <= 1 for s in odd.values())
    untrained = quality.train(table, labelled(spark, "quality", []))
    assert {r["score"] for r in quality.score(docs, untrained).collect()} == {0.5}
