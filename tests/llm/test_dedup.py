"""Exact deduplication, the Jaccard join and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import exact_dedup, jaccard, lines
from wayline.llm.common import Scratch, fetch

from .conftest import as_table, awkward, prose


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_find(docs):
    got = exact_dedup.find(docs).collect()
    rows = awkward()
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_keep(docs, empty):
    out = exact_dedup.keep(docs)
    assert out.columns == docs.columns
    texts = [plain(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({plain(t) for _, t in awkward()})
    assert exact_dedup.keep(empty).count() == exact_dedup.find(empty).count() == 0


def test_exact_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(6000)]
    got = exact_dedup.find(as_table(spark, rows))
    assert got.where("kept").count() == 2001 and got.where("keep_id = 1 and group_size = 4000").count() == 4000


def test_filter_passes_unique_rows(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    n, bits = exact_dedup.filter_bits(hashes)
    alone = exact_dedup.maybe_repeated(hashes, exact_dedup.repeated_cells(hashes, bits), bits)
    assert n == 20_000 and alone.where("maybe").count() < 0.1 * n
    twice = hashes.unionAll(hashes.limit(500))
    tested = exact_dedup.maybe_repeated(twice, exact_dedup.repeated_cells(twice, bits), bits)
    repeated = twice.groupBy("id").count().where("count > 1").select("id")
    assert tested.join(repeated, "id").where("not maybe").count() == 0


def test_slices_of_the_filter(spark, monkeypatch):
    """More rows than one filter holds: as many filters, and no more false positives."""
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 1 << 16)
    rows = spark.range(10_000).selectExpr("id", "xxhash64(if(id < 400, id div 2, id)) as h")
    got = exact_dedup.maybe_twice(rows, 10_000)
    assert got.count() == 10_000 and got.where("id < 400 and not maybe").count() == 0
    assert got.where("id >= 400 and maybe").count() < 1200
    found = exact_dedup.find(as_table(spark, [(i, f"text {i % 3000}") for i in range(5000)]))
    assert found.where("kept").count() == 3000 and found.where("group_size = 2").count() == 4000


def test_fetch_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id < 4000, 7, id) as a", "id as b")
    facts = spark.range(5000).selectExpr("id as a", "concat('f', id) as fact").where("a <> 4500")
    got = fetch(rows, "a", facts, "b", 5000, per=100)
    assert Counter(map(tuple, got.select("a", "b", "fact").collect())) == Counter((a, b, f"f{a}") for a, b in [(7 if i < 4000 else i, i) for i in range(5000)] if a != 4500)


def brute_components(rows, width, share):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out[doc, len(sets[i]), min(ids) if ids else None] += 1
    return out


def edited(seed: int) -> list[tuple[int, str]]:
    """Texts of several lengths, each with copies that differ in a growing number of words, and shared passages."""
    r, rows = random.Random(seed), []
    shared = prose(999, 25)
    for family in range(6):
        base = prose(1000 + 10 * seed + family, r.choice([12, 40, 90, 400])).split(" ")
        for k in range(9):
            text = list(base)
            for _ in range(k):
                text[r.randrange(len(text))] = f"w{r.randrange(10**6)}"
            rows.append((1000 * family + k, " ".join(text) + (" " + shared if k % 4 == 3 else "")))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "share"), [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, width, share):
    rows = awkward() + edited(width)
    got = jaccard.join(as_table(spark, rows).repartition(3), width, share)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_components(rows, width, share)


def test_jaccard_keep(spark, empty):
    rows = edited(7)
    docs = as_table(spark, rows)
    out = jaccard.keep(docs, 5, 80)
    want = {c for _, _, c in brute_components(rows, 5, 80)}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    assert jaccard.join(empty).count() == jaccard.keep(empty).count() == 0


def test_jaccard_keep_goes_by_rows(spark):
    """Null and repeated ids: each row stands for itself, and one of each component stays."""
    base = prose(70, 80)
    near, other = base + " more", prose(71, 80)
    rows = [(1, base), (5, near), (5, other), (None, near + " still"), (6, other), (6, other), (9, ""), (None, None), (9, ""), (None, "lone words"), (None, prose(72, 60)), (None, prose(72, 60) + " end"), (None, prose(72, 60) + " end")]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep(as_table(spark, rows), 5, 80).collect())
    ends = {t for (i, t) in kept if i is None and t and t.startswith(prose(72, 60))}
    assert len(ends) == 1 and kept.pop((None, ends.pop())) == 1
    assert kept == Counter([(1, base), (5, other), (9, ""), (9, ""), (None, None), (None, "lone words")])


def test_jaccard_large_family(spark):
    """A large group of near copies of one text, most of them too far apart from each other."""
    r, base, rows = random.Random(5), prose(77, 150).split(" "), []
    for i in range(400):
        text = list(base)
        for _ in range(r.randint(0, 5)):
            text.insert(r.randrange(len(text)), f"w{r.randrange(10**6)}")
        rows.append((i, " ".join(text)))
    assert Counter(map(tuple, jaccard.join(as_table(spark, rows), 3, 90).collect())) == brute_components(rows, 3, 90)


@pytest.mark.parametrize("share", [80, 90])
def test_similar_sets_share_a_signature(share):
    rng, rule = np.random.default_rng(1), jaccard.PartEnum(share)
    for _ in range(300):
        n = int(rng.choice([1, 2, 5, 9, 10, 11, 19, 30, 100, 700]))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        cut = rng.integers(0, max(1, int(len(a) * (100 - share) / 100)) + 1)
        grow = rng.integers(0, 3)
        b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 2**64, grow, np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if 100 * both >= share * (len(a) + len(b) - both):
            made, cuts = rule.signatures([a, b])
            assert set(made[: cuts[1]].tolist()) & set(made[cuts[1] :].tolist())
            assert jaccard.differ(rule.sketch(a), rule.sketch(b)) <= rule.allowed(np.int64(len(a) + len(b)))


def test_signature_groups_stream_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted((int(rng.integers(0, 30)), int(rng.integers(0, 12))) for _ in range(300))
    want = set()
    for s in {s for s, _ in rows}:
        ids = {i for t, i in rows if t == s}
        want |= {(s, i) for i in ids} if len(ids) > 1 else set()
    for size in (1, 2, 3, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], names=["sig", "sid"]) for k in range(0, len(rows), size)]
        got = [(r["sig"], r["sid"]) for b in jaccard._members(iter(batches)) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, 1001 + i) for i in range(300)]
    got = {r["sid"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, **{1000 + i: 1000 for i in range(301)}}


def test_lines(docs, spark, empty):
    r = random.Random(3)
    passage = [prose(500 + k, 8).replace("\n", "") for k in range(6)]
    long = prose(600, 70).replace("\n", "")
    rows = awkward()
    for i in range(30):
        text = [prose(700 + 10 * i + k, 9).replace("\n", "") for k in range(r.randint(1, 5))]
        at = r.randrange(len(text) + 1)
        text[at:at] = passage[: r.randint(1, 6)] if i % 2 else [long]
        rows.append((300 + i, "\n".join(text)))
    rows.append((400, "\n".join(passage + ["only here"] + passage)))
    table = as_table(spark, rows)
    got = lines.digest(table).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    texts = dict(rows)
    for r_ in got:
        if r_["doc_id"] in (None, 12, 13):
            continue
        gone = set(map(int, r_["removed"].split(","))) if r_["removed"] else set()
        left = "\n".join(x for k, x in enumerate((texts[r_["doc_id"]] or "").split("\n")) if k not in gone)
        assert r_["text_sha256"] == hashlib.sha256(left.encode()).hexdigest() and r_["n_removed"] == len(gone)
    # the first copy of the long line stays, all later ones go
    holders = sorted(i for i, t in rows if i and long in (t or ""))
    assert by[holders[0]]["n_removed"] == 0
    for i in holders[1:]:
        assert long not in [x for k, x in enumerate(texts[i].split("\n")) if str(k) not in by[i]["removed"].split(",")]
    # a run of two lines or more that stood before goes
    whole = texts[400].split("\n")
    left = [x for k, x in enumerate(whole) if str(k) not in by[400]["removed"].split(",")]
    assert left == ["only here"]
    assert by[12]["n_removed"] == 0 and by[1]["n_lines"] == 1 and by[1]["n_removed"] == 0
    assert lines.digest(empty).count() == 0
    found = lines.find(docs)
    assert lines.clean(docs, found).columns == docs.columns and lines.clean(docs, found).count() == docs.count()


def test_lines_rule_by_brute_force(spark):
    rng = random.Random(11)
    alphabet = [f"line {c} {'pad ' * (60 if c == 'z' else 3)}" for c in "abcdefz"]
    rows = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    got = {r["doc_id"]: r["removed"] for r in lines.digest(as_table(spark, rows)).collect()}
    first, marks = {}, {}
    parsed = lines.line_hashes([t.encode() for _, t in rows])
    key = {(i, t): None for i, t in rows}
    assert len(key) == len(rows)
    for (i, _), (h, n, _, _) in zip(rows, parsed, strict=True):
        k, at, _ = lines.winnow(h, n, 2, 2, 50)
        marks[i] = sorted(zip(at.tolist(), k.tolist(), strict=True))
        for p, x in marks[i]:
            first.setdefault(x, (i, p))
    for (i, _), (h, n, number, _) in zip(rows, parsed, strict=True):
        gone = set()
        for p, x in marks[i]:
            a, s = first[x]
            if (a, s) == (i, p):
                continue
            e, lo, hi = parsed[a][0], p, p
            while lo and s - p + lo > 0 and h[lo - 1] == e[s - p + lo - 1]:
                lo -= 1
            while hi < len(h) and s - p + hi < len(e) and h[hi] == e[s - p + hi]:
                hi += 1
            if hi - lo >= 2 or n[lo:hi].sum() >= 50:
                gone |= set(number[lo:hi].tolist())
        assert got[i] == ",".join(map(str, sorted(gone)))


def test_lines_runs_of_two_lines(spark):
    """Whatever the windows chose: copies of two lines of earlier documents go, by a search for every repeated pair."""
    rng = random.Random(29)
    rows = [(i, "\n".join(f"line {i} {j} {rng.random()}" for j in range(6))) for i in range(60)]
    for i in range(60, 90):
        parts = []
        for _ in range(12):
            source, at = rng.randrange(60), rng.randrange(5)
            parts += rows[source][1].split("\n")[at : at + 2] + [f"own {i} {rng.random()}"] * rng.randint(0, 1)
        rows.append((i, "\n".join(parts)))
    found = {r["doc_id"]: {int(x) for x in r["removed"].split(",") if x} for r in lines.digest(as_table(spark, rows)).collect()}
    seen = set()
    for i, t in rows:
        text = t.split("\n")
        for k in range(len(text) - 1):
            if (text[k], text[k + 1]) in seen:
                assert {k, k + 1} <= found[i]
            seen.add((text[k], text[k + 1]))
        assert not any(text[k].startswith("own") and text.count(text[k]) == 1 for k in found[i])


def test_lines_runs_of_many_words(spark):
    """Every run of 50 words or more that stood before goes, whatever minima winnowing chose."""
    rng = random.Random(23)
    passages = [[f"passage {k} line {j} " + "word " * 26 for j in range(2 + k % 2)] for k in range(24)]
    rows = []
    for i in range(72):
        text = [f"own {i} {j}" for j in range(rng.randint(0, 4))]
        at = rng.randrange(len(text) + 1)
        rows.append((i, "\n".join(text[:at] + passages[i % 24] + text[at:])))
    found = {r["doc_id"]: r["removed"] for r in lines.digest(as_table(spark, rows)).collect()}
    split = {i: t.split("\n") for i, t in rows}
    seen, runs = set(), 0
    for i, text in split.items():
        gone = {int(x) for x in found[i].split(",") if x}
        mine = [(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1)]
        for a, b in mine:
            if tuple(text[a:b]) in seen and sum(len(x.split()) for x in text[a:b]) >= 50:
                runs += 1
                assert set(range(a, b)) <= gone, (i, a, b)
        seen |= {tuple(text[a:b]) for a, b in mine}
        assert not any(text[k].startswith("own") for k in gone)
    assert runs >= 48
