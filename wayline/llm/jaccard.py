"""Exact n-gram Jaccard self-join by PartEnum signatures, down to its components.

A document's set holds the distinct shingles of its words. Sets fall into size
bands [l, l / similarity]; similar sets lie in one band or in neighbouring
ones. For each pair of neighbouring bands the similarity bounds the Hamming
distance by some k. The feature domain, 64-bit hashes, is cut into n1 x n2
ranges. For k up to 2, n1 is 1 and a signature is the content of one of the
subsets of n2 - k of k + 2 second-level partitions. Beyond that each
first-level partition has n2 = 3 second-level ones, and a signature is the
content of two of these: k differences can spoil at most k + n1 of the 3 n1
subsets, so similar sets agree in 2 n1 - k of them or more. There are SPARE
hundredths more first-level partitions than needed, and a set leaves out the
2 n1 - k - 1 smallest of its signatures, by (size, content). Of the subsets in
which two similar sets agree, which are more than either leaves out, both keep
the largest; the small ones, which unrelated sets share by chance, are gone.

Equal sets are one class and make signatures once a task. Sorted by signature, rows
stream past; sets that share one with others are its members. Two rounds of
exact verification follow, each without pairs of a whole group:

1. every member against one centre of its signature (a star): the set that
   meets the most others over all its signatures, so that the text which near
   copies were made from is asked for, not one of them;
2. where a signature's members still lie in several components, the pairs
   across these, compared in blocks inside a task. Members outside the block's
   largest component name the partners nearest to them by sketches, NEAREST at
   first; verified links join components, and signatures that had more to name
   are asked again for four times as many, until none has.

Before sets are fetched, both rounds compare sketches: members fall into cells,
and a bit says whether a cell has an odd number of them. Every cell that differs
holds a difference, so too many of them rule a pair out for sure.
A centre's sketch and set are copied once for every PER_COPY partners, never
for each. Shingles and sets go by 64-bit hashes. Components come from
alternating large and small stars.

Edge cases: a null or blank text has the empty set and is its own component.
Fewer words than the shingle has make one shingle. Null ids take part; a
component of null ids only has a null id. Repeated rows are copies. Rows that
share an id but not the text are documents of their own. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Scratch, Words, attach, fetch, joint_hash, lean, splitmix, text_blocks, text_hash
from .exact_dedup import bitmap, maybe_repeated, maybe_twice

BLOCK = 1024  # members of a signature compared at once
NEAREST = 4  # partners that a member names in the first of the rounds across components; four times as many in each further one
SPARE = 15  # first-level partitions beyond those needed, in hundredths


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` are one shingle, no words none."""
    w = Words(texts)
    shifted = [w.hash[i : max(len(w.hash) - width + 1 + i, i)] for i in range(width)]
    grams = joint_hash(*shifted) if len(shifted[0]) else np.zeros(0, np.uint64)
    out = []
    for i in range(len(texts)):
        lo, hi = w.first[i], w.first[i + 1]
        if hi - lo >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:
            out.append(joint_hash(*[w.hash[j : j + 1] for j in range(lo, hi)]) ^ np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class PartEnum:
    """Signatures for sets whose Jaccard similarity is at least ``share`` / 100."""

    def __init__(self, share: int):
        self.share = share
        self._starts = [1]

    def band(self, sizes: np.ndarray) -> np.ndarray:
        top = int(sizes.max(initial=1))
        while self._starts[-1] <= top:
            self._starts.append(self._starts[-1] * 100 // self.share + 1)
        return np.searchsorted(self._starts, sizes, side="right") - 1

    def last(self, band: int) -> int:
        while len(self._starts) <= band + 1:
            self._starts.append(self._starts[-1] * 100 // self.share + 1)
        return self._starts[band + 1] - 1

    @lru_cache(maxsize=None)
    def plan(self, instance: int) -> tuple[int, int, tuple[tuple[int, ...], ...], int]:
        """(n1, n2, subsets of the n2, signatures to leave out) for sets of bands ``instance - 1`` and ``instance``."""
        k = (100 - self.share) * 2 * self.last(instance) // (100 + self.share)
        if k <= 2:
            n2 = k + 2 if k else 1
            return 1, n2, tuple(itertools.combinations(range(n2), n2 - k)), 0
        n1 = -(-(k + 1) * (100 + SPARE) // 200)
        return n1, 3, ((0, 1), (0, 2), (1, 2)), 2 * n1 - k - 1

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All sets' signatures, one set's after another's, and where each set's begin (and the end)."""
        sizes = np.array([len(s) for s in sets])
        filled = np.flatnonzero(sizes)
        bands = self.band(sizes)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(flat + np.uint64(0x5851F42D4C957F2D)))])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for up in (0, 1):
            for instance in np.unique(bands[filled]) + up:
                rows = filled[bands[filled] + up == instance]
                n1, n2, subsets, spare = self.plan(int(instance))
                fine = n1 * n2
                place = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
                of = np.repeat(np.arange(len(rows)), sizes[rows])
                key = of * fine + ((flat[place] >> np.uint64(32)) * np.uint64(fine) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(key, np.arange(len(rows) * fine + 1))
                sums_run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(run[place + 1] - run[place])])
                sums = (sums_run[cuts[1:]] - sums_run[cuts[:-1]]).reshape(len(rows), n1, n2)
                made = np.empty((len(rows), n1, len(subsets)), np.uint64)
                where = np.arange(n1, dtype=np.uint64)[None, :]
                for i, subset in enumerate(subsets):
                    tag = np.broadcast_to(np.uint64(instance) << np.uint64(40) | where << np.uint64(8) | np.uint64(i), (len(rows), n1)).ravel()
                    made[:, :, i] = joint_hash(tag, *[sums[:, :, j].ravel() for j in subset]).reshape(len(rows), n1)
                made = made.reshape(len(rows), -1)
                if spare:
                    held = np.diff(cuts).reshape(len(rows), n1, n2)
                    size = np.stack([held[:, :, list(subset)].sum(2) for subset in subsets], 2).reshape(len(rows), -1)
                    kept = np.lexsort((made, size), axis=1)[:, spare:]
                    made = np.take_along_axis(made, kept, 1)
                parts.append((np.repeat(rows, made.shape[1]), made.ravel()))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(len(sets) + 1, np.int64)
        of = np.concatenate([p[0] for p in parts])
        order = np.argsort(of, kind="stable")
        return np.concatenate([p[1] for p in parts])[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sets)))])

    # ------------------------------------------------------------- sketches

    def allowed(self, total: np.ndarray) -> np.ndarray:
        """Most differences of two similar sets that have ``total`` members together."""
        return (100 - self.share) * total // (100 + self.share)

    def sketch(self, members: np.ndarray) -> bytes:
        """A bit a cell: whether the cell has an odd number of members. A cell's number is the low bits of a hash, so halves fold onto each other."""
        cells = 64
        while cells < 16 * (int(self.allowed(np.int64(2 * len(members)))) + 1):
            cells *= 2
        cell = (splitmix(members ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(cells - 1)).astype(np.int64)
        return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch folded down to ``size`` bytes."""
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def differ(a: bytes, b: bytes) -> int:
    """At least so many differences."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=np.int64))


# ---------------------------------------------------------------- Spark side


def _sets(width: int, share: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = PartEnum(share)
        for batch, texts in text_blocks(batches):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([rule.sketch(s) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "th", "n", "sid", "sketch"],
            )

    return run


def _signatures(width: int, share: int):
    """(sig, sid) of the distinct sets of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, seen = PartEnum(share), set()
        for _, texts in text_blocks(batches):
            fresh, ids = [], []
            for members in shingle_sets(texts, width):
                if len(members) and (sid := set_id(members)) not in seen:
                    seen.add(sid)
                    fresh.append(members)
                    ids.append(sid)
            made, cuts = rule.signatures(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), np.diff(cuts)))], names=["sig", "sid"])

    return run


def set_id(members: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = splitmix(members ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
        return int(splitmix(np.array([total + np.uint64(len(members))], np.uint64)).view(np.int64)[0])


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows, a table at a time, with whether a row begins a new run of equal keys; the first table's first row does."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = [c[0] for c in columns]
        new[0] = before is None or first != before
        before = [c[-1] for c in columns]
        yield batch, new


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (sig, sid) sorted: (sig, center, sid) of the signatures that several sets share, once each. Holds one batch."""
    center, last, told = None, None, False
    for batch, new in _runs(batches, ["sig"]):
        sig, sid = (batch.column(k).to_numpy() for k in ("sig", "sid"))
        again = np.zeros(len(sid), bool)
        again[1:] = (sid[1:] == sid[:-1]) & ~new[1:]
        again[0] = not new[0] and sid[0] == last
        starts = np.flatnonzero(new)
        head = np.repeat(sid[starts], np.diff(np.append(starts, len(sid))))
        lead = starts[0] if len(starts) else len(sid)
        centers = np.concatenate([np.full(lead, center if center is not None else 0, np.int64), head])
        other = ~new & ~again & (sid != centers)
        # the centre is told with its first other member
        run_of = np.cumsum(new)
        firsts = np.zeros(len(sid), bool)
        at = np.flatnonzero(other)
        if len(at):
            firsts[at[np.unique(run_of[at], return_index=True)[1]]] = True
            if told and len(at) and run_of[at[0]] == 0:
                firsts[at[0]] = False
        if other.any():
            a, b = np.flatnonzero(firsts), at
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([sig[a], sig[b]])), pa.array(np.concatenate([centers[a], centers[b]])), pa.array(np.concatenate([centers[a], sid[b]]))], names=["sig", "center", "sid"]
            )
        told = bool(other[run_of == run_of[-1]].any()) or (told and run_of[-1] == 0)
        center, last = int(centers[-1]), sid[-1]


def _passing(share: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = PartEnum(share)
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = rule.allowed(n)
            ok = [differ(a, b) <= m for a, b, m in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(share: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _across(share: int, most: int):
    """Of (sig, bi, bj, block, sid, comp, n, sketch) sorted by the first three: pairs across components that sketches don't rule out.

    A run holds at most two blocks of a signature's members. Of its components
    the largest only answers: each member of another one names the ``most``
    partners that differ least from it, so a run gives ``most`` rows a member at
    most. A signature for which more were left comes out as ``again``."""

    def pairs(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, bool]:
        t = pa.Table.from_batches(rows)
        sid, comp, n = (t.column(k).to_numpy() for k in ("sid", "comp", "n"))
        inner = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        block = t.column("block").to_numpy()
        raw = t.column("sketch").to_pylist()
        size = max(min(map(len, raw)), 8)
        sketch = np.stack([folded(r, size) for r in raw]).view(np.uint64)
        rule, out, left = PartEnum(share), [], False
        names, sizes = np.unique(comp, return_counts=True)
        for i in np.flatnonzero(comp != names[np.argmax(sizes)]):
            ok = (comp != comp[i]) & (sid != sid[i]) & (100 * np.minimum(n, n[i]) >= share * np.maximum(n, n[i]))
            if not inner:
                ok &= block != block[i]
            at = np.flatnonzero(ok)
            apart = np.bitwise_count(sketch[at] ^ sketch[i]).sum(1, dtype=np.int64)
            near = apart <= rule.allowed(n[at] + n[i])
            at, apart = at[near], apart[near]
            if len(at) > most:
                at, left = at[np.lexsort((sid[at], apart))[:most]], True
            out.append((np.full(len(at), sid[i]), sid[at]))
        a, b = (np.concatenate([o[k] for o in out] + [np.zeros(0, np.int64)]) for k in (0, 1))
        return np.minimum(a, b), np.maximum(a, b), left

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        again: set[int] = set()

        def close() -> None:
            a, b, left = pairs(held)
            found.append((a, b))
            if left:
                again.add(held[0].column("sig")[0].as_py())
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]) for k in (0, 1))
            once = np.unique(np.stack([a, b], 1), axis=0)
            sigs = sorted(again)
            found.clear()
            again.clear()
            columns = [pa.array([*once[:, 0].tolist(), *[None] * len(sigs)], pa.int64()), pa.array([*once[:, 1].tolist(), *[None] * len(sigs)], pa.int64()), pa.array([None] * len(once) + sigs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "again"])

        for batch, new in _runs(batches, ["sig", "bi", "bj"]):
            starts = np.flatnonzero(new)
            edges = np.unique(np.concatenate([[0], starts, [batch.num_rows]]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if new[lo] and held:
                    close()
                held.append(batch.slice(lo, hi - lo))
            if sum(len(f[0]) for f in found) > 100_000:
                yield from flush()
        if held:
            close()
        if found:
            yield from flush()

    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, root) of the nodes of ``links`` (a, b): the smallest node of their component, by alternating large and small stars."""
    edges = scratch.save(links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "links-0")
    state, turn = None, 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        n = both.count()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
        large = attach(both, least, "u", "deg", n).where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        large = scratch.save(large, f"large-{turn}")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
        small = attach(large, down, "u", "deg", max(n, 1))
        small = small.where("v <> m").select(F.col("m").alias("v"), F.col("v").alias("u")).unionByName(down.select(F.col("m").alias("v"), "u")).distinct()
        edges = scratch.save(small, f"links-{turn}")
        scratch.drop(f"links-{turn - 1}", f"large-{turn}")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (now["n"], now["x"]) == state:
            roots = edges.select(F.col("u").alias("sid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("sid"), F.col("v").alias("root")).distinct())
            roots = scratch.save(roots, "roots")
            scratch.drop(f"links-{turn}")
            return roots
        state = (now["n"], now["x"])


class Join:
    """One run of the operator over (doc_id, text). A row's identity is (id is null, id, hash of the text), in this order."""

    def __init__(self, docs: DataFrame, width: int, share: int):
        ship(docs.sparkSession)
        self.width, self.share = width, share
        self.scratch = Scratch(docs.sparkSession, "jaccard")
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), text_hash(docs["text"]).alias("th"))
        schema = "doc_id bigint, th bigint, n bigint, sid bigint, sketch binary"
        rows = self.docs.mapInArrow(lean(_sets(width, share)), schema).withColumn("rid", F.monotonically_increasing_id()).withColumn("h", F.col("sid"))
        self.rows = self.scratch.save(rows, "sets")
        filled = self.rows.where("n > 0")
        self.n_rows = self.rows.count()
        tested = maybe_twice(filled, self.n_rows)
        some = tested.where("maybe")
        groups = some.groupBy("sid").agg(F.min("rid").alias("first_rid"), F.min(identity()).alias("first"), F.count(F.lit(1)).alias("size"))
        self.groups = self.scratch.save(groups.where("size > 1"), "copies")
        alone = tested.where("not maybe").select("sid", "n", "doc_id", "th", "sketch", identity().alias("first"))
        met = attach(tested.where("maybe").select("sid", "n", "doc_id", "th", "sketch", "rid"), self.groups, "sid", "size", self.n_rows)
        kept = met.where("first_rid is null or rid = first_rid").select("sid", "n", "doc_id", "th", "sketch", F.coalesce("first", identity()).alias("first"))
        self.classes = alone.unionByName(kept)

    def members(self) -> DataFrame:
        rows = self.docs.select("text").mapInArrow(lean(_signatures(self.width, self.share)), "sig bigint, sid bigint")
        return self.scratch.save(rows.repartition("sig").sortWithinPartitions("sig", "sid").mapInArrow(lean(_members), "sig bigint, center bigint, sid bigint"), "members")

    def links(self, pairs: DataFrame, turn: str) -> DataFrame:
        """Of candidate pairs (a, b) those that are similar, by their whole sets."""
        scratch = self.scratch
        wanted = scratch.save(pairs.select(F.col("a").alias("_sid")).unionByName(pairs.select(F.col("b").alias("_sid"))).distinct(), f"wanted-{turn}")
        # one row of each wanted class, found again in the documents by a bitmap of their identities
        who = self.classes.select("sid", F.xxhash64("doc_id", "th").alias("h")).join(wanted, F.col("sid") == F.col("_sid")).select("h")
        held, bits = bitmap(who, max(wanted.count(), 1))
        again = maybe_repeated(self.docs.withColumn("h", F.xxhash64("doc_id", "th")), held, bits).where("maybe").select("text")
        width = self.width

        def remake(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in text_blocks(batches):
                sets = [s for s in shingle_sets(texts, width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "members"])

        made = again.mapInArrow(lean(remake), "sid bigint, members binary").join(wanted, F.col("sid") == F.col("_sid"), "left_semi")
        one = scratch.save(made.groupBy("sid").agg(F.min("members").alias("members")), f"once-{turn}")
        n = max(pairs.count(), 1)
        met = fetch(pairs, "a", one.select(F.col("sid").alias("a"), F.col("members").alias("set_a")), "b", n)
        met = fetch(met, "b", one.select(F.col("sid").alias("b"), F.col("members").alias("set_b")), "a", n)
        links = scratch.save(met.select("a", "b", "set_a", "set_b").mapInArrow(lean(_verify(self.share)), "a bigint, b bigint"), f"similar-{turn}")
        scratch.drop(f"wanted-{turn}", f"once-{turn}")
        return links

    def components(self) -> DataFrame:
        """doc_id, th, n, component (the smallest identity of it) of every row; of rows in no group it is null."""
        scratch = self.scratch
        members = self.members().select("sig", "sid")
        nodes = self.classes.select("sid", "n", "sketch").join(members.select(F.col("sid").alias("_sid")).distinct(), F.col("sid") == F.col("_sid"), "left_semi")
        nodes = scratch.save(nodes, "nodes")
        n_members = max(members.count(), 1)
        sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
        weight = attach(members, sizes, "sig", "size", n_members).groupBy(F.col("sid").alias("_sid")).agg(F.sum("size").alias("weight"))
        weighted = members.join(weight, F.col("sid") == F.col("_sid")).select("sig", "sid", "weight")
        centers = weighted.groupBy("sig").agg(F.max(F.struct("weight", F.col("sid").alias("center"))).alias("c"), F.count(F.lit(1)).alias("size"))
        centers = scratch.save(centers.select("sig", "size", "c.center"), "centers")
        star = attach(members, centers, "sig", "size", n_members).where("center <> sid").select(F.least("center", "sid").alias("a"), F.greatest("center", "sid").alias("b")).distinct()
        star = scratch.save(star, "star")
        scratch.drop("centers")
        n_star = max(star.count(), 1)
        a, b = (nodes.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
        near = fetch(fetch(star, "a", a, "b", n_star), "b", b, "a", n_star).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        near = near.where(f"100 * least(n_a, n_b) >= {self.share} * greatest(n_a, n_b)")
        links = self.links(scratch.save(near.mapInArrow(lean(_passing(self.share)), "a bigint, b bigint"), "near"), "star")
        scratch.drop("star", "near")
        roots = components(links, scratch).withColumnRenamed("sid", "_sid")
        # members whose signature still joins several components: in rounds, the nearest partners first
        most, turn, again = NEAREST, 0, None
        while True:
            own = members if again is None else members.join(again, F.col("sig") == F.col("again"), "left_semi")
            told = own.join(roots, F.col("sid") == F.col("_sid"), "left").select("sig", "sid", F.coalesce("root", "sid").alias("comp"))
            told = scratch.save(told, f"told-{turn}")
            split = told.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi and size > 2")
            split = scratch.save(split.select("sig", "size"), f"split-{turn}")
            left = attach(told, split, "sig", "size", n_members).where("size is not null")
            left = left.join(nodes.withColumnRenamed("sid", "_sid"), F.col("sid") == F.col("_sid")).drop("_sid")
            left = left.withColumn("blocks", F.expr(f"cast(ceil(size / {BLOCK}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(sid), blocks) as int)"))
            left = left.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
            left = left.select("sig", "bi", "bj", "block", "sid", "comp", "n", "sketch")
            more = left.repartition("sig", "bi", "bj").sortWithinPartitions("sig", "bi", "bj").mapInArrow(lean(_across(self.share, most)), "a bigint, b bigint, again bigint").distinct()
            more = scratch.save(more, f"across-{turn}")
            scratch.drop(f"told-{turn}", f"split-{turn}")
            pairs = more.where("a is not null").select("a", "b")
            if not pairs.isEmpty():
                second = self.links(pairs, f"across-{turn}")
                if not second.isEmpty():
                    links = scratch.save(links.unionByName(second), f"all-{turn}")
                    scratch.drop("roots")
                    roots = components(links, scratch).withColumnRenamed("sid", "_sid")
            again = more.where("again is not null").select("again")
            if again.isEmpty():
                break
            most, turn = 4 * most, turn + 1
        scratch.drop("members", "nodes")
        linked = self.classes.select("sid", "first").join(roots, F.col("sid") == F.col("_sid")).select("sid", "first", "root")
        linked = scratch.save(linked, "linked")
        least = linked.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("members"))
        named = scratch.save(attach(linked.select("sid", "root"), least, "root", "members", max(linked.count(), 1)).select("sid", "component"), "named")
        # rows: a class of copies has its size; other linked sets are classes of one
        of = self.groups.select("sid", "first", "size").join(named.withColumnRenamed("sid", "_sid"), F.col("sid") == F.col("_sid"), "full")
        of = of.select(F.coalesce("sid", "_sid").alias("sid"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("component", "first").alias("component"))
        of = scratch.save(of, "of")
        scratch.drop(*[name for name in scratch.paths if name not in ("sets", "of")])
        return attach(self.rows.select("doc_id", "th", "n", "sid"), of, "sid", "size", self.n_rows).select("doc_id", "th", "n", "component")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        named = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component.doc_id"))
        return self.components().select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"))


def identity() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("th"))


def join(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. ``share``: the similarity, in hundredths."""
    return Join(docs, width, share).run()


def keep(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, null ids last.

    Goes by rows, not by ids: of documents that share an id each stands for
    itself, by a hash of its text. Of rows that repeat both one stays; so one row
    of each component is left, null ids included. Documents without words are
    linked with nothing and all stay. Which rows may leave is tested against a
    bitmap first, so most never shuffle."""
    run = Join(docs, width, share)
    grouped = run.components().where("component is not null")
    own = grouped.groupBy("doc_id", "th").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("rows"))
    leaves = ~F.col("component").eqNullSafe(identity())
    told = own.where(leaves | (F.col("rows") > 1)).select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "th").alias("k"), F.xxhash64("doc_id", "th").alias("h"), "rows", leaves.alias("leaves"))
    told = run.scratch.save(told, "lost")
    run.scratch.drop(*[name for name in run.scratch.paths if name != "lost"])
    held, bits = bitmap(told, max(told.count(), 1))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc"), text_hash(docs["text"]).alias("th"))
    tested = maybe_repeated(rows.withColumn("h", F.xxhash64("doc", "th")), held, bits)
    some = tested.where("maybe").select("row", F.concat_ws(":", F.coalesce(F.col("doc").cast("string"), F.lit("-")), "th").alias("k"))
    met = attach(some, told.drop("h"), "k", "rows", run.n_rows, spread="k")
    whole = met.where("leaves is null").select("row.*")
    once = met.where("not leaves").dropDuplicates(["k"]).select("row.*")
    return tested.where("not maybe").select("row.*").unionByName(whole).unionByName(once)
