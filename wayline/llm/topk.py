"""Exact top-k search by block-at-a-time pruning.

Vectors are rows of terms (dimensions) with integer weights. Blocks are ranges
of ids; each keeps its forward index (the vectors' weights) and, for every
term, its largest and smallest weight. For a query, the sum over its terms of
the larger of weight times maximum and weight times minimum bounds every score
in the block. Blocks are visited in falling order of that bound and scored
through their forward index until the bound is below the query's k-th score so
far. Scores equal to the k-th still count, since ties go to the smaller id.

A task holds one group of blocks, which it is sent once, and meets the queries one
packet at a time, so its memory does not grow with the number of queries.
Packets are copied to the groups of blocks, stream past behind the group, and
leave k results a query and group; a window over these keeps the best k. Every
group starts without a threshold; blocks are skipped within a group.

Edge cases: vectors that are null or hold null or non-finite components take no
part. Rows that share an id are vectors of their own: each is a candidate for
other ids and a query, whose results stand side by side.
Vectors meet only vectors of equal length; empty ones score 0. Null ids take no
part. Fewer than k candidates give fewer rows. Weights must stay below 2**22
in size and 2**9 terms for exact arithmetic in doubles; beyond that 64-bit
integers are used. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize

K = 5
BLOCK = 256  # ids of a block
GROUP = 8192  # vectors of a group of blocks, on average
PACKET = 512  # queries scored together
_EXACT = float(1 << 22)
_NONE = -(1 << 62)  # below every score


def integer_weights(vector: Column) -> Column:
    """floor(256 * x) of each component as double; null where the vector takes no part."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(as_double, lambda x: F.floor(x * 256).cast("bigint")))


def _pack(rows: DataFrame, per: int, name: str) -> DataFrame:
    """Rows of (dims, ``name``, ids, weights): the vectors of each range of row numbers, at most ``per``."""
    cell = F.floor(F.col("n") / F.lit(per)).cast("bigint")
    grouped = rows.groupBy("dims", cell.alias(name)).agg(F.array_sort(F.collect_list(F.struct("id", "n", "weights"))).alias("v"))
    return grouped.select("dims", name, F.col("v.id").alias("ids"), F.col("v.n").alias("rows"), F.flatten("v.weights").alias("weights"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id; the score _NONE stands for none."""
    if scores.shape[1] > 8 * k:  # whatever ties with the k-th stays
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = int((scores >= kth).sum(1).max())
        part = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
        scores, ids = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Blocks:
    """A group's blocks: forward indexes and term bounds."""

    def __init__(self, dims: int, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``blocks``: ids, row numbers and weights."""
        self.ids, self.rows = [b[0] for b in blocks], [b[1] for b in blocks]
        self.forward = [b[2].reshape(len(b[0]), dims) for b in blocks]
        small = all(np.abs(f).max(initial=0) < _EXACT for f in self.forward) and dims < 512
        self.kind = np.float64 if small else np.int64
        self.forward = [f.astype(self.kind) for f in self.forward]
        self.top = np.stack([f.max(0) for f in self.forward])
        self.low = np.stack([f.min(0) for f in self.forward])
        self.visited = 0

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of every query but the row ``own``."""
        n = len(own)
        kind = self.kind if np.abs(queries).max(initial=0) < _EXACT else np.int64
        q = queries.astype(kind)
        bound = (np.maximum(q, 0) @ self.top.T.astype(kind) + np.minimum(q, 0) @ self.low.T.astype(kind)).astype(np.int64)
        order = np.argsort(-bound, axis=1, kind="stable")
        scores = np.full((n, k), _NONE)
        ids = np.zeros((n, k), np.int64)
        live = np.arange(n)
        for step in range(bound.shape[1]):
            block = order[live, step]
            # a block whose bound is below the k-th score ends the query, as all later ones are lower still
            open_ = bound[live, block] >= scores[live, k - 1]
            live, block = live[open_], block[open_]
            if not len(live):
                break
            by = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by], prepend=-1))
            for at, end in zip(cuts, [*cuts[1:], len(by)], strict=True):
                rows, b = live[by[at:end]], block[by[at]]
                self.visited += len(rows)
                got = (q[rows] @ self.forward[b].T.astype(kind)).astype(np.int64)
                got[self.rows[b][None, :] == own[rows][:, None]] = _NONE
                names = np.broadcast_to(self.ids[b], got.shape)
                s, i = best(np.concatenate([scores[rows], got], 1), np.concatenate([ids[rows], names], 1), k)
                scores[rows], ids[rows] = s, i
        return scores, ids


def _numbers(lists: pa.ListArray) -> list[np.ndarray]:
    flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _search(k: int):
    """Rows sorted by (dims, grp, packet): each group's blocks, packet -1, before its packets of queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            columns = {c: batch.column(c) for c in ("dims", "grp", "packet", "blocks", "ids", "rows", "weights")}
            for at in range(batch.num_rows):
                now = (columns["dims"][at].as_py(), columns["grp"][at].as_py())
                if columns["packet"][at].as_py() < 0:
                    blocks = columns["blocks"][at].values
                    parts = [_numbers(blocks.field(c)) for c in ("ids", "rows", "weights")]
                    held, key = Blocks(now[0], list(zip(*parts, strict=True))), now
                    continue
                if key != now:  # no vectors of this length in this group
                    continue
                ids, rows, weights = (columns[c][at].values.to_numpy(zero_copy_only=False) for c in ("ids", "rows", "weights"))
                scores, found = held.search(rows, weights.reshape(len(ids), now[0]), k)
                there = scores > _NONE
                who, which = (np.broadcast_to(x[:, None], found.shape)[there] for x in (ids, rows))
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(who), pa.array(found[there]), pa.array(scores[there])], names=["n", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of the other rows for each row that ``is_query`` selects.

    ``vectors``: id, weights (array of bigint, null for rows that take no part)."""
    ship(vectors.sparkSession)
    rows = vectors.where("id is not null and weights is not null").select("id", "weights", F.size("weights").cast("int").alias("dims"))
    rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "topk")
    n_groups = rows.count() // GROUP + 1
    blocks = _pack(rows, BLOCK, "block").withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int"))
    groups = blocks.groupBy("dims", "grp").agg(F.array_sort(F.collect_list(F.struct("block", "ids", "rows", "weights"))).alias("blocks"))
    queries = _pack(rows.where(is_query), PACKET * 50, "packet")
    asked = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    none = F.lit(None).cast("array<bigint>")
    there = groups.select("dims", "grp", F.lit(-1).cast("bigint").alias("packet"), "blocks", none.alias("ids"), none.alias("rows"), none.alias("weights"))
    asked = asked.select("dims", "grp", "packet", F.lit(None).cast(groups.schema["blocks"].dataType).alias("blocks"), "ids", "rows", "weights")
    met = there.unionByName(asked).repartition("dims", "grp").sortWithinPartitions("dims", "grp", "packet")
    found = met.mapInArrow(_search(k), "n bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("n").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
