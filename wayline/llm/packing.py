"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every partition tokenises its documents, cuts those of more than the capacity,
and packs its pieces best-fit, longest first. Bins with at most SLACK free
tokens are done, and so are those that the smallest bin left no longer fits in.
The underfull rest become items themselves: they are dealt to a FAN_IN-th as many
nodes, which merge theirs by best-fit, emit what is done, and pass on what is
not, up a tree. A bin carries its members, at most one a token, so no level
needs a join to find them again. The tree ends with one node, or with as many as
keep NODE_BINS bins to a node on average: best-fit over so many wastes next to
nothing, and no task grows with the corpus.

Local packing holds its partition's piece lengths, not its texts; input
partitions are bounded by ``spark.sql.files.maxPartitionBytes``.

Edge cases: a null or empty text is one piece, the separator alone. Rows that
repeat an id are packed each on its own. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import lean, materialize, text_blocks

CAPACITY = 2048
SEPARATOR = 0
SLACK = 8
FAN_IN = 8
NODE_BINS = 50_000
MEMBER = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
BIN = f"bin bigint, used bigint, node bigint, members {MEMBER}"

# The pattern by which the published byte-level BPE vocabulary splits a text; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, as the ``tokenizers`` library gives them.

    The file's vocabulary runs in tiktoken, which gives equal ids at a quarter
    of the CPU time. Files of another make, and texts that tiktoken refuses, go
    to ``tokenizers`` itself."""

    def __init__(self, path: str):
        self.path, self._slow, self._fast = path, None, None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, before = made["model"], made.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
        made_of = [model["vocab"].get(a + b, -1) for a, b in merges]
        in_order = all(a < b for a, b in zip(made_of, made_of[1:]))  # tiktoken merges by id, the file by place
        usual = in_order and model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer") and not model.get("ignore_merges")
        if usual:
            import tiktoken

            shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            self._special = [s.encode() for s in special]
            self._fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def ids(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        if self._fast is None or any(s in raw for s in self._special):
            return np.array(self.slow(text), "<u4")
        try:
            return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        except ValueError:  # its splitter gives up on some very long runs of white space
            return np.array(self.slow(text), "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the open bin with the least room that still holds it.

    ``rooms`` is a bit set of the free sizes for which a bin is open, so the
    search for the least sufficient one takes a shift and a lowest set bit."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def pack_locally(path: str, capacity: int):
    """Arrow batches of (doc_id, text) of a partition to its bins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, found = ByteBpe(path), []
        for batch, texts in text_blocks(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(bpe.ids(raw), np.uint32(SEPARATOR)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    found.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
        # a fixed order whatever the order of rows, so that a repeated task makes the same bins
        found.sort(key=lambda m: (-m[3], m[0] is None, m[0] or 0, m[1], m[4]))
        part = TaskContext.get().partitionId()
        yield from _bins([([m], m[3]) for m in found], capacity, part << 33, part)

    return run


def merge(capacity: int):
    """The underfull bins of a node's children, packed again; their ids stay unique, as a bin takes one of its own members'."""

    def run(key: tuple, frame: pa.Table) -> pa.Table:
        rows = sorted(frame.select(["bin", "used", "members"]).to_pylist(), key=lambda r: (-r["used"], r["bin"]))
        out = []
        for b in best_fit([r["used"] for r in rows], capacity):
            out.append((min(rows[i]["bin"] for i in b), sum(rows[i]["used"] for i in b), key[0].as_py(), [m for i in b for m in rows[i]["members"]]))
        names = ["bin", "used", "node", "members"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _arrow_types(), strict=True)], names=names)

    return run


def _arrow_types() -> list[pa.DataType]:
    member = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return [pa.int64(), pa.int64(), pa.int64(), pa.list_(member)]


def _bins(items: list[tuple[list, int]], capacity: int, first: int, node: int) -> Iterator[pa.RecordBatch]:
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    bins = best_fit([n for _, n in items], capacity)
    for at in range(0, len(bins), 2000):
        part = bins[at : at + 2000]
        members = [[dict(zip(fields, m, strict=True)) for i in b for m in items[i][0]] for b in part]
        used = [sum(items[i][1] for i in b) for b in part]
        columns = [[first + at + k for k in range(len(part))], used, [node] * len(part), members]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _arrow_types(), strict=True)], names=["bin", "used", "node", "members"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, node_bins: int = NODE_BINS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    level = materialize(rows.mapInArrow(lean(pack_locally(tokenizer, capacity)), BIN), "pack")
    done, depth, nodes = [], 0, None
    while True:
        under = level.where(F.col("used") < capacity - slack)
        seen = under.agg(F.min("used").alias("least"), F.countDistinct("node").alias("nodes")).first()
        # whoever has less room than the least of them takes none
        open_ = (F.col("used") < capacity - slack) & (F.col("used") <= capacity - (seen["least"] or 0))
        left = level.where(open_).count()
        nodes = seen["nodes"] if nodes is None else nodes
        upper = max(-(-nodes // fan_in), -(-left // node_bins))
        if not left or upper >= nodes:
            done.append(level)
            break
        done.append(level.where(~open_))
        rest = level.where(open_).withColumn("node", F.pmod(F.xxhash64("bin"), F.lit(upper)))
        merged = rest.repartition(upper, "node").groupBy("node").applyInArrow(merge(capacity), BIN)
        level, depth, nodes = materialize(merged, f"pack-{depth + 1}"), depth + 1, upper
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    before = "aggregate(slice(members, 1, at), 0L, (s, m) -> s + m.length)"
    placed = bins.select("bin", F.expr("transform(members, (m, at) -> struct(m as m, coalesce({}, 0L) as offset))".format(before)).alias("members"))
    out = placed.select("bin", F.explode("members").alias("x"))
    return out.select("x.m.doc_id", "x.m.piece", "x.m.start", "x.m.length", "x.m.ids_crc32", F.col("bin").alias("sequence_id"), "x.offset")
