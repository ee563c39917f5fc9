"""Line deduplication by winnowing over line hashes.

A line is known by a hash of its words (A-Z folded; blank lines don't count).
Fingerprints are runs of GRAM lines, chosen by winnowing: of every WINDOW
consecutive runs the one with the smallest hash, and every run that has
LONG_WORDS words or more; a line of LONG_WORDS words or more is a fingerprint by
itself. Fingerprints are joined to the place where
their content stands first in the corpus, by (doc_id, position). Each match is
extended both ways as long as the lines agree; the later copy of a run of at
least GRAM lines, or with LONG_WORDS words, is deleted.

Windows alone guarantee runs of GRAM + WINDOW - 1 lines. For shorter ones there is
an exact way: of the runs of GRAM lines that no window chose, those join whose
hash a bitmap, of all that stand more than once, can't clear. So every run of
GRAM lines or more that stood before is found, and nothing of it stays; the first
copy of a fingerprint always stays.

Only hashes move, and of each content one first place: a line in a third of all
documents is counted before it shuffles, and its first place is broadcast with
the others of at most 1000 such contents.

Edge cases: a null text is empty, with one blank line. Rows that repeat both id
and text are one document. Null ids come last. Other columns are ignored by
``find`` and kept by ``clean``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Words, attach, joint_hash, materialize, splitmix, text_blocks
from .exact_dedup import bitmap, maybe_repeated, maybe_twice

GRAM, WINDOW, LONG_WORDS = 2, 2, 50


def line_hashes(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each text: hashes, word counts and numbers of its lines with words, and the number of all its lines."""
    w = Words(texts)
    stops = np.flatnonzero(w.data == 10)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
    lo = np.searchsorted(w.begin, begins)
    hi = np.append(lo[1:], len(w.begin)) if len(lo) else lo
    nth = (np.arange(len(w.begin)) - np.repeat(lo, hi - lo)).astype(np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(w.hash + nth * np.uint64(0xA0761D6478BD642F)))])
    hashes = splitmix(run[hi] - run[lo] + (hi - lo).astype(np.uint64))
    first = np.searchsorted(begins, w.offset)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        held = np.flatnonzero(hi[a:b] > lo[a:b])
        out.append((hashes[a:b][held], (hi - lo)[a:b][held], held, int(b - a)))
    return out


def winnow(lines: np.ndarray, words: np.ndarray, gram: int, window: int, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content hash, position, chosen) of the runs of a sequence of lines: fingerprints, and the others."""
    long = np.flatnonzero(words >= long_words)
    keys, at, chosen_ = [joint_hash(np.ones(len(long), np.uint64), lines[long])], [long], [np.ones(len(long), bool)]
    n = len(lines) - gram + 1
    if n > 0:
        grams = joint_hash(np.full(n, gram, np.uint64), *[lines[i : i + n] for i in range(gram)])
        wide = min(window, n)
        view = np.lib.stride_tricks.sliding_window_view(grams, wide)
        # the rightmost of equal minima
        least = np.arange(len(view)) + wide - 1 - view[:, ::-1].argmin(1)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(words, dtype=np.int64)])
        chosen = np.union1d(least, np.flatnonzero(upto[gram:] - upto[:n] >= long_words))
        keys.append(grams)
        at.append(np.arange(n))
        chosen_.append(np.isin(np.arange(n), chosen))
    return np.concatenate(keys), np.concatenate(at), np.concatenate(chosen_)


def extend(later: np.ndarray, earlier: np.ndarray, at: int, source: int, same: bool) -> tuple[int, int]:
    """The longest run around a match of position ``at`` with ``source``, as a range of the later text."""
    lo = at
    while lo > 0 and source - (at - lo) > 0 and later[lo - 1] == earlier[source - (at - lo) - 1]:
        lo -= 1
    hi = at
    while hi < len(later) and source + (hi - at) < len(earlier) and later[hi] == earlier[source + (hi - at)]:
        hi += 1
    return lo, hi


def removed_lines(lines: np.ndarray, words: np.ndarray, matches: Iterable[tuple[int, int, np.ndarray]], gram: int, long_words: int) -> np.ndarray:
    """Positions to delete, from matches (position, source position, the source's lines)."""
    gone = np.zeros(len(lines), bool)
    done: set[tuple[int, int, int]] = set()
    for at, source, earlier in matches:
        known = (id(earlier), at - source, at)
        if known in done:
            continue
        lo, hi = extend(lines, earlier, at, source, earlier is lines)
        done.update((known[0], known[1], k) for k in range(lo, hi))
        if hi - lo >= gram or words[lo:hi].sum() >= long_words:
            gone[lo:hi] = True
    return np.flatnonzero(gone)


_LONG = pa.list_(pa.int64())


def _scan(gram: int, window: int, long_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            found = line_hashes(texts)
            marks = [winnow(h, w, gram, window, long_words) for h, w, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([f[0].view(np.int64) for f in found], _LONG),
                    pa.array([f[1] for f in found], _LONG),
                    pa.array([f[2] for f in found], _LONG),
                    pa.array([m[0].view(np.int64) for m in marks], _LONG),
                    pa.array([m[1] for m in marks], _LONG),
                    pa.array([m[2] for m in marks], pa.list_(pa.bool_())),
                ],
                names=["doc_id", "th", "n_lines", "lines", "words", "number", "keys", "at", "chosen"],
            )

    return run


def _delete(gram: int, long_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gone = [], []
            columns = {k: batch.column(k) for k in batch.schema.names}
            for i in range(batch.num_rows):
                lines, words, number = (columns[k][i].values.to_numpy(zero_copy_only=False) for k in ("lines", "words", "number"))
                earlier = columns["source_lines"][i].values.to_numpy(zero_copy_only=False)
                matches = [(m["at"], m["source"], earlier) for m in columns["matches"][i].as_py()]
                ids.append(columns["id"][i].as_py())
                gone.append(number[removed_lines(lines, words, sorted(matches, key=lambda m: m[:2]), gram, long_words)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(gone, _LONG)], names=["id", "gone"])

    return run


def text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def find(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, th, n_lines, gone) of each distinct document; gone: numbers of its lines to delete, from 0, sorted."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), text_hash(docs).alias("th"))
    schema = "doc_id bigint, th bigint, n_lines bigint, lines array<bigint>, words array<bigint>, number array<bigint>, keys array<bigint>, at array<bigint>, chosen array<boolean>"
    found = rows.mapInArrow(_scan(gram, window, long_words), schema).dropDuplicates(["doc_id", "th"])
    found = materialize(found.withColumn("id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "th")), "lines")
    n = max(found.count(), 1)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "pos")
    places = found.select("id", "doc_id", "th", F.explode(F.arrays_zip("keys", "at", "chosen")).alias("x")).select("id", "doc_id", "th", F.col("x.keys").alias("h"), F.col("x.at").alias("pos"), "x.chosen")
    n_places = found.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"]
    places = maybe_twice(places, n_places).where("chosen or maybe").select("id", "doc_id", "th", F.col("h").alias("key"), "pos")
    firsts = places.groupBy("key").agg(F.min(F.struct(*[order], "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select("key", "n", F.col("first.id").alias("source_id"), F.col(f"first.{'col1'}.pos").alias("source")), "lines-firsts")
    joined = attach(places.select("id", "key", "pos"), firsts, "key", "n", n).where("source_id is not null and not (id = source_id and pos = source)")
    pairs = joined.groupBy("id", "source_id").agg(F.collect_set(F.struct(F.col("pos").alias("at"), "source")).alias("matches"))
    pairs = materialize(pairs, "lines-pairs")
    used = pairs.groupBy("source_id").agg(F.count(F.lit(1)).alias("uses"))
    sources = used.join(found.select("id", F.col("lines").alias("source_lines")), F.col("source_id") == F.col("id")).select("source_id", "uses", "source_lines")
    sources = materialize(sources, "lines-sources")
    met = attach(pairs, sources, "source_id", "uses", max(pairs.count(), 1))
    own = found.select(F.col("id").alias("_id"), "lines", "words", "number")
    met = met.join(own, F.col("id") == F.col("_id")).select("id", "lines", "words", "number", "source_lines", "matches")
    gone = met.mapInArrow(_delete(gram, long_words), "id string, gone array<bigint>")
    gone = gone.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")).withColumnRenamed("id", "_id")
    none = F.expr("cast(array() as array<bigint>)")
    return found.join(gone, F.col("id") == F.col("_id"), "left").select("doc_id", "th", "n_lines", F.coalesce("gone", none).alias("gone"))


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the lines that ``find`` found (written once before), with all their columns.

    Documents that a bitmap of the changed ones clears do not shuffle."""
    lost = found.where("size(gone) > 0").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "gone")
    held, bits = bitmap(lost.select(F.xxhash64("_doc", "_th").alias("h")), max(lost.count(), 1))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc"), text_hash(docs).alias("th"))
    tested = maybe_repeated(rows.withColumn("h", F.xxhash64("doc", "th")), held, bits)
    joined = tested.where("maybe").join(lost, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
    short = F.expr("array_join(filter(split(row.text, '\\n', -1), (x, i) -> not array_contains(gone, cast(i as bigint))), '\\n')")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(short)
    cut = joined.select(F.col("row").withField("text", text).alias("row"))
    return tested.where("not maybe").select("row.*").unionByName(cut.select("row.*"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), text_sha256 (of what stays) of every document."""
    found = materialize(find(docs), "lines-gone")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    short = clean(plain.withColumn("th", F.xxhash64("text")), found).select("doc_id", "th", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    facts = found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))
    return short.join(facts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).select("doc_id", "n_lines", "n_removed", "removed", "text_sha256")
