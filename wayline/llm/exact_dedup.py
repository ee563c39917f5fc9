"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Texts are equal when identical after every run of ASCII white space is
replaced by one space. Pass one hashes each row to a cell of a filter and
counts the cells: no row moves, only the numbers of the cells that a task has
met (partially aggregated). Pass two tests each row against the bitmap of
cells hit more than once. Only rows that pass - repeated texts and a few false
positives - shuffle to be grouped; all others are unique and go straight
through.

The bitmap has BITS_PER_ROW bits a row. Rows that need more than MAX_BITS, of
which 256 MB are broadcast, are dealt by hash range into slices with a filter
each, written next to each other without a shuffle and tested one after
another; so the share of false positives is the same at any input size. The
grouping is by the whole SHA-256 digest.

Edge cases: a null text counts as the empty text. Null ids sort after all
others. Among rows with the same smallest id exactly one stays. Other columns
are ignored by ``find`` and kept by ``keep``. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, fresh_path, materialize

BITS_PER_ROW = 16
MAX_BITS = 1 << 31
_CELL = 32768  # bits of one bitmap of Spark's bitmap functions


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def repeated_cells(hashes: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the filter's cells that more than one row hits."""
    cells = hashes.groupBy(F.pmod("h", F.lit(bits)).alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cells.groupBy(F.expr(f"cell div {_CELL}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"cell % {_CELL}")).alias("bitmap"))


def maybe_repeated(rows: DataFrame, filled: DataFrame, bits: int) -> DataFrame:
    """``rows`` with a column ``maybe``: whether the filter can't rule a repetition out."""
    cell = f"pmod(h, {bits}L)"
    byte = f"cast(conv(hex(substring(bitmap, cast({cell} % {_CELL} div 8 as int) + 1, 1)), 16, 10) as int)"
    tested = rows.join(F.broadcast(filled), F.expr(f"{cell} div {_CELL}") == F.col("bucket"), "left")
    maybe = F.expr(f"coalesce((shiftright({byte}, cast({cell} % 8 as int)) & 1) = 1, false)")
    return tested.select(*rows.columns, maybe.alias("maybe"))


def _bits(n: int) -> int:
    bits = _CELL
    while bits < MAX_BITS and bits < n * BITS_PER_ROW:
        bits *= 2
    return bits


def filter_bits(rows: DataFrame) -> tuple[int, int]:
    """Number of rows, and the bits of a filter for so many."""
    n = rows.count()
    return n, _bits(n)


def bitmap(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(bucket, bitmap) of the cells of about ``n`` hashes h, for ``maybe_repeated``, and its bits.

    Past MAX_BITS more rows pass than need to; callers join what passes exactly."""
    bits = _bits(n)
    cells = hashes.select(F.pmod("h", F.lit(bits)).alias("cell")).distinct()
    return cells.groupBy(F.expr(f"cell div {_CELL}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"cell % {_CELL}")).alias("bitmap")), bits


def maybe_twice(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (with a hash h, ``n`` of them) with ``maybe``: false where the hash certainly stands once."""
    slices, bits = -(-n * BITS_PER_ROW // MAX_BITS), _bits(n)
    if slices <= 1:
        return maybe_repeated(rows, repeated_cells(rows, bits), bits)
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "slices")
    rows.withColumn("_slice", F.expr(f"cast(shiftrightunsigned(h, 40) % {slices} as int)")).write.partitionBy("_slice").parquet(path)
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(path)
    out = None
    for i in range(slices):
        own = dealt.where(F.col("_slice") == i).drop("_slice")
        done = materialize(maybe_repeated(own, repeated_cells(own, bits), bits), "slice")
        out = done if out is None else out.unionByName(done)
    return out


def _digests(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text_sha256, h, rid, maybe) of every row; their number. All but ``maybe`` lies in the shared folder."""
    digest = F.sha2(normalized(docs["text"]).cast("binary"), 256)
    rows = docs.select(docs["doc_id"].alias("doc_id"), digest.alias("text_sha256"))
    rows = materialize(rows.withColumn("h", F.xxhash64("text_sha256")).withColumn("rid", F.monotonically_increasing_id()), "exact")
    n = rows.count()
    return maybe_twice(rows, n), n


def _groups(some: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    return some.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))


def find(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    tested, n = _digests(docs)
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = tested.where("maybe").select("doc_id", "text_sha256", "rid")
    joined = attach(some, _groups(some), "text_sha256", "group_size", n)
    grouped = joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the one with the smallest id.

    The hashes' groups give a second filter, of the repeated ones alone, for the
    documents themselves: texts that it clears never shuffle; the others meet
    the first id of their group."""
    tested, n = _digests(docs)
    groups = _groups(tested.where("maybe")).where("group_size > 1").withColumn("h", F.xxhash64("text_sha256"))
    groups = materialize(groups, "exact-groups")
    held, bits = bitmap(groups, max(groups.count(), 1))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.sha2(normalized(docs["text"]).cast("binary"), 256).alias("text_sha256"))
    found = maybe_repeated(marked.withColumn("h", F.xxhash64("text_sha256")), held, bits)
    alone = found.where("not maybe").select("row.*")
    joined = attach(found.where("maybe").select("row", "text_sha256"), groups.drop("h"), "text_sha256", "group_size", n, "row.doc_id")
    single = joined.where("group_size is null").select("row.*")
    # rows that repeat both id and text: one of them stays
    first = joined.where("group_size is not null and row.doc_id <=> first.doc_id").dropDuplicates(["text_sha256"])
    return alone.unionByName(single).unionByName(first.select("row.*"))
