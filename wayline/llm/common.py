"""What the operators of this subpackage share.

* ``materialize`` cuts lineage with a Parquet table in the shared folder the
  session names, so a lost executor costs a re-read, not a recomputation;
* ``attach`` joins group facts back to rows when one group may hold any share
  of them;
* ``text_blocks`` and ``Words`` turn Arrow batches of text into numpy arrays,
  a bounded number of bytes at a time.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

# A group with more than one row in so many counts as hot; there can be at
# most so many of them, which bounds what ``attach`` broadcasts.
HOT_SHARE = 1000

# Rows that share one copy of a key's facts in ``fetch``.
PER_COPY = 512

# Bytes of text handled at once in a Python worker (one longer text is handled alone).
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a folder of its own; a
    cluster without it is an error, since a machine-local folder would be
    invisible to the other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"/tmp/checkpoints/wayline-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_forget, spark, found)
    return found.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/wayline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets go of what earlier jobs left on the driver: plans and generated classes, and shuffle files and broadcasts, which Spark deletes once nothing on the driver refers to them.

    Native memory that the JVM has freed goes back to the system too."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give native memory that it has freed, but its allocator keeps, back to the system. False where the JVM has no command for it, as older ones don't."""
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface: its class is not open to calls from outside
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


class Scratch:
    """Tables of one run in the shared folder, by name; ``drop`` deletes those whose readers have all written their results."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = fresh_path(self.spark, f"{self.label}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, spread: str | None = None) -> DataFrame:
    """``rows`` left-joined with the facts of their group, for any distribution of ``key``.

    ``groups`` has one row for each key, with the group's number of rows in
    ``size``. At most HOT_SHARE groups can hold more than ``n_rows / HOT_SHARE``
    rows: these are broadcast, and their rows never shuffle by the key. Rows
    that found a hot group are dealt out by a hash of their content and task in
    the join with the rest: a task that is run again deals them out alike.
    ``spread`` names what to hash, by default all columns of plain types. Rows
    without a group keep nulls; a null key has none."""
    limit = max(1, n_rows // HOT_SHARE)
    facts = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in facts])
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in facts])
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    text_key = F.col(key).cast("string")
    content = [F.col(spread)] if spread else [F.col(f.name) for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    away = F.concat(F.lit("~"), F.xxhash64(*content, F.spark_partition_id()).cast("string"))
    found = found.withColumn("_jk", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), text_key).otherwise(away))
    joined = found.join(cold, F.col("_jk") == F.col("_ck").cast("string"), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in facts])


def fetch(rows: DataFrame, key: str, facts: DataFrame, salt_by: str, n_rows: int, per: int = PER_COPY) -> DataFrame:
    """``rows`` joined with the one row of ``facts`` (which has a column ``key`` too) for their key, for any distribution of it.

    The facts of a key that more than ``per`` rows use are copied once for so
    many rows, and these are dealt out over the copies by a hash of ``salt_by``."""
    uses = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_uses")).where(F.col("_uses") > per)
    salted = attach(rows, uses, key, "_uses", n_rows).withColumn("_salt", F.expr(f"cast(pmod(xxhash64({salt_by}), coalesce(ceil(_uses / {per}), 1)) as int)")).drop("_uses")
    wide = facts.join(uses.withColumnRenamed(key, "_ukey"), F.col(key) == F.col("_ukey"), "left")
    wide = wide.withColumn("_copy", F.explode(F.expr(f"sequence(0, cast(coalesce(ceil(_uses / {per}), 1) as int) - 1)"))).drop("_uses", "_ukey").withColumnRenamed(key, "_fkey")
    return salted.join(wide, (F.col(key) == F.col("_fkey")) & (F.col("_salt") == F.col("_copy"))).drop("_fkey", "_salt", "_copy")


def text_hash(text: Column) -> Column:
    """With the id, what tells rows apart; null texts are empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and nothing of what else the table carries."""
    return df.select(*[df[n] for n in names])


# ---------------------------------------------------------------- text blocks


def text_blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose ``text`` column has about ``limit`` bytes, with the texts' bytes; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("text")
        texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
        first, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > limit:
                yield batch.slice(first, i - first), texts[first:i]
                first, held = i, 0
            held += len(t) + 1
        yield batch.slice(first), texts[first:]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED = _VALUES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _sums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each range of bytes: the sum of its bytes' values times powers of the base. Holds about a block at a time, whatever the lengths."""
    out = np.empty(len(begin), np.uint64)
    up, down = _power_table(BLOCK_BYTES)
    first = 0
    while first < len(begin):
        low = begin[first]
        last = max(int(np.searchsorted(end, low + BLOCK_BYTES, side="right")), first + 1)
        high = end[last - 1]
        if high - low <= BLOCK_BYTES:
            run = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_FOLDED[data[low:high]] * up[: high - low], out=run[1:])
            out[first:last] = (run[end[first:last] - low] - run[begin[first:last] - low]) * down[begin[first:last] - low]
        else:  # one word that is longer than a block
            total, step = 0, pow(_BASE, BLOCK_BYTES, 1 << 64)
            scale = 1
            for at in range(low, high, BLOCK_BYTES):
                part = data[at : min(at + BLOCK_BYTES, high)]
                total += scale * int((_FOLDED[part] * up[: len(part)]).sum(dtype=np.uint64))
                scale = scale * step % (1 << 64)
            out[first] = total % (1 << 64)
        first = last
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts as arrays.

    ``begin`` and ``end`` are byte positions in ``data`` (the texts, a newline
    after each), ``hash`` a 64-bit hash of the word's bytes, A-Z folded to a-z.
    The words of text i are ``first[i]`` up to ``first[i + 1]``."""

    def __init__(self, texts: list[bytes], between: np.ndarray = WHITE):
        joined = b"\n".join([*texts, b""])
        self.data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        white = between[self.data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(white) and not white[0]:
            edge = np.concatenate([[0], edge])
        self.begin, self.end = edge[0::2], edge[1::2]
        self.hash = splitmix(_sums(self.data, self.begin, self.end) + (self.end - self.begin).astype(np.uint64) * np.uint64(_BASE))
        self.first = np.searchsorted(self.begin, self.offset)


def joint_hash(*columns: np.ndarray) -> np.ndarray:
    """A hash of the sequence of values in each row."""
    out = np.full(len(columns[0]), 0x243F6A8885A308D3, np.uint64)
    for x in columns:
        out = splitmix(out * np.uint64(_BASE) + x)
    return out


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


SAMPLE_BYTES = 24 << 20  # of texts in a training sample


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, out: int, bounds: dict[int, int]) -> DataFrame:
    """(doc_id, text, label, place) of at most ``bounds[v]`` documents labelled v, whose remainder is not ``out``.

    The sample is the ids with the smallest hashes, so it is the same in each
    run; ``place`` orders it. An id with several labels takes the smallest, one
    that stands more than once in ``docs`` its smallest text. The ids, bounded by
    the bounds, are broadcast to the documents."""
    ship(docs.sparkSession)
    one = labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("sample_id")).agg(F.min(labels[label]).cast("int").alias("label"))
    one = one.where(remainder(F.col("sample_id"), divisor) != out)
    parts = [one.where(F.col("label") == v).orderBy(F.xxhash64("sample_id"), "sample_id").limit(n) for v, n in bounds.items()]
    ids = parts[0]
    for more in parts[1:]:
        ids = ids.unionByName(more)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    met = rows.join(F.broadcast(ids), rows["doc_id"] == ids["sample_id"])
    return met.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))


def lean(run):
    """A function for ``mapInArrow`` that hands the memory it has freed back to the system when its task ends.

    Workers live on from task to task beside the executor's own memory, and would keep it."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def apart(work, *args) -> bytes:
    """What ``work`` returns, made in a child process, whose memory goes with it."""
    import os

    back, out = os.pipe()
    child = os.fork()
    if not child:
        done = 1
        try:
            os.close(back)
            with os.fdopen(out, "wb") as f:
                f.write(work(*args))
            done = 0
        finally:
            os._exit(done)
    os.close(out)
    with os.fdopen(back, "rb") as f:
        made = f.read()
    if os.waitpid(child, 0)[1]:
        raise RuntimeError("the child process failed")
    return made


def train_remotely(sample: DataFrame, fit, most_bytes: int = SAMPLE_BYTES):
    """What ``fit`` makes of (texts, labels) of the sample, trained in one task of an executor.

    The driver gets the model alone. The task holds at most ``most_bytes`` of
    texts: it takes them in order of place, and passes over what no longer fits.
    A task that is run again trains on the same rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        kept, left = [], most_bytes
        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "label")), strict=True):
                raw = (text or "").encode()
                if len(raw) <= left:
                    kept.append((doc_id, raw, label))
                    left -= len(raw)
        kept.sort(key=lambda row: row[0])
        model = apart(lambda: pickle.dumps(fit([k[1] for k in kept], np.array([k[2] for k in kept], np.int64))))
        for at in range(0, len(model), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([model[at : at + (1 << 20)]], pa.binary())], names=["at", "part"])

    import pickle

    one = sample.select("place", "doc_id", "text", "label").repartition(1).sortWithinPartitions("place", "doc_id")
    parts = one.mapInArrow(lean(run), "at bigint, part binary").collect()  # the model: of bounded size, as the sample is
    if not parts:  # an empty sample may have no task
        return fit([], np.zeros(0, np.int64))
    return pickle.loads(b"".join(bytes(p["part"]) for p in sorted(parts, key=lambda p: p["at"])))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
