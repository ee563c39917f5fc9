"""Personal data: base spans by pattern, and terms that give protected entities away.

The values of the base spans (e-mail addresses, IP addresses, card and phone
numbers) are the protected entities. How strongly a term t reveals an entity
e is the pointwise mutual information log2(N n(e,t) / (n(e) n(t))), from counts
over all documents: n(t) of documents with the term, n(e) of documents with
the entity, n(e,t) of documents with the term among the CONTEXT words on either
side of the entity. It is at most the entity's information content,
-log2(n(e) / N), reached when the term never stands without it. Terms whose
share of it is ALPHA or more disclose the entity, if they met it in at least
SUPPORT different contexts; with SUPPORT 1 a name that stands once, beside the
one address, counts. Short words and numbers are terms like others. In a
document that holds the entity, every occurrence of such a term, however far
from it, becomes a span: removed when it never stands without the entity, else
generalised to a word class. ``sanitise`` gives the documents with base spans
masked by their kind, and these terms removed or generalised.

Counts are exact and distributed; (term, count) pairs and context terms
shuffle, and a pair that most documents share is counted before it moves. For
the second pass, terms of documents with entities that a bitmap of the
disclosing terms does not clear shuffle, and texts that hold such a term may.

Edge cases: a null text is empty, and stays null when sanitised. Rows that
repeat an id count each on its own. A null id stays null. Other columns are
ignored by ``find`` and kept by ``sanitise``. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import WHITE, Words, attach, materialize, text_blocks, text_hash
from .exact_dedup import bitmap, maybe_repeated

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 8
ALPHA = 0.9
SUPPORT = 1
TERMS_AT_ONCE = 1 << 20  # distinct terms whose counts a task holds before it passes them on

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin inside a run of digits whose start does not match, so looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BETWEEN = WHITE.copy()
_BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m and at > free and text[at - 1] in _LOCAL:
            start = at - 1
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kinds are numbers of KINDS."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> int:
    plain = value.lower() if kind < 2 else "".join(c for c in value if c.isdigit())
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def _terms_of(text: str, taken: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int], list[bool]]:
    """Places and hashes of a text's words, and whether each is clear of the spans (sorted by start); one sweep."""
    words = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    hashes = Words([" ".join(text[s:e] for s, e in words).encode("utf-8", "replace")], _BETWEEN).hash.view(np.int64).tolist()
    clear, at, reach = [], 0, 0
    for s, e in words:
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        clear.append(s >= reach)
    return words, hashes, clear


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Distinct (entity, term, context) of the terms beside each span; context: a hash of all of the span's terms."""
    words, hashes, clear = _terms_of(text, [(s, e) for s, _, e in spans])
    starts, out = [w[0] for w in words], set()
    for start, kind, end in spans:
        at = bisect.bisect_left(starts, start)
        after = bisect.bisect_left(starts, end)
        near = [hashes[i] for i in (*range(max(0, at - CONTEXT), at), *range(after, min(after + CONTEXT, len(words)))) if clear[i]]
        if near:
            whole = int.from_bytes(hashlib.blake2b(repr(near).encode(), digest_size=8).digest(), "little", signed=True)
            who = entity(kind, text[start:end])
            out.update((who, t, whole) for t in near)
    return sorted(out)


def occurrences(text: str, spans: list[tuple[int, int]], terms: dict[int, bool]) -> list[tuple[int, int, bool]]:
    """(start, end, value) of every place of the terms outside the spans (sorted by start)."""
    words, hashes, clear = _terms_of(text, spans)
    return [(s, e, terms[t]) for (s, e), t, free in zip(words, hashes, clear, strict=True) if free and t in terms]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_NEAR = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("context", pa.int64())]))
_FOUND = "doc_id bigint, th bigint, base array<struct<start:bigint,kind:int,end:bigint>>, near array<struct<e:bigint,t:bigint,context:bigint>>, entities array<bigint>, held string"
_ADDED = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("removed", pa.bool_())]))


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = re.compile(rb"[0-9@]")
    for batch, texts in text_blocks(batches):
        base, near, entities, held = [], [], [], []
        for raw in texts:
            spans, beside, text = [], [], ""
            if marks.search(raw):
                text = raw.decode("utf-8", "replace")
                spans = base_spans(text)
                beside = contexts(text, spans) if spans else []
            base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
            near.append([dict(zip(("e", "t", "context"), c, strict=True)) for c in beside])
            entities.append(sorted({entity(k, text[s:e]) for s, k, e in spans}))
            held.append(text if spans else None)
        columns = [batch.column("doc_id"), batch.column("th"), pa.array(base, _SPAN), pa.array(near, _NEAR), pa.array(entities, pa.list_(pa.int64())), pa.array(held, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "base", "near", "entities", "held"])


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, t): the distinct terms of each text."""
    for batch, texts in text_blocks(batches):
        w = Words(texts, _BETWEEN)
        if not len(w.hash):
            continue
        distinct, which = np.unique(w.hash, return_inverse=True)
        pair = np.unique(np.repeat(np.arange(len(texts)), np.diff(w.first)) * len(distinct) + which)
        rid, t = batch.column("rid").to_numpy()[pair // len(distinct)], distinct[pair % len(distinct)].view(np.int64)
        for at in range(0, len(t), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(rid[at : at + (1 << 16)]), pa.array(t[at : at + (1 << 16)])], names=["rid", "t"])


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_blocks(batches):
        base, told = batch.column("base"), batch.column("told")
        added, masked_texts = [], []
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            terms = {x["t"]: x["always"] for x in told[i].as_py() or []}
            own = base[i].as_py()
            found = occurrences(text, [(x["start"], x["end"]) for x in own], terms) if terms else []
            added.append([{"start": s, "kind": 4, "end": e, "removed": always} for s, e, always in found])
            spans = sorted([(x["start"], x["kind"], x["end"], False) for x in own] + [(s, 4, e, always) for s, e, always in found])
            masked_texts.append(masked(text, spans))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(added, _ADDED), pa.array(masked_texts, pa.string())], names=["rid", "added", "masked"])


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, n): in how many of the task's texts a term stands, in as few rows as its memory bound allows."""

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        t = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        order = np.argsort(t, kind="stable")
        t, at = np.unique(t[order], return_index=True)
        return t, np.add.reduceat(n[order], at)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, texts in text_blocks(batches):
        w = Words(texts, _BETWEEN)
        if not len(w.hash):
            continue
        distinct, which = np.unique(w.hash, return_inverse=True)
        pair = np.unique(np.repeat(np.arange(len(texts)), np.diff(w.first)) * len(distinct) + which)
        held.append((distinct, np.bincount(pair % len(distinct), minlength=len(distinct))))
        if sum(len(t) for t, _ in held) >= 2 * TERMS_AT_ONCE:
            held = [rows(held)]
            if len(held[0][0]) >= TERMS_AT_ONCE:
                yield from _count_batches(*held.pop())
    if held:
        yield from _count_batches(*rows(held))


def _count_batches(t: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(t), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(t[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)].astype(np.int64))], names=["t", "n"])


def disclosing(near: DataFrame, holders: DataFrame, docs: DataFrame, n_docs: int, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(e, t, n_et, pmi, information, always) of the terms that reveal an entity.

    ``near``: distinct (rid, e, t, context); ``holders``: distinct (rid, e)."""
    supported = near.select(F.col("e").alias("_ee"), F.col("t").alias("_tt"), "context").distinct().groupBy("_ee", "_tt").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    pairs = near.select("rid", "e", "t").distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"))
    pairs = pairs.join(supported, (F.col("e") == F.col("_ee")) & (F.col("t") == F.col("_tt")), "left_semi")
    holders = holders.groupBy(F.col("e").alias("_e")).agg(F.count(F.lit(1)).alias("n_e"))
    counts = docs.select(docs["text"].alias("text")).mapInArrow(_term_counts, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n_t")).withColumnRenamed("t", "_t")
    known = pairs.join(holders, F.col("e") == F.col("_e")).join(counts, F.col("t") == F.col("_t"))
    information = -F.log2(F.col("n_e") / F.lit(float(n_docs)))
    pmi = F.log2(F.lit(float(n_docs)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    scored = known.select("e", "t", "n_et", pmi.alias("pmi"), information.alias("information"), (F.col("n_et") >= F.col("n_t")).alias("always"))
    return scored.where((F.col("information") > 0) & (F.col("pmi") >= alpha * F.col("information")))


def _told(found: DataFrame, told: DataFrame) -> DataFrame:
    """(rid, told): of each document with an entity the terms anywhere in it that disclose one of its entities, with ``always``.

    Of a term that discloses several, it is true if it is for any of them."""
    holding = found.where("size(entities) > 0")
    terms = told.select("t").distinct()
    filled, bits = bitmap(terms.select(F.xxhash64("t").alias("h")), max(terms.count(), 1))
    words = holding.select("rid", F.col("held").alias("text")).mapInArrow(_terms, "rid bigint, t bigint")
    words = materialize(maybe_repeated(words.withColumn("h", F.xxhash64("t")), filled, bits).where("maybe").select("rid", "t"), "pii-words")
    sizes = words.groupBy(F.col("t").alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    facts = told.groupBy("t").agg(F.collect_list(F.struct("e", "always")).alias("es")).join(sizes, F.col("t") == F.col("_t")).select("t", "n", "es")
    met = attach(words, materialize(facts, "pii-facts"), "t", "n", max(words.count(), 1)).where("n is not null")
    met = met.select("rid", "t", F.explode("es").alias("x")).select("rid", "t", "x.e", "x.always")
    own = holding.select(F.col("rid").alias("_rid"), F.explode("entities").alias("_e"))
    met = met.join(own, (F.col("rid") == F.col("_rid")) & (F.col("e") == F.col("_e")), "left_semi")
    return met.groupBy("rid", "t").agg(F.max("always").alias("always")).groupBy("rid").agg(F.collect_list(F.struct("t", "always")).alias("told"))


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """One row a document: doc_id, th (a hash of the text), base and all spans (start, kind, end, removed) sorted by start and kind, and the masked text (null where there is nothing to mask)."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), text_hash(docs["text"]).alias("th"))
    found = materialize(rows.mapInArrow(_find, _FOUND).withColumn("rid", F.monotonically_increasing_id()), "pii")
    n_docs = found.count()
    near = found.where("size(near) > 0").select("rid", F.explode("near").alias("x")).select("rid", "x.e", "x.t", "x.context")
    holders = found.where("size(entities) > 0").select("rid", F.explode("entities").alias("e"))
    told = materialize(disclosing(near, holders, docs, n_docs, alpha, support), "pii-terms").select("e", "t", "always")
    holding = found.where("size(base) > 0").select("rid", "base", F.col("held").alias("text"))
    added = holding.join(_told(found, told).withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left").select("rid", "base", "text", "told")
    added = added.mapInArrow(_mark, "rid bigint, added array<struct<start:bigint,kind:int,end:bigint,removed:boolean>>, masked string")
    joined = found.join(added.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left")
    base = F.expr("transform(base, s -> struct(s.start as start, s.kind as kind, s.end as end, false as removed))")
    spans = F.array_sort(F.concat(base, F.coalesce("added", F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint,removed:boolean>>"))))
    return joined.select("doc_id", "th", "base", spans.alias("spans"), "masked")


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with what ``find`` found (written once before) masked, removed or generalised, with all their columns.

    Documents that a bitmap of the changed ones clears do not shuffle. Rows with
    one id and text are masked alike."""
    changed = found.where("masked is not null").groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.first("masked").alias("masked"))
    held, bits = bitmap(changed.select(F.xxhash64("_doc", "_th").alias("h")), max(changed.count(), 1))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc"), text_hash(docs["text"]).alias("th"))
    tested = maybe_repeated(rows.withColumn("h", F.xxhash64("doc", "th")), held, bits)
    joined = tested.where("maybe").join(changed, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
    new = joined.select(F.col("row").withField("text", F.coalesce("masked", "row.text")).alias("row"))
    return tested.where("not maybe").select("row.*").unionByName(new.select("row.*"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from ``find``."""
    names = "array('email','ip','card','phone','term')"
    shown = "array_join(transform({}, s -> concat(element_at(" + names + ", s.kind + 1), ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(4)]
    terms = [F.expr(f"cast(size(filter(spans, s -> s.kind = 4 and {test})) as bigint)").alias(name) for name, test in (("n_removed", "s.removed"), ("n_generalised", "not s.removed"))]
    return found.select("doc_id", *counts, F.sha2(F.expr(shown.format("base")).cast("binary"), 256).alias("base_sha256"), F.expr(shown.format("spans")).alias("spans"), *terms, F.sha2(F.col("masked").cast("binary"), 256).alias("masked_sha256"))


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span masked by its kind, disclosing terms removed or generalised; spans inside others go with these."""
    out, at = [], 0
    for start, kind, end, removed in spans:
        if start < at:
            at = max(at, end)
            continue
        out.append(text[at:start])
        if kind < 4:
            out.append(f"[{KINDS[kind].upper()}]")
        elif not removed:
            word = text[start:end]
            out.append("[CODE]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]")
        at = end
    return "".join([*out, text[at:]])
