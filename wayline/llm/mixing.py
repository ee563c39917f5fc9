"""Mixing domains to target weights by soft membership, in DataFrame functions only.

Domains come from a labelled table (doc_id, domain); what a document belongs to
is read from its text alone. The classifier is naive Bayes over two kinds of
features of whole texts: shapes (classes of length, of word length, of the
shares of distinct words, symbols, digits, capitals and line ends), and for each
domain the class of its strongest marking word. Words are hashed to WORD_CLASSES
classes; one marks a domain if it stands in MARKED standard deviations more of
the domain's documents than chance gives. Every document gets posteriors over
the domains; the classifier trains on at most SAMPLE documents of each domain,
those with the smallest hashes, and scores all.

Documents whose posteriors agree to 1 / GRAIN form a cell and share a rate, the
number of times a document is taken. Rates r >= min_rate minimise the least
squares of S_d - T_d, divided by the domain's own tokens N_d, where
S_d = sum of r * tokens * P(d) is the expected token total of a domain and T_d
its target. S uses every document's own posteriors, summed a cell. Projected
gradient descent, accelerated, runs on the distributed table of cells; every step sums up S (a
row of as many numbers as domains comes to the driver), moves the rates along
the posteriors and cuts them off at min_rate. In this metric the gradient's
Lipschitz constant is at most 1, so steps of length 1 always descend. ``Mix``
says how many steps were made, and ``totals`` what is left between target and
expectation.

``take`` applies rates: a document comes floor(r) times, and once more if a
hash of its id and text falls below the rest, so repeated runs agree. Posteriors
are columns of the text, so no text shuffles.

Edge cases: a null text counts as empty and has no tokens. Null ids take part.
Repeated rows are documents each, taken equally often. Ids with several domains
take the smallest name, repeated ids their smallest text, for training. Without
labelled rows, or with one domain, every document comes at the same rate. More
than MAX_DOMAINS domains are an error. Targets of domains without tokens can't be
met and show in ``totals``. Other columns are ignored by ``rates`` and kept by
``take``. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize

MAX_DOMAINS = 64
SAMPLE = 4000  # documents of a domain that train the classifier
WORD_CLASSES = 1 << 15
MARKED = 6.0
SHRINK, SMOOTH = 20.0, 5.0  # counts that the rate of all documents adds to a word's, and to a feature's
LEVELS = 8  # classes of each feature
GRAIN = 32
TEMPER = 0.7
STEPS, CLOSE, STILL = 100, 1e-4, 1e-5  # gap, and move of a step, that end the descent, as shares of all tokens
N_SHAPES = 7
SYMBOLS = r"[!#$%&*+/<=>?@\[\\\]^_`{|}~]"  # single characters: the pattern compiler makes a table of these, not of ranges


def _share_class(part: Column, whole: Column) -> Column:
    """0 for none, else 1 to 7 by powers of two of the share."""
    share = part / F.greatest(whole, F.lit(1))
    return F.when(part <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(LEVELS - 1), F.lit(LEVELS) + F.floor(F.log2(share))))).cast("int")


def with_features(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with tokens, even (a hash of id and text in [0, 1)), words (distinct classes) and shapes (a feature number each)."""
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split(F.lower(F.regexp_replace("_t", r"[\x09-\x0D]", " ")), " "), ""))
    df = df.withColumn("words", F.array_distinct(F.transform("_w", lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_CLASSES)).cast("int"))))
    df = df.withColumn("tokens", F.size("_w").cast("long")).withColumn("_n", F.length("_t"))

    def count(one: str) -> Column:
        return F.regexp_count("_t", F.lit(one))

    shapes = [
        F.least(F.floor(F.log2(F.col("tokens") + 1) / 2), F.lit(LEVELS - 1)),
        F.least(F.floor(F.col("_n") / F.greatest("tokens", F.lit(1)) / 1.5), F.lit(LEVELS - 1)),
        F.least(F.floor(F.size("words") * LEVELS / F.greatest("tokens", F.lit(1))), F.lit(LEVELS - 1)),
        _share_class(count(SYMBOLS), F.col("_n")),
        _share_class(count("[0-9]"), F.col("_n")),
        _share_class(count("[A-Z]"), F.col("_n")),
        _share_class(F.col("_n") - F.length(F.replace("_t", F.lit("\n"), F.lit(""))), F.col("_n")),
    ]
    return df.withColumn("shapes", F.array(*[(s + LEVELS * i).cast("int") for i, s in enumerate(shapes)])).drop("_t", "_w", "_n")


def _constant(values: list, kind: str) -> Column:
    """A constant array, folded when the plan is made."""
    if not values:
        return F.expr(f"cast(array() as array<{kind}>)")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _row(constants: Column, i: Column, wide: int) -> Column:
    """Row i of a table of ``wide`` columns that lies in a flat array."""
    return F.slice(constants, i * wide + 1, wide)


@dataclass
class Classifier:
    """``marked``: word classes that mark a domain; ``strength``: of each its strength class in every domain; ``scores``: of each feature the log-likelihood ratio of every domain; ``prior``: logarithms."""

    domains: list[str]
    marked: list[int]
    strength: list[list[int]]
    scores: list[list[float]]
    prior: list[float]

    def features(self) -> Column:
        """All feature numbers of a row with words and shapes: the plan is of one size, however many domains there are."""
        place = {w: str(i) for i, w in enumerate(self.marked)}
        places = F.split(F.lit(",".join(place.get(w, "") for w in range(WORD_CLASSES))), ",").try_cast("array<int>")  # null for the others
        there, d = F.array_compact(F.transform("words", lambda w: F.get(places, w))), len(self.domains)
        strength = _constant([x for row in self.strength for x in row], "int")
        worst = F.aggregate(there, F.array_repeat(F.lit(0), d), lambda a, i: F.zip_with(a, _row(strength, i, d), lambda x, y: F.greatest(x, y)))
        return F.concat("shapes", F.transform(worst, lambda x, i: x + LEVELS * (i + N_SHAPES)))

    def posteriors(self, df: DataFrame) -> DataFrame:
        """``df`` (words, shapes) with p, an array over the domains."""
        if not self.domains:
            return df.withColumn("p", F.expr("cast(array() as array<double>)"))
        scores, d = _constant([x for row in self.scores for x in row], "double"), len(self.domains)
        logit = F.aggregate("_f", _constant(self.prior, "double"), lambda a, f: F.zip_with(a, _row(scores, f, d), lambda x, y: x + y))
        df = df.withColumn("_f", self.features()).withColumn("_l", logit).withColumn("_e", F.expr("transform(_l, x -> exp(x - array_max(_l)))"))
        return df.withColumn("p", F.expr("transform(_e, x -> x / aggregate(_e, 0D, (s, y) -> s + y))")).drop("_f", "_l", "_e")


def train(docs: DataFrame, examples: DataFrame) -> Classifier:
    """From the texts of ``examples`` (doc_id, domain)."""
    one = examples.where(examples["doc_id"].isNotNull() & examples["domain"].isNotNull()).groupBy(examples["doc_id"].cast("long").alias("sample_id")).agg(F.min(examples["domain"].cast("string")).alias("domain"))
    one = materialize(one, "mix-examples")
    domains = [r["domain"] for r in one.select("domain").distinct().orderBy("domain").limit(MAX_DOMAINS + 1).collect()]
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not domains:
        return Classifier([], [], [], [], [])
    ids = reduce(DataFrame.unionByName, [one.where(F.col("domain") == v).orderBy(F.xxhash64("sample_id"), "sample_id").limit(SAMPLE) for v in domains])
    d = len(domains)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = rows.join(F.broadcast(ids), rows["doc_id"] == ids["sample_id"]).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("domain").alias("domain"))
    number = reduce(lambda c, i: c.when(F.col("domain") == domains[i], i), range(1, d), F.when(F.col("domain") == domains[0], 0))
    rows = materialize(with_features(rows, F.col("text")).select(number.alias("y"), "words", "shapes"), "mix-sample")
    n = [0.0] * d
    for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["y"]] = float(r["n"])
    total = sum(n)
    if not total:
        return Classifier([], [], [], [], [])
    # words: how much more often than chance
    each = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(*[F.sum((F.col("y") == i).cast("double")).alias(f"c{i}") for i in range(d)])
    rate = (sum((F.col(f"c{i}") for i in range(1, d)), F.col("c0")) + 1) / (total + 2)
    each = each.withColumn("q", rate)
    strong = [F.when((F.col(f"c{i}") - n[i] * F.col("q")) / F.sqrt(n[i] * F.col("q") + 1) >= MARKED, F.log((F.col(f"c{i}") + SHRINK * F.col("q")) / (n[i] + SHRINK) / F.col("q"))).otherwise(0.0).alias(f"l{i}") for i in range(d)]
    found = each.select("w", *strong).where(" or ".join(f"l{i} > 0" for i in range(d))).orderBy("w").collect()  # at most a row a word class
    strength = [[min(LEVELS - 1, int(r[f"l{i}"] * 2.5)) for i in range(d)] for r in found]
    made = Classifier(domains, [r["w"] for r in found], strength, [], [math.log((x + 1) / (total + d)) for x in n])
    counts = rows.select("y", F.explode(made.features()).alias("f")).groupBy("y", "f").agg(F.count(F.lit(1)).alias("n")).collect()  # domains x features
    size = LEVELS * (N_SHAPES + d)
    seen = [[0.0] * d for _ in range(size)]
    for r in counts:
        seen[r["f"]][r["y"]] = float(r["n"])
    rates = [(sum(s) + 1) / (total + LEVELS) for s in seen]
    made.scores = [[math.log((x + SMOOTH * q) / (m + SMOOTH) / q) for x, m in zip(s, n, strict=True)] for s, q in zip(seen, rates, strict=True)]
    return made


@dataclass
class Mix:
    """``rows``: doc_id, even, tokens, p and cell of every document; ``cells``: cell, n, tokens, s (tokens of each domain), rate."""

    rows: DataFrame
    cells: DataFrame
    classifier: Classifier
    targets: list[float]
    natural: list[float]
    reached: list[float]
    steps: int
    converged: bool

    def totals(self) -> DataFrame:
        """domain, natural, target, expected, steps and converged of each domain."""
        rows = [(*r, self.steps, self.converged) for r in zip(self.classifier.domains, self.natural, self.targets, self.reached, strict=True)]
        return self.rows.sparkSession.createDataFrame(rows, "domain string, natural double, target double, expected double, steps int, converged boolean")


def cell() -> Column:
    return F.array_join(F.transform("p", lambda x: F.round(x * GRAIN).cast("int").cast("string")), ",")


def even(doc_id: Column, text: Column) -> Column:
    """Spread evenly over [0, 1)."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")), F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _sums(cells: DataFrame, weight: str, d: int) -> list[float]:
    """Sum of ``weight`` times the tokens of each domain: one row of d numbers."""
    if not d:
        return []
    out = cells.agg(*[F.sum(F.expr(f"{weight} * s[{i}]")).alias(f"s{i}") for i in range(d)]).first()
    return [float(x or 0.0) for x in out]


def fit(docs: DataFrame, examples: DataFrame, weights: dict[str, float] | None = None, min_rate: float = 0.0, temper: float = TEMPER) -> Mix:
    """Rates for the documents.

    ``examples``: doc_id, domain. ``weights``: of each domain, in any unit; by
    default each domain's share of tokens to the power ``temper``, which lifts
    small ones. Names that are no domain are passed over; if all are, it is an
    error. The total is that of the corpus, or as much more as lets every document
    of a domain come ``min_rate`` times."""
    classifier = train(docs, examples)
    domains, d = classifier.domains, len(classifier.domains)
    if weights and d and not set(weights) & set(domains):
        raise ValueError(f"weights for none of the domains {domains}")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), even(docs["doc_id"], docs["text"]).alias("even"))
    rows = classifier.posteriors(with_features(plain, F.col("text"))).withColumn("cell", cell())
    rows = materialize(rows.select("doc_id", "even", "tokens", "p", "cell"), "mix-rows")
    sums = [F.sum(F.col("tokens") * F.col("p")[i]) for i in range(d)]
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").cast("double").alias("tokens"), F.array(*sums).alias("s") if sums else F.expr("cast(array() as array<double>)").alias("s"), F.first("p").alias("p0"))
    # a cell's rate moves along the cell's mean posteriors
    mean = F.when(F.col("tokens") > 0, F.transform("s", lambda x: x / F.col("tokens"))).otherwise(F.col("p0"))
    cells = materialize(cells.withColumn("p", mean).drop("p0"), "mix-cells")
    natural = _sums(cells, "1D", d)
    whole = sum(natural)
    raw = [max(float(weights.get(s, 0.0)), 0.0) for s in domains] if weights else [x**temper for x in natural]
    scale = sum(raw) or 1.0
    share = [x / scale for x in raw]
    total = max([whole, *(min_rate * x / w for x, w in zip(natural, share, strict=True) if w > 0)])
    targets = [w * total for w in share]
    # accelerated: a step starts from the last rates moved on by some of the last step, whose sums follow from theirs
    moves: list[list[float]] = []
    reached = _sums(cells, _rate(min_rate, moves), d)
    before, ahead, turn, converged = reached, reached, 1.0, not d
    while d:
        met = max(abs(s - t) for s, t in zip(reached, targets, strict=True)) <= CLOSE * max(whole, 1.0)
        still = bool(moves) and max(abs(s - b) for s, b in zip(reached, before, strict=True)) <= STILL * max(whole, 1.0)
        converged = met or still
        if converged or len(moves) == STEPS:
            break
        gap = [(s - t) / max(x, 1.0) for s, t, x in zip(ahead, targets, natural, strict=True)]
        turn, last = (1 + math.sqrt(1 + 4 * turn * turn)) / 2, turn
        moves.append([*gap, (last - 1) / turn])
        before, reached = reached, _sums(cells, _rate(min_rate, moves), d)
        if _error(reached, targets, natural) > _error(before, targets, natural):  # too far: without a run-up from here
            moves[-1][-1], turn = 0.0, 1.0
        ahead = [s + moves[-1][-1] * (s - b) for s, b in zip(reached, before, strict=True)]
    cells = materialize(cells.withColumn("rate", F.expr(_rate(min_rate, moves))), "mix-rates")
    return Mix(rows, cells, classifier, targets, natural, reached, len(moves), converged)


def _error(reached: list[float], targets: list[float], natural: list[float]) -> float:
    return sum((s - t) ** 2 / max(x, 1.0) for s, t, x in zip(reached, targets, natural, strict=True))


def _rate(min_rate: float, moves: list[list[float]]) -> str:
    """A cell's rate after the steps so far, each given by its gaps and how far the next one runs ahead; the plan stays of one size, so no step is written."""
    start = float(max(min_rate, 1.0))
    if not moves:
        return f"{start!r}D"
    new = f"greatest({float(min_rate)!r}D, a.y - aggregate(zip_with(p, g, (x, y) -> x * coalesce(y, 0D)), 0D, (s, x) -> s + coalesce(x, 0D)))"
    step = f"(a, g) -> transform(array({new}), r -> named_struct('r', r, 'y', r + element_at(g, -1) * (r - a.r)))[0]"
    return f"aggregate(from_json('{json.dumps(moves)}', 'array<array<double>>'), named_struct('r', {start!r}D, 'y', {start!r}D), {step}, a -> a.r)"


def _copies() -> Column:
    whole = F.floor("rate")
    return (whole + (F.col("even") < F.col("rate") - whole).cast("long")).cast("long")


def rates(mix: Mix) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), membership (its posterior), rate, copies of every document."""
    named = F.array(*[F.lit(s) for s in mix.classifier.domains])
    best = F.element_at(named, F.expr("array_position(p, array_max(p))").cast("int")) if mix.classifier.domains else F.lit(None).cast("string")
    joined = attach(mix.rows, mix.cells.select("cell", "n", "rate"), "cell", "n", max(mix.rows.count(), 1))
    return joined.select("doc_id", "tokens", best.alias("domain"), F.array_max("p").alias("membership"), "rate", _copies().alias("copies"))


def take(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents as often as their rates say, with all their columns.

    No text shuffles: posteriors are made anew from each text, and the cells that
    hold more than a thousandth of the documents, at most 1000, are broadcast; so
    are the others where BROADCAST_CELLS bounds them."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), even(docs["doc_id"], docs["text"]).alias("even"), docs["text"].alias("text"))
    row = mix.classifier.posteriors(with_features(row, F.col("text"))).select("row", "even", cell().alias("cell"))
    found = mix.cells.select("cell", "n", "rate")
    if mix.cells.count() <= BROADCAST_CELLS:
        # a left join: an inner one would have a test for null, and so the whole classifier, computed once more below it
        joined = row.join(F.broadcast(found.withColumnRenamed("cell", "_cell")), F.col("cell") == F.col("_cell"), "left")
    else:
        joined = attach(row, found, "cell", "n", max(mix.rows.count(), 1), spread="even")
    copies = joined.withColumn("rate", F.coalesce("rate", F.lit(1.0))).withColumn("copies", _copies()).where("copies > 0")
    return copies.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


BROADCAST_CELLS = 100_000


def label_domains(labels: DataFrame) -> DataFrame:
    """Examples from the labelled table: toxic documents, and good and poor ones of the others."""
    domain = F.when(labels["toxic"] == 1, "toxic").when(labels["quality"] == 1, "good").when(labels["quality"] == 0, "poor")
    return labels.select(labels["doc_id"].cast("long").alias("doc_id"), domain.alias("domain"))
