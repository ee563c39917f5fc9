"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the folder that all machines share and reads it back for the next one.
All but the last return the columns of documents:

1. toxicity: documents predicted toxic go;
2. exact dedup: of equal texts the smallest id stays;
3. near dedup: of each group linked by five-word shingles with a Jaccard
   similarity of 0.8 or more the row with the smallest id stays;
4. mixing: what classifies as good text moves towards a share of MIX of the
   tokens. No document is lost (rates are at least 1), some of the good come again;
5. packing: what is left, tokenised and packed.

Edge cases: null texts count as empty; all of them are exact copies of each
other, so one stays. Null ids take part and come last where the smallest id
stays. Rows that repeat both id and text are copies, rows that repeat an id
alone are documents of their own. Columns beyond those of documents are kept up
to packing. Empty tables, and labels of no document, give empty or unlabelled
stages that lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import exact_dedup, jaccard, mixing, packing, toxicity
from wayline.llm.common import documents, materialize, table
from wayline.llm.queries import tokenizer_path


# Shares of tokens that mixing aims at.
MIX = {"good": 0.87, "poor": 0.13}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep(docs, width=5, share=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.fit(docs, mixing.label_domains(table(spark, sf_dir, "labels")), MIX, min_rate=1.0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

# A trained network decides in the first stage, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
