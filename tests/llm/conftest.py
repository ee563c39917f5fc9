from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, sid string, bitmap string, row string, gone int, label int"


def word(r: random.Random) -> str:
    return "".join(r.choice(["an", "the", "ou", "re", "éa", "zu", "Ing", "st"]) for _ in range(r.randint(1, 4)))


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(word(r) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, very long ones, repeated rows, copies and near copies."""
    base = prose(1, 300)
    near = base.split(" ")
    near[150] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "one two"), (6, "One  TWO"), (7, base), (8, base.replace(" ", "\t ")),
        (9, " ".join(near)), (10, prose(2, 40_000)), (11, "x" * 300_000), (12, prose(3, 120)), (12, prose(3, 120)), (13, prose(4, 60)), (13, prose(5, 60)),
        (None, prose(6, 80)), (None, None), (-5, base), (2**62, "ünïcödé ñ 数据 text with spaces"), (14, "<|endoftext|> a <|endoftext|>"),
    ]
    return rows + [(100 + i, prose(100 + i, 30 + i)) for i in range(12)]


def as_table(spark, rows):
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", None, k, "s", "b", "r", 1, 0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    as_table(spark, awkward()).repartition(3).write.parquet(path + "/d")
    return spark.read.parquet(path + "/d")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    as_table(spark, []).write.parquet(path + "/d")
    return spark.read.parquet(path + "/d")
