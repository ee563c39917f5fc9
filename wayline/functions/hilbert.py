"""Hilbert curve numbers of grid cells, after Skilling's bitwise transform.

``with_number`` adds a column, unrolled over the bits; ``numbers`` is its numpy
twin, ``cells`` the inverse, ``ranges`` covers boxes on the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_number(df: DataFrame, ordinates: list[str], bits: int, name: str) -> DataFrame:
    """``df`` with the curve number of its ordinate columns.

    The expression is cut into a step for each bit: nested as one, it would
    double with every bit."""
    n, cols = len(ordinates), [f"_h{i}" for i in range(len(ordinates))]
    kept = df.columns
    df = df.select("*", *[F.col(o).cast("int").alias(c) for o, c in zip(ordinates, cols, strict=True)])
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            first, own = F.col(cols[0]), F.col(cols[i])
            high, swap = own.bitwiseAND(1 << b) != 0, first.bitwiseXOR(own).bitwiseAND(low)
            new = {cols[0]: F.when(high, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap) if i else first)}
            if i:
                new[cols[i]] = F.when(high, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(new)
    for i in range(1, n):
        df = df.withColumn(cols[i], F.col(cols[i]).bitwiseXOR(F.col(cols[i - 1])))
    flip = F.lit(0)
    for b in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(cols[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumns({c: F.col(c).bitwiseXOR(flip) for c in cols})
    out = F.lit(0).cast("bigint")
    for b in range(bits - 1, -1, -1):
        for c in cols:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(F.col(c), b).bitwiseAND(1).cast("bigint"))
    return df.select(*kept, out.alias(name))


def numbers(ordinates: np.ndarray, bits: int) -> np.ndarray:
    """Curve numbers of rows of ordinates."""
    x = np.array(ordinates, np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def cells(number: np.ndarray, bits: int, dims: int) -> np.ndarray:
    """Rows of ordinates of curve numbers."""
    h = np.atleast_1d(np.asarray(number, np.int64))
    x = np.zeros((dims, len(h)), np.int64)
    for b in range(bits):
        for i in range(dims):
            x[i] |= ((h >> (b * dims + dims - 1 - i)) & 1) << b
    gray = x[dims - 1] >> 1
    for i in range(dims - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= gray
    for b in range(1, bits):
        low = (1 << b) - 1
        for i in range(dims - 1, -1, -1):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    return x.T


def neighbours(number: int, bits: int, dims: int) -> list[int]:
    """Curve numbers of the cells beside a cell, corners included; those beyond the grid are left out."""
    at = cells(np.array([number]), bits, dims)[0]
    around = [tuple(at + np.array(step)) for step in itertools.product((-1, 0, 1), repeat=dims) if any(step)]
    inside = [c for c in around if all(0 <= v < 1 << bits for v in c)]
    return sorted(numbers(np.array(inside), bits).tolist()) if inside else []


def ranges(low: list[int], high: list[int], bits: int) -> list[tuple[int, int]]:
    """Closed runs of curve numbers that cover a box of cells, both corners included.

    Descends the curve's quadrants: whole ones inside the box are one run, those
    across its sides are cut further, so work and memory grow with the box's
    surface, not with its cells."""
    lo, hi, dims = np.array(low, np.int64), np.array(high, np.int64), len(low)
    steps = np.array(list(itertools.product((0, 1), repeat=dims)), np.int64)
    blocks, found = np.zeros((1, dims), np.int64), []
    for level in range(bits, -1, -1):
        first, last = blocks << level, ((blocks + 1) << level) - 1
        inside = ((first >= lo) & (last <= hi)).all(1)
        size = 1 << (level * dims)
        start = numbers(first[inside], bits) // size * size
        found.append(np.stack([start, start + size - 1], 1))
        cut = ~inside & ((last >= lo) & (first <= hi)).all(1)
        blocks = ((blocks[cut] << 1)[:, None, :] + steps).reshape(-1, dims)
    runs = np.concatenate(found)
    runs = runs[np.argsort(runs[:, 0])]
    if not len(runs):
        return []
    opens = np.r_[True, runs[1:, 0] > runs[:-1, 1] + 1]
    return [(int(a), int(b)) for a, b in zip(runs[opens, 0], runs[np.r_[opens[1:], True], 1], strict=True)]
