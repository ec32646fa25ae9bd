"""Measures of extraction quality: recovery by category, and ink shared by two renderings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Pixels darker than this are ink; renderings may be off by so many pixels.
INK, NUDGE = 200, 2


def recovery_rate(cases: DataFrame, got: Column, want: Column, by: list[str]) -> DataFrame:
    """How many cases come back exactly (line breaks aside), by category."""
    bare = lambda c: F.replace(c, F.lit("\n"), F.lit(""))
    same = F.coalesce(bare(got) == bare(want), F.lit(False))
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(same).alias("exact"), F.avg(same.cast("int")).alias("rate"))


def parse_pgm(data: bytes) -> np.ndarray | None:
    """Pixels of a binary grey map (P5); None for anything else."""
    m = re.match(rb"(?:\s|#[^\n]*\n)*P5" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s", data)
    if m is None:
        return None
    width, height, most = (int(m[k]) for k in (1, 2, 3))
    if not (width and height and most) or m.end() + width * height > len(data):
        return None
    return np.frombuffer(data, np.uint8, width * height, m.end()).reshape(height, width)


def ink_crop(pixels: np.ndarray) -> np.ndarray | None:
    """The ink within its tightest box; None for a blank page."""
    ink = pixels < INK
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    return ink[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if len(rows) else None


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared ink over all ink, both cropped to their ink, at the best of the small shifts."""
    x, y = ink_crop(a), ink_crop(b)
    if x is None or y is None:
        return 1.0 if x is y else 0.0
    height, width = max(x.shape[0], y.shape[0]), max(x.shape[1], y.shape[1])
    fixed = np.zeros((height, width), bool)
    fixed[: x.shape[0], : x.shape[1]] = x
    wide = np.zeros((height + 2 * NUDGE, width + 2 * NUDGE), bool)
    wide[NUDGE : NUDGE + y.shape[0], NUDGE : NUDGE + y.shape[1]] = y
    shifts = range(2 * NUDGE + 1)
    moved = (wide[dy : dy + height, dx : dx + width] for dy in shifts for dx in shifts)
    return max(float((fixed & m).sum() / max(1, (fixed | m).sum())) for m in moved)


@F.pandas_udf(DoubleType())
def ink_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two columns of grey maps; null where one can't be read."""

    def one(p, q):
        x, y = (parse_pgm(v) if v is not None else None for v in (p, q))
        return None if x is None or y is None else overlap(x, y)

    return pd.Series([one(p, q) for p, q in zip(a, b)], dtype="float64")
