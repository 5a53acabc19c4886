"""Bounded samples for fitting models on the driver, and bounded portions of the batches that executors work on."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_SPAN = 1 << 40
#: Characters worked on at a time.
PORTION = 1_000_000


def hashed_below(df: DataFrame, key: str, sample: int, n: int | None = None) -> DataFrame:
    """Rows whose key's hash lies below the share that ``sample`` is of all ``n`` rows: about ``sample`` rows, all of a small table."""
    n = df.count() if n is None else n
    if n <= sample:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(_SPAN)) < int(_SPAN * sample / n))


def bounded_sample(df: DataFrame, key: str, sample: int) -> list[Row]:
    """At most ``sample`` rows, in the order of their key's hash; no partition sends more than its part of them."""
    picked = hashed_below(df, key, sample).withColumn("_order", F.xxhash64(F.lit("sample"), key))
    rows = sorted(picked.take(sample + sample // 4), key=lambda r: (r["_order"], str(r[key])))
    return rows[:sample]


def portions(texts: list[str | None], most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` characters together; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
