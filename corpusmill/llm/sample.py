"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that a classifier learns at most, the most frequent first.
MAX_CLASSES = 64


def fold(key: Column) -> Column:
    """crc32 of a key as text, mod 4; fold 2 is held out. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def per_label(rows: DataFrame, label: str, most: int, key: str, seed: int = 7) -> DataFrame:
    """About ``most`` rows of each label, by a hash of ``key``; never over twice that a label in total.

    Counts cover all rows; the hash makes the same choice in every run. Rows whose label is null take no part.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(MAX_CLASSES).collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * most / n))])[F.col(label)]
    draw = F.xxhash64(F.col(key).cast("string"), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return rows.where(draw < F.coalesce(share, F.lit(0.0))).limit(2 * most * len(counts))
