"""Joins and aggregates that a few keys with most of the rows cannot unbalance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so at most this many keys are hot: the bound of what is broadcast.
HOT_PARTS = 1024


def split_join(rows: DataFrame, states: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``states`` (one row per key, with the key's number of rows in ``weight``).

    States of keys that hold at least 1/1024 of ``total`` rows are at most 1024
    and are broadcast, so their rows stay where they are; all other keys are
    joined by a shuffle in which no key is heavy.  ``how``: inner or left.
    Rows with a null key match nothing (kept with nulls when ``how`` is left).
    """
    is_hot = F.coalesce(F.col(weight) * HOT_PARTS >= F.lit(total), F.lit(False))
    hot, cold = states.where(is_hot).drop(weight), states.where(~is_hot).drop(weight)
    near = rows.join(F.broadcast(hot), key, "inner")
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def compact_join(left: DataFrame, right: DataFrame, on: Sequence[str], group: Sequence[str] = (), left_sums: dict[str, Column] | None = None, right_sums: dict[str, Column] | None = None, how: str = "inner") -> DataFrame:
    """Both inputs aggregated by join key before the join, then the compact states joined.

    One row per (on, group): ``left_rows``, ``right_rows``, the sums of
    ``left_sums`` over the left rows and of ``right_sums`` over the right rows.
    Every input row is folded into its state on the map side, so a key with a
    third of all rows costs one state per task.  Null join keys match nothing;
    null groups are a group.  ``how``: inner or left; left keeps the left states
    that match nothing, with nulls for ``right_rows`` and the right sums.
    """
    lefts = [F.sum(c).alias(n) for n, c in (left_sums or {}).items()]
    rights = [F.sum(c).alias(n) for n, c in (right_sums or {}).items()]
    a = left.groupBy(*on, *group).agg(F.count(F.lit(1)).alias("left_rows"), *lefts)
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("right_rows"), *rights)
    return a.join(b, list(on), how)


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: Sequence[str], group: Sequence[str], left_sums: dict[str, Column] | None = None, right_sums: dict[str, Column] | None = None, how: str = "inner") -> DataFrame:
    """Counts and sums of ``left JOIN right`` per ``group``, without making the joined rows.

    A left state of n rows meets a right state of m rows in n*m joined rows, so
    ``joined_rows`` adds n*m, a left sum counts m times and a right sum n times.
    ``group`` names columns of the left input (or of ``on``).  Empty inputs give
    no rows; null measures are left out of sums as in SQL.  With ``how`` left, a
    left state that matches nothing (as one with a null key) stays: it adds no
    ``joined_rows``, its left sums count once and it has no right sums.
    ``left_rows`` counts the left rows themselves.
    """
    extra = [g for g in group if g not in on]
    states = compact_join(left, right, on, extra, left_sums, right_sums, how)
    times = lambda value, n: F.sum(F.col(value) * F.coalesce(F.col(n), F.lit(1))).alias(value)
    return states.groupBy(*group).agg(
        F.sum("left_rows").alias("left_rows"),
        F.sum(F.col("left_rows") * F.coalesce(F.col("right_rows"), F.lit(0))).alias("joined_rows"),
        *[times(n, "right_rows") for n in (left_sums or {})],
        *[times(n, "left_rows") for n in (right_sums or {})],
    )


def heavy_keys(results: DataFrame, key: str, rows: str, share: float) -> DataFrame:
    """The per-key ``results`` whose ``rows`` are at least ``share`` of all keys' rows.

    ``results`` has one row per key, the null key included, which counts among
    all rows but is no heavy key; it is read twice, so give a written table.
    The total is rolled up from the per-key counts, one number.  Without keys
    there are no rows.
    """
    total = results.agg(F.sum(rows).cast("decimal(38,0)")).first()[0] or Decimal(0)
    return results.where(F.col(key).isNotNull() & (F.col(rows) >= F.lit(math.ceil(total * Decimal(str(share))))))
