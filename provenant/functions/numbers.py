"""Column functions on numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(n: Column, d: Column, default: float | None = None) -> Column:
    """n / d; the default where d is null or zero."""
    return F.when(d.isNotNull() & (d != 0), n / d).otherwise(F.lit(default).cast("double"))


def churn_weight(additions: Column, deletions: Column) -> Column:
    """|additions| + |deletions|; 1.0 where both are null."""
    return F.when(additions.isNull() & deletions.isNull(), F.lit(1.0)).otherwise(F.abs(F.coalesce(additions, F.lit(0))) + F.abs(F.coalesce(deletions, F.lit(0)))).cast("double")


def time_bucket(created: Column, at: Column) -> Column:
    """pre_issue up to the creation itself, post_issue after it, unknown without either time."""
    return F.when(created.isNull() | at.isNull(), "unknown").when(at <= created, "pre_issue").otherwise("post_issue")


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000.0)


def polarity_label(compound: Column, at: float = 0.05) -> Column:
    return F.when(compound > at, "positive").when(compound < -at, "negative").otherwise("neutral")


#: Confidence levels in ascending order.
CONFIDENCE = ("very_low", "low", "medium", "high", "very_high")


def confidence_rank(c: Column) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(CONFIDENCE, 1):
        out = F.when(F.lower(c) == name, rank).otherwise(out)
    return out


def count_bin(c: Column, edges: list[int]) -> Column:
    """'0', '1-2', ..., 'n+' by ascending lower edges."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, [*edges[1:], None], strict=True):
        label = f"{lo}+" if hi is None else str(lo) if hi == lo + 1 else f"{lo}-{hi - 1}"
        out = F.when(c >= lo, label).otherwise(out)
    return out


def clipped(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))
