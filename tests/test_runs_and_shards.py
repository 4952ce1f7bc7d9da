"""Shard planning against a plain queue; stages that stop half-way and are run again."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from provenant.operators.shards import plan_shards
from provenant.sources import runs


def queue(days, start, end, most, most_splits, at_risk=1000):
    left, planned, used = [(start, end)], [], 0
    while left:
        a, b = left.pop(0)
        n = sum(v for d, v in days.items() if a <= d <= b)
        if not n:
            continue
        if n <= most or a >= b:
            planned.append((a, b, n, int(n > at_risk)))
        elif used >= most_splits:
            planned.append((a, b, n, 1))
        else:
            middle = a + (b - a) // 2 if (b - a).days % 2 == 0 else a + dt.timedelta(days=(b - a).days // 2)
            left += [(a, middle), (middle + dt.timedelta(days=1), b)]
            used += 1
    return planned


@pytest.mark.parametrize(("most", "most_splits"), [(40, 1000), (10, 9)])
def test_shards_are_those_of_a_queue(spark, most, most_splits):
    random.seed(most)
    start, end = dt.date(2023, 1, 1), dt.date(2023, 6, 30)
    rows = [(repo, start + dt.timedelta(days=random.randrange(-3, 185)), random.randrange(1, 5)) for repo, k in (("a", 300), ("b", 20), (None, 60)) for _ in range(k)] + [("c", dt.date(2023, 2, 2), 2000), ("d", None, 5), ("e", dt.date(2020, 1, 1), 5)]
    got = plan_shards(spark.createDataFrame(rows, "repo string, day date, n long"), str(start), str(end), most=most, most_splits=most_splits).collect()
    want = []
    for repo in ("a", "b", None, "c", "d", "e"):
        days = collections.Counter()
        for r, d, n in rows:
            if r == repo and d is not None and start <= d <= end:
                days[d] += n
        want += [(repo, str(a), str(b), n, risk) for a, b, n, risk in queue(days, start, end, most, most_splits)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_windows_split_until_none_is_too_large(spark):
    """2,048 days of two rows each need 2,047 splits."""
    days = spark.range(2048).select(F.lit("a").alias("repo"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit(2).cast("long").alias("n"))
    got = plan_shards(days, "2020-01-01", "2025-08-09", most=3).collect()
    assert len(got) == 2048 and all(r["start_date"] == r["end_date"] and r["total_count"] == 2 and r["is_truncated_risk"] == 0 for r in got)


def test_a_stage_is_taken_up_again(spark, tmp_path):
    path, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    rows = spark.createDataFrame([(f"r{k % 12}", k) for k in range(240)] + [(None, 1)], "repo string, v long")
    calls = []

    def stage(df):
        if len(calls) == 2:
            raise RuntimeError("stopped")
        calls.append(1)
        return df.filter("v % 5 > 0").withColumn("even", F.col("v") % 2 == 0)

    with pytest.raises(RuntimeError):
        runs.run_stage(rows, stage, path, manifest, batches=4)
    half = {r["repo"] for r in runs.finished(spark, manifest).collect()}
    assert half and len(half) < 12
    # a batch that was written and not noted is written again, over itself
    spark.createDataFrame([(999, True, "r-lost")], "v long, even boolean, repo string").write.mode("append").partitionBy("repo").parquet(path)
    calls.clear()
    calls.append(1)
    done = runs.run_stage(rows, lambda df: df.filter("v % 5 > 0").withColumn("even", F.col("v") % 2 == 0), path, manifest, batches=4, counters={"even": F.col("even")})
    out = spark.read.parquet(path).filter("repo <> 'r-lost'")
    assert out.count() == 192 == out.distinct().count() and out.select("repo").distinct().count() == 12
    noted = runs.finished(spark, manifest)
    assert noted.count() == 12 and {r["repo"] for r in noted.collect()} == {f"r{k}" for k in range(12)}
    second = noted.filter(~F.col("repo").isin(*half))
    assert sum(d["rows_in"] for d in done.values()) == 20 * (12 - len(half)) and sum(d["even"] for d in done.values()) == out.filter(~F.col("repo").isin(*half)).filter("even").count()
    assert {(r["batch"], r["rows_out"]) for r in second.collect()} == {(b, d["rows_out"]) for b, d in done.items()}
    assert runs.run_stage(rows, stage, path, manifest, batches=4) == {}
