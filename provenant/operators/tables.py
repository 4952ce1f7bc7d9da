"""Joins, set operations, dedupe and reports on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.operators.statistics import grouped_quantiles, prefix_sums


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an explicit order, which should break all ties."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct(*keys)).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def merge_keeping_base(base: DataFrame, more: DataFrame, keys: list[str], marker: str | None = None) -> DataFrame:
    """Left join in which columns that base has stay base's; marker (if named) is 1 where more has the key."""
    new = [c for c in more.columns if c in keys or c not in base.columns]
    right = more.select(*new, *([F.lit(1).alias(marker)] if marker else []))
    out = base.join(right, keys, "left")
    return out.withColumn(marker, F.coalesce(marker, F.lit(0))) if marker else out


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and their share by column, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    long = one.unpivot(["n"], columns, "column_name", "null_count")
    return long.select("column_name", "null_count", (F.col("null_count") / F.col("n")).alias("null_share"))


def quantiles(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """One row with q: exact quantiles, linear between neighbours. Their places come from counts and prefix sums over ranges, so no task holds all values."""
    counts = df.select(F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.sum("n") - 1).alias("last"))
    placed = prefix_sums(counts, "v", "n").join(F.broadcast(total))  # one row of the total
    from_, to = F.col("below_n"), F.col("below_n") + F.col("n")
    found = placed.agg(*(F.max(F.when((from_ <= at) & (at < to), F.col("v"))).alias(f"{side}{i}") for i, q in enumerate(qs) for side, at in (("lo", F.floor(F.col("last") * q)), ("hi", F.ceil(F.col("last") * q)))), F.max("last").alias("last"))
    between = lambda i, q: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (F.col("last") * q - F.floor(F.col("last") * q))
    return found.select(F.array(*(between(i, q) for i, q in enumerate(qs))).alias("q"))


def quantile_bucket(df: DataFrame, value: str, n: int, into: str = "bucket") -> DataFrame:
    """Right-closed buckets between distinct quantile edges, the lowest value included; ties stay together."""
    edges = quantiles(df, value, [k / n for k in range(n + 1)]).select(F.array_distinct("q").alias("_e"))
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    at = F.size(F.filter(inner, lambda e: F.col(value) > e)) + 1
    return df.join(F.broadcast(edges)).withColumn(into, at).drop("_e")  # one row of edges


def top_pairs(df: DataFrame, group: str, label: str, n: int = 5) -> DataFrame:
    """group with its n most frequent labels as 'label:count | label:count'."""
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("k"))
    best = per.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("k"), label))).filter(F.col("rn") <= n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rn", F.concat_ws(":", F.col(label).cast("string"), F.col("k").cast("string")).alias("s")))), lambda x: x["s"])
    return best.groupBy(group).agg(F.array_join(listed, " | ").alias("top_pairs"))


def population_cube(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a and b, each also over all of the other."""
    out = df.cube(a, b).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    return out.select(F.when(F.col("g").bitwiseAND(2) > 0, "all").otherwise(F.col(a)).alias(a), F.when(F.col("g").bitwiseAND(1) > 0, "all").otherwise(F.col(b)).alias(b), "n")


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: rows, known values, their mean, deviation, exact quartiles and ends. The quartiles come from prefix sums, so a group may be of any size."""
    v = F.col(value).cast("double")
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    q = grouped_quantiles(df, [group], value, [0.25, 0.5, 0.75]).select(F.col(group).alias("_g"), "q")
    both = out.join(q, F.col(group).eqNullSafe(F.col("_g")), "left")
    return both.select(group, "n_rows", "n", "mean", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "minimum", "maximum")


def unique_path_links(mentions: DataFrame, universe: DataFrame) -> DataFrame:
    """mentions (issue, mention) resolved to paths: the same path, else the only path with that base name."""
    from provenant.functions.text import basename

    exact = mentions.join(universe.select(F.col("path").alias("mention")).distinct(), "mention").select("issue", F.col("mention").alias("path"), F.lit("exact").alias("how"))
    names = universe.select("path", basename("path").alias("mention")).distinct().groupBy("mention").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    rest = mentions.join(exact.select("issue", F.col("path").alias("mention")), ["issue", "mention"], "left_anti")
    return exact.union(rest.join(names, "mention").select("issue", "path", F.lit("basename").alias("how"))).distinct()
