"""Group comparisons: effect sizes, rank statistics, adjusted p-values, trends, regressions from aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from provenant.functions.tails import chi2_upper, t_two_sided
from provenant.sources.scratch import stored

#: Coefficients of the fit of erfc, constant first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def in_ranges(df: DataFrame, value: str) -> DataFrame:
    """df dealt by ranges of a value into a stored table, with part: its range's number. Stored, as Spark samples the bounds anew at every run."""
    return stored(df.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "ranges")


def prefix_sums(df: DataFrame, value: str, *sums: str) -> DataFrame:
    """df, whose values are distinct, with below_<c>: the sum of c over all smaller values.

    Sums within a range and the totals of the ranges before it; only the totals, one row for each range, meet in one task.
    """
    parts = in_ranges(df, value)
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(*(F.sum(c).alias(f"t_{c}") for c in sums)).select("part", *(F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"t_{c}") for c in sums))
    run = Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select("*", *(F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"r_{c}") for c in sums)).join(F.broadcast(totals), "part")  # a row per range
    return placed.select(*df.columns, *((F.col(f"r_{c}") + F.col(f"t_{c}")).alias(f"below_{c}") for c in sums))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """value and its 1-based rank with ties averaged, a row for each distinct value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counts, value, "n").select(value, (F.col("below_n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, Pearson's and Spearman's correlation, null below ten rows."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = rows.join(average_ranks(rows, x).withColumnRenamed("rank", "rank_x"), x).join(average_ranks(rows, y).withColumnRenamed("rank", "rank_y"), y)
    enough = F.count(F.lit(1)) >= 10
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(enough, F.corr(x, y)).alias("pearson"), F.when(enough, F.corr("rank_x", "rank_y")).alias("spearman"))


def moments(df: DataFrame, group: str, value: str, *by: str) -> DataFrame:
    """One row (per by) with n, mean and variance of the groups 1 (a) and 0 (b)."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value).cast("double"))
    aggs = [f(pick(g)).alias(f"{name}_{s}") for g, s in ((1, "a"), (0, "b")) for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def effect_sizes(m: DataFrame) -> DataFrame:
    """m with difference, Cohen's d by pooled deviation, Hedges' g, Welch's t, its degrees of freedom and two-sided p."""
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    diff = F.col("mean_a") - F.col("mean_b")
    d = F.when(pooled > 0, diff / pooled)
    se2 = va / na + vb / nb
    out = m.withColumn("difference", diff).withColumn("cohen_d", d).withColumn("hedges_g", d * (1 - 3 / (4 * (na + nb) - 9))).withColumn("welch_t", F.when(se2 > 0, diff / F.sqrt(se2))).withColumn("welch_df", F.when(se2 > 0, se2 * se2 / (F.pow(va / na, F.lit(2)) / (na - 1) + F.pow(vb / nb, F.lit(2)) / (nb - 1))))
    return out.withColumn("welch_p", t_two_sided(F.col("welch_t"), F.col("welch_df")))


def pairwise_welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """group_a, group_b (a < b) of all groups with two known values or more: their sizes and means, Welch's t, degrees of freedom, p, and p adjusted over all pairs.

    Rows meet only as moments by group; the pairs are those of the groups' names, whose number the caller's grouping bounds.
    """
    v = F.col(value).cast("double")
    g = df.filter(v.isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var")).filter("n > 1")
    one = g.agg(F.sort_array(F.collect_list(F.struct("g", "n", "mean", "var"))).alias("all"))
    pairs = one.select("all", F.posexplode("all").alias("k", "a")).select("a", F.explode(F.slice("all", F.col("k") + 2, F.size("all"))).alias("b"))
    rows = pairs.select(F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("n", "mean", "var") for s in "ab"))
    return benjamini_hochberg(effect_sizes(rows).drop("var_a", "var_b"), "welch_p")


def rank_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mann-Whitney U of group 1, its two-sided p by the normal approximation with ties, and Cliff's delta.

    Ranks come from counts by distinct value and prefix sums over ranges of it, not from a sort of all rows in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum((F.col(group) == 1).cast("long")).alias("a"), F.sum((F.col(group) == 0).cast("long")).alias("b"))
    t = F.col("a") + F.col("b")
    out = prefix_sums(counts, "v", "b").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * (F.col("below_b") + F.col("b") / 2)).alias("mann_whitney_u"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("mann_whitney_u") - na * nb / 2) - 0.5) / sd
    out = out.withColumn("mann_whitney_p", F.when(sd > 0, two_sided_normal(F.greatest(z, F.lit(0.0)))))
    return out.withColumn("cliffs_delta", F.when((na > 0) & (nb > 0), 2 * F.col("mann_whitney_u") / (na * nb) - 1)).drop("ties")


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, rows, H corrected for ties, its degrees of freedom and p; H is null below two groups or where all values are equal."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g is not null and v is not null")
    per = rows.groupBy("v", "g").agg(F.count(F.lit(1)).alias("k"))
    placed = average_ranks(rows, "v")
    sums = per.join(placed, "v").groupBy("g").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("rank")).alias("t"))
    one = sums.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("k").alias("n"), F.sum(F.col("t") * F.col("t") / F.col("k")).alias("q"))
    t = F.col("t").cast("double")
    ties = per.groupBy("v").agg(F.sum("k").alias("t")).agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    even = 1 - F.col("ties") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / even
    return one.join(F.broadcast(ties)).select("n_groups", "n", F.when((F.col("n_groups") > 1) & (even > 0), h).alias("kruskal_h"), (F.col("n_groups") - 1).alias("df")).withColumn("kruskal_p", chi2_upper(F.greatest("kruskal_h", F.lit(0.0)), F.col("df")))  # one row each


def wilcoxon(df: DataFrame, late: str, early: str, by: str) -> DataFrame:
    """Per group: signed-rank W of pairs that differ, and its two-sided p by the normal approximation with ties.

    Ranks of all groups come from one set of prefix sums over (group, size of difference), less what lies before the group.
    """
    d = F.col(late).cast("double") - F.col(early).cast("double")
    rows = df.select(F.col(by).alias("g"), d.alias("d")).filter("d <> 0 and g is not null")
    counts = rows.groupBy(F.struct("g", F.abs("d").alias("v")).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    placed = prefix_sums(counts, "at", "n").withColumn("g", F.col("at.g"))
    start = placed.groupBy("g").agg(F.min("below_n").alias("start"))
    rank = F.col("below_n") - F.col("start") + (F.col("n") + 1) / 2
    t = F.col("n").cast("double")
    g = placed.join(start, "g").groupBy("g").agg(F.sum("n").alias("n_pairs"), F.sum(rank * F.col("up")).alias("plus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n_pairs").cast("double")
    mean, sd = n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    w = F.least(F.col("plus"), n * (n + 1) / 2 - F.col("plus"))
    return g.select(F.col("g").alias(by), "n_pairs", w.alias("wilcoxon_w"), F.when(sd > 0, two_sided_normal(F.abs(w - mean) / sd)).alias("wilcoxon_p"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """df (a table of tests) with p_adj: least p * n / rank of this and all larger p, at most 1. Null p stays null.

    Ranks by prefix sums over ranges of p; then the least within a range and over the ranges after it.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("_n"))
    ranked = prefix_sums(counts, "_p", "k").join(F.broadcast(total)).select("_p", (F.col("_p") * F.col("_n") / (F.col("below_k") + F.col("k"))).alias("q"))  # one row of the total
    parts = in_ranges(ranked, "_p")
    after = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    least = parts.groupBy("part").agg(F.min("q").alias("m")).select("part", F.min("m").over(after).alias("m"))
    own = Window.partitionBy("part").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    adjusted = parts.withColumn("q", F.min("q").over(own)).join(F.broadcast(least), "part").select("_p", F.least("q", "m", F.lit(1.0)).alias("p_adj"))  # a row per range
    return df.join(adjusted, df[p] == adjusted["_p"], "left").drop("_p")


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a/b) / (c/d), each count with 0.5 more."""
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def proportion_effects(df: DataFrame, group: str, flag: str) -> DataFrame:
    """2 x 2 counts of a flag by group with rates, risk difference, odds ratio, Yates' chi-square and its p."""
    n = lambda g, f: F.sum(((F.col(group) == g) & (F.col(flag) == f)).cast("long"))
    t = df.agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    total = a + b + c + d
    chi = total * F.pow(F.greatest(F.abs(a * d - b * c) - total / 2, F.lit(0.0)), F.lit(2)) / ((a + b) * (c + d) * (a + c) * (b + d))
    return t.withColumn("rate_a", a / (a + b)).withColumn("rate_b", c / (c + d)).withColumn("risk_difference", F.col("rate_a") - F.col("rate_b")).withColumn("odds_ratio", odds_ratio(a, b, c, d)).withColumn("chi2_yates", chi).withColumn("chi2_p", chi2_upper(chi, F.lit(1)))


def within_group_z(df: DataFrame, value: str, by: str) -> DataFrame:
    """df with z: the population z-score within the group; 0 where the deviation is 0 or null. Moments by aggregate, joined to the rows."""
    m = df.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    j = df.join(m, df[by].eqNullSafe(m["_by"]))
    return j.select(*df.columns, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("z"))


def fixed_effect_slope(df: DataFrame, y: str, x: str, by: str) -> DataFrame:
    """OLS slope of y on x with a fixed effect for each group: from sums by group, one row of which is all that a group sends on."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(n) for n, c in (("sx", F.col(x)), ("sy", F.col(y)), ("sxy", F.col(x) * F.col(y)), ("sxx", F.col(x) * F.col(x)))))
    return g.agg(F.sum("n").alias("n"), (F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))).alias("slope"))


def logit_by_group(df: DataFrame, y: str, x: str, by: str, rounds: int = 25) -> DataFrame:
    """by, n, intercept, slope of a logistic regression of y (0 or 1) on x with an intercept for each group and one slope.

    Groups whose y never differs are left out, as their intercept has no finite value. Newton steps: each is one aggregate by group,
    whose rows (one for each group) are joined back as the next step's intercepts; only the slope passes through the driver.
    """
    both = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")).filter("m > 0 and m < 1")
    fit = stored(both.select(F.col(by).alias("_by"), "n", F.log(F.col("m") / (1 - F.col("m"))).alias("a")), "intercepts")
    rows = stored(df.select(by, F.col(y).alias("_y"), F.col(x).cast("double").alias("_x")).join(fit.select("_by"), F.col(by) == F.col("_by"), "left_semi").filter("_y is not null and _x is not null"), "rows")
    b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("a") + F.lit(b) * F.col("_x"))))
        step = rows.join(fit, rows[by] == fit["_by"]).withColumn("_p", p).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
        g = stored(step.groupBy("_by", "n", "a").agg(F.sum(F.col("_y") - F.col("_p")).alias("r"), F.sum((F.col("_y") - F.col("_p")) * F.col("_x")).alias("rx"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("wx"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("wxx")), "newton")
        s = g.agg(F.sum(F.col("rx") - F.col("wx") * F.col("r") / F.col("w")), F.sum(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w"))).first()
        if s[0] is None:
            break
        d = s[0] / s[1] if s[1] > 1e-12 else 0.0
        fit = stored(g.select("_by", "n", (F.col("a") + (F.col("r") - F.lit(d) * F.col("wx")) / F.col("w")).alias("a")), "intercepts")
        b += d
        if abs(d) < 1e-9 and g.filter("abs(r / w) > 1e-9").limit(1).count() == 0:
            break
    return fit.select(F.col("_by").alias(by), "n", F.col("a").alias("intercept"), F.lit(b).alias("slope"))


def logit_model(df: DataFrame, y: str, xs: list[str], by: str, *, rounds: int = 40, at_most: float = 25.0) -> DataFrame:
    """Logistic regression of y (0 or 1) on xs with an intercept for each group: model, term, coefficient, std_error, ci_low, ci_high, odds_ratio, p_value, n, n_groups.

    Rows with an unknown value go, and so do groups whose y never differs. A Newton step is one aggregate by group; the intercepts' part of the information is diagonal, so the slopes need only
    the sums of each group's part less what its intercept explains (Schur's complement): one row of at most (1 + xs) squared sums reaches the driver, and its inverse holds the slopes' errors.
    Where the slopes have no finite value (an effect of more than at_most in standard deviations: xs separate y) or do not come to rest, the result is that of the linear model with the same intercepts, named linear.
    """
    k = len(xs)
    rows = df.select(F.col(by).alias("_by"), F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs))).dropna()
    both = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m")).filter("m > 0 and m < 1")
    fit = stored(both.select("_by", F.log(F.col("m") / (1 - F.col("m"))).alias("a")), "intercepts")
    rows = stored(rows.join(fit.select("_by"), "_by", "left_semi"), "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_by").alias("g"), *(F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k))).first()
    sd = np.array([size[f"s{i}"] or 0.0 for i in range(k)])
    b, inverse, finite = np.zeros(k), None, False
    for _ in range(rounds if size["n"] and (sd > 0).all() else 0):
        p = 1 / (1 + F.exp(-sum((F.lit(float(b[i])) * F.col(f"x{i}") for i in range(k)), F.col("a"))))
        step = rows.join(fit, "_by").withColumn("_r", F.col("_y") - p).withColumn("_w", p * (1 - p))
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        sums = [F.sum("_r").alias("r"), F.sum("_w").alias("w"), *(F.sum(F.col("_r") * F.col(f"x{i}")).alias(f"r{i}") for i in range(k)), *(F.sum(F.col("_w") * F.col(f"x{i}")).alias(f"w{i}") for i in range(k)), *(F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"w{i}_{j}") for i, j in pairs)]
        g = stored(step.groupBy("_by", "a").agg(*sums), "newton")
        s = g.agg(*(F.sum(F.col(f"r{i}") - F.col(f"w{i}") * F.col("r") / F.col("w")).alias(f"g{i}") for i in range(k)), *(F.sum(F.col(f"w{i}_{j}") - F.col(f"w{i}") * F.col(f"w{j}") / F.col("w")).alias(f"h{i}_{j}") for i, j in pairs), F.max(F.abs(F.col("r") / F.col("w"))).alias("off")).first()
        info = np.array([[s[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
        if not np.isfinite(info).all() or (np.diag(info) <= 0).any() or np.linalg.matrix_rank(info / np.sqrt(np.outer(np.diag(info), np.diag(info))), tol=1e-9) < k:
            break
        inverse = np.linalg.inv(info)
        d = inverse @ np.array([s[f"g{i}"] for i in range(k)])
        b = b + d
        if (np.abs(b) * sd > at_most).any():
            break
        fit = stored(g.select("_by", (F.col("a") + (F.col("r") - sum((F.lit(float(d[i])) * F.col(f"w{i}") for i in range(k)), F.lit(0.0))) / F.col("w")).alias("a")), "intercepts")
        if (np.abs(d) * sd < 1e-9).all() and s["off"] < 1e-8:
            finite = True
            break
    if not finite:
        linear = fixed_effect_model(df.select(by, F.col(y).cast("double").alias(y), *xs), y, xs, by)
        return linear.select(F.lit("linear").alias("model"), "term", "coefficient", "std_error", "ci_low", "ci_high", F.lit(None).cast("double").alias("odds_ratio"), "p_value", "n", "n_groups")
    rows = [(xs[i], float(b[i]), float(np.sqrt(inverse[i, i]))) for i in range(k)]
    out = df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double")
    c, e = F.col("coefficient"), F.col("std_error")
    return out.select(F.lit("logit").alias("model"), "term", c, e, (c - 1.96 * e).alias("ci_low"), (c + 1.96 * e).alias("ci_high"), F.exp(c).alias("odds_ratio"), two_sided_normal(F.abs(c / e)).alias("p_value"), F.lit(size["n"]).cast("bigint").alias("n"), F.lit(size["g"]).cast("bigint").alias("n_groups"))


def odds_two_by_two(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact two-sided p of a 2 x 2 table of counts: tables no likelier than this one, summed outwards until a term no longer counts.

    The walk ends some deviations away, so its length grows as the root of the counts.
    """
    n, row, column = a + b + c + d, a + b, a + c
    low, high = max(0, row + column - n), min(row, column)
    log_p = lambda k: sum(map(math.lgamma, (row + 1, n - row + 1, column + 1, n - column + 1))) - sum(map(math.lgamma, (n + 1, k + 1, row - k + 1, column - k + 1, n - row - column + k + 1)))
    own = log_p(a)
    mode = min(high, max(low, (row + 1) * (column + 1) // (n + 2)))

    def outwards(k: int, step: int) -> float:
        total = 0.0
        while low <= k <= high and (t := math.exp(log_p(k) - own)) > 1e-17:
            total += t
            k += step
        return total

    if log_p(mode) <= own + 1e-7:
        return 1.0
    step = -1 if a < mode else 1
    inside, outside = mode, (high if step < 0 else low) - step  # likelier, and beyond the other end
    while abs(outside - inside) > 1:
        k = (inside + outside) // 2
        inside, outside = (inside, k) if not low <= k <= high or log_p(k) <= own + 1e-7 else (k, outside)
    return min(1.0, math.exp(own) * (outwards(a, step) + outwards(outside, -step)))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's p of tables that are aggregates already, a row for each."""
    return pd.Series([odds_two_by_two(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype="float64")


def flag_effects(df: DataFrame, group: str, flags: list[str], by: list[str], min_n: int = 5) -> DataFrame:
    """A row per by and flag: sizes, positives and rates of the groups 1 (a) and 0 (b), risk difference, odds ratio, Fisher's p.

    A flag that is unknown counts as not set. Below min_n rows in a group the status is limited_n and p is null.
    """
    v = lambda f: F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) > 0
    n = lambda g, c: F.sum(((F.col(group) == g) & c).cast("long"))
    t = df.filter(F.col(group).isin(0, 1)).groupBy(*by).agg(n(1, F.lit(True)).alias("n_a"), n(0, F.lit(True)).alias("n_b"), *(x for f in flags for x in (n(1, v(f)).alias(f"{f}_a"), n(0, v(f)).alias(f"{f}_b"))))
    rows = t.select(*by, "n_a", "n_b", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_a").alias("positive_a"), F.col(f"{f}_b").alias("positive_b")) for f in flags))))
    pa, pb, na, nb = (F.col(c) for c in ("positive_a", "positive_b", "n_a", "n_b"))
    enough = (na >= min_n) & (nb >= min_n)
    rate = lambda p, k: F.when(k > 0, p / k)
    out = rows.withColumn("rate_a", rate(pa, na)).withColumn("rate_b", rate(pb, nb)).withColumn("risk_difference", F.col("rate_a") - F.col("rate_b"))
    out = out.withColumn("odds_ratio", F.when((na > 0) & (nb > 0), odds_ratio(pa, na - pa, pb, nb - pb))).withColumn("status", F.when(enough, "ok").otherwise("limited_n"))
    return out.withColumn("fisher_p", F.when(enough, fisher_p(pa, na - pa, pb, nb - pb)))


def grouped_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """by and q: exact quantiles, linear between neighbours, of each group that has a value; from counts and prefix sums, so no task holds a group."""
    counts = df.select(F.struct(*by, F.col(value).cast("double").alias("_v")).alias("k")).filter("k._v is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    placed = stored(prefix_sums(counts, "k", "n"), "placed")
    group = F.struct(*(F.col(f"k.{b}").alias(b) for b in by))
    sizes = placed.groupBy(group.alias("g")).agg(F.min("below_n").alias("start"), (F.sum("n") - 1).alias("last"))
    rank = F.col("below_n") - F.col("start")
    here = lambda at: F.max(F.when((rank <= at) & (at < rank + F.col("n")), F.col("k._v")))
    found = placed.join(sizes, group.eqNullSafe(F.col("g"))).groupBy("g", "last").agg(*(here(side(F.col("last") * q)).alias(f"{name}{i}") for i, q in enumerate(qs) for name, side in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda i, q: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (F.col("last") * q - F.floor(F.col("last") * q))
    return found.select(*(F.col(f"g.{b}").alias(b) for b in by), F.array(*(between(i, q) for i, q in enumerate(qs))).alias("q"))


def grouped_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and the exact median of a value in each group that has one."""
    return grouped_quantiles(df, by, value, [0.5]).select(*by, F.col("q")[0].alias("median"))


def fixed_effect_model(df: DataFrame, y: str, xs: list[str], by: str) -> DataFrame:
    """OLS of y on xs with an intercept for each group: term, coefficient, HC3 error, 95 % interval, p, n, n_groups, r_squared.

    Rows with an unknown value go. Values are centred by group, so the intercepts never become columns: a row's leverage is 1 / group size
    plus its part in the centred terms. A group of one row says nothing of the slopes and adds nothing to their errors. Terms that
    depend on each other give no row. What reaches the driver is one row of (1 + xs) squared sums.
    """
    cols, k = [y, *xs], len(xs)
    rows = df.select(F.col(by).alias("_by"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols))).dropna()
    means = stored(rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), *(F.avg(f"c{i}").alias(f"m{i}") for i in range(k + 1))), "means")
    z = stored(rows.join(means, "_by").select("_n", "c0", *((F.col(f"c{i}") - F.col(f"m{i}")).alias(f"z{i}") for i in range(k + 1))), "centred")
    s = z.agg(F.count(F.lit(1)).alias("n"), (F.var_pop("c0") * F.count(F.lit(1))).alias("sst"), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i + 1))).first()
    fit = None
    if s["n"]:
        a = np.array([[s[f"s{max(i, j)}_{min(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        scale = np.sqrt(np.diag(a)[1:])
        if (scale > 0).all() and np.linalg.matrix_rank(a[1:, 1:] / np.outer(scale, scale), tol=1e-9) == k:
            inverse = np.linalg.inv(a[1:, 1:])
            fit = inverse @ a[1:, 0]
    if fit is None:
        return df.sparkSession.createDataFrame([], "term string, coefficient double, std_error double, ci_low double, ci_high double, p_value double, n bigint, n_groups bigint, r_squared double")
    total = lambda terms: sum(terms, F.lit(0.0))
    zs = [F.col(f"z{i + 1}") for i in range(k)]
    weight = lambda t: total(F.lit(float(inverse[t, j])) * zs[j] for j in range(k))
    error = F.col("z0") - total(F.lit(float(fit[j])) * zs[j] for j in range(k))
    free = 1 - 1 / F.col("_n") - total(weight(t) * zs[t] for t in range(k))
    left = F.when(free > 1e-12, error / free).otherwise(0.0)
    one = z.select(error.alias("e"), *((weight(t) * left).alias(f"u{t}") for t in range(k))).agg(F.sum(F.col("e") * F.col("e")).alias("sse"), *(F.sqrt(F.sum(F.col(f"u{t}") * F.col(f"u{t}"))).alias(f"se{t}") for t in range(k)))
    n_groups = means.agg(F.count(F.lit(1)).alias("n_groups"))
    terms = F.inline(F.array(*(F.struct(F.lit(xs[t]).alias("term"), F.lit(float(fit[t])).alias("coefficient"), F.col(f"se{t}").alias("std_error")) for t in range(k))))
    out = one.join(F.broadcast(n_groups)).select("sse", "n_groups", terms)  # one row each
    b, se = F.col("coefficient"), F.col("std_error")
    r2 = 1 - F.col("sse") / F.lit(float(s["sst"])) if s["sst"] > 0 else F.lit(None).cast("double")
    return out.select("term", "coefficient", "std_error", (b - 1.96 * se).alias("ci_low"), (b + 1.96 * se).alias("ci_high"), F.when(se > 0, two_sided_normal(F.abs(b / se))).alias("p_value"), F.lit(s["n"]).cast("bigint").alias("n"), "n_groups", r2.alias("r_squared"))


def adjusted_change(df: DataFrame, y: str, x: str, controls: list[str], by: str) -> DataFrame:
    """x's coefficient in the models of y without and with controls (rows complete for each model): model, n, coefficient, std_error, change from the first."""
    base = fixed_effect_model(df, y, [x], by).withColumn("model", F.lit("base"))
    more = fixed_effect_model(df, y, [x, *controls], by).withColumn("model", F.lit("adjusted"))
    first = base.select(F.col("coefficient").alias("_base"))
    both = base.union(more).filter(F.col("term") == x).join(F.broadcast(first), how="left")  # one row
    return both.select("model", "n", "coefficient", "std_error", F.when(F.col("model") == "adjusted", F.col("coefficient") - F.col("_base")).alias("change"))


def two_sided_normal(z: Column) -> Column:
    """Two-sided p of a standard normal z >= 0: Chebyshev fit of erfc, relative error below 1.2e-7."""
    t = 1 / (1 + 0.5 * z / math.sqrt(2))
    poly = F.lit(0.0)
    for c in ERFC[::-1]:
        poly = poly * t + c
    return F.least(F.lit(1.0), t * F.exp(-z * z / 2 + poly))
