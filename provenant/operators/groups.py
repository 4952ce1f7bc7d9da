"""Names of groups, denominators, and summaries of features by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.functions import text as tx
from provenant.functions.numbers import safe_divide
from provenant.functions.tails import f_upper, t_two_sided
from provenant.operators.statistics import grouped_medians

#: What several spellings of a group's name stand for.
CASE_NAMES = ("wontfix", "won_t_fix", "won't_fix", "wont_fix")
COMPARISON_NAMES = ("comparison", "control", "controls", "non_wontfix", "non_wontfix_comparison")
BUCKET_NAMES = {"resolved_pr": "pr_resolved", "closed": "closed_non_wontfix"}

#: Denominators: columns that must all be positive for an issue to count. The fixed names are those of the reports.
DENOMINATORS: dict[str, tuple[str, ...]] = {
    "all_rq2_issues": (),
    "issues_with_resolved_commenters": ("commenter_count_with_resolved_key",),
    "issues_with_top_commenter": ("top_commenter_comment_count",),
    "file_applicable_issues": ("participant_role_file_features_applicable",),
    "file_applicable_issues_with_resolved_commenters": ("participant_role_file_features_applicable", "participant_role_file_commenter_count_with_resolved_key"),
    "file_applicable_issues_with_top_commenter": ("participant_role_file_features_applicable", "top_commenter_comment_count"),
    "issues_with_post_issue_owners": ("post_issue_owner_count_for_continuity",),
    "issues_with_post_issue_owners_and_resolved_commenters": ("post_issue_owner_count_for_continuity", "commenter_count_with_resolved_key"),
}
#: A column that stands in for another one that a table lacks.
INSTEAD = {"participant_role_file_commenter_count_with_resolved_key": "commenter_count_with_resolved_key"}


def _plain(c: Column) -> Column:
    return F.translate(F.lower(tx.clean_text(c)), "- ", "__")


def analysis_set(c: Column) -> Column:
    """wontfix, comparison, missing, or the name itself in lower case with underscores."""
    name = _plain(c)
    return F.when(name.isNull(), "missing").when(name.isin(*CASE_NAMES), "wontfix").when(name.isin(*COMPARISON_NAMES), "comparison").otherwise(name)


def comparison_group(c: Column, of_set: Column) -> Column:
    """wontfix for that set; else the bucket's name, comparison where it has none."""
    name, out = _plain(c), _plain(c)
    for alias, to in BUCKET_NAMES.items():
        out = F.when(name == alias, to).otherwise(out)
    return F.when(analysis_set(of_set) == "wontfix", "wontfix").otherwise(F.coalesce(out, F.lit("comparison")))


def denominator(df: DataFrame, name: str) -> Column:
    """Whether a row counts; a column that the table lacks is 0, and an unknown name counts every row."""
    out = F.lit(True)
    for c in DENOMINATORS.get(name, ()):
        held = c if c in df.columns else INSTEAD.get(c)
        out = out & (F.coalesce(F.col(held).try_cast("double"), F.lit(0.0)) > 0 if held in df.columns else F.lit(False))
    return out


def feature_summary(df: DataFrame, feature: str, group: str, counts: Column, binary: bool) -> DataFrame:
    """Per group of the rows that count: n, valid_n, positive_count and rate of a flag, or mean, median and deviation of a number."""
    v = F.col(feature).try_cast("double")
    rows = df.filter(counts).select(F.col(group).alias("analysis_set"), v.alias("_v"))
    v = F.col("_v")
    g = rows.groupBy("analysis_set").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("valid_n"), F.sum((F.coalesce(v, F.lit(0.0)) > 0).cast("int")).alias("positive"), F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"))
    if not binary:
        middle = grouped_medians(rows, ["analysis_set"], "_v").select(F.col("analysis_set").alias("_s"), F.col("median").alias("median_"))
        g = g.join(middle, F.col("analysis_set").eqNullSafe(F.col("_s")), "left")
    rate = safe_divide(F.col("positive"), F.col("n"))
    none = F.lit(None).cast("double")
    return g.select("analysis_set", F.lit(feature).alias("feature"), "n", "valid_n", (F.col("positive") if binary else F.lit(None).cast("bigint")).alias("positive_count"), (rate if binary else none).alias("rate"), (rate if binary else F.col("m")).alias("mean"), (none if binary else F.col("median_")).alias("median"), (none if binary else F.col("sd")).alias("std"))


def zero_pattern(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group: which of missing, zero and other values a column has, in one word."""
    v = F.col(value).try_cast("double")
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("known"), F.sum((v == 0).cast("int")).alias("zeros"))
    known, zeros = F.col("known"), F.coalesce("zeros", F.lit(0))
    return g.select(*by, "n", (F.col("n") - known).alias("missing_count"), zeros.alias("zero_count"), F.when(known == 0, "all_missing").when((zeros == known) & (known == F.col("n")), "all_zero").when(zeros == known, "zero_and_missing").otherwise("contains_nonzero_values").alias("pattern"))


def mark_duplicates(df: DataFrame, keys: list[str], into: str = "duplicate_key") -> DataFrame:
    """df with 1 for every row whose key another row has too."""
    return df.withColumn(into, (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1).cast("int"))


def early_late(df: DataFrame, early: str, late: str, *by: str) -> DataFrame:
    """Per group: pairs, mean difference of late and early, its deviation, and the paired t with its degrees of freedom and p."""
    d = F.col(late) - F.col(early)
    g = df.groupBy(*by).agg(F.count(d).alias("n_pairs"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"))
    return g.withColumn("paired_t", F.when((F.col("sd_difference") > 0) & (F.col("n_pairs") > 1), F.col("mean_difference") / (F.col("sd_difference") / F.sqrt("n_pairs")))).withColumn("df", F.col("n_pairs") - 1).withColumn("paired_p", t_two_sided(F.col("paired_t"), F.col("df")))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance from moments by group: groups, rows, F, its degrees of freedom and p."""
    v = F.col(value).cast("double")
    g = df.filter(v.isNotNull()).groupBy(group).agg(F.count(v).alias("k"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    n, grand = F.sum("k"), F.sum(F.col("k") * F.col("m")) / F.sum("k")
    one = g.agg(F.count(F.lit(1)).alias("n_groups"), n.alias("n"), F.sum(F.col("k") * F.col("m") * F.col("m")).alias("q"), grand.alias("mean"), F.sum(F.col("k") * F.col("s")).alias("within"))
    between = F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    f = (between / (F.col("n_groups") - 1)) / (F.col("within") / (F.col("n") - F.col("n_groups")))
    out = one.select("n_groups", "n", F.when((F.col("n_groups") > 1) & (F.col("n") > F.col("n_groups")) & (F.col("within") > 0), f).alias("f_statistic"), (F.col("n_groups") - 1).alias("df_between"), (F.col("n") - F.col("n_groups")).alias("df_within"))
    return out.withColumn("f_p", f_upper(F.greatest("f_statistic", F.lit(0.0)), F.col("df_between"), F.col("df_within")))
