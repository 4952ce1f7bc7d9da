"""Report tables: derived flags, participation by group, emotions with sentiment, timing of evidence, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.numbers import safe_divide
from provenant.operators.statistics import grouped_medians

#: A flag is 1 where any of its columns is positive.
SIGNALS = {
    "has_post_issue_ownership": ("ownership_post_issue_contributor_count", "ownership_has_post_issue_ownership", "post_issue_owner_count_for_continuity"),
    "has_pre_issue_issue_linked_ownership": ("ownership_pre_issue_contributor_count", "ownership_has_pre_issue_ownership", "pre_issue_owner_count_for_continuity"),
    "has_repo_participant_role_signal": ("issue_author_is_pre_issue_repo_contributor", "any_commenter_is_pre_issue_repo_contributor", "top_commenter_is_pre_issue_repo_contributor"),
    "has_file_participant_role_signal": ("issue_author_is_pre_issue_file_contributor", "any_commenter_is_pre_issue_file_contributor", "top_commenter_is_pre_issue_file_contributor"),
    "has_continuity_signal": ("any_post_issue_owner_with_pre_issue_repo_history", "any_post_issue_owner_with_pre_issue_file_history", "any_commenter_is_eventual_post_issue_owner"),
}
#: Fixed value: the flag that also asks for this column to be positive.
SIGNAL_NEEDS = {"has_file_participant_role_signal": "participant_role_file_features_applicable"}
#: Words that stand for an unknown coverage.
UNKNOWN = ("", "nan", "None", "<NA>")


def number(df: DataFrame, name: str) -> Column:
    """A column as a double, null where it is no number or not there."""
    return F.col(name).try_cast("double") if name in df.columns else F.lit(None).cast("double")


def _positive(df: DataFrame, name: str) -> Column:
    return F.coalesce(number(df, name), F.lit(0.0)) > 0


def ownership_defaults(df: DataFrame, *, flags: list[str] = (), counts: list[str] = (), shares: list[str] = (), coverage: list[str] = ()) -> DataFrame:
    """df with numbers in place: flags (int) and counts 0 where unknown, shares null, coverage words 'missing'; columns that lack are added."""
    word = lambda c: F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")
    known = lambda c: F.coalesce(F.when(word(c).isin(*UNKNOWN), F.lit("missing")).otherwise(word(c)), F.lit("missing"))
    return df.withColumns({**{c: F.coalesce(number(df, c), F.lit(0.0)).cast("int") for c in flags}, **{c: F.coalesce(number(df, c), F.lit(0.0)) for c in counts}, **{c: number(df, c) for c in shares}, **{c: known(c) for c in coverage}})


def signal_flags(df: DataFrame) -> DataFrame:
    """df with the flags of SIGNALS; a column that lacks or holds no number counts as 0."""
    flag = lambda f: reduce(lambda a, b: a | b, (_positive(df, c) for c in SIGNALS[f])) & (_positive(df, SIGNAL_NEEDS[f]) if f in SIGNAL_NEEDS else F.lit(True))
    return df.withColumns({f: flag(f).cast("int") for f in SIGNALS})


def participation_by_group(df: DataFrame, by: list[str], features: dict[str, bool]) -> DataFrame:
    """Per group: issues, issues with comments, issues without and their share, and mean, median and n of each feature.

    features says for each whether only issues with comments count. Medians come from prefix sums, so a group may be of any size.
    """
    commented = F.coalesce(number(df, "comment_count"), F.lit(0.0)) > 0
    zero = F.coalesce(number(df, "zero_comment_flag"), F.lit(0.0))
    value = lambda f: F.when(commented, number(df, f)) if features[f] else number(df, f)
    rows = df.select(*by, commented.cast("long").alias("_commented"), zero.alias("_zero"), *(value(f).alias(f) for f in features))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("issue_count"), F.sum("_commented").alias("comment_bearing_issue_count"), F.sum("_zero").cast("long").alias("zero_comment_count"), *(a for f in features for a in (F.avg(f).alias(f"{f}__mean"), F.count(f).alias(f"{f}__n"))))
    g = g.withColumn("zero_comment_share", safe_divide(F.col("zero_comment_count"), F.col("issue_count")))
    for f in features:
        m = grouped_medians(rows, by, f).select(*(F.col(b).alias(f"_{b}") for b in by), F.col("median").alias(f"{f}__median"))
        g = g.join(m, reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by)), "left").drop(*(f"_{b}" for b in by))
    return g


def group_differences(df: DataFrame, features: dict[str, bool], binary: list[str] = (), a: str = "wontfix", b: str = "comparison") -> DataFrame:
    """A row per feature: n, mean, median (numbers) or positives (flags) in the two sets, and a's less b's.

    features as in participation_by_group; all of them are taken in one pass over the rows.
    """
    commented = F.coalesce(number(df, "comment_count"), F.lit(0.0)) > 0
    value = lambda f: F.when(commented, number(df, f)) if features[f] else number(df, f)
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(f in binary).alias("is_flag"), value(f).alias("v")) for f in features))
    long = df.filter(F.col("analysis_set").isin(a, b)).select("analysis_set", F.inline(cells)).filter("v is not null")
    side = lambda s, c: F.when(F.col("analysis_set") == s, c)
    aggs = [x for s in (a, b) for x in (F.count(side(s, F.col("v"))).alias(f"{s}_n"), F.avg(side(s, F.col("v"))).alias(f"{s}_mean"), F.sum(side(s, (F.col("v") == 1).cast("long"))).alias(f"{s}_pos"))]
    g = long.groupBy("feature", "is_flag").agg(*aggs)
    m = grouped_medians(long, ["feature", "analysis_set"], "v").groupBy("feature").agg(*(F.max(side(s, F.col("median"))).alias(f"{s}_med") for s in (a, b)))
    shown = lambda s: [F.col(f"{s}_n"), F.col(f"{s}_mean"), F.when(~F.col("is_flag"), F.col(f"{s}_med")).alias(f"{s}_median"), F.when(F.col("is_flag"), F.coalesce(f"{s}_pos", F.lit(0))).alias(f"{s}_positive_count")]
    out = g.join(m, "feature").select("feature", F.when(F.col("is_flag"), "binary").otherwise("numeric").alias("feature_type"), *shown(a), *shown(b))
    return out.withColumn("mean_difference", F.col(f"{a}_mean") - F.col(f"{b}_mean")).withColumn("median_difference", F.col(f"{a}_median") - F.col(f"{b}_median"))


def participation_counters(df: DataFrame, by: str) -> DataFrame:
    """Per repository of participation rows: issues by what is known of their comments, medians, and shares of flags."""
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    g = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("issue_rows_written"), n(F.col("comment_count") == 0, "issues_with_zero_comments"), n(F.col("resolved_comment_count") > 0, "issues_with_resolved_comments"),
        n(F.col("unique_commenter_count") > 1, "issues_with_multiple_commenters"), n(F.col("only_author_commented_flag") == 1, "issues_with_only_author_comments"), n(F.col("participation_coverage_flag") == "ok", "issues_ok"),
        F.avg("top_commenter_share").alias("mean_top_commenter_share"), F.avg("issue_author_commented_flag").alias("share_issue_author_commented"), F.avg("single_commenter_flag").alias("share_single_commenter"),
    )
    for c in ("comment_count", "unique_commenter_count"):
        m = grouped_medians(df.select(by, F.col(c).cast("double").alias(c)), [by], c).select(F.col(by).alias("_by"), F.col("median").alias(f"median_{c}"))
        g = g.join(m, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return g


def emotions_with_sentiment(emotions: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Per analysis set and dominant emotion of the issues that have both: issues, repositories, mean confidence and sentiment; unknown sets are 'unknown'."""
    m = sentiment.join(emotions.select("repo", "issue", "emotion", "confidence"), ["repo", "issue"])
    means = {"avg_emotion_confidence": "confidence", "avg_comment_count": "comment_count", "avg_comment_sentiment": "mean_comment_sentiment", "avg_negative_share": "negative_comment_share"}
    return m.groupBy(F.coalesce("analysis_set", F.lit("unknown")).alias("analysis_set"), F.coalesce("emotion", F.lit("unknown")).alias("emotion")).agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("repo").alias("repos"), *(F.avg(number(m, c)).alias(k) for k, c in means.items()))


def emotions_across_sets(emotions: DataFrame, sentiment: DataFrame, a: str = "wontfix", b: str = "comparison") -> DataFrame:
    """A row per emotion: issues, share, repositories, mean share over the repositories that have it, and mean confidence in both sets, with a's less b's.

    A set without the emotion has no share by repository (null). Rows are counted by repository, set and emotion first; the rest works on those counts.
    """
    s = sentiment.filter(F.col("analysis_set").isin(a, b)).select("repo", "issue", "analysis_set")
    m = s.join(emotions.filter("emotion is not null").select("repo", "issue", "emotion", F.col("confidence").try_cast("double").alias("conf")), ["repo", "issue"])
    c = m.groupBy("repo", "analysis_set", "emotion").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("conf"), F.count("conf").alias("n_conf"))
    t = c.groupBy("repo", "analysis_set").agg(F.sum("n").alias("of"))
    rows = c.join(t, ["repo", "analysis_set"]).withColumn("share", F.col("n") / F.col("of"))
    at = lambda k, x: F.when(F.col("analysis_set") == k, F.col(x))
    g = rows.groupBy("emotion").agg(*(x for k in (a, b) for x in (F.coalesce(F.sum(at(k, "n")), F.lit(0)).alias(f"{k}_issues"), F.count(at(k, "repo")).alias(f"{k}_repos"), F.avg(at(k, "share")).alias(f"{k}_avg_repo_share"), (F.sum(at(k, "conf")) / F.sum(at(k, "n_conf"))).alias(f"{k}_avg_confidence"))))
    total = c.agg(*(F.sum(at(k, "n")).alias(f"_{k}") for k in (a, b)))
    out = g.join(F.broadcast(total))  # one row of totals
    for k in (a, b):
        out = out.withColumn(f"{k}_share", F.coalesce(safe_divide(F.col(f"{k}_issues"), F.col(f"_{k}")), F.lit(0.0)))
    return out.drop(f"_{a}", f"_{b}").withColumn("share_diff", F.col(f"{a}_share") - F.col(f"{b}_share")).withColumn("avg_repo_share_diff", F.col(f"{a}_avg_repo_share") - F.col(f"{b}_avg_repo_share"))


def timed_evidence(evidence: DataFrame, issues: DataFrame) -> DataFrame:
    """evidence (repo, issue, ts, ...) with created, days after the issue's creation and bucket: pre_issue (its moment included), post_issue, unknown."""
    known = issues.groupBy("repo", "issue").agg(F.min("created").alias("created"))
    days = (F.unix_micros(F.col("ts")) - F.unix_micros(F.col("created"))) / 86_400_000_000
    return evidence.join(known, ["repo", "issue"], "left").withColumn("days", days).withColumn("bucket", F.when(F.col("days") <= 0, "pre_issue").when(F.col("days") > 0, "post_issue").otherwise("unknown"))


def timing_by_type(timed: DataFrame) -> DataFrame:
    return timed.groupBy("selected", "bucket", "evidence_type").agg(F.count(F.lit(1)).alias("row_count"))


def timing_by_issue(timed: DataFrame) -> DataFrame:
    """Per issue: selected rows, rows before and after, and the least, median and greatest distance in days."""
    n = lambda k: F.sum((F.col("bucket") == k).cast("long"))
    g = timed.groupBy("repo", "issue").agg(F.sum("selected").alias("selected_rows"), n("pre_issue").alias("pre_issue_rows"), n("post_issue").alias("post_issue_rows"), F.min("days").alias("min_days"), F.max("days").alias("max_days"))
    m = grouped_medians(timed, ["repo", "issue"], "days").select(F.col("repo").alias("_r"), F.col("issue").alias("_i"), F.col("median").alias("median_days"))
    return g.join(m, F.col("repo").eqNullSafe(F.col("_r")) & F.col("issue").eqNullSafe(F.col("_i")), "left").drop("_r", "_i")


def findings(tests: DataFrame, n: int = 5) -> DataFrame:
    """The n first tests (feature, difference, hedges_g, p, p_adj, reject): rejected ones first, then by p_adj and p, then by name, each with a sentence."""
    word = F.when(F.coalesce("difference", F.lit(0.0)) > 0, "higher").otherwise("lower")
    shown = lambda c, digits: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise("NA")
    text = F.concat(F.col("feature"), F.lit(" was "), word, F.lit(" in cases than in comparison issues (difference "), shown("difference", 4), F.lit(", g "), shown("hedges_g", 4), F.lit(")"))
    top = tests.orderBy(F.col("reject").desc_nulls_last(), F.col("p_adj").asc_nulls_last(), F.col("p").asc_nulls_last(), "feature").limit(n)
    return top.select("feature", "p_adj", text.alias("finding"))
