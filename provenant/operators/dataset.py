"""The analysis dataset: its population, families joined by two keys, flags, readiness, owners among commenters, short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as tx
from provenant.functions.numbers import confidence_rank, safe_divide
from provenant.operators.tables import quantiles

#: Coverage flags that mean that an issue has no ownership features.
HARD_MISSING = ("no_file_links", "no_commit_matches", "no_resolved_commit_authors", "missing_issue_created_at")
#: Kinds of evidence, the dominant one first.
DOMINANCE = {"merge": "pr_merge", "exact": "pr_exact_commit", "head": "pr_head", "fallback": "file_fallback"}


def population(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Issues (repo, issue_id, issue_number) of both sets, each once, with analysis_set: wontfix where a case is a control as well."""
    both = cases.withColumn("case", F.lit(1)).unionByName(controls.withColumn("case", F.lit(0)))
    g = both.groupBy("repo", "issue_id", "issue_number").agg(F.max("case").alias("case"))
    return g.select("repo", "issue_id", "issue_number", F.when(F.col("case") == 1, "wontfix").otherwise("comparison").alias("analysis_set"))


def merge_by_id_or_number(base: DataFrame, more: DataFrame) -> DataFrame:
    """base (repo, issue_id, issue_number, ...) with more's columns by issue_id, and where that gives null by issue_number.

    Columns that base has stay base's. more has a key at most once; null keys meet nothing.
    """
    keys = ("repo", "issue_id", "issue_number")
    new = [c for c in more.columns if c not in keys and c not in base.columns]

    def side(key: str, p: str) -> DataFrame:
        return more.filter(F.col(key).isNotNull()).select(F.col("repo").alias(f"{p}repo"), F.col(key).alias(f"{p}key"), *(F.col(c).alias(f"{p}{c}") for c in new))

    i, n = side("issue_id", "_i_"), side("issue_number", "_n_")
    out = base.join(i, (base["repo"] == i["_i_repo"]) & (base["issue_id"] == i["_i_key"]), "left")
    out = out.join(n, (out["repo"] == n["_n_repo"]) & (out["issue_number"] == n["_n_key"]), "left")
    return out.select(*base.columns, *(F.coalesce(f"_i_{c}", f"_n_{c}").alias(c) for c in new))


def attach_set(issues: DataFrame, members: DataFrame) -> DataFrame:
    """The issues of a population with their analysis_set, by id or else by number; others go."""
    return merge_by_id_or_number(issues, members).filter("analysis_set is not null")


def with_total(df: DataFrame, label: str, **counts: Column) -> DataFrame:
    """Counts by label and a row all over every label."""
    g = df.rollup(label).agg(F.grouping(label).alias("_g"), *(c.alias(n) for n, c in counts.items()))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(label)).alias(label), *counts)


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def family_flags(df: DataFrame, *, sparse_counts: bool = True) -> DataFrame:
    """df with has_* for each family of features and usable_for_* for each question; a column that it lacks counts as 0 or null.

    Reads has_sentiment, has_participation, has_ownership (0 or 1), ownership_coverage_flag, issue_author_has_resolved_key,
    commenter_count_with_resolved_key, participant_role_file_features_applicable and post_issue_owner_count_for_continuity.
    """
    flag = lambda c: c.cast("int")
    coverage = F.col("ownership_coverage_flag") if "ownership_coverage_flag" in df.columns else F.lit(None).cast("string")
    isin = lambda *names: F.coalesce(coverage.isin(*names), F.lit(False))
    direct = coverage.isNotNull() & ~isin(*HARD_MISSING) if "ownership_coverage_flag" in df.columns else _number(df, "has_ownership") > 0
    people = (_number(df, "issue_author_has_resolved_key") > 0) | (_number(df, "commenter_count_with_resolved_key") > 0)
    files, later = _number(df, "participant_role_file_features_applicable"), _number(df, "post_issue_owner_count_for_continuity") > 0
    talk, said = _number(df, "has_participation"), _number(df, "has_sentiment")
    usable = isin("ok", "sparse_evidence") if sparse_counts else isin("ok")
    return df.select(
        "*",
        flag(said).alias("has_sentiment_features"),
        flag(talk).alias("has_participation_features"),
        flag(direct).alias("has_direct_issue_linked_ownership_features"),
        flag(people).alias("has_repo_participant_role_features"),
        flag(files).alias("has_file_participant_role_features"),
        flag(later).alias("has_continuity_features"),
        flag((_number(df, "has_ownership") > 0) | people | (files > 0) | direct | later).alias("has_ownership_features"),
        flag(said.cast("int") == 1).alias("usable_for_rq1"),
        flag(people).alias("usable_for_rq2"),
        flag(files).alias("usable_for_rq2_file_participant_roles"),
        flag(usable).alias("usable_for_rq2_direct_ownership"),
        flag(isin("ok")).alias("usable_for_rq2_strict"),
        flag(later).alias("usable_for_rq2_continuity"),
        flag(talk.cast("int") == 1).alias("usable_for_rq3"),
    )


def question_views(df: DataFrame, *, filter_rq2: bool = False) -> dict[str, DataFrame]:
    """The rows that each question works on."""
    return {"rq1": df.filter("usable_for_rq1 = 1"), "rq2": df.filter("usable_for_rq2 = 1") if filter_rq2 else df, "rq3": df.filter("usable_for_rq3 = 1")}


def derived_sentiment(df: DataFrame, at: float = 0.05, digits: int = 6) -> DataFrame:
    """df with threshold flags, the range of sentiment, and a flag for deviations in the upper quarter (compared to so many digits)."""
    low, high, sd = F.col("min_comment_sentiment"), F.col("max_comment_sentiment"), F.col("std_comment_sentiment")
    cut = quantiles(df, "std_comment_sentiment", [0.75]).select(F.round(F.col("q")[0], digits).alias("_cut"))
    out = df.join(F.broadcast(cut))  # one row
    return out.select(
        *df.columns,
        (low < -at).cast("int").alias("has_strongly_negative_comment"),
        (high > at).cast("int").alias("has_strongly_positive_comment"),
        (F.col("comment_sentiment_change_late_minus_early") < 0).cast("int").alias("late_more_negative_than_early"),
        F.coalesce(F.round(sd, digits) >= F.col("_cut"), F.lit(False)).cast("int").alias("high_sentiment_volatility"),
        (high - low).alias("comment_sentiment_range"),
    )


def issue_file_summary(links: DataFrame, high: tuple[str, ...] = ("high", "very_high")) -> DataFrame:
    """Per (issue, path) of links (issue, path, source, confidence): sources, best confidence, and whether that is a high one."""
    c = tx.clean_text(F.col("confidence"))
    g = links.groupBy("issue", "path").agg(F.count(F.lit(1)).alias("link_rows"), F.array_sort(F.collect_set(tx.clean_text(F.col("source")))).alias("sources"), F.max(F.when(c.isNotNull(), F.struct(confidence_rank(c).alias("rank"), c.alias("name")))).alias("best"))
    best = F.col("best.name")
    return g.select("issue", "path", "link_rows", F.to_json("sources").alias("link_source"), best.alias("link_confidence"), F.coalesce(F.lower(best).isin(*high), F.lit(False)).cast("int").alias("is_high_confidence"))


def issue_link_counts(files: DataFrame) -> DataFrame:
    """Per issue of issue_file_summary: link rows, linked files, and those of high confidence."""
    return files.groupBy("issue").agg(F.sum("link_rows").alias("all_link_row_count"), F.count(F.lit(1)).alias("linked_file_count_all"), F.sum("is_high_confidence").alias("linked_file_count_high_confidence"))


def top_evidence_contributor(evidence: DataFrame) -> DataFrame:
    """Per issue the contributor with most distinct commits, then rows, then files, then the least key."""
    per = evidence.filter("contributor is not null").groupBy("issue", "contributor").agg(F.countDistinct("sha").alias("k"), F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("f"))
    return per.groupBy("issue").agg(F.min_by("contributor", F.struct(-F.col("k"), -F.col("n"), -F.col("f"), "contributor")).alias("top_contributor"))


def coverage_flags(issues: DataFrame, *, files_at: int, rows_at: int, contributors_at: int) -> DataFrame:
    """issues (created, linked_files, evidence_rows, resolved_rows, contributors, kinds) with coverage_flag and dominant_evidence_type."""
    ladder = F.when(F.col("created").isNull(), "missing_issue_created_at").when(F.col("linked_files") <= 0, "no_file_links").when(F.col("evidence_rows") <= 0, "no_commit_matches").when(F.col("contributors") <= 0, "no_resolved_commit_authors")
    few = (F.col("linked_files") < files_at) | (F.col("resolved_rows") < rows_at) | (F.col("contributors") < contributors_at)
    dominant = F.coalesce(*(F.when(F.array_contains("kinds", k), name) for k, name in DOMINANCE.items()))
    return issues.select("*", ladder.when(few, "sparse_evidence").otherwise("ok").alias("coverage_flag"), dominant.alias("dominant_evidence_type"))


def owner_commenter_overlap(evidence: DataFrame, comments: DataFrame) -> DataFrame:
    """Per (repo, issue): owners by six choices of the flagged evidence, how many of them comment (repo, issue, author), and that share.

    Owners are reduced to distinct contributors of an issue first; commenters join them as keys, so no list of an issue's people is made.
    """
    high, any_, careful = (F.col(c) == 1 for c in ("high", "chosen", "conservative"))
    pre, post = F.col("bucket") == "pre_issue", F.col("bucket") == "post_issue"
    kinds = {"high_all": high, "high_pre": high & pre, "any_all": any_, "any_pre": any_ & pre, "any_post": any_ & post, "conservative": any_ & careful}
    people = evidence.filter("contributor is not null").groupBy("repo", "issue", "contributor").agg(*(F.max(c.cast("int")).alias(n) for n, c in kinds.items()))
    talk = comments.filter("author is not null").select("repo", "issue", F.col("author").alias("contributor"), F.lit(1).alias("talks")).distinct()
    j = people.join(talk, ["repo", "issue", "contributor"], "left").withColumn("talks", F.coalesce("talks", F.lit(0)))
    g = j.groupBy("repo", "issue").agg(*(F.sum(n).alias(f"owners_{n}") for n in kinds), *(F.sum(F.col(n) * F.col("talks")).alias(f"overlap_{n}") for n in kinds))
    return g.select("*", *(safe_divide(F.col(f"overlap_{n}"), F.col(f"owners_{n}")).alias(f"fraction_{n}") for n in kinds))


def family_readiness(df: DataFrame, covered: str, leaks: str | None = None) -> DataFrame:
    """Per mode: coverage of a family in both sets, the repositories that hold it, and how far it can be used.

    df has mode, repo and analysis_set; covered is a positive number where the family is there; leaks, if named, must sum to 0.
    """
    here = (_number(df, covered) > 0).cast("int")
    leak = _number(df, leaks) if leaks else F.lit(0.0)
    per = df.groupBy("mode", "analysis_set", "repo").agg(F.count(F.lit(1)).alias("n"), F.sum(here).alias("k"), F.sum(leak).alias("leaks"))
    sets = per.groupBy("mode", "analysis_set").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum((F.col("k") > 0).cast("int")).alias("repos"), F.sum("leaks").alias("leaks"))
    of = lambda name, c: F.max(F.when(F.col("analysis_set") == name, c))
    rate = F.col("k") / F.col("n")
    g = sets.groupBy("mode").agg(*(e.alias(f"{p}_{s}") for p, name in (("case", "wontfix"), ("control", "comparison")) for s, e in (("rate", of(name, rate)), ("repos", of(name, F.col("repos"))))), F.sum("leaks").alias("leaks"))
    a, b = F.col("case_rate"), F.col("control_rate")
    at_least = lambda x: (a >= x) & (b >= x)
    status = F.when(a.isNull() | b.isNull() | (F.col("leaks") != 0), "not_ready").when(at_least(0.20) & (F.col("case_repos") >= 2) & (F.col("control_repos") >= 2), "analysis_ready").when(at_least(0.05), "secondary_or_stratified").when((a > 0) | (b > 0), "descriptive_only").otherwise("not_ready")
    return g.select("mode", "case_rate", "control_rate", "case_repos", "control_repos", status.alias("readiness_status"))


def extreme_issues(df: DataFrame, n: int, negative: bool) -> DataFrame:
    """The n issues of lowest (else highest) mean sentiment; ties: the larger share of such comments, then the issue."""
    mean, share = F.col("mean_comment_sentiment"), F.col("negative_comment_share" if negative else "positive_comment_share")
    return df.orderBy(mean.asc_nulls_last() if negative else mean.desc_nulls_last(), share.desc_nulls_last(), "issue").limit(n)


def count_screen(df: DataFrame, count: str, at_least: int, order: list[str], tie: str, limit: int | None = None) -> DataFrame:
    """Rows with at least so many, in descending order of columns; the first ones of them where a positive limit is named."""
    out = df.filter(F.col(count) >= at_least).orderBy(*(F.desc(c) for c in order), tie)
    return out.limit(limit) if limit is not None and limit > 0 else out


def canonical_value(c: Column) -> Column:
    """Aggregate: the shortest clean value, then the first in lower case, then the first."""
    v = tx.clean_text(c)
    return F.min_by(v, F.when(v.isNotNull(), F.struct(F.length(v), F.lower(v), v)))
