"""Code ownership: contributor profiles, history before an issue, evidence, concentration, continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.functions.numbers import safe_divide


def repo_profiles(joined: DataFrame, *, rank_at: int = 5, share_at: float = 0.05) -> DataFrame:
    """Per (repo, contributor) of rows (repo, sha, contributor, ts, file, churn): activity, shares, dense rank, dominant flag."""
    keys = ["repo", "contributor"]
    per_commit = joined.groupBy(*keys, "sha").agg(F.countDistinct("file").alias("files"), F.min("ts").alias("ts"), F.count(F.lit(1)).alias("touches"), F.sum("churn").alias("churn"))
    act = per_commit.groupBy(*keys).agg(F.count(F.lit(1)).alias("commit_count_total"), F.min("ts").alias("first_commit_timestamp"), F.max("ts").alias("last_commit_timestamp"), F.countDistinct(F.to_date("ts")).alias("commit_days_active"), F.median("files").alias("median_files_per_commit"), F.sum("touches").alias("file_touch_events_total"), F.sum("churn").alias("churn_total"))
    distinct_files = joined.groupBy(*keys).agg(F.countDistinct("file").alias("distinct_files_touched_total"))
    repo = Window.partitionBy("repo")
    out = act.join(distinct_files, keys)
    out = out.withColumn("share_of_repo_commits", F.col("commit_count_total") / F.sum("commit_count_total").over(repo)).withColumn("share_of_repo_file_touches", F.col("file_touch_events_total") / F.sum("file_touch_events_total").over(repo)).withColumn("repo_contributor_rank", F.dense_rank().over(repo.orderBy(F.desc("commit_count_total"))))
    return out.withColumn("dominant_flag", ((F.col("repo_contributor_rank") <= rank_at) | (F.col("share_of_repo_commits") >= share_at)).cast("int"))


def file_profiles(joined: DataFrame, *, rank_at: int = 3, share_at: float = 0.10) -> DataFrame:
    """Per (repo, file, contributor): commits, days, share, dense rank, major flag."""
    keys = ["repo", "file", "contributor"]
    per = joined.filter("file is not null").groupBy(*keys).agg(F.countDistinct("sha").alias("commit_count_on_file"), F.countDistinct(F.to_date("ts")).alias("distinct_commit_days_on_file"), F.min("ts").alias("first_commit_on_file"), F.max("ts").alias("last_commit_on_file"))
    w = Window.partitionBy("repo", "file")
    out = per.withColumn("share_of_file_commits", F.col("commit_count_on_file") / F.sum("commit_count_on_file").over(w)).withColumn("file_owner_rank", F.dense_rank().over(w.orderBy(F.desc("commit_count_on_file"))))
    return out.withColumn("major_flag", ((F.col("file_owner_rank") <= rank_at) | (F.col("share_of_file_commits") >= share_at)).cast("int"))


def evidence_counts(issues: DataFrame, evidence: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """issue, keys, kind, bucket, n_rows, n_days, churn of the evidence (keys, kind, ts, churn) before (up to the issue's time) and after each issue.

    Evidence is summed by day first. An issue meets the sums of other days, and single rows of its own day alone, so that its
    cost is that of days and not of all evidence of a key.
    """
    day = F.to_date("ts")
    daily = evidence.groupBy(*keys, kind, day.alias("day")).agg(F.count(F.lit(1)).alias("k"), F.sum("churn").alias("c"))
    own = issues.select("issue", *keys, "created", F.to_date("created").alias("own_day"))
    others = own.join(daily, keys).filter("day <> own_day").select("issue", *keys, kind, F.when(F.col("day") < F.col("own_day"), "pre_issue").otherwise("post_issue").alias("bucket"), "day", "k", "c")
    same = own.join(evidence.withColumn("own_day", day), [*keys, "own_day"]).select("issue", *keys, kind, F.when(F.col("ts") <= F.col("created"), "pre_issue").otherwise("post_issue").alias("bucket"), F.col("own_day").alias("day"), F.lit(1).cast("long").alias("k"), F.col("churn").alias("c"))
    return others.union(same).groupBy("issue", *keys, kind, "bucket").agg(F.sum("k").alias("n_rows"), F.collect_set("day").alias("days"), F.sum("c").alias("churn"))


def ownership_policy(exact: Column, merge: Column, head: Column) -> Column:
    """Which evidence a repository's issues rest on, by the rates of pull request, merge and head commits that are known."""
    return F.when((exact >= 0.80) & (merge >= 0.50), "exact_plus_merge").when((merge >= 0.50) & (head >= 0.50), "merge_plus_head").when(merge >= 0.50, "merge_first").when(exact >= 0.50, "exact_first").otherwise("fallback_heavy")


def concentration(evidence: DataFrame, issue: str, contributor: str, churn: str, sha: str) -> DataFrame:
    """Per issue: owners, top shares of churn and commits, entropies of both."""
    per = evidence.groupBy(issue, contributor).agg(F.sum(churn).alias("churn"), F.countDistinct(sha).alias("commits"))
    w = Window.partitionBy(issue)
    per = per.withColumn("pc", safe_divide(F.col("churn"), F.sum("churn").over(w), 0.0)).withColumn("pk", F.col("commits") / F.sum("commits").over(w))
    entropy = lambda p: -F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(p)))
    return per.groupBy(issue).agg(F.count(F.lit(1)).alias("owner_count"), F.max("pc").alias("top_churn_share"), F.max("pk").alias("top_commit_share"), entropy("pc").alias("churn_entropy"), entropy("pk").alias("commit_entropy"))


def continuity(rows: DataFrame, issue: str, contributor: str, bucket: str) -> DataFrame:
    """Per issue: contributors before and after, in common, and their Jaccard similarity (null without any)."""
    seen = lambda when: F.max((F.col(bucket) == when).cast("int"))
    # one row for each person of an issue, so that no set of people is gathered
    per = rows.groupBy(issue, contributor).agg(seen("pre_issue").alias("pre"), seen("post_issue").alias("post"))
    known = F.col(contributor).isNotNull()
    n = lambda c: F.sum(F.when(known & c, 1).otherwise(0)).cast("int")
    g = per.groupBy(issue).agg(n(F.col("pre") == 1).alias("pre_owner_count"), n(F.col("post") == 1).alias("post_owner_count"), n((F.col("pre") == 1) & (F.col("post") == 1)).alias("shared_owner_count"), n((F.col("pre") == 1) | (F.col("post") == 1)).alias("either"))
    return g.select(issue, "pre_owner_count", "post_owner_count", "shared_owner_count", safe_divide(F.col("shared_owner_count"), F.col("either")).alias("owner_jaccard"), (F.col("shared_owner_count") > 0).cast("int").alias("any_shared_owner_flag"))


def conservative_support(evidence: DataFrame, issue: str, contributor: str, *, commits_at: int = 2, days_at: int = 1) -> DataFrame:
    """(issue, contributor) with enough distinct commits and days among the evidence before the issue."""
    out = evidence.filter("bucket = 'pre_issue'").groupBy(issue, contributor).agg(F.countDistinct("sha").alias("commits"), F.countDistinct(F.to_date("ts")).alias("days"))
    return out.filter((F.col("commits") >= commits_at) & (F.col("days") >= days_at))
