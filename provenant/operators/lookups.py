"""Lookups that several stages share: commits of two tables, pairs with numbers, links, texts of issues, identity candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import clean_text, has_real_value


def _first_known(c: Column) -> Column:
    """The least known value of the lowest side."""
    return F.min(F.when(c.isNotNull(), F.struct(F.col("side"), c.alias("v"))))["v"]


def merged_commits(commits: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per sha of either table (sha, repo, ts, email, name, login; resolved also contributor).

    A field takes its first known value, commits before resolved and ties by the least; blank text is unknown, rows without a sha go.
    Both tables meet in one aggregate with partial sums, so a sha that repeats is combined before the shuffle.
    """
    fields = ["repo", "ts", "email", "name", "login"]
    a = commits.select("sha", *fields, F.lit(None).cast("string").alias("contributor"), F.lit(0).alias("side"))
    b = resolved.select("sha", *fields, F.col("contributor").cast("string").alias("contributor"), F.lit(1).alias("side"))
    text = lambda c: clean_text(c) if c in ("email", "name", "login", "contributor") else F.col(c)
    rows = a.union(b).withColumn("sha", clean_text(F.col("sha").cast("string"))).filter("sha is not null")
    return rows.groupBy("sha").agg(*(_first_known(text(c)).alias(c) for c in (*fields, "contributor")))


def pair_numbers(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """Distinct pairs (repo, wontfix_issue_id, comparison_issue_id) with the numbers of both issues, null where an id is unknown; issues has issue_id and issue_number."""
    known = issues.select("issue_id", "issue_number").distinct()
    out = pairs.select("repo", "wontfix_issue_id", "comparison_issue_id").distinct()
    for side in ("wontfix", "comparison"):
        out = out.join(known.toDF(f"{side}_issue_id", f"{side}_issue_number"), f"{side}_issue_id", "left")
    return out.select("repo", "wontfix_issue_id", "wontfix_issue_number", "comparison_issue_id", "comparison_issue_number").distinct()


def flag_linked(issues: DataFrame, links: DataFrame) -> DataFrame:
    """issues with has_linked_pr (0 or 1), by (repo, issue_number) if links has numbers, else by (repo, issue_id); a flag that issues had is replaced."""
    key = "issue_number" if "issue_number" in links.columns else "issue_id"
    known = links.filter(F.col(key).isNotNull()).select("repo", key).distinct().withColumn("_linked", F.lit(1))
    return issues.drop("has_linked_pr").join(known, ["repo", key], "left").withColumn("has_linked_pr", F.coalesce("_linked", F.lit(0))).drop("_linked")


def issue_texts(issues: DataFrame, comments: DataFrame, with_comments: bool = True) -> DataFrame:
    """(issue, source, place, text) of titles, bodies and comments in this order (place 0, 1, 2 + seq); blank texts go."""
    own = issues.select("issue", F.inline(F.array(*(F.struct(F.lit(s).alias("source"), F.lit(i).cast("long").alias("place"), F.col(s).alias("text")) for i, s in enumerate(("title", "body"))))))
    said = comments.select("issue", F.lit("comment").alias("source"), (F.col("seq") + 2).cast("long").alias("place"), F.col("body").alias("text"))
    rows = own.union(said) if with_comments else own
    return rows.withColumn("text", clean_text("text")).filter("text is not null")


def identity_candidates(issues: DataFrame, comments: DataFrame, pulls: DataFrame, commits: DataFrame) -> DataFrame:
    """Distinct (repo, source_type, login, name, email) of everyone who wrote or closed an issue, commented, opened a pull request or committed."""
    none = F.lit(None).cast("string")
    actor = lambda df, kind, c: df.select("repo", F.lit(kind).alias("source_type"), F.col(c).alias("login"), none.alias("name"), none.alias("email"))
    parts = [actor(issues, "issue_author", "author_login"), actor(issues, "issue_closer", "closed_by_login"), actor(comments, "issue_comment", "author_login"), actor(pulls, "pr_author", "author_login")]
    parts.append(commits.select("repo", F.lit("commit_author").alias("source_type"), none.alias("login"), F.col("author_name").alias("name"), F.col("author_email").alias("email")))
    blank = reduce(lambda a, b: a & b, ((F.coalesce(F.col(c), F.lit("")) == "") for c in ("login", "name", "email")))
    return reduce(DataFrame.union, parts).filter(~blank).distinct()


def commit_emails(commits: DataFrame) -> DataFrame:
    """sha and email (trimmed, lower case): that of the latest row of a sha, ties by the greatest address; unknown addresses go."""
    e = F.lower(F.trim("email"))
    known = commits.select("sha", F.when(has_real_value("email"), e).alias("email"), "ts").filter("sha is not null and email is not null")
    return known.groupBy("sha").agg(F.max(F.struct("ts", "email"))["email"].alias("email"))


def rows_with_actor(df: DataFrame, actors: list[str]) -> DataFrame:
    """One row: n_rows and n_with_actor, the rows in which any of the actor columns is known."""
    any_ = reduce(lambda a, b: a | b, (has_real_value(c) for c in actors))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(any_.cast("int")), F.lit(0)).alias("n_with_actor"))
