"""Issue discussions: comment features, issue sentiment and participation features, trajectories.

Comments are rows with issue, seq (1-based, in order of time and id), author and body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.functions import text as tx
from provenant.functions.numbers import polarity_label, safe_divide


def numbered(comments: DataFrame, issue: str, *order: Column) -> DataFrame:
    """comments with seq by the given order, ties by what the caller adds."""
    return comments.withColumn("seq", F.row_number().over(Window.partitionBy(issue).orderBy(*order)))


def comment_features(comments: DataFrame, **lexicon) -> DataFrame:
    """issue, seq, author, text features, polarity and its label flags."""
    scored = comments.select("issue", "seq", "author", *(c.alias(n) for n, c in tx.text_features("body").items()), tx.polarity("body", **lexicon).alias("p"))
    scored = scored.select("issue", "seq", "author", *tx.text_features("body"), *(F.col(f"p.{k}").alias(f"sentiment_{k}") for k in ("neg", "neu", "pos", "compound")))
    label = polarity_label(F.col("sentiment_compound"))
    return scored.select("*", *((label == k).cast("int").alias(f"is_{k}_comment") for k in ("positive", "negative", "neutral")))


def issue_sentiment(scored: DataFrame) -> DataFrame:
    """Per issue: counts, shares, moments, early and late means (split after floor(n/2) texts, at least one), slope, concentration."""
    has = F.col("has_text") == 1
    texts = scored.withColumn("k", F.when(has, F.row_number().over(Window.partitionBy("issue", "has_text").orderBy("seq")))).withColumn("n_text", F.sum("has_text").over(Window.partitionBy("issue")))
    cut = F.greatest(F.lit(1), F.floor(F.col("n_text") / 2))
    value = F.when(has, F.col("sentiment_compound"))
    early = F.when(has & (F.col("k") <= cut), F.col("sentiment_compound"))
    late = F.when(has & ((F.col("k") > cut) | (F.col("n_text") == 1)), F.col("sentiment_compound"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    main = texts.groupBy("issue").agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.sum("has_text").alias("comments_with_text_count"),
        *(F.sum(f"is_{k}_comment").alias(f"{k}_comment_count") for k in ("positive", "negative", "neutral")),
        zero(F.avg(value)).alias("mean_comment_sentiment"),
        zero(F.median(value)).alias("median_comment_sentiment"),
        zero(F.min(value)).alias("min_comment_sentiment"),
        zero(F.max(value)).alias("max_comment_sentiment"),
        zero(F.stddev_samp(value)).alias("std_comment_sentiment"),
        zero(F.avg(early)).alias("early_mean_comment_sentiment"),
        zero(F.avg(late)).alias("late_mean_comment_sentiment"),
        zero(F.regr_slope(value, F.col("k") - 1)).alias("comment_sentiment_slope"),
        F.sum(F.when(has, F.col("text_length_chars")).otherwise(0)).alias("total_comment_text_chars"),
        F.sum("question_mark_count").alias("total_question_mark_count"),
    )
    per = scored.filter(F.col("author").isNotNull()).groupBy("issue", "author").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("issue").agg(F.count(F.lit(1)).alias("unique_commenter_count"), F.max("k").alias("top"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    n = F.col("comment_count")
    out = main.join(per, "issue", "left")
    return out.select(
        *main.columns,
        *(safe_divide(F.col(f"{k}_comment_count"), n, 0.0).alias(f"{k}_comment_share") for k in ("positive", "negative", "neutral")),
        (F.col("late_mean_comment_sentiment") - F.col("early_mean_comment_sentiment")).alias("comment_sentiment_change_late_minus_early"),
        F.coalesce("unique_commenter_count", F.lit(0)).alias("unique_commenter_count"),
        (F.coalesce("top", F.lit(0)) / n).alias("top_commenter_share"),
        (F.coalesce("squares", F.lit(0)) / (n * n)).alias("comment_concentration_ratio"),
    )


def issue_participation(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Per issue (issue, issue_author): commenters, top shares, author flags, first and last resolved commenter, coverage flag."""
    totals = comments.groupBy("issue").agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.count("author").alias("resolved_comment_count"),
        F.min_by("author", F.when(F.col("author").isNotNull(), F.col("seq"))).alias("first_author"),
        F.max_by("author", F.when(F.col("author").isNotNull(), F.col("seq"))).alias("last_author"),
    )
    per = comments.filter(F.col("author").isNotNull()).groupBy("issue", "author").agg(F.count(F.lit(1)).alias("k"))
    per = per.join(issues.select("issue", "issue_author"), "issue")
    own = F.coalesce(F.col("author") == F.col("issue_author"), F.lit(False))
    ranked = per.groupBy("issue").agg(
        F.count(F.lit(1)).alias("unique_commenter_count"),
        F.slice(F.sort_array(F.collect_list("k"), asc=False), 1, 2).alias("top"),
        F.sum((F.col("k") > 1).cast("int")).alias("repeat_commenter_count"),
        F.max(own.cast("int")).alias("own"),
        F.sum(F.when(own, 0).otherwise(F.col("k"))).alias("others"),
        F.sum((~own).cast("int")).alias("n_others"),
    )
    j = issues.join(totals, "issue", "left").join(ranked, "issue", "left")
    n, r = F.coalesce("comment_count", F.lit(0)), F.coalesce("resolved_comment_count", F.lit(0))
    some, known = r > 0, F.col("issue_author").isNotNull()
    return j.select(
        "issue",
        n.alias("comment_count"),
        r.alias("resolved_comment_count"),
        (n - r).alias("missing_resolved_comment_count"),
        F.coalesce("unique_commenter_count", F.lit(0)).alias("unique_commenter_count"),
        safe_divide(F.col("top")[0], r).alias("top_commenter_share"),
        safe_divide(F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x), r).alias("top_2_commenters_share"),
        F.coalesce("repeat_commenter_count", F.lit(0)).alias("repeat_commenter_count"),
        safe_divide(r, F.col("unique_commenter_count")).alias("mean_comments_per_commenter"),
        F.when(some & known, F.col("own")).alias("issue_author_commented_flag"),
        F.coalesce("n_others", F.lit(0)).alias("num_distinct_non_author_commenters"),
        safe_divide(F.col("others"), F.when(some, r)).alias("non_author_comment_share"),
        F.when(some & known, ((F.col("own") == 1) & (F.col("n_others") == 0)).cast("int")).alias("only_author_commented_flag"),
        F.when(some, (F.col("unique_commenter_count") == 1).cast("int")).alias("single_commenter_flag"),
        F.when(some & known, (F.col("first_author") == F.col("issue_author")).cast("int")).alias("first_comment_by_author_flag"),
        F.when(some & known, (F.col("last_author") == F.col("issue_author")).cast("int")).alias("last_comment_by_author_flag"),
        F.when(n == 0, "zero_comments").when(r == 0, "no_resolved_comment_authors").when(~known, "missing_issue_author_key").otherwise("ok").alias("participation_coverage_flag"),
    )


def top_commenter(comments: DataFrame) -> DataFrame:
    """Per issue the commenter with most comments; ties: earliest first comment, then key."""
    per = comments.filter(F.col("author").isNotNull()).groupBy("issue", "author").agg(F.count(F.lit(1)).alias("k"), F.min("seq").alias("first_seq"))
    best = Window.partitionBy("issue").orderBy(F.desc("k"), "first_seq", "author")
    return per.withColumn("rk", F.row_number().over(best)).filter("rk = 1").select("issue", F.col("author").alias("top_commenter_key"), F.col("k").alias("top_commenter_count"))


def trajectory(scored: DataFrame, bins: int = 5, min_comments: int = 2) -> DataFrame:
    """Mean, count and 1.96 standard errors of sentiment by normalized position in the discussion."""
    n = F.count(F.lit(1)).over(Window.partitionBy("issue"))
    at = scored.withColumn("n", n).filter(F.col("n") >= min_comments)
    pos = F.least(F.floor((F.col("seq") - 1) / (F.col("n") - 1) * bins) + 1, F.lit(bins))
    out = at.groupBy(pos.cast("int").alias("position_bin")).agg(F.avg("sentiment_compound").alias("mean_sentiment"), F.count(F.lit(1)).alias("n_comments"), F.coalesce(F.stddev_samp("sentiment_compound"), F.lit(0.0)).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n_comments")
    return out.select("position_bin", "mean_sentiment", "n_comments", (F.col("mean_sentiment") - half).alias("ci_low"), (F.col("mean_sentiment") + half).alias("ci_high"))
