"""Queries on groups of issues: their names, denominators and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import discussion as d
from provenant.operators import groups as gr
from provenant.operators import statistics as st
from provenant.plans import tails
from provenant.plans.discussion import _ISSUE, scored
from provenant.plans.registry import load, query, rounded
from provenant.plans.reports import base

_B = "b AS (SELECT d.doc_id, d.lang AS repo, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'wontfix' WHEN o_orderkey % 5 = 1 THEN 'comparison' WHEN o_orderkey % 5 = 2 THEN 'missing' ELSE lower(replace(replace(o_orderpriority, '-', '_'), ' ', '_')) END AS analysis_set,
  CASE WHEN o_orderkey % 5 = 0 THEN 'wontfix' WHEN o_orderstatus = 'O' THEN 'pr_resolved' WHEN o_orderstatus = 'F' THEN 'closed_non_wontfix' ELSE 'comparison' END AS comparison_group FROM orders""")
def group_names(spark, sf):
    k, s = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    name = F.when(k == 0, "Won't-Fix").when(k == 1, " Controls ").when(k == 2, " ").otherwise(F.col("o_orderpriority"))
    bucket = F.when(s == "O", "Resolved-PR").when(s == "F", "closed")
    return load(spark, sf, "orders").select("o_orderkey", gr.analysis_set(name).alias("analysis_set"), gr.comparison_group(bucket, name).alias("comparison_group"))


@query("""WITH p AS (SELECT c_nationkey AS analysis_set, o_totalprice AS v, (o_orderkey % 3 = 0)::INT AS flag, o_orderkey % 4 AS n_c, o_orderkey % 2 AS fileable FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT analysis_set, 'v' AS feature, count(*) AS n, count(v) AS valid_n, NULL::BIGINT AS positive_count, NULL::DOUBLE AS rate, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std FROM p WHERE n_c > 0 GROUP BY analysis_set
  UNION ALL SELECT analysis_set, 'flag', count(*), count(flag), sum(flag)::BIGINT, round(avg(flag), 6), round(avg(flag), 6), NULL, NULL FROM p WHERE fileable > 0 AND n_c > 0 GROUP BY analysis_set""")
def feature_summary_by_group(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    k = F.col("o_orderkey")
    p = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("analysis_set"), F.col("o_totalprice").alias("v"), (k % 3 == 0).cast("int").alias("flag"), (k % 4).alias("commenter_count_with_resolved_key"), (k % 2).alias("participant_role_file_features_applicable"))
    number = gr.feature_summary(p, "v", "analysis_set", gr.denominator(p, "issues_with_resolved_commenters"), False)
    return rounded(number.union(gr.feature_summary(p, "flag", "analysis_set", gr.denominator(p, "file_applicable_issues_with_resolved_commenters"), True)))


@query(f"""WITH {_B} SELECT source, count(*) AS n, count(*) - count(toxic) AS missing_count, coalesce(sum((toxic = 0)::INT), 0)::BIGINT AS zero_count, CASE WHEN count(toxic) = 0 THEN 'all_missing' WHEN sum((toxic = 0)::INT) = count(*) THEN 'all_zero'
  WHEN sum((toxic = 0)::INT) = count(toxic) THEN 'zero_and_missing' ELSE 'contains_nonzero_values' END AS pattern FROM b GROUP BY source""")
def zero_value_patterns(spark, sf):
    return gr.zero_pattern(base(spark, sf), "toxic", "source")


@query("SELECT event_id, (count(*) OVER (PARTITION BY user_id, event_type, ts::DATE) > 1)::INT AS duplicate_key FROM events")
def duplicate_markers(spark, sf):
    e = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return gr.mark_duplicates(e, ["user_id", "event_type", "day"]).select("event_id", "duplicate_key")


@query(f"""WITH f AS ({_ISSUE}), g AS (SELECT (issue % 2)::INT AS part, count(*) AS n_pairs, avg(late_mean_comment_sentiment - early_mean_comment_sentiment) AS m, stddev_samp(late_mean_comment_sentiment - early_mean_comment_sentiment) AS sd FROM f GROUP BY part)
  SELECT part, n_pairs, round(m, 4) AS mean_difference, round(sd, 4) AS sd_difference, round(m / (sd / sqrt(n_pairs)), 3) AS paired_t, n_pairs - 1 AS df, round({tails.t_tail('(m / (sd / sqrt(n_pairs)))', 'n_pairs - 1')}, 6) AS paired_p FROM g""")
def early_late_within_group(spark, sf):
    """The pairs are those of the table of issues, whose means have six digits."""
    i = rounded(d.issue_sentiment(scored(spark, sf))).withColumn("part", (F.col("issue") % 2).cast("int"))
    g = gr.early_late(i, "early_mean_comment_sentiment", "late_mean_comment_sentiment", "part")
    return g.select("part", "n_pairs", F.round("mean_difference", 4).alias("mean_difference"), F.round("sd_difference", 4).alias("sd_difference"), F.round("paired_t", 3).alias("paired_t"), "df", F.round("paired_p", 6).alias("paired_p"))


@query(f"""WITH g AS (SELECT o_orderpriority, count(*) AS k, avg(o_totalprice) AS m, var_pop(o_totalprice) AS s FROM orders GROUP BY o_orderpriority), t AS (SELECT count(*) AS n_groups, sum(k)::BIGINT AS n, sum(k * m) / sum(k) AS gm, sum(k * s) AS w FROM g)
  SELECT n_groups, n, round(f, 5) AS f_statistic, df_between, df_within, round({tails.f_tail('f', 'df_between', 'df_within')}, 6) AS f_p FROM (SELECT any_value(n_groups) AS n_groups, any_value(n) AS n, (sum(k * (m - gm) * (m - gm)) / (any_value(n_groups) - 1)) / (any_value(w) / (any_value(n) - any_value(n_groups))) AS f, any_value(n_groups) - 1 AS df_between, any_value(n) - any_value(n_groups) AS df_within FROM g, t)""")
def anova_by_priority(spark, sf):
    return gr.anova(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice").withColumn("f_statistic", F.round("f_statistic", 5)).withColumn("f_p", F.round("f_p", 6))


@query(f"""WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS s FROM orders GROUP BY o_orderpriority HAVING count(*) > 1),
  p AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, a.m AS mean_a, b.m AS mean_b, a.m - b.m AS d, a.s / a.n AS ea, b.s / b.n AS eb, sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)) AS pooled FROM g a JOIN g b ON a.g < b.g),
  w AS (SELECT *, d / sqrt(ea + eb) AS t, (ea + eb) * (ea + eb) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1)) AS df FROM p), q AS (SELECT *, {tails.t_tail('t', 'df')} AS p FROM w),
  r AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS adj FROM q)
  SELECT group_a, group_b, n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(d, 4) AS difference, round(d / pooled, 6) AS cohen_d, round(d / pooled * (1 - 3 / (4 * (n_a + n_b) - 9)), 6) AS hedges_g, round(t, 5) AS welch_t, round(df, 3) AS welch_df, round(p, 6) AS welch_p,
    round(least(1.0, min(adj) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r""")
def pairwise_by_priority(spark, sf):
    out = st.pairwise_welch(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    places = {"mean_a": 4, "mean_b": 4, "difference": 4, "welch_t": 5, "welch_df": 3}
    return rounded(out.withColumns({c: F.round(c, n) for c, n in places.items()}))
