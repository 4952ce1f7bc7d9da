"""Queries on the analysis dataset's population and flags, on owners and commenters, and on short lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import dataset as ds
from provenant.operators import discussion as d
from provenant.operators import evidence as ev
from provenant.operators import statistics as st
from provenant.plans import tails
from provenant.plans.discussion import _ISSUE, scored
from provenant.plans.evidence import _ROWS, _rows
from provenant.plans.registry import load, query, rounded
from provenant.plans.reports import base

_ISSUES = "b AS (SELECT o_custkey % 25 AS repo, CASE WHEN o_orderkey % 7 > 0 THEN 'i' || o_orderkey END AS issue_id, o_orderkey AS issue_number, o_orderpriority FROM orders)"


def _issues(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("repo"), F.when(k % 7 > 0, F.concat(F.lit("i"), k)).alias("issue_id"), k.alias("issue_number"), "o_orderpriority")


@query(f"""WITH {_ISSUES}, m AS (SELECT o_custkey % 25 AS repo, CASE WHEN o_orderkey % 3 > 0 THEN 'i' || o_orderkey END AS issue_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS issue_number, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 11 END AS comments FROM orders)
  SELECT b.repo, b.issue_number, o_orderpriority, coalesce(i.comments, n.comments) AS comments FROM b LEFT JOIN m i ON b.repo = i.repo AND b.issue_id = i.issue_id LEFT JOIN m n ON b.repo = n.repo AND b.issue_number = n.issue_number""")
def features_by_id_or_number(spark, sf):
    k = F.col("o_orderkey")
    more = load(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("repo"), F.when(k % 3 > 0, F.concat(F.lit("i"), k)).alias("issue_id"), F.when(k % 5 > 0, k).alias("issue_number"), F.when(k % 11 > 0, k % 11).alias("comments"), F.lit("other").alias("o_orderpriority"))
    return ds.merge_by_id_or_number(_issues(spark, sf), more).select("repo", "issue_number", "o_orderpriority", "comments")


@query(f"""WITH {_ISSUES}, p AS (SELECT *, CASE WHEN issue_number % 10 = 0 THEN 'wontfix' ELSE 'comparison' END AS analysis_set FROM b WHERE issue_number % 10 = 0 OR issue_number % 4 = 0)
  SELECT coalesce(analysis_set, 'all') AS analysis_set, count(*) AS n_issues, count(DISTINCT repo) AS n_repos, count(issue_id) AS with_id FROM p GROUP BY ROLLUP (analysis_set)""")
def population_summary(spark, sf):
    b = _issues(spark, sf)
    keys = b.select("repo", "issue_id", "issue_number")
    members = ds.population(keys.filter("issue_number % 10 = 0"), keys.filter("issue_number % 4 = 0"))
    return ds.with_total(ds.attach_set(b, members), "analysis_set", n_issues=F.count(F.lit(1)), n_repos=F.countDistinct("repo"), with_id=F.count("issue_id"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'sparse_evidence' WHEN 2 THEN 'no_file_links' WHEN 3 THEN 'no_commit_matches' WHEN 4 THEN 'no_resolved_commit_authors' WHEN 5 THEN 'missing_issue_created_at' WHEN 6 THEN 'ok' END AS c,
    o_custkey % 5 = 0 OR o_custkey % 4 > 0 AS people, o_orderkey % 3 = 0 AS files, o_custkey % 6 > 0 AS later FROM orders),
  g AS (SELECT *, c IN ('ok', 'sparse_evidence') AND c IS NOT NULL AS direct FROM f)
  SELECT k AS o_orderkey, (k % 2)::INT AS has_sentiment_features, (k % 3 > 0)::INT AS has_participation_features, coalesce(direct, false)::INT AS has_direct_issue_linked_ownership_features, people::INT AS has_repo_participant_role_features, files::INT AS has_file_participant_role_features, later::INT AS has_continuity_features,
  (k % 4 = 0 OR people OR files OR coalesce(direct, false) OR later)::INT AS has_ownership_features, (k % 2)::INT AS usable_for_rq1, people::INT AS usable_for_rq2, files::INT AS usable_for_rq2_file_participant_roles, coalesce(direct, false)::INT AS usable_for_rq2_direct_ownership, coalesce(c = 'ok', false)::INT AS usable_for_rq2_strict,
  later::INT AS usable_for_rq2_continuity, (k % 3 > 0)::INT AS usable_for_rq3 FROM g""")
def family_flags(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(n) for n in ("ok", "sparse_evidence", "no_file_links", "no_commit_matches", "no_resolved_commit_authors", "missing_issue_created_at", "ok", None)])
    f = load(spark, sf, "orders").select("o_orderkey", (k % 2).alias("has_sentiment"), (k % 3 > 0).cast("int").alias("has_participation"), (k % 4 == 0).cast("int").alias("has_ownership"), names[(k % 8).cast("int")].alias("ownership_coverage_flag"), (c % 5 == 0).cast("int").alias("issue_author_has_resolved_key"), (c % 4).alias("commenter_count_with_resolved_key"), (k % 3 == 0).cast("int").alias("participant_role_file_features_applicable"), (c % 6).alias("post_issue_owner_count_for_continuity"))
    return ds.family_flags(f).drop(*f.columns[1:])


@query(f"""WITH f AS ({_ISSUE}), q AS (SELECT round(quantile_cont(std_comment_sentiment, 0.75), 6) AS cut FROM f) SELECT issue, (min_comment_sentiment < -0.05)::INT AS has_strongly_negative_comment, (max_comment_sentiment > 0.05)::INT AS has_strongly_positive_comment,
  (comment_sentiment_change_late_minus_early < 0)::INT AS late_more_negative_than_early, (std_comment_sentiment >= cut)::INT AS high_sentiment_volatility, round(max_comment_sentiment - min_comment_sentiment, 6) AS comment_sentiment_range FROM f, q""")
def derived_sentiment_flags(spark, sf):
    i = rounded(d.issue_sentiment(scored(spark, sf)))
    return rounded(ds.derived_sentiment(i).select("issue", "has_strongly_negative_comment", "has_strongly_positive_comment", "late_more_negative_than_early", "high_sentiment_volatility", "comment_sentiment_range"))


_LINKS = "k AS (SELECT l_orderkey AS issue, l_partkey % 3 AS path, CASE WHEN l_linenumber % 2 = 0 THEN 'pr_commit_chain' ELSE 'text' END AS source, CASE l_suppkey % 4 WHEN 1 THEN 'low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' END AS confidence FROM lineitem)"


def _file_links(spark, sf):
    s = F.col("l_suppkey") % 4
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("issue"), (F.col("l_partkey") % 3).alias("path"), F.when(F.col("l_linenumber") % 2 == 0, "pr_commit_chain").otherwise("text").alias("source"), F.when(s == 1, "low").when(s == 2, "Medium").when(s == 3, "High").alias("confidence"))


@query(f"""WITH {_LINKS} SELECT issue, path, count(*) AS link_rows, '[' || string_agg(DISTINCT '"' || source || '"', ',' ORDER BY '"' || source || '"') || ']' AS link_source, CASE WHEN bool_or(confidence = 'High') THEN 'High' WHEN bool_or(confidence = 'Medium') THEN 'Medium' WHEN bool_or(confidence = 'low') THEN 'low' END AS link_confidence,
  coalesce(bool_or(confidence = 'High'), false)::INT AS is_high_confidence FROM k GROUP BY issue, path""")
def issue_file_summary(spark, sf):
    return ds.issue_file_summary(_file_links(spark, sf))


@query(f"WITH {_LINKS} SELECT issue, count(*) AS all_link_row_count, count(DISTINCT path) AS linked_file_count_all, count(DISTINCT CASE WHEN confidence = 'High' THEN path END) AS linked_file_count_high_confidence FROM k GROUP BY issue")
def issue_link_counts(spark, sf):
    return ds.issue_link_counts(ds.issue_file_summary(_file_links(spark, sf)))


@query("""WITH p AS (SELECT l_partkey AS issue, l_suppkey % 5 AS c, count(DISTINCT l_orderkey) AS k, count(*) AS n, count(DISTINCT l_linenumber) AS f FROM lineitem GROUP BY ALL)
  SELECT issue, c AS top_contributor FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY k DESC, n DESC, f DESC, c) AS rn FROM p) WHERE rn = 1""")
def top_evidence_contributor(spark, sf):
    return ds.top_evidence_contributor(load(spark, sf, "lineitem").select(F.col("l_partkey").alias("issue"), (F.col("l_suppkey") % 5).alias("contributor"), F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("path")))


@query("""WITH e AS (SELECT o_custkey AS issue, o_orderkey AS sha, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 9 END AS contributor, CASE l_linenumber % 4 WHEN 0 THEN 'fallback' WHEN 1 THEN 'head' WHEN 2 THEN 'exact' ELSE 'merge' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > o_custkey % 6),
  g AS (SELECT issue, count(*) AS n, count(contributor) AS r, count(DISTINCT contributor) AS c, list_distinct(list(kind)) AS kinds FROM e GROUP BY issue),
  i AS (SELECT c_custkey AS issue, c_custkey % 17 = 0 AS unborn, c_custkey % 4 AS linked, coalesce(n, 0) AS n, coalesce(r, 0) AS r, coalesce(c, 0) AS c, coalesce(kinds, []) AS kinds FROM customer LEFT JOIN g ON c_custkey = issue)
  SELECT issue, CASE WHEN unborn THEN 'missing_issue_created_at' WHEN linked <= 0 THEN 'no_file_links' WHEN n <= 0 THEN 'no_commit_matches' WHEN c <= 0 THEN 'no_resolved_commit_authors' WHEN linked < 2 OR r < 3 OR c < 2 THEN 'sparse_evidence' ELSE 'ok' END AS coverage_flag,
  CASE WHEN list_contains(kinds, 'merge') THEN 'pr_merge' WHEN list_contains(kinds, 'exact') THEN 'pr_exact_commit' WHEN list_contains(kinds, 'head') THEN 'pr_head' WHEN list_contains(kinds, 'fallback') THEN 'file_fallback' END AS dominant_evidence_type FROM i""")
def ownership_coverage_flags(spark, sf):
    li, o, c = (load(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    n = F.col("l_linenumber") % 4
    e = li.join(o, li.l_orderkey == o.o_orderkey).filter(F.col("l_linenumber") > F.col("o_custkey") % 6)
    e = e.select(F.col("o_custkey").alias("issue"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 9).alias("contributor"), F.when(n == 0, "fallback").when(n == 1, "head").when(n == 2, "exact").otherwise("merge").alias("kind"))
    g = e.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.count("contributor").alias("r"), F.countDistinct("contributor").alias("c"), F.collect_set("kind").alias("k"))
    k = F.col("c_custkey")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    i = c.join(g, k == F.col("issue"), "left").select(k.alias("issue"), F.when(k % 17 > 0, F.lit(1)).alias("created"), (k % 4).alias("linked_files"), zero("n").alias("evidence_rows"), zero("r").alias("resolved_rows"), zero("c").alias("contributors"), F.coalesce("k", F.array().cast("array<string>")).alias("kinds"))
    return ds.coverage_flags(i, files_at=2, rows_at=3, contributors_at=2).select("issue", "coverage_flag", "dominant_evidence_type")


_KINDS = {"high_all": "high", "high_pre": "high AND bucket = 'pre_issue'", "any_all": "high OR careful", "any_pre": "(high OR careful) AND bucket = 'pre_issue'", "any_post": "(high OR careful) AND bucket = 'post_issue'", "conservative": "careful"}
_SETS = ", ".join(f"list_distinct(coalesce(list(contributor) FILTER ({c}), [])) AS {n}" for n, c in _KINDS.items())
_OVER = ", ".join(f"len({n}) AS owners_{n}, len(list_intersect({n}, talk)) AS overlap_{n}, round(len(list_intersect({n}, talk)) / nullif(len({n}), 0), 6) AS fraction_{n}" for n in _KINDS)


@query(f"WITH {_ROWS}, g AS (SELECT repo, issue, {_SETS} FROM f GROUP BY repo, issue), talkers AS (SELECT o_custkey AS issue, list(DISTINCT o_orderkey % 9) AS talk FROM orders WHERE o_orderkey % 4 > 0 GROUP BY o_custkey) SELECT g.repo, g.issue, {_OVER} FROM (SELECT g.*, coalesce(talk, []) AS talk FROM g LEFT JOIN talkers ON g.issue = talkers.issue) g")
def owner_commenter_overlap(spark, sf):
    n = load(spark, sf, "nation")
    names = F.array(*[F.lit(p) for p in ("exact_plus_merge", "merge_plus_head", "merge_first", "exact_first", "fallback_heavy")])
    policies = n.select(F.col("n_nationkey").alias("repo"), F.element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("policy"))
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    talk = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("repo"), F.col("o_custkey").alias("issue"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 9).alias("author"))
    return rounded(ds.owner_commenter_overlap(ev.select_evidence(_rows(spark, sf), policies), talk))


@query("""WITH b AS (SELECT d.doc_id % 3 AS mode, d.source AS repo, CASE WHEN l.toxic = 1 THEN 'wontfix' ELSE 'comparison' END AS analysis_set, CASE WHEN d.doc_id % 3 = 2 THEN (d.doc_id % 10 = 0)::INT ELSE l.quality END AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  r AS (SELECT mode, analysis_set, repo, count(*) AS n, sum((coalesce(q, 0) > 0)::INT) AS k FROM b GROUP BY ALL), s AS (SELECT mode, analysis_set, sum(k) / sum(n) AS rate, sum((k > 0)::INT)::BIGINT AS repos FROM r GROUP BY ALL),
  p AS (SELECT mode, max(rate) FILTER (analysis_set = 'wontfix') AS a, max(rate) FILTER (analysis_set = 'comparison') AS c, max(repos) FILTER (analysis_set = 'wontfix') AS ar, max(repos) FILTER (analysis_set = 'comparison') AS cr FROM s GROUP BY mode)
  SELECT mode, round(a, 6) AS case_rate, round(c, 6) AS control_rate, ar AS case_repos, cr AS control_repos, CASE WHEN a IS NULL OR c IS NULL THEN 'not_ready' WHEN a >= 0.2 AND c >= 0.2 AND ar >= 2 AND cr >= 2 THEN 'analysis_ready' WHEN a >= 0.05 AND c >= 0.05 THEN 'secondary_or_stratified' WHEN a > 0 OR c > 0 THEN 'descriptive_only' ELSE 'not_ready' END AS readiness_status FROM p""")
def feature_readiness(spark, sf):
    b = base(spark, sf).select((F.col("doc_id") % 3).alias("mode"), F.col("source").alias("repo"), F.when(F.col("toxic") == 1, "wontfix").otherwise("comparison").alias("analysis_set"), F.when(F.col("doc_id") % 3 == 2, (F.col("doc_id") % 10 == 0).cast("int")).otherwise(F.col("quality")).alias("covered"))
    return rounded(ds.family_readiness(b, "covered"))


def _extreme(spark, sf, negative):
    i = rounded(d.issue_sentiment(scored(spark, sf)))
    return ds.extreme_issues(i, 10, negative).select("issue", "comment_count", "mean_comment_sentiment", "negative_comment_share", "positive_comment_share")


_SHORT = "issue, comment_count, mean_comment_sentiment, negative_comment_share, positive_comment_share"


@query(f"WITH f AS ({_ISSUE}) SELECT {_SHORT} FROM f ORDER BY mean_comment_sentiment, negative_comment_share DESC, issue LIMIT 10")
def top_negative_issues(spark, sf):
    return _extreme(spark, sf, True)


@query(f"WITH f AS ({_ISSUE}) SELECT {_SHORT} FROM f ORDER BY mean_comment_sentiment DESC, positive_comment_share DESC, issue LIMIT 10")
def top_positive_issues(spark, sf):
    return _extreme(spark, sf, False)


@query("SELECT user_id, count(*) AS hits, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) >= 3 ORDER BY hits DESC, kinds DESC, user_id LIMIT 25")
def screened_repositories(spark, sf):
    g = load(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("event_type").alias("kinds"))
    return ds.count_screen(g, "hits", 3, ["hits", "kinds"], "user_id", 25)


@query("SELECT p_type, arg_min(p_name, (length(p_name), lower(p_name), p_name)) AS canonical FROM part GROUP BY p_type")
def canonical_names(spark, sf):
    return load(spark, sf, "part").groupBy("p_type").agg(ds.canonical_value(F.col("p_name")).alias("canonical"))


_RANKED = "r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM p)"


@query(f"""WITH p AS (SELECT o_orderpriority AS g, o_orderkey % 1000 AS v FROM orders), {_RANKED}, s AS (SELECT g, count(*) AS k, sum(rk) AS t FROM r GROUP BY g), n AS (SELECT count(*)::DOUBLE AS n FROM p),
  c AS (SELECT sum(t::DOUBLE * t * t - t) AS ties FROM (SELECT count(*) AS t FROM p GROUP BY v)),
  h AS (SELECT (SELECT count(*) FROM s) AS n_groups, (SELECT count(*) FROM p) AS n, (12 / (n.n * (n.n + 1)) * (SELECT sum(t * t / k) FROM s) - 3 * (n.n + 1)) / (1 - c.ties / (n.n * n.n * n.n - n.n)) AS h, (SELECT count(*) FROM s) - 1 AS df FROM n, c)
  SELECT n_groups, n, round(h, 4) AS kruskal_h, df, round({tails.chi2_tail('h', 'df')}, 6) AS kruskal_p FROM h""")
def kruskal_by_priority(spark, sf):
    o = load(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderkey") % 1000).alias("v"))
    return st.kruskal_wallis(o, "o_orderpriority", "v").withColumn("kruskal_h", F.round("kruskal_h", 4)).withColumn("kruskal_p", F.round("kruskal_p", 6))


@query(f"""WITH p AS (SELECT c_nationkey AS part, c_custkey % 37 - c_custkey % 23 AS d FROM customer), z AS (SELECT part, d, abs(d) AS v FROM p WHERE d <> 0),
  r AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY v) + (count(*) OVER (PARTITION BY part, v) - 1) / 2.0 AS rk FROM z),
  t AS (SELECT part, sum(t * t * t - t) AS ties FROM (SELECT part, v, count(*)::DOUBLE AS t FROM z GROUP BY ALL) GROUP BY part),
  w AS (SELECT part, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END))::DOUBLE AS w FROM r GROUP BY part),
  s AS (SELECT w.*, sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd FROM w JOIN t ON w.part = t.part)
  SELECT part, n AS n_pairs, round(w, 4) AS wilcoxon_w, CASE WHEN sd > 0 THEN round({tails.normal_tail('(abs(w - n * (n + 1) / 4.0) / sd)')}, 4) END AS wilcoxon_p FROM s""")
def wilcoxon_by_nation(spark, sf):
    k = F.col("c_custkey")
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("part"), (k % 37).alias("late"), (k % 23).alias("early"))
    return rounded(st.wilcoxon(c, "late", "early", "part"), 4)
