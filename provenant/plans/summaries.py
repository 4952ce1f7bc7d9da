"""Queries on shared lookups and on report tables: participation, emotions with sentiment, timing of evidence, models, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import lookups as lk
from provenant.operators import statistics as st
from provenant.operators import summaries as sm
from provenant.plans import discussion
from provenant.plans.registry import ORACLES, load, query, rounded
from provenant.plans.reports import _BASE, _TWO, base, two_groups

#: Events as commits: the plain table lacks every third sha, the resolved one every fourth; some fields are blank.
_SHAS = "a AS (SELECT event_id::VARCHAR AS sha, event_type AS repo, ts, CASE WHEN event_id % 5 > 0 THEN 'u' || user_id END AS email, ' ' AS name FROM events WHERE event_id % 3 > 0), r AS (SELECT event_id::VARCHAR AS sha, event_type AS repo, ts, 'v' || user_id AS email, 'N' || user_id AS name, CASE WHEN event_id % 7 > 0 THEN 'k' || user_id % 50 END AS contributor FROM events WHERE event_id % 4 > 0)"


@query(f"WITH {_SHAS} SELECT coalesce(a.sha, r.sha) AS sha, coalesce(a.repo, r.repo) AS repo, coalesce(a.ts, r.ts) AS ts, coalesce(a.email, r.email) AS email, coalesce(nullif(trim(a.name), ''), r.name) AS name, NULL::VARCHAR AS login, r.contributor FROM a FULL JOIN r ON a.sha = r.sha")
def merged_commits(spark, sf):
    e, i, u = load(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    none = F.lit(None).cast("string").alias("login")
    a = e.filter(i % 3 > 0).select(i.alias("sha"), F.col("event_type").alias("repo"), "ts", F.when(i % 5 > 0, F.concat(F.lit("u"), u)).alias("email"), F.lit(" ").alias("name"), none)
    r = e.filter(i % 4 > 0).select(i.alias("sha"), F.col("event_type").alias("repo"), "ts", F.concat(F.lit("v"), u).alias("email"), F.concat(F.lit("N"), u).alias("name"), none, F.when(i % 7 > 0, F.concat(F.lit("k"), u % 50)).alias("contributor"))
    return lk.merged_commits(a, r)


@query("""WITH k AS (SELECT o_orderkey AS id, o_custkey AS n FROM orders WHERE o_orderkey % 3 > 0) SELECT DISTINCT p.repo, p.w AS wontfix_issue_id, a.n AS wontfix_issue_number, p.c AS comparison_issue_id, b.n AS comparison_issue_number
  FROM (SELECT DISTINCT l_returnflag AS repo, l_orderkey AS w, l_orderkey + l_linenumber AS c FROM lineitem) p LEFT JOIN k a ON p.w = a.id LEFT JOIN k b ON p.c = b.id""")
def pair_numbers(spark, sf):
    p = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_orderkey").alias("wontfix_issue_id"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("comparison_issue_id"))
    k = load(spark, sf, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("issue_id"), F.col("o_custkey").alias("issue_number"))
    return lk.pair_numbers(p, k)


@query("SELECT o_orderstatus AS repo, o_orderkey AS issue_id, ((o_orderstatus, o_orderkey) IN (SELECT (l_linestatus, l_orderkey) FROM lineitem))::INT AS has_linked_pr FROM orders")
def linked_issues(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").alias("issue_id"), F.lit(7).alias("has_linked_pr"))
    return lk.flag_linked(o, load(spark, sf, "lineitem").select(F.col("l_linestatus").alias("repo"), F.col("l_orderkey").alias("issue_id")))


@query("SELECT conv_id AS issue, CASE turn WHEN 0 THEN 'title' WHEN 1 THEN 'body' ELSE 'comment' END AS source, turn AS place, trim(text, ' \t\n\r\f\v') AS text FROM conversations WHERE turn < 2 OR turn >= 2 AND trim(text, ' \t\n\r\f\v') <> ''")
def issue_text_sources(spark, sf):
    c = load(spark, sf, "conversations")
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    issues = c.groupBy(F.col("conv_id").alias("issue")).agg(at(0).alias("title"), at(1).alias("body"))
    return lk.issue_texts(issues, c.filter("turn >= 2").select(F.col("conv_id").alias("issue"), (F.col("turn") - 2).alias("seq"), F.col("text").alias("body")))


@query("""WITH e AS (SELECT event_type AS repo, user_id % 60 AS u, event_id % 5 AS k FROM events) SELECT DISTINCT * FROM (SELECT repo, 'issue_author' AS source_type, CASE WHEN k > 0 THEN 'u' || u END AS login, NULL::VARCHAR AS name, NULL::VARCHAR AS email FROM e
  UNION ALL SELECT repo, 'issue_closer', CASE WHEN k = 1 THEN 'u' || (u + 1) END, NULL, NULL FROM e UNION ALL SELECT repo, 'issue_comment', 'u' || u, NULL, NULL FROM e WHERE k = 2 UNION ALL SELECT repo, 'pr_author', 'u' || u, NULL, NULL FROM e WHERE k = 3
  UNION ALL SELECT repo, 'commit_author', NULL, CASE WHEN u % 2 = 0 THEN 'n' || u END, CASE WHEN u % 3 = 0 THEN 'm' || u END FROM e WHERE k = 4) WHERE coalesce(login, name, email) IS NOT NULL""")
def identity_candidates(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("repo"), (F.col("user_id") % 60).alias("u"), (F.col("event_id") % 5).alias("k"))
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    u, k = F.col("u"), F.col("k")
    issues = e.select("repo", F.when(k > 0, named("u", u)).alias("author_login"), F.when(k == 1, named("u", u + 1)).alias("closed_by_login"))
    said = lambda n: e.filter(k == n).select("repo", named("u", u).alias("author_login"))
    commits = e.filter(k == 4).select("repo", F.when(u % 2 == 0, named("n", u)).alias("author_name"), F.when(u % 3 == 0, named("m", u)).alias("author_email"))
    return lk.identity_candidates(issues, said(2), said(3), commits)


@query("SELECT user_id AS sha, lower(arg_max(e, (ts, e))) AS email FROM (SELECT user_id, ts, CASE WHEN event_id % 3 > 0 THEN event_type END AS e FROM events) WHERE e IS NOT NULL GROUP BY user_id")
def commit_emails(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("sha"), "ts", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(" "), F.upper("event_type"))).alias("email"))
    return lk.commit_emails(e)


@query("SELECT count(*) AS n_rows, sum((event_id % 3 = 0 OR event_id % 5 = 0)::INT)::BIGINT AS n_with_actor FROM events")
def rows_with_actor(spark, sf):
    i = F.col("event_id")
    return lk.rows_with_actor(load(spark, sf, "events").select(F.when(i % 3 == 0, "a").alias("login"), F.when(i % 5 == 0, "b").otherwise(" nan ").alias("name")), ["login", "name"])


@query("""WITH e AS (SELECT event_id, event_id % 2 AS a, event_id % 3 - 1 AS b, CASE WHEN event_id % 5 > 0 THEN event_id % 4 END AS c FROM events) SELECT event_id, coalesce(c, 0)::DOUBLE AS ownership_post_issue_contributor_count, CASE WHEN event_id % 5 > 0 THEN event_type ELSE 'missing' END AS participant_role_file_coverage_flag,
  (coalesce(c, 0) > 0)::INT AS has_post_issue_ownership, 0 AS has_pre_issue_issue_linked_ownership, (b > 0)::INT AS has_repo_participant_role_signal, (a > 0 AND b > 0)::INT AS has_file_participant_role_signal, 0 AS has_continuity_signal FROM e JOIN events USING (event_id)""")
def ownership_signals(spark, sf):
    i = F.col("event_id")
    e = load(spark, sf, "events").select(i, F.when(i % 5 > 0, (i % 4).cast("string")).otherwise("none").alias("ownership_post_issue_contributor_count"), F.when(i % 5 > 0, F.col("event_type")).otherwise(" nan ").alias("participant_role_file_coverage_flag"))
    e = e.withColumns({"participant_role_file_features_applicable": i % 2, "any_commenter_is_pre_issue_repo_contributor": i % 3 - 1, "issue_author_is_pre_issue_file_contributor": i % 3 - 1})
    d = sm.signal_flags(sm.ownership_defaults(e, counts=["ownership_post_issue_contributor_count"], coverage=["participant_role_file_coverage_flag"]))
    return d.select("event_id", "ownership_post_issue_contributor_count", "participant_role_file_coverage_flag", *sm.SIGNALS)


_FEATURES = {"comment_count": False, "top_commenter_share": True, "issue_author_commented_flag": False}
_TAKEN = f"f AS (SELECT *, issue % 5 AS repo, CASE issue % 3 WHEN 0 THEN 'wontfix' WHEN 1 THEN 'comparison' END AS analysis_set FROM ({ORACLES['issue_participation_features']}))"


def _taken(spark, sf):
    i = F.col("issue")
    return discussion.issue_participation_features(spark, sf).withColumn("repo", i % 5).withColumn("analysis_set", F.when(i % 3 == 0, "wontfix").when(i % 3 == 1, "comparison"))


_CELL = lambda c, w: f"round(avg({c}) {w}, 6) AS {c}__mean, round(median({c}) {w}, 6) AS {c}__median, count({c}) {w} AS {c}__n"


@query(f"""WITH {_TAKEN} SELECT repo, analysis_set, count(*) AS issue_count, sum((comment_count > 0)::INT)::BIGINT AS comment_bearing_issue_count, sum((comment_count = 0)::INT)::BIGINT AS zero_comment_count, round(avg((comment_count = 0)::INT), 6) AS zero_comment_share,
  {', '.join(_CELL(c, 'FILTER (comment_count > 0)' if w else '') for c, w in _FEATURES.items())} FROM f GROUP BY repo, analysis_set""")
def participation_by_group(spark, sf):
    f = _taken(spark, sf).withColumn("zero_comment_flag", (F.col("comment_count") == 0).cast("int"))
    return rounded(sm.participation_by_group(f, ["repo", "analysis_set"], _FEATURES))


def _difference_sql(c: str, flag: bool) -> str:
    n = lambda s: f"count({c}) FILTER (analysis_set = '{s}') AS {s}_n, round(avg({c}) FILTER (analysis_set = '{s}'), 6) AS {s}_mean, " + (f"NULL::DOUBLE AS {s}_median, count(*) FILTER (analysis_set = '{s}' AND {c} = 1) AS {s}_positive_count" if flag else f"round(median({c}) FILTER (analysis_set = '{s}'), 6) AS {s}_median, NULL::BIGINT AS {s}_positive_count")
    less = lambda agg: f"round({agg}({c}) FILTER (analysis_set = 'wontfix') - {agg}({c}) FILTER (analysis_set = 'comparison'), 6)"
    return f"SELECT '{c}' AS feature, '{'binary' if flag else 'numeric'}' AS feature_type, {n('wontfix')}, {n('comparison')}, {less('avg')} AS mean_difference, {'NULL::DOUBLE' if flag else less('median')} AS median_difference FROM f"


@query(f"WITH {_TAKEN} " + " UNION ALL ".join(_difference_sql(c, c.endswith("_flag")) for c in _FEATURES))
def participation_differences(spark, sf):
    return rounded(sm.group_differences(_taken(spark, sf), _FEATURES, ["issue_author_commented_flag"]))


@query(f"""WITH {_TAKEN} SELECT repo, count(*) AS issue_rows_written, sum((comment_count = 0)::INT)::BIGINT AS issues_with_zero_comments, sum((resolved_comment_count > 0)::INT)::BIGINT AS issues_with_resolved_comments, sum((unique_commenter_count > 1)::INT)::BIGINT AS issues_with_multiple_commenters,
  sum((only_author_commented_flag = 1)::INT)::BIGINT AS issues_with_only_author_comments, sum((participation_coverage_flag = 'ok')::INT)::BIGINT AS issues_ok, round(avg(top_commenter_share), 5) AS mean_top_commenter_share, round(avg(issue_author_commented_flag), 6) AS share_issue_author_commented,
  round(avg(single_commenter_flag), 6) AS share_single_commenter, median(comment_count)::DOUBLE AS median_comment_count, median(unique_commenter_count)::DOUBLE AS median_unique_commenter_count FROM f GROUP BY repo""")
def participation_counters(spark, sf):
    return rounded(sm.participation_counters(_taken(spark, sf), "repo").withColumn("mean_top_commenter_share", F.round("mean_top_commenter_share", 5)))


#: Events as issues with a set and a sentiment; every event but each third also with an emotion.
_FELT = """s AS (SELECT event_type AS repo, event_id AS issue, CASE user_id % 3 WHEN 0 THEN 'wontfix' WHEN 1 THEN 'comparison' END AS analysis_set, value AS mean_comment_sentiment, user_id % 7 AS comment_count FROM events),
  m AS (SELECT s.*, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'joy' WHEN 2 THEN 'anger' ELSE 'neutral' END AS emotion, (event_id % 11) / 11 AS confidence FROM s JOIN events ON issue = event_id WHERE event_id % 3 > 0)"""


def _felt(spark, sf):
    e, i, u = load(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    s = e.select(F.col("event_type").alias("repo"), i.alias("issue"), F.when(u % 3 == 0, "wontfix").when(u % 3 == 1, "comparison").alias("analysis_set"), F.col("value").alias("mean_comment_sentiment"), (u % 7).alias("comment_count"))
    m = e.filter(i % 3 > 0).select(F.col("event_type").alias("repo"), i.alias("issue"), F.when(i % 5 == 1, "joy").when(i % 5 == 2, "anger").when(i % 5 > 2, "neutral").alias("emotion"), ((i % 11) / 11).alias("confidence"))
    return m, s


@query(f"WITH {_FELT} SELECT coalesce(analysis_set, 'unknown') AS analysis_set, coalesce(emotion, 'unknown') AS emotion, count(*) AS issues, count(DISTINCT repo) AS repos, round(avg(confidence), 6) AS avg_emotion_confidence, round(avg(comment_count), 6) AS avg_comment_count, round(avg(mean_comment_sentiment), 5) AS avg_comment_sentiment FROM m GROUP BY 1, 2")
def emotions_with_sentiment(spark, sf):
    g = sm.emotions_with_sentiment(*_felt(spark, sf)).drop("avg_negative_share")
    return rounded(g.withColumn("avg_comment_sentiment", F.round("avg_comment_sentiment", 5)))


_SIDE = lambda k: f"sum(n) FILTER (analysis_set = '{k}')::BIGINT AS {k}_issues, count(*) FILTER (analysis_set = '{k}') AS {k}_repos, avg(n / o) FILTER (analysis_set = '{k}') AS {k}_avg_repo_share, sum(c) FILTER (analysis_set = '{k}') / sum(n) FILTER (analysis_set = '{k}') AS {k}_avg_confidence"


@query(f"""WITH {_FELT}, g AS (SELECT repo, analysis_set, emotion, count(*) AS n, sum(confidence) AS c FROM m WHERE analysis_set IS NOT NULL AND emotion IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY repo, analysis_set) AS o FROM g),
  w AS (SELECT emotion, {_SIDE('wontfix')}, {_SIDE('comparison')} FROM t GROUP BY emotion), x AS (SELECT *, wontfix_issues / (SELECT sum(n) FROM g WHERE analysis_set = 'wontfix') AS ws, comparison_issues / (SELECT sum(n) FROM g WHERE analysis_set = 'comparison') AS cs FROM w)
  SELECT emotion, wontfix_issues, wontfix_repos, round(wontfix_avg_repo_share, 6) AS wontfix_avg_repo_share, round(wontfix_avg_confidence, 6) AS wontfix_avg_confidence, comparison_issues, comparison_repos, round(comparison_avg_repo_share, 6) AS comparison_avg_repo_share, round(comparison_avg_confidence, 6) AS comparison_avg_confidence,
  round(ws, 6) AS wontfix_share, round(cs, 6) AS comparison_share, round(ws - cs, 6) AS share_diff, round(wontfix_avg_repo_share - comparison_avg_repo_share, 6) AS avg_repo_share_diff FROM x""")
def emotions_across_sets(spark, sf):
    return rounded(sm.emotions_across_sets(*_felt(spark, sf)))


#: Lines as evidence of their order's issue, which was created a month after the order; some orders are unknown.
_TIMED = "e AS (SELECT l_returnflag AS repo, l_orderkey AS issue, l_shipdate AS ts, (l_linenumber % 2)::BIGINT AS selected, l_linestatus AS evidence_type, date_diff('microsecond', o_orderdate + INTERVAL 30 DAY, l_shipdate) / 86400000000 AS days FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 6 > 0) ON l_orderkey = o_orderkey), t AS (SELECT *, CASE WHEN days <= 0 THEN 'pre_issue' WHEN days > 0 THEN 'post_issue' ELSE 'unknown' END AS bucket FROM e)"


def _timed(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_orderkey").alias("issue"), F.col("l_shipdate").alias("ts"), (F.col("l_linenumber") % 2).cast("bigint").alias("selected"), F.col("l_linestatus").alias("evidence_type"))
    o = load(spark, sf, "orders").filter("o_orderkey % 6 > 0").select(F.explode(F.array(*(F.lit(f) for f in "ARN"))).alias("repo"), F.col("o_orderkey").alias("issue"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("created"))
    return sm.timed_evidence(li, o)


@query(f"WITH {_TIMED} SELECT selected, bucket, evidence_type, count(*) AS row_count FROM t GROUP BY ALL")
def evidence_timing_by_type(spark, sf):
    return sm.timing_by_type(_timed(spark, sf))


@query(f"WITH {_TIMED} SELECT repo, issue, sum(selected)::BIGINT AS selected_rows, sum((bucket = 'pre_issue')::INT)::BIGINT AS pre_issue_rows, sum((bucket = 'post_issue')::INT)::BIGINT AS post_issue_rows, round(min(days), 6) AS min_days, round(max(days), 6) AS max_days, round(median(days), 6) AS median_days FROM t GROUP BY ALL")
def evidence_timing_by_issue(spark, sf):
    return rounded(sm.timing_by_issue(_timed(spark, sf)))


@query(f"""{_TWO}, m AS (SELECT x, x - avg(x) OVER w AS y, g - avg(g) OVER w AS z, count(*) OVER w AS k, repo FROM r WINDOW w AS (PARTITION BY repo)), s AS (SELECT sum(z * z) AS zz, sum(z * y) / sum(z * z) AS b, var_pop(x) * count(*) AS sst FROM m),
  h AS (SELECT m.*, b, zz, sst, y - b * z AS e, 1 - 1 / k - z * z / zz AS f FROM m, s), v AS (SELECT any_value(b) AS b, sqrt(sum(CASE WHEN f > 1e-12 THEN (z * e / f) ** 2 ELSE 0 END)) / any_value(zz) AS se, count(*) AS n, count(DISTINCT repo) AS n_groups, 1 - sum(e * e) / any_value(sst) AS r2 FROM h)
  SELECT 'toxic' AS term, round(b, 4) AS coefficient, round(se, 4) AS std_error, round(b - 1.96 * se, 4) AS ci_low, round(b + 1.96 * se, 4) AS ci_high, n, n_groups, round(r2, 6) AS r_squared FROM v""")
def fixed_effect_hc3(spark, sf):
    m = st.fixed_effect_model(two_groups(spark, sf), "x", ["toxic"], "repo").drop("p_value")  # its p is tested on known values
    return m.select("term", *(F.round(c, 4).alias(c) for c in ("coefficient", "std_error", "ci_low", "ci_high")), "n", "n_groups", F.round("r_squared", 6).alias("r_squared"))


@query(f"""WITH {_BASE}, r AS (SELECT repo, toxic AS g, quality AS q, ln(1 + n_chars) AS x FROM b WHERE toxic IS NOT NULL AND quality IS NOT NULL), m AS (SELECT x - avg(x) OVER w AS y, g - avg(g) OVER w AS z, q - avg(q) OVER w AS t FROM r WINDOW w AS (PARTITION BY repo)),
  s AS (SELECT count(*) AS n, sum(z * y) / sum(z * z) AS base, (sum(z * y) * sum(t * t) - sum(t * y) * sum(z * t)) / (sum(z * z) * sum(t * t) - sum(z * t) * sum(z * t)) AS more FROM m)
  SELECT 'base' AS model, n, round(base, 6) AS coefficient, NULL::DOUBLE AS change FROM s UNION ALL SELECT 'adjusted', n, round(more, 6), round(more - base, 6) FROM s""")
def adjusted_model_change(spark, sf):
    r = base(spark, sf).filter("toxic is not null and quality is not null").withColumn("x", F.log1p("n_chars"))
    return rounded(st.adjusted_change(r, "x", "toxic", ["quality"], "repo").drop("std_error"))


@query(f"""WITH {_BASE}, r AS (SELECT repo, toxic AS g, coalesce(quality, 0) AS quality, (n_chars > 2000)::INT AS long FROM b WHERE toxic IS NOT NULL), u AS (SELECT repo, g, 'quality' AS feature, quality AS v FROM r UNION ALL SELECT repo, g, 'long', long FROM r),
  c AS (SELECT repo, feature, count(*) FILTER (g = 1) AS n_a, count(*) FILTER (g = 0) AS n_b, count(*) FILTER (g = 1 AND v > 0) AS positive_a, count(*) FILTER (g = 0 AND v > 0) AS positive_b FROM u GROUP BY ALL)
  SELECT *, round(positive_a / n_a, 6) AS rate_a, round(positive_b / n_b, 6) AS rate_b, round(positive_a / n_a - positive_b / n_b, 6) AS risk_difference, CASE WHEN n_a > 0 AND n_b > 0 THEN round((positive_a + 0.5::DOUBLE) * (n_b - positive_b + 0.5) / ((n_a - positive_a + 0.5) * (positive_b + 0.5)), 6) END AS odds_ratio,
  CASE WHEN n_a >= 5 AND n_b >= 5 THEN 'ok' ELSE 'limited_n' END AS status FROM c""")
def flag_effects_by_repo(spark, sf):
    r = base(spark, sf).filter("toxic is not null").withColumn("long", (F.col("n_chars") > 2000).cast("int"))
    return rounded(st.flag_effects(r, "toxic", ["quality", "long"], ["repo"]).drop("fisher_p"))  # Fisher's p is tested on known values


@query("""WITH t AS (SELECT p_name || p_partkey AS feature, (p_partkey % 17 - 8) / 4 AS difference, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 13) / 8 END AS g, (p_partkey * 37 % 997) / 1000.0::DOUBLE AS p FROM part)
  SELECT feature, round(least(1, p * 2), 6) AS p_adj, feature || ' was ' || CASE WHEN difference > 0 THEN 'higher' ELSE 'lower' END || ' in cases than in comparison issues (difference ' || printf('%.4f', difference) || ', g ' || coalesce(printf('%.4f', g), 'NA') || ')' AS finding
  FROM t ORDER BY (p * 2 < 0.05) DESC, least(1, p * 2), p, feature LIMIT 5""")
def top_findings(spark, sf):
    k = F.col("p_partkey")
    t = load(spark, sf, "part").select(F.concat("p_name", k.cast("string")).alias("feature"), ((k % 17 - 8) / 4).alias("difference"), F.when(k % 5 > 0, (k % 13) / 8).alias("hedges_g"), (k * 37 % 997 / 1000).alias("p"))
    t = t.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * 2)).withColumn("reject", F.col("p") * 2 < 0.05)
    return rounded(sm.findings(t))
