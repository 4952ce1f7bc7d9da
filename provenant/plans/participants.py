"""Queries on the history of issues' people, on the reach of links into code, and on rates and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import evidence as ev
from provenant.operators import participants as pt
from provenant.operators import standing as sd
from provenant.plans.evidence import _PULLS, _pulls
from provenant.plans.ownership import _issues_and_history, _roles_sql
from provenant.plans.registry import load, query, rounded
from provenant.plans.reports import _BASE, base

#: Errors of the events as issues; up to four comments on each, some without an author, some by the issue's own.
_TALK = "talk AS (SELECT issue, k AS seq, CASE WHEN (issue + k) % 7 > 0 THEN CASE k % 3 WHEN 0 THEN author ELSE (author * 3 + k) % 40 END END AS author FROM (SELECT DISTINCT issue, author FROM i), range(1, 5) t(k) WHERE k <= issue % 5)"
_PEOPLE = """said AS (SELECT issue, author AS who, count(*) AS n, min(seq) AS f FROM talk WHERE author IS NOT NULL GROUP BY ALL), per AS (SELECT said.*, commits, rank, share, coalesce(major, 0) AS major FROM said LEFT JOIN m ON said.issue = m.issue AND who = contributor),
  top AS (SELECT issue, major AS tm FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY n DESC, f, who) AS rn FROM per) WHERE rn = 1),
  g AS (SELECT issue, count(*) AS cc, count(commits) AS ch, sum(major)::BIGINT AS mc, sum(n) AS said, sum(n * major) AS ms, min(rank) AS br, max(share) AS mx FROM per GROUP BY issue)
  SELECT i.issue, coalesce(m.commits, 0) AS author_commits, m.rank::INT AS author_rank, round(m.share, 6) AS author_share, coalesce(m.major, 0) AS author_is_major, coalesce(cc, 0) AS commenter_count, coalesce(ch, 0) AS commenters_with_history, coalesce(mc, 0) AS major_commenter_count, (coalesce(mc, 0) > 0)::INT AS any_commenter_is_major,
  round(mc / cc, 6) AS major_commenter_share, round(ms / said, 6) AS comment_share_by_major, br::INT AS best_commenter_rank, round(mx, 6) AS max_commenter_share, coalesce(tm, 0) AS top_commenter_is_major FROM (SELECT DISTINCT issue, author FROM i) i LEFT JOIN m ON i.issue = m.issue AND i.author = m.contributor LEFT JOIN g ON i.issue = g.issue LEFT JOIN top ON i.issue = top.issue"""


def _talk(issues):
    k, a = F.col("seq"), F.col("author")
    by = F.when(k % 3 == 0, a).otherwise((a * 3 + k) % 40)
    rows = issues.select("issue", "author", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seq")).filter(k <= F.col("issue") % 5)
    return rows.select("issue", "seq", F.when((F.col("issue") + k) % 7 > 0, by).alias("author"))


def _history(spark, sf, kind_as_file, rank, share):
    """Issues, comments, and the roles of authors and commenters alone."""
    issues, history = _issues_and_history(spark, sf, kind_as_file)
    own = issues.select("issue", "author").distinct()
    talk = _talk(own)
    who = own.select("issue", F.col("author").alias("contributor")).union(talk.select("issue", "author")).filter("contributor is not null").distinct()
    people = issues.select("issue", "scope", "ts").join(who, "issue")
    return own, talk, sd.roles_before(people, sd.steps(history), rank_at=rank, share_at=share)


@query(_roles_sql("'all'", "'all'", 5, 0.05).rsplit("SELECT issue, scope", 1)[0].rstrip() + f", {_TALK}, {_PEOPLE}")
def repo_participant_roles(spark, sf):
    issues, talk, roles = _history(spark, sf, False, 5, 0.05)
    return rounded(pt.participant_roles(issues, talk, roles))


@query(_roles_sql("unnest(['click', 'view'])", "event_type", 3, 0.2).rsplit("SELECT issue, scope", 1)[0].rstrip().replace("m AS (", "m0 AS (") + f""",
  m1 AS (SELECT issue, contributor, sum(commits)::BIGINT AS commits, sum(days)::BIGINT AS days, min(rank) AS rank, max(share) AS share FROM m0 GROUP BY ALL), m AS (SELECT *, (commits >= 2 AND days >= 1 AND (rank <= 3 OR share >= 0.2))::INT AS major FROM m1), {_TALK}, {_PEOPLE}""")
def file_participant_roles(spark, sf):
    issues, talk, roles = _history(spark, sf, True, 3, 0.2)
    return rounded(pt.participant_roles(issues, talk, pt.over_files(roles)))


@query(f"""WITH {_PULLS}, xs AS (SELECT j.repo, issue, sha FROM j JOIN x ON j.repo = x.repo AND j.pr_id = x.pr_id), n AS (SELECT 1 AS step, 'linked' AS name, count(DISTINCT (repo, issue)) AS n FROM k UNION ALL SELECT 2, 'pull_request', count(DISTINCT (repo, issue)) FROM j
  UNION ALL SELECT 3, 'pull_request_commit', count(DISTINCT (repo, issue)) FROM xs UNION ALL SELECT 4, 'known_commit', count(DISTINCT (repo, issue)) FROM xs WHERE (repo, sha) IN (SELECT (repo, sha) FROM c WHERE sha LIKE 'x1%'))
  SELECT step, name, n AS n_issues, round(n / (SELECT n FROM n WHERE step = 1), 6) AS share FROM n""")
def coverage_funnel(spark, sf):
    pulls, links, commits, known = _pulls(spark, sf)
    return rounded(pt.coverage_funnel(links, ev.linked_pulls(links, pulls), commits, known.filter("sha like 'x1%'")))


@query(f"WITH {_BASE} SELECT doc_id % 2 AS mode, repo, CASE WHEN toxic = 1 THEN 'wontfix' ELSE 'comparison' END AS analysis_set, count(*) AS issue_count, sum(has_labels)::BIGINT AS has_labels_count, round(avg(has_labels), 6) AS has_labels_rate, sum((coalesce(quality, 0) > 0)::INT)::BIGINT AS quality_count, round(avg((coalesce(quality, 0) > 0)::INT), 6) AS quality_rate FROM b GROUP BY ALL")
def coverage_by_repo_and_group(spark, sf):
    b = base(spark, sf).select((F.col("doc_id") % 2).alias("mode"), "repo", F.when(F.col("toxic") == 1, "wontfix").otherwise("comparison").alias("analysis_set"), "has_labels", "quality")
    return rounded(pt.count_rates(b, ["mode", "repo", "analysis_set"], ["has_labels", "quality"]))


@query("SELECT coalesce(a.k, b.k) AS sha, CASE WHEN b.k IS NULL THEN 'first' ELSE 'second' END AS only_in FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 9 > 0) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 8 > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def git_pass_differences(spark, sf):
    a = load(spark, sf, "orders").filter("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("sha"))
    b = load(spark, sf, "lineitem").filter("l_orderkey % 8 > 0").select(F.col("l_orderkey").alias("sha"))
    return pt.differences(a, b, ["sha"])


@query("""WITH e AS (SELECT event_type AS analysis_set, CASE user_id % 4 WHEN 0 THEN 'anger' WHEN 1 THEN 'joy' WHEN 2 THEN 'neutral' END AS emotion FROM events WHERE event_id % 3 = 0)
  SELECT analysis_set, emotion, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY analysis_set), 6) AS share FROM e WHERE emotion IS NOT NULL GROUP BY analysis_set, emotion""")
def emotion_distribution(spark, sf):
    u = F.col("user_id") % 4
    e = load(spark, sf, "events").select(F.col("event_type").alias("analysis_set"), F.when(F.col("event_id") % 3 == 0, "summary").otherwise("comment").alias("level"), F.when(u == 0, "anger").when(u == 1, "joy").when(u == 2, "neutral").alias("emotion"))
    return rounded(pt.emotion_distribution(pt.issue_emotions(e), "analysis_set"))
