"""Queries on bridges of logins and addresses, and on merged identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import bridges as br
from provenant.operators import identity as idn
from provenant.plans.ownership import _ACTIVITY, _decided, _typed
from provenant.plans.registry import load, query, rounded


@query("""WITH p AS (SELECT o_custkey % 5 AS repo, o_orderkey AS pr_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 7 END AS pr_number, CASE WHEN o_orderkey % 11 > 0 THEN 'u' || (o_custkey % 90) END AS login FROM orders),
  x AS (SELECT o_custkey % 5 AS repo, l_orderkey AS pr_id, CASE WHEN l_linenumber % 3 > 0 THEN l_orderkey + 7 END AS pr_number, l_orderkey * 10 + l_linenumber AS sha, CASE WHEN l_linenumber = 6 AND o_custkey % 4 = 0 THEN 'all@x' WHEN l_linenumber = 7 THEN NULL ELSE 'm' || (o_custkey % 90) || '@x' END AS email FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  f AS (SELECT p.repo, login, sha, 'pr_id:' || p.pr_id AS pull FROM p JOIN x ON p.repo = x.repo AND p.pr_id = x.pr_id WHERE login IS NOT NULL UNION SELECT p.repo, login, sha, 'pr_number:' || p.pr_number FROM p JOIN x ON p.repo = x.repo AND p.pr_number = x.pr_number WHERE login IS NOT NULL),
  s AS (SELECT f.repo, login, email, f.sha, pull FROM f JOIN (SELECT DISTINCT repo, sha, email FROM x) e ON f.repo = e.repo AND f.sha = e.sha WHERE email IS NOT NULL),
  c AS (SELECT repo, login, email, count(*) AS evidence_count, count(DISTINCT sha) AS commit_count, count(DISTINCT pull) AS pull_count FROM s GROUP BY ALL HAVING count(*) >= 2)
  SELECT *, (count(*) OVER (PARTITION BY repo, login) = 1 AND count(*) OVER (PARTITION BY repo, email) = 1)::INT AS is_bridge FROM c""")
def login_email_bridge(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pulls = o.select((c % 5).alias("repo"), k.alias("pr_id"), F.when(k % 2 == 0, k + 7).alias("pr_number"), F.when(k % 11 > 0, F.concat(F.lit("u"), c % 90)).alias("login"))
    n = F.col("l_linenumber")
    rows = li.join(o, k == F.col("l_orderkey")).select((c % 5).alias("repo"), k.alias("pr_id"), F.when(n % 3 > 0, k + 7).alias("pr_number"), (k * 10 + n).alias("sha"), F.when((n == 6) & (c % 4 == 0), "all@x").when(n == 7, None).otherwise(F.concat(F.lit("m"), c % 90, F.lit("@x"))).alias("email"))
    return br.login_email_bridge(pulls, rows.select("repo", "pr_id", "pr_number", "sha"), rows.select("repo", "sha", "email").distinct())


_CLUSTERS = f"""{_ACTIVITY}, both_ AS (SELECT a, b FROM d WHERE decision = 'accepted' UNION SELECT b, a FROM d WHERE decision = 'accepted'),
  w AS (SELECT k AS node, k AS r FROM a UNION SELECT w.node, both_.b FROM w JOIN both_ ON w.r = both_.a), c0 AS (SELECT node, min(r) AS cluster FROM w GROUP BY node), n0 AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM c0),
  f AS (SELECT repo, k AS key, CASE WHEN n > 6 THEN k ELSE cluster END AS cluster, login, name, email, CASE k % 3 WHEN 0 THEN 'commit_author' WHEN 1 THEN 'issue_comment' ELSE 'pr_author' END AS source FROM n0 JOIN a ON node = k),
  tt AS (SELECT repo, cluster, row_number() OVER (PARTITION BY repo ORDER BY cluster) AS number, '["' || string_agg(key::VARCHAR, '","' ORDER BY key::VARCHAR) || '"]' AS members, count(*) AS cluster_size, '["' || string_agg(DISTINCT source, '","' ORDER BY source) || '"]' AS sources,
    max((source = 'commit_author')::INT) AS contains_commit_author, max((source = 'issue_comment')::INT) AS contains_issue_comment, max((source = 'pr_author')::INT) AS contains_pr_author FROM f GROUP BY repo, cluster)"""


def _merged(spark, sf):
    accepted = idn.accepted_pairs(_decided(spark, sf))
    k = F.col("k")
    t = _typed(spark, sf)
    source = F.when(k % 3 == 0, "commit_author").when(k % 3 == 1, "issue_comment").otherwise("pr_author")
    rows = t.select("repo", k.alias("key"), F.when(k % 3 == 0, F.concat(F.lit("user"), k % 100)).alias("login"), F.when(k % 5 > 0, F.col("typed")).alias("name"), F.when(k % 2 == 0, F.concat(F.replace("typed", F.lit(" "), F.lit(".")), F.lit("@example.com"))).alias("email"), source.alias("source"))
    found = idn.fuzzy_clusters(spark, t.select(k.alias("node")), accepted)
    return rows, t.select("repo", k.alias("key")).join(found, F.col("key") == F.col("node")).select("repo", "key", "cluster"), accepted


@query(f"""WITH RECURSIVE {_CLUSTERS} SELECT repo, cluster, number, printf('%d::fuzzy_cluster::%05d', repo, number) AS cluster_id, printf('%d::fuzzy::%d::%05d', repo, repo, number) AS fuzzy_key, members, cluster_size, sources, contains_commit_author, contains_issue_comment, contains_pr_author, 0 AS ambiguity_flag FROM tt""")
def fuzzy_cluster_table(spark, sf):
    rows, clusters, _ = _merged(spark, sf)
    return br.cluster_table(rows, clusters).drop("canonical_login", "canonical_name", "canonical_email")


@query(f"""WITH RECURSIVE {_CLUSTERS}, e AS (SELECT a AS key, score FROM d WHERE decision = 'accepted' UNION ALL SELECT b, score FROM d WHERE decision = 'accepted'), g AS (SELECT key, max(score) AS best_score, count(*) AS n FROM e GROUP BY key)
  SELECT f.repo, f.key, f.login, f.name, f.email, f.source, printf('%d::fuzzy::%d::%05d', f.repo, f.repo, number) AS fuzzy_key, 'fuzzy_cluster_merge' AS method, round(best_score, 6) AS best_score, coalesce(g.n, 0) AS n_signals FROM f JOIN tt ON f.repo = tt.repo AND f.cluster = tt.cluster LEFT JOIN g ON f.key = g.key""")
def fuzzy_identity_map(spark, sf):
    rows, clusters, accepted = _merged(spark, sf)
    return rounded(br.rewritten_map(rows, clusters, br.cluster_table(rows, clusters), accepted))
