"""Queries on contributor keys by actor: orders stand for issues and commits, customers for the identity map."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import actors as ac
from provenant.plans.registry import load, query

_MAP = """m AS (SELECT c_nationkey AS repo, s AS src, CASE WHEN c_custkey % 13 > 0 THEN 'u' || (c_custkey % 40) END AS login, CASE WHEN c_custkey % 4 > 0 THEN 'n' || (c_custkey % 50) END AS name, CASE WHEN c_custkey % 3 > 0 THEN 'e' || (c_custkey % 30) END AS email,
    CASE WHEN c_custkey % 17 > 0 THEN 'k' || (c_custkey % 120) END AS key, 's' || (c_custkey % 120) AS strict, CASE WHEN c_custkey % 2 = 0 THEN 'f' || (c_custkey % 240) END AS fuzzy, CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'strict' END AS method
    FROM customer, (VALUES ('issue_author'), ('issue_closer'), ('commit_author')) t(s) WHERE NOT (s = 'issue_closer' AND c_custkey % 5 = 0)),
  b AS (SELECT c_nationkey AS repo, o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN ' u' || (o_orderkey % 45) || ' ' END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || (o_orderkey % 41) END AS c, 'n' || (o_orderkey % 50) AS n, CASE WHEN o_orderkey % 5 > 0 THEN 'e' || (o_orderkey % 30) END AS e FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _identities(spark, sf):
    k = F.col("c_custkey")
    word = lambda p, n: F.concat(F.lit(p), k % n)
    source = F.explode(F.array(*[F.lit(s) for s in ("issue_author", "issue_closer", "commit_author")])).alias("raw_source_type")
    rows = load(spark, sf, "customer").select(
        F.col("c_nationkey").alias("repo"), k, source, F.when(k % 13 > 0, word("u", 40)).alias("raw_login"), F.when(k % 4 > 0, word("n", 50)).alias("raw_name"), F.when(k % 3 > 0, word("e", 30)).alias("raw_email"), F.when(k % 17 > 0, word("k", 120)).alias("resolved_contributor_key"),
        word("s", 120).alias("strict_resolved_contributor_key"), F.when(k % 2 == 0, word("f", 240)).alias("fuzzy_resolved_contributor_key"), F.when(k % 2 == 0, "name").otherwise("strict").alias("fuzzy_resolution_method"),
    )
    return rows.filter(~((F.col("raw_source_type") == "issue_closer") & (k % 5 == 0))).drop("c_custkey")


def _base(spark, sf):
    o, c, k = load(spark, sf, "orders"), load(spark, sf, "customer"), F.col("o_orderkey")
    word = lambda p, n: F.concat(F.lit(p), k % n)
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("repo"), k.alias("id"), F.when(k % 9 > 0, F.concat(word(" u", 45), F.lit(" "))).alias("author_login"), F.when(k % 2 == 0, word("u", 41)).alias("closed_by_login"), word("n", 50).alias("author_name"), F.when(k % 5 > 0, word("e", 30)).alias("author_email"))


def _known(source: str, keys: str) -> str:
    return f"SELECT repo, {keys}, min(key) AS key, min(row(strict, coalesce(fuzzy, ''), method)) AS how FROM m WHERE src = '{source}' AND key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT key) = 1"


@query(f"""WITH {_MAP}, x AS ({_known('issue_author', 'login')}), y AS ({_known('issue_closer', 'login')})
  SELECT b.repo, id, x.key AS issue_author_contributor_key, y.key AS issue_closer_contributor_key, x.how[1] AS strict_resolved_contributor_key, nullif(x.how[2], '') AS fuzzy_resolved_contributor_key, x.how[3] AS fuzzy_resolution_method, 'fuzzy' AS identity_resolution_mode
  FROM b LEFT JOIN x ON b.repo = x.repo AND trim(a) IS NOT DISTINCT FROM x.login LEFT JOIN y ON b.repo = y.repo AND c IS NOT DISTINCT FROM y.login""")
def annotated_issues(spark, sf):
    got = ac.annotate(_base(spark, sf), _identities(spark, sf), "issues", fuzzy=True)
    return got.drop("author_login", "closed_by_login", "author_name", "author_email")


@query(f"""WITH {_MAP}, x AS ({_known('commit_author', 'name, email')}) SELECT b.repo, id, x.key AS commit_author_contributor_key, 'strict' AS identity_resolution_mode
  FROM b LEFT JOIN x ON b.repo = x.repo AND n IS NOT DISTINCT FROM x.name AND e IS NOT DISTINCT FROM x.email""")
def annotated_commits(spark, sf):
    return ac.annotate(_base(spark, sf), _identities(spark, sf), "commits").select("repo", "id", "commit_author_contributor_key", "identity_resolution_mode")


def _tally(source: str, col: str) -> str:
    return f"SELECT '{source}' AS actor, count(b.{col}) AS rows_with_actor, count(x.key) AS rows_attached, (SELECT count(*) FROM (SELECT 1 FROM m WHERE src = '{source}' AND key IS NOT NULL GROUP BY repo, login HAVING count(DISTINCT key) > 1)) AS ambiguous_keys_dropped FROM b LEFT JOIN ({_known(source, 'login')}) x ON b.repo = x.repo AND trim(b.{col}) IS NOT DISTINCT FROM x.login"


@query(f"WITH {_MAP} {_tally('issue_author', 'a')} UNION ALL {_tally('issue_closer', 'c')}")
def identity_attachment_counts(spark, sf):
    known = _identities(spark, sf)
    return ac.attachment_counts(ac.annotate(_base(spark, sf), known, "issues"), known, "issues")
