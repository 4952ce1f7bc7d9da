"""Logins and addresses linked through pull requests, and the tables of merged identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators.dataset import canonical_value
from provenant.operators.statistics import prefix_sums
from provenant.sources.scratch import stored


def login_email_bridge(pulls: DataFrame, links: DataFrame, emails: DataFrame, *, least_evidence: int = 2, least_pulls: int = 1, bijective: bool = True) -> DataFrame:
    """repo, login, email, evidence_count, commit_count, pull_count, is_bridge: who writes pull requests whose commits have an address.

    pulls (repo, pr_id, pr_number, login), links (repo, pr_id, pr_number, sha), emails (repo, sha, email; one address for a sha). Pull requests meet their commits by id and by number, and each
    way is evidence of its own. Pairs below the thresholds go. A bridge is a pair whose login has no other address and, if bijective, whose address has no other login. Every count is a row of a
    relation (login, address): nothing is gathered for a login or an address.
    """
    found = None
    for key in ("pr_id", "pr_number"):
        own = pulls.filter(F.col("login").isNotNull() & F.col(key).isNotNull()).select("repo", key, "login").distinct()
        one = own.join(links.filter(F.col(key).isNotNull() & F.col("sha").isNotNull()).select("repo", key, "sha").distinct(), ["repo", key]).select("repo", "login", "sha", F.concat(F.lit(f"{key}:"), F.col(key).cast("string")).alias("pull"))
        found = one if found is None else found.union(one)
    seen = found.join(emails.filter("email is not null").select("repo", "sha", "email"), ["repo", "sha"]).distinct()
    # first by commit, so that a pair's commits are counted and not gathered
    commits = seen.groupBy("repo", "login", "email", "sha").agg(F.count(F.lit(1)).alias("k")).groupBy("repo", "login", "email").agg(F.sum("k").alias("evidence_count"), F.count(F.lit(1)).alias("commit_count"))
    by_pull = seen.select("repo", "login", "email", "pull").distinct().groupBy("repo", "login", "email").agg(F.count(F.lit(1)).alias("pull_count"))
    pairs = stored(commits.join(by_pull, ["repo", "login", "email"]).filter((F.col("evidence_count") >= least_evidence) & (F.col("pull_count") >= least_pulls)), "bridges")
    per_login = pairs.groupBy("repo", "login").agg(F.count(F.lit(1)).alias("_e"))
    per_email = pairs.groupBy("repo", "email").agg(F.count(F.lit(1)).alias("_l"))
    unique = (F.col("_e") == 1) & ((F.col("_l") == 1) if bijective else F.lit(True))
    return pairs.join(per_login, ["repo", "login"]).join(per_email, ["repo", "email"]).select("repo", "login", "email", "evidence_count", "commit_count", "pull_count", unique.cast("int").alias("is_bridge"))


def numbered(clusters: DataFrame) -> DataFrame:
    """clusters (repo, key, cluster) with number: from 1 in each repository, in the order of the clusters' least keys. By prefix sums over (repo, cluster): no task holds a repository."""
    each = clusters.groupBy(F.struct("repo", "cluster").alias("at")).agg(F.lit(1).alias("one"))
    placed = stored(prefix_sums(each, "at", "one"), "numbers")
    start = placed.groupBy(F.col("at.repo").alias("_repo")).agg(F.min("below_one").alias("_start"))
    numbers = placed.join(start, F.col("at.repo").eqNullSafe(F.col("_repo"))).select(F.col("at.repo").alias("_repo"), F.col("at.cluster").alias("_cluster"), (F.col("below_one") - F.col("_start") + 1).alias("number"))
    return clusters.join(numbers, clusters["repo"].eqNullSafe(F.col("_repo")) & (clusters["cluster"] == F.col("_cluster"))).drop("_repo", "_cluster")


def cluster_table(identities: DataFrame, clusters: DataFrame, *, most: int = 6, repo_id: Column | None = None) -> DataFrame:
    """A row for each cluster: repo, number, cluster_id, fuzzy_key (with the repository's id, if one is given as a column of its name), members as a JSON list, size, canonical login, name and email of its rows, its sources, flags of three of them, and whether it is suspiciously large.

    identities (repo, key, login, name, email, source: rows, several for a key), clusters (repo, key, cluster: the least key; a row for each key). Clusters of more than `most` keys have fallen apart before
    (identity.without_large), so members are few.
    """
    own = stored(numbered(clusters), "numbered")
    keys = own.groupBy("repo", "cluster", "number").agg(F.sort_array(F.collect_list(F.col("key").cast("string"))).alias("members"), F.count(F.lit(1)).alias("cluster_size"))
    rows = identities.join(own.select("repo", "key", "cluster"), ["repo", "key"])
    has = lambda s: F.coalesce(F.max((F.col("source") == s).cast("int")), F.lit(0)).alias(f"contains_{s}")
    best = rows.groupBy("repo", "cluster").agg(*(canonical_value(F.col(c)).alias(f"canonical_{c}") for c in ("login", "name", "email")), F.sort_array(F.collect_set("source")).alias("sources"), *(has(s) for s in ("commit_author", "issue_comment", "pr_author")))
    safe = F.replace(F.col("repo").cast("string"), F.lit("/"), F.lit("__"))
    fuzzy = F.format_string("%s::fuzzy::%s::%05d", (F.col("repo") if repo_id is None else repo_id).cast("string"), safe, "number")
    return keys.join(best, ["repo", "cluster"], "left").select("repo", "cluster", "number", F.format_string("%s::fuzzy_cluster::%05d", safe, "number").alias("cluster_id"), fuzzy.alias("fuzzy_key"), F.to_json("members").alias("members"), "cluster_size", "canonical_login", "canonical_name", "canonical_email", F.coalesce(F.to_json("sources"), F.lit("[]")).alias("sources"), *(F.coalesce(f"contains_{s}", F.lit(0)).alias(f"contains_{s}") for s in ("commit_author", "issue_comment", "pr_author")), (F.col("cluster_size") > most).cast("int").alias("ambiguity_flag"))


def rewritten_map(identities: DataFrame, clusters: DataFrame, table: DataFrame, accepted: DataFrame) -> DataFrame:
    """identities with fuzzy_key (their own key where they are in no cluster), method, the best score of the accepted pairs (a, b, score, tier, families) of their key, and how many these are."""
    ends = accepted.select(F.col("a").alias("key"), "score").union(accepted.select(F.col("b").alias("key"), "score"))
    scores = ends.groupBy("key").agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_signals"))
    keys = clusters.select("repo", "key", "cluster").join(table.select("repo", "cluster", "fuzzy_key"), ["repo", "cluster"]).drop("cluster")
    j = identities.join(keys, ["repo", "key"], "left").join(scores, "key", "left")
    return j.select(*identities.columns, F.coalesce("fuzzy_key", F.col("key").cast("string")).alias("fuzzy_key"), F.when(F.col("fuzzy_key").isNull(), "strict_only").otherwise("fuzzy_cluster_merge").alias("method"), "best_score", F.coalesce("n_signals", F.lit(0)).alias("n_signals"))
