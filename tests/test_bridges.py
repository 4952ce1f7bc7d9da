"""Bridges of logins and addresses, and tables of merged identities, on small rows."""

import json

from provenant.operators import bridges as br


def test_bridges_are_mutual_and_repeated(spark):
    pulls = spark.createDataFrame([("r", 1, 11, "ann"), ("r", 2, None, "ann"), ("r", 3, 13, "bob"), ("r", 4, 14, None), ("r", 5, 15, "cy"), ("q", 1, 11, "ann")], "repo string, pr_id long, pr_number long, login string")
    links = spark.createDataFrame([("r", 1, 11, "s1"), ("r", 1, 11, "s1"), ("r", 2, None, "s2"), ("r", 3, None, "s3"), ("r", None, 13, "s4"), ("r", 5, 15, "s5"), ("r", 5, 15, "s6"), ("r", 4, 14, "s7"), ("q", 1, None, "s1"), ("r", 5, None, None)], "repo string, pr_id long, pr_number long, sha string")
    emails = spark.createDataFrame([("r", "s1", "ann@x"), ("r", "s2", "ann@x"), ("r", "s3", "bob@x"), ("r", "s4", "bob@x"), ("r", "s5", "cy@x"), ("r", "s6", "ann@x"), ("r", "s7", "no@x"), ("q", "s1", "ann@x"), ("r", "s8", None)], "repo string, sha string, email string")
    rows = {(r["repo"], r["login"], r["email"]): tuple(r)[3:] for r in br.login_email_bridge(pulls, links, emails).collect()}
    # a pull request that is known by id and by number is evidence twice; cy's two addresses are none, and one of them is shared with ann
    assert rows == {("r", "ann", "ann@x"): (3, 2, 3, 0), ("r", "bob", "bob@x"): (2, 2, 2, 1), ("r", "cy", "cy@x"): (2, 1, 2, 0), ("r", "cy", "ann@x"): (2, 1, 2, 0)}
    loose = {(r["login"], r["email"]): r["is_bridge"] for r in br.login_email_bridge(pulls, links, emails, least_evidence=1, bijective=False).filter("repo = 'r'").collect()}
    assert loose == {("ann", "ann@x"): 1, ("bob", "bob@x"): 1, ("cy", "cy@x"): 0, ("cy", "ann@x"): 0}
    assert br.login_email_bridge(pulls.limit(0), links, emails).count() == 0


def test_tables_of_clusters(spark):
    people = spark.createDataFrame([("o/r", "k1", "Ann", "ann lee", None, "commit_author"), ("o/r", "k1", "ann", None, "a@x", "issue_comment"), ("o/r", "k2", None, "ann", "aa@x", "pr_author"), ("o/r", "k3", "bob", None, None, "pr_author"), ("o/s", "k4", None, None, None, "commit_author"), ("o/s", "k9", None, None, None, "commit_author")], "repo string, key string, login string, name string, email string, source string")
    clusters = spark.createDataFrame([("o/r", "k1", "k1"), ("o/r", "k2", "k1"), ("o/r", "k3", "k3"), ("o/s", "k4", "k4")], "repo string, key string, cluster string")
    table = br.cluster_table(people, clusters, most=1)
    rows = {r["fuzzy_key"]: r for r in table.collect()}
    assert sorted(rows) == ["o/r::fuzzy::o__r::00001", "o/r::fuzzy::o__r::00002", "o/s::fuzzy::o__s::00001"]
    one = rows["o/r::fuzzy::o__r::00001"]
    assert json.loads(one["members"]) == ["k1", "k2"] and one["cluster_size"] == 2 and one["ambiguity_flag"] == 1 and one["canonical_email"] == "a@x" and one["canonical_name"] == "ann"
    assert json.loads(one["sources"]) == ["commit_author", "issue_comment", "pr_author"] and one["contains_pr_author"] == 1 and rows["o/s::fuzzy::o__s::00001"]["canonical_login"] is None and one["cluster_id"] == "o__r::fuzzy_cluster::00001"
    accepted = spark.createDataFrame([("k1", "k2", 1.5, "strong"), ("k2", "k3", 0.9, "moderate")], "a string, b string, score double, tier string")
    got = {(r["key"], r["source"]): (r["fuzzy_key"], r["method"], r["best_score"], r["n_signals"]) for r in br.rewritten_map(people, clusters, table, accepted).collect()}
    assert got[("k1", "commit_author")] == ("o/r::fuzzy::o__r::00001", "fuzzy_cluster_merge", 1.5, 1) and got[("k2", "pr_author")][2:] == (1.5, 2)
    assert got[("k9", "commit_author")] == ("k9", "strict_only", None, 0) and len(got) == 6
