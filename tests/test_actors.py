"""Contributor keys by actor: nulls as values, shared values, columns that are missing or already there, empty tables."""

from provenant.operators import actors as ac

MAP = "repo string, raw_source_type string, raw_login string, raw_name string, raw_email string, resolved_contributor_key string, strict_resolved_contributor_key string, fuzzy_resolved_contributor_key string, fuzzy_resolution_method string"


def known(spark):
    rows = [
        ("r", "issue_author", "ann", None, None, "k1", "s2", None, "strict"),
        ("r", "issue_author", " ann ", None, None, "k1", "s1", "f1", "name"),
        ("r", "issue_author", "bob", None, None, "k2", "s3", None, None),
        ("r", "issue_author", "bob", None, None, "k3", "s3", None, None),
        ("r", "issue_author", None, None, None, "k9", None, None, None),
        ("r", "issue_closer", "bob", None, None, "k2", None, None, None),
        ("r", "commit_author", None, "Ann", None, "k1", None, None, None),
        ("r", "commit_author", None, "Bob", "b@x", None, None, None, None),
    ]
    return spark.createDataFrame(rows, MAP)


def test_issues_with_provenance(spark):
    base = spark.createDataFrame([("r", 1, "ann", "bob"), ("r", 2, "bob", None), ("r", 3, "", None), ("q", 4, "ann", None)], "repo string, id int, author_login string, closed_by_login string")
    got = {r["id"]: r for r in ac.annotate(base, known(spark), "issues", fuzzy=True).collect()}
    assert [got[i]["issue_author_contributor_key"] for i in (1, 2, 3, 4)] == ["k1", None, "k9", None]
    assert got[1]["issue_closer_contributor_key"] == "k2" and got[2]["issue_closer_contributor_key"] is None
    assert (got[1]["strict_resolved_contributor_key"], got[1]["fuzzy_resolved_contributor_key"], got[1]["fuzzy_resolution_method"]) == ("s1", "f1", "name")
    assert all(r["identity_resolution_mode"] == "fuzzy" for r in got.values())
    n = {r["actor"]: r for r in ac.attachment_counts(ac.annotate(base, known(spark), "issues"), known(spark), "issues").collect()}
    assert (n["issue_author"]["rows_with_actor"], n["issue_author"]["rows_attached"], n["issue_author"]["ambiguous_keys_dropped"]) == (3, 2, 1)


def test_commits_and_odd_columns(spark):
    base = spark.createDataFrame([("r", "Ann", "old"), ("r", "Bob", "old")], "repo string, author_name string, commit_author_contributor_key string")
    got = {r["author_name"]: r["commit_author_contributor_key"] for r in ac.annotate(base, known(spark), "commits").collect()}
    assert got == {"Ann": "k1", "Bob": None}
    assert ac.annotate(base.limit(0), known(spark), "commits").count() == 0
    none = ac.annotate(base, known(spark).limit(0), "comments")
    assert none.count() == 2 and [r["comment_author_contributor_key"] for r in none.collect()] == [None, None]
