"""Lookups, report tables and models on small rows whose results are known."""

import math
import random
import statistics as py

import numpy as np
from pyspark.sql import functions as F

from provenant.operators import lookups as lk
from provenant.operators import statistics as st
from provenant.operators import summaries as sm


def fisher(a, b, c, d):
    """All tables with the same margins, in whole numbers."""
    row, column, n = a + b, a + c, a + b + c + d
    ways = {k: math.comb(row, k) * math.comb(n - row, column - k) for k in range(max(0, row + column - n), min(row, column) + 1)}
    return sum(w for w in ways.values() if w * 10**9 <= ways[a] * (10**9 + 100)) / math.comb(n, column)


def test_fisher_equals_all_tables():
    r = random.Random(1)
    tables = [(0, 0, 0, 0), (3, 0, 0, 3), (5, 0, 5, 0), (1, 9, 11, 3), (0, 7, 0, 0)] + [tuple(r.randrange(40) for _ in range(4)) for _ in range(200)]
    for t in tables:
        assert math.isclose(st.odds_two_by_two(*t), fisher(*t), rel_tol=1e-6), t
    assert st.odds_two_by_two(500_000, 500_000, 501_000, 499_000) < 0.2  # large counts take few steps


def test_flag_effects_hold_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", g, f) for g, f in [(1, "1")] * 6 + [(0, None)] * 5 + [(0, "x")]] + [("b", 1, "0"), (None, 0, "1"), ("a", None, "1")], "repo string, g int, f string")
    got = {r["repo"]: r for r in st.flag_effects(df, "g", ["f"], ["repo"]).collect()}
    assert (got["a"]["n_a"], got["a"]["positive_a"], got["a"]["n_b"], got["a"]["positive_b"]) == (6, 6, 6, 0)
    assert got["a"]["status"] == "ok" and math.isclose(got["a"]["fisher_p"], fisher(6, 0, 0, 6))
    assert got["b"]["status"] == "limited_n" and got["b"]["fisher_p"] is None and got["b"]["rate_b"] is None
    assert got[None]["n_b"] == 1
    assert st.flag_effects(df.limit(0), "g", ["f"], ["repo"]).collect() == []


def test_grouped_medians_equal_plain_ones(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.randrange(2), r.choice([None, float(r.randrange(9))])) for _ in range(500)] + [("c", 0, None)]
    by = {}
    for g, h, v in rows:
        if v is not None:
            by.setdefault((g, h), []).append(v)
    got = st.grouped_medians(spark.createDataFrame(rows, "g string, h int, v double").repartition(7), ["g", "h"], "v").collect()
    assert {(x["g"], x["h"]): x["median"] for x in got} == {k: py.median(v) for k, v in by.items()}


def dummies(y, xs, by):
    """Least squares with a column for each group, and HC3 errors by the whole hat matrix."""
    groups = sorted(set(by))
    a = np.array([[*x, *(float(g == k) for k in groups)] for x, g in zip(xs, by, strict=True)])
    inverse = np.linalg.inv(a.T @ a)
    b = inverse @ a.T @ y
    e = y - a @ b
    h = np.einsum("ij,jk,ik->i", a, inverse, a)
    cov = inverse @ (a.T * (e / (1 - h)) ** 2) @ a @ inverse
    return b, np.sqrt(np.diag(cov)), 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))


def test_fixed_effect_model_equals_dummies(spark):
    r = random.Random(3)
    rows = [(r.choice("abcd"), r.gauss(0, 1), float(r.randrange(2)), r.gauss(2, 3)) for _ in range(300)]
    rows = [(g, y + 2 * x - 0.5 * z + ord(g), x, z) for g, y, x, z in rows]
    b, se, r2 = dummies(np.array([t[1] for t in rows]), [t[2:] for t in rows], [t[0] for t in rows])
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), ("b", float("nan"), 0.0, 1.0)], "g string, y double, x double, z double")
    got = {t["term"]: t for t in st.fixed_effect_model(df, "y", ["x", "z"], "g").collect()}
    for i, name in enumerate(["x", "z"]):
        t = got[name]
        assert math.isclose(t["coefficient"], b[i], rel_tol=1e-9) and math.isclose(t["std_error"], se[i], rel_tol=1e-9) and math.isclose(t["r_squared"], r2, rel_tol=1e-9)
        assert math.isclose(t["p_value"], math.erfc(abs(b[i] / se[i]) / math.sqrt(2)), rel_tol=1e-5, abs_tol=1e-300)
        assert t["n"] == 300 and t["n_groups"] == 4
    both = {t["model"]: t for t in st.adjusted_change(df, "y", "x", ["z"], "g").collect()}
    assert math.isclose(both["adjusted"]["change"], b[0] - both["base"]["coefficient"], rel_tol=1e-9) and both["base"]["change"] is None


def test_fixed_effect_model_without_an_answer(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 5.0)], "g string, y double, x double")
    assert st.fixed_effect_model(df, "y", ["x"], "g").collect() == []
    assert st.fixed_effect_model(df.limit(0), "y", ["x"], "g").collect() == []
    assert st.fixed_effect_model(df.withColumn("w", F.rand(1)), "y", ["w", "w"], "g").collect() == []


def test_merged_commits_take_first_known_values(spark):
    s = "sha string, repo string, ts string, email string, name string, login string"
    a = spark.createDataFrame([("1", "r", None, " ", "A", None), (None, "r", "t", "e", "n", "l"), (" ", "r", "t", "e", "n", "l")], s)
    b = spark.createDataFrame([("1", "q", "t", "e", "B", "l", "k"), ("2", "r", "t", None, None, None, " ")], s + ", contributor string")
    got = {r["sha"]: tuple(r)[1:] for r in lk.merged_commits(a, b).collect()}
    assert got == {"1": ("r", "t", "e", "A", "l", "k"), "2": ("r", "t", None, None, None, None)}


def test_linked_flag_prefers_numbers_and_replaces(spark):
    issues = spark.createDataFrame([("r", 1, 10, 1), ("r", 2, None, 1), (None, 3, 30, 1)], "repo string, issue_id int, issue_number int, has_linked_pr int")
    by_number = spark.createDataFrame([("r", 2, 10), ("r", 2, None)], "repo string, issue_id int, issue_number int")
    assert {r["issue_id"]: r["has_linked_pr"] for r in lk.flag_linked(issues, by_number).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r["issue_id"]: r["has_linked_pr"] for r in lk.flag_linked(issues, by_number.drop("issue_number")).collect()} == {1: 0, 2: 1, 3: 0}


def test_emotions_across_sets_leave_missing_shares_null(spark):
    s = spark.createDataFrame([("r", 1, "wontfix"), ("r", 2, "wontfix"), ("q", 3, "comparison"), ("q", 4, None)], "repo string, issue int, analysis_set string")
    m = spark.createDataFrame([("r", 1, "joy", 0.5), ("r", 2, "fear", None), ("q", 3, "joy", 0.2), ("q", 4, "joy", 0.9)], "repo string, issue int, emotion string, confidence double")
    got = {r["emotion"]: r for r in sm.emotions_across_sets(m, s).collect()}
    assert got["joy"]["wontfix_share"] == 0.5 and got["joy"]["comparison_share"] == 1.0 and got["joy"]["share_diff"] == -0.5
    assert got["fear"]["comparison_issues"] == 0 and got["fear"]["comparison_avg_repo_share"] is None and got["fear"]["wontfix_avg_confidence"] is None


def test_timing_counts_the_moment_itself_as_before(spark):
    e = spark.createDataFrame([("r", 1, "2024-01-02", 1), ("r", 1, "2024-01-03", 0), ("r", 2, "2024-01-01", 1)], "repo string, issue int, ts string, selected int").withColumn("ts", F.col("ts").cast("timestamp"))
    i = spark.createDataFrame([("r", 1, "2024-01-02")], "repo string, issue int, created string").withColumn("created", F.col("created").cast("timestamp"))
    got = {r["issue"]: r for r in sm.timing_by_issue(sm.timed_evidence(e, i)).collect()}
    assert (got[1]["pre_issue_rows"], got[1]["post_issue_rows"], got[1]["median_days"], got[1]["selected_rows"]) == (1, 1, 0.5, 1)
    assert got[2]["pre_issue_rows"] == got[2]["post_issue_rows"] == 0 and got[2]["median_days"] is None


def test_findings_put_rejected_tests_first(spark):
    t = spark.createDataFrame([("a", 1.0, None, 0.5, 0.9, False), ("b", -1.0, 0.25, 0.01, 0.02, True), ("c", None, None, None, None, None)], "feature string, difference double, hedges_g double, p double, p_adj double, reject boolean")
    got = sm.findings(t).collect()
    assert [r["feature"] for r in got] == ["b", "a", "c"] and "lower" in got[0]["finding"] and got[1]["finding"].endswith("g NA)")
