"""Every registered query of the engine against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from provenant.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    have = sorted((tuple(plain(v) for v in r) for r in got.select(*cols).collect()), key=repr)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


def test_fuzzy_name_pairs_equal_all_pairs(spark, con):
    names = con.sql("SELECT DISTINCT p_type, p_name FROM part").fetchall()
    by = {}
    for scope, name in names:
        by.setdefault(scope, []).append(name)
    want = {(s, a, b) for s, ns in by.items() for a in ns for b in ns if a < b and set(a.split(" ")) & set(b.split(" "))}
    got = catalog.QUERIES["fuzzy_name_pairs"](spark, SF).collect()
    assert {tuple(r)[:3] for r in got} == want and len(got) == len(want)
    assert all(0 <= r["similarity"] <= 1 for r in got)


def test_matched_controls_have_no_partner_twice(spark):
    got = catalog.QUERIES["matched_controls_greedy"](spark, SF).collect()
    assert got and len({r["control_issue"] for r in got}) == len(got)


def test_logit_gradient_is_zero(spark, con):
    fit = {r["repo"]: (r["intercept"], r["slope"]) for r in catalog.QUERIES["logit_fixed_effects"](spark, SF).collect()}
    rows = con.sql("SELECT lang, toxic, ln(1 + n_chars) - 7 FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL").fetchall()
    assert fit
    left = {k: 0.0 for k in fit}
    slope = 0.0
    for repo, y, x in rows:
        if repo in fit:
            r = y - 1 / (1 + math.exp(-(fit[repo][0] + fit[repo][1] * x)))
            left[repo] += r
            slope += r * x
    assert all(abs(v) < 1e-3 for v in left.values()) and abs(slope) < 1e-2


def test_early_and_late_means_are_paired_as_issues_have_them(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = catalog.QUERIES["early_late_within_group"](spark, sf)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES['early_late_within_group']}) ORDER BY part").fetchall()
    assert sorted(map(tuple, got.collect())) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
