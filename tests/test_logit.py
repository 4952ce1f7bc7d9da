"""Logistic regression against a dense fit with a column for each group."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.operators import statistics as st
from provenant.plans import catalog

SF = "/root/testdata/sf0.001"


def dense(groups, x, y):
    names = sorted(set(groups))
    z = np.column_stack([x, *(np.array([g == n for g in groups], float) for n in names)])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        h = z.T @ (z * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, z.T @ (y - p))
    return b[: x.shape[1]], np.sqrt(np.diag(np.linalg.inv(h)))[: x.shape[1]]


def test_errors_are_those_of_a_dense_fit(spark):
    rows = duckdb.sql(f"SELECT month(o_orderdate), (o_orderpriority LIKE '1%')::INT, o_totalprice / 100000, o_custkey % 10, day(o_orderdate) / 10 FROM '{SF}/orders.parquet'").fetchall()
    got = {r["term"]: r for r in catalog.QUERIES["logit_with_errors"](spark, SF).collect()}
    a = np.array(rows, float)
    b, e = dense([r[0] for r in rows], a[:, 2:], a[:, 1])
    for i, term in enumerate(("price", "load", "day")):
        r = got[term]
        assert r["model"] == "logit" and r["n"] == len(rows) and r["n_groups"] == 12
        assert abs(r["coefficient"] - b[i]) < 2e-6 and abs(r["std_error"] - e[i]) < 2e-6 and abs(r["p_value"] - math.erfc(abs(b[i] / e[i]) / math.sqrt(2))) < 2e-6 and abs(r["odds_ratio"] - math.exp(b[i])) < 2e-6


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None, "same"][k % 4], float(k % 4 == 3 or rng.random() < 0.5), float(rng.normal())) for k in range(200)] + [("a", None, 1.0), ("b", 1.0, None)]
    return spark.createDataFrame(rows, "g string, y double, x double")


def test_separation_falls_back_to_the_linear_model(spark, frame):
    apart = frame.withColumn("y", (F.col("x") > 0).cast("double"))
    assert [r["model"] for r in st.logit_model(apart, "y", ["x"], "g").collect()] == ["linear"]
    one = frame.withColumn("twice", 2 * F.col("x"))
    assert st.logit_model(one, "y", ["x", "twice"], "g").count() == 0  # terms that depend on each other have no values in either model
    assert st.logit_model(frame.limit(0), "y", ["x"], "g").count() == 0
    usual = st.logit_model(frame, "y", ["x"], "g").first()
    assert usual["model"] == "logit" and usual["n_groups"] == 2 and usual["n"] == 100
