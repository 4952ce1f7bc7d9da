"""Tails of distributions against tabulated values and closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from provenant.functions import tails

#: Two-sided p of t: closed forms of 1, 2, 3 and 4 degrees of freedom, and tabulated critical values.
T = [(1.0, 1, 0.5), (12.706204736174694, 1, 0.05), (4.302652729749464, 2, 0.05), (2.2281388519862744, 10, 0.05), (3.169272672616839, 10, 0.01), (1.9719565442493954, 199, 0.05), (1.959966357, 1_000_000, 0.05), (0.0, 7, 1.0)]
F_TABLE = [(4.964602743730711, 1, 10, 0.05), (3.3258345304130112, 5, 10, 0.05), (2.6049, 3, 1e6, None), (1.0, 4, 4, 0.5), (0.0, 3, 9, 1.0)]
CHI = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05), (0.0, 3, 1.0), (2.0, 2, math.exp(-1)), (60.0, 2, math.exp(-30))]


def test_t(spark):
    rows = spark.createDataFrame([(float(t), float(n), p) for t, n, p in T], "t double, n double, p double").select("p", "n", tails.t_two_sided(F.col("t"), F.col("n")).alias("got"), tails.t_two_sided(-F.col("t"), F.col("n")).alias("mirror")).collect()
    assert not [r for r in rows if abs(r["got"] - r["p"]) > (1e-8 if r["n"] < 1e5 else 1e-6) or r["got"] != r["mirror"]]
    closed = spark.range(1, 200).select((F.col("id") / 10).alias("t")).select("t", tails.t_two_sided(F.col("t"), F.lit(1.0)).alias("one"), tails.t_two_sided(F.col("t"), F.lit(2.0)).alias("two"), tails.t_two_sided(F.col("t"), F.lit(4)).alias("four")).collect()
    for r in closed:
        t = r["t"]
        assert math.isclose(r["one"], 1 - 2 * math.atan(t) / math.pi, rel_tol=1e-9)
        assert math.isclose(r["two"], 1 - t / math.sqrt(2 + t * t), rel_tol=1e-9)
        u = t / math.sqrt(4 + t * t)
        assert math.isclose(r["four"], 1 - u * (3 - u * u) / 2, rel_tol=1e-8, abs_tol=1e-12)


def test_f(spark):
    rows = spark.createDataFrame([(float(f), float(a), float(b), p) for f, a, b, p in F_TABLE], "f double, a double, b double, p double").select("p", tails.f_upper(F.col("f"), F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["p"] is None and abs(r["got"] - 0.05) < 1e-4 or r["p"] is not None and abs(r["got"] - r["p"]) < 1e-8 for r in rows)
    # F of 1 and n degrees is t squared of n
    same = spark.range(1, 60).select((F.col("id") / 7).alias("t")).select(tails.f_upper(F.col("t") * F.col("t"), F.lit(1), F.lit(23)).alias("f"), tails.t_two_sided(F.col("t"), F.lit(23)).alias("p")).collect()
    assert all(math.isclose(r["f"], r["p"], rel_tol=1e-10) for r in same)


def test_chi_square(spark):
    rows = spark.createDataFrame([(float(x), float(n), p) for x, n, p in CHI], "x double, n double, p double").select("p", tails.chi2_upper(F.col("x"), F.col("n")).alias("got")).collect()
    assert all(abs(r["got"] - r["p"]) < 1e-8 and (r["p"] == 0 or math.isclose(r["got"], r["p"], rel_tol=1e-7)) for r in rows)
    even = spark.range(1, 150).select((F.col("id") / 3).alias("x")).select("x", tails.chi2_upper(F.col("x"), F.lit(1)).alias("one"), tails.chi2_upper(F.col("x"), F.lit(6)).alias("six")).collect()
    for r in even:
        x = r["x"] / 2
        assert math.isclose(r["one"], math.erfc(math.sqrt(x)), rel_tol=1e-9)
        assert math.isclose(r["six"], math.exp(-x) * (1 + x + x * x / 2), rel_tol=1e-9)


@pytest.mark.parametrize("f", [lambda: tails.t_two_sided(F.lit(None).cast("double"), F.lit(3)), lambda: tails.t_two_sided(F.lit(1.0), F.lit(0)), lambda: tails.chi2_upper(F.lit(-1.0), F.lit(2)), lambda: tails.f_upper(F.lit(1.0), F.lit(0), F.lit(3))])
def test_undefined(spark, f):
    assert spark.range(1).select(f().alias("p")).first()["p"] is None
