"""Queries on the analysis dataset: descriptives, coverage, effect sizes, models, quality checks, round trips."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.functions.numbers import clipped, safe_divide
from provenant.operators import statistics as st
from provenant.operators import tables as tb
from provenant.plans import tails
from provenant.plans.registry import load, query, rounded
from provenant.sources import io
from provenant.sources.scratch import new_path
from provenant.streaming.windows import activity

_BASE = """b AS (SELECT d.doc_id, d.lang AS repo, d.source, d.n_chars, l.quality, l.toxic, (l.doc_id IS NOT NULL)::INT AS has_labels FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def base(spark, sf):
    """Documents as issues with their labels as a feature family: toxic is the case group, quality a second flag."""
    d = load(spark, sf, "documents").select("doc_id", F.col("lang").alias("repo"), "source", "n_chars")
    return tb.merge_keeping_base(d, load(spark, sf, "labels"), ["doc_id"], "has_labels").select("doc_id", "repo", "source", "n_chars", "quality", "toxic", "has_labels")


def two_groups(spark, sf):
    return base(spark, sf).filter("toxic is not null").withColumn("x", F.col("n_chars").cast("double"))


@query(f"""WITH {_BASE} SELECT doc_id, repo, source, n_chars, coalesce(quality, 0) AS quality, toxic, has_labels, CASE toxic WHEN 1 THEN 'case' WHEN 0 THEN 'comparison' ELSE 'unlabelled' END AS comparison_group,
  (has_labels = 1 AND n_chars > 0)::INT AS usable_for_rq1, round(ln(1 + n_chars), 6) AS log_chars FROM b""")
def analysis_dataset(spark, sf):
    b = base(spark, sf)
    group = F.when(F.col("toxic") == 1, "case").when(F.col("toxic") == 0, "comparison").otherwise("unlabelled")
    return rounded(b.select("doc_id", "repo", "source", "n_chars", F.coalesce("quality", F.lit(0)).alias("quality"), "toxic", "has_labels", group.alias("comparison_group"), ((F.col("has_labels") == 1) & (F.col("n_chars") > 0)).cast("int").alias("usable_for_rq1"), F.log1p("n_chars").alias("log_chars")))


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)""")
def population_rollup(spark, sf):
    return tb.population_cube(load(spark, sf, "documents"), "lang", "source")


@query(f"""WITH {_BASE} SELECT 'quality' AS column_name, sum((quality IS NULL)::INT)::BIGINT AS null_count, round(avg((quality IS NULL)::INT), 6) AS null_share FROM b
  UNION ALL SELECT 'toxic', sum((toxic IS NULL)::INT)::BIGINT, round(avg((toxic IS NULL)::INT), 6) FROM b UNION ALL SELECT 'n_chars', sum((n_chars IS NULL)::INT)::BIGINT, round(avg((n_chars IS NULL)::INT), 6) FROM b""")
def missingness_summary(spark, sf):
    return rounded(tb.missingness(base(spark, sf), ["quality", "toxic", "n_chars"]))


@query(f"WITH {_BASE} SELECT repo, source, count(*) AS n, sum(has_labels)::BIGINT AS covered, round(avg(has_labels), 6) AS coverage, round(count(*) / sum(count(*)) OVER (PARTITION BY repo), 6) AS share_of_repo FROM b GROUP BY repo, source")
def coverage_by_source(spark, sf):
    g = base(spark, sf).groupBy("repo", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("has_labels").alias("covered"), F.avg("has_labels").alias("coverage"))
    return rounded(g.withColumn("share_of_repo", F.col("n") / F.sum("n").over(Window.partitionBy("repo"))))


@query(f"""WITH {_BASE} SELECT toxic, count(*) AS n_rows, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3,
  min(n_chars)::DOUBLE AS minimum, max(n_chars)::DOUBLE AS maximum FROM b WHERE toxic IS NOT NULL GROUP BY toxic""")
def group_descriptives(spark, sf):
    return rounded(tb.describe_by(two_groups(spark, sf), "toxic", "n_chars"))


@query("""WITH o AS (SELECT o_orderkey, c_nationkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT o_orderkey, round(CASE WHEN stddev_pop(o_totalprice) OVER w > 0 THEN (o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w ELSE 0 END, 6) AS z FROM o WINDOW w AS (PARTITION BY c_nationkey)""")
def repo_zscores(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey", "o_totalprice")
    return rounded(st.within_group_z(j, "o_totalprice", "c_nationkey").select("o_orderkey", "z"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 6) AS winsorized FROM orders, q""")
def winsorized_values(spark, sf):
    o = load(spark, sf, "orders")
    q = tb.quantiles(o, "o_totalprice", [0.01, 0.99])
    return rounded(o.join(F.broadcast(q)).select("o_orderkey", clipped(F.col("o_totalprice"), F.col("q")[0], F.col("q")[1]).alias("winsorized")))  # one row of quantiles


def _effects_sql(rows: str, by: str) -> str:
    key = f"{by}, " if by else ""
    return f"""m AS (SELECT {key}count(*) FILTER (g = 1) AS n_a, avg(x) FILTER (g = 1) AS mean_a, var_samp(x) FILTER (g = 1) AS var_a, count(*) FILTER (g = 0) AS n_b, avg(x) FILTER (g = 0) AS mean_b, var_samp(x) FILTER (g = 0) AS var_b FROM {rows} {f'GROUP BY {by}' if by else ''}),
  f AS (SELECT *, mean_a - mean_b AS difference, CASE WHEN sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) > 0 THEN (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) END AS d, var_a / n_a + var_b / n_b AS se2 FROM m)"""


_TWO = f"WITH {_BASE}, r AS (SELECT repo, toxic AS g, n_chars::DOUBLE AS x FROM b WHERE toxic IS NOT NULL)"


@query(f"""{_TWO}, {_effects_sql('r', '')} SELECT n_a, round(mean_a, 6) AS mean_a, round(var_a, 4) AS var_a, n_b, round(mean_b, 6) AS mean_b, round(var_b, 4) AS var_b, round(difference, 6) AS difference, round(d, 6) AS cohen_d, round(d * (1 - 3 / (4 * (n_a + n_b) - 9)), 6) AS hedges_g,
  round(wt, 6) AS welch_t, round(wd, 6) AS welch_df, round({tails.t_tail('wt', 'wd')}, 6) AS welch_p FROM (SELECT *, difference / sqrt(se2) AS wt, se2 * se2 / ((var_a / n_a) ** 2 / (n_a - 1) + (var_b / n_b) ** 2 / (n_b - 1)) AS wd FROM f)""")
def two_group_effects(spark, sf):
    e = st.effect_sizes(st.moments(two_groups(spark, sf), "toxic", "x"))
    return rounded(e.withColumn("var_a", F.round("var_a", 4)).withColumn("var_b", F.round("var_b", 4)))


@query(f"""{_TWO}, k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM r),
  u AS (SELECT count(*) FILTER (g = 1) AS n_a, count(*) FILTER (g = 0) AS n_b, sum(rk) FILTER (g = 1) AS s FROM k),
  w AS (SELECT n_a, n_b, s - n_a * (n_a + 1) / 2 AS u, (n_a + n_b)::DOUBLE AS n, (SELECT sum(t * t * t - t) FROM (SELECT count(*)::DOUBLE AS t FROM r WHERE g IN (0, 1) GROUP BY x)) AS ties FROM u),
  z AS (SELECT *, greatest((abs(u - n_a::DOUBLE * n_b / 2) - 0.5) / sqrt(n_a::DOUBLE * n_b / 12 * ((n + 1) - ties / (n * (n - 1)))), 0.0) AS z FROM w)
  SELECT n_a, n_b, round(u, 4) AS mann_whitney_u, round({tails.normal_tail('z')}, 6) AS mann_whitney_p, round(2 * u / (n_a * n_b) - 1, 6) AS cliffs_delta FROM z""")
def mann_whitney_ranks(spark, sf):
    out = st.rank_statistics(two_groups(spark, sf), "toxic", "x")
    return rounded(out.withColumn("mann_whitney_u", F.round("mann_whitney_u", 4)))


@query(f"""WITH t AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS a, count(*) FILTER (toxic = 1 AND quality = 0) AS b, count(*) FILTER (toxic = 0 AND quality = 1) AS c, count(*) FILTER (toxic = 0 AND quality = 0) AS d FROM labels)
  SELECT a, b, c, d, round(a / (a + b), 6) AS rate_a, round(c / (c + d), 6) AS rate_b, round(a / (a + b) - c / (c + d), 6) AS risk_difference, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio,
  round(chi, 6) AS chi2_yates, round({tails.chi2_tail('chi', '1')}, 6) AS chi2_p FROM (SELECT *, (a + b + c + d) * greatest(abs(a::DOUBLE * d - b::DOUBLE * c) - (a + b + c + d) / 2, 0) ** 2 / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)) AS chi FROM t)""")
def proportion_effects(spark, sf):
    return rounded(st.proportion_effects(load(spark, sf, "labels"), "toxic", "quality"))


@query(f"""{_TWO}, {_effects_sql('r', 'repo')} SELECT round(sum(d * (n_a + n_b)) / sum(CASE WHEN d IS NOT NULL THEN n_a + n_b END), 6) AS weighted_d, count(d) AS n_repos FROM f""")
def repo_weighted_effects(spark, sf):
    e = st.effect_sizes(st.moments(two_groups(spark, sf), "toxic", "x", "repo"))
    w = F.when(F.col("cohen_d").isNotNull(), F.col("n_a") + F.col("n_b"))
    return rounded(e.agg((F.sum(F.col("cohen_d") * w) / F.sum(w)).alias("weighted_d"), F.count("cohen_d").alias("n_repos")))


@query(f"""{_TWO}, {_effects_sql('r', 'repo')} SELECT repo, n_a, n_b, round(difference, 6) AS difference, round(difference - 1.96 * sqrt(se2), 6) AS ci_low, round(difference + 1.96 * sqrt(se2), 6) AS ci_high FROM f WHERE n_a >= 5 AND n_b >= 5""")
def repo_forest(spark, sf):
    m = st.moments(two_groups(spark, sf), "toxic", "x", "repo").filter("n_a >= 5 and n_b >= 5")
    half = 1.96 * F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    d = F.col("mean_a") - F.col("mean_b")
    return rounded(m.select("repo", "n_a", "n_b", d.alias("difference"), (d - half).alias("ci_low"), (d + half).alias("ci_high")))


@query("""WITH t AS (SELECT p_partkey AS test, CASE WHEN p_partkey % 13 > 0 THEN (p_partkey * 37 % 997) / 1000.0 END AS p FROM part),
  k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS n FROM t WHERE p IS NOT NULL)
  SELECT test, round(p, 6) AS p, round(least(min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_adj FROM k UNION ALL SELECT test, NULL, NULL FROM t WHERE p IS NULL""")
def bh_adjusted_pvalues(spark, sf):
    t = load(spark, sf, "part").select(F.col("p_partkey").alias("test"), F.when(F.col("p_partkey") % 13 > 0, (F.col("p_partkey") * 37 % 997) / 1000).alias("p"))
    return rounded(st.benjamini_hochberg(t, "p"))


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]))
def feature_corr_matrix(spark, sf):
    pairs = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]]
    one = load(spark, sf, "lineitem").agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "correlation")
    return rounded(long.select(F.split("pair", r"\|")[0].alias("feature_x"), F.split("pair", r"\|")[1].alias("feature_y"), "correlation"))


@query(f"""{_TWO}, m AS (SELECT x - avg(x) OVER (PARTITION BY repo) AS y, g - avg(g) OVER (PARTITION BY repo) AS z FROM r) SELECT count(*) AS n, round(sum(z * y) / sum(z * z), 6) AS slope FROM m""")
def ols_fixed_effects(spark, sf):
    return rounded(st.fixed_effect_slope(two_groups(spark, sf), "x", "toxic", "repo"))


@query()
def logit_with_errors(spark, sf):
    """Priority of orders on price and clerk's load, with an intercept for each month: no closed form, so tests compare it with a dense fit."""
    o = load(spark, sf, "orders")
    rows = o.select(F.month("o_orderdate").alias("part"), F.col("o_orderpriority").like("1%").cast("int").alias("urgent"), (F.col("o_totalprice") / 100_000).alias("price"), (F.col("o_custkey") % 10).cast("double").alias("load"), (F.dayofmonth("o_orderdate") / 10).alias("day"))
    return rounded(st.logit_model(rows, "urgent", ["price", "load", "day"], "part"))


@query()
def logit_fixed_effects(spark, sf):
    """Iterative; its coefficients are checked in tests. An intercept for each repo with both outcomes, one slope."""
    return rounded(st.logit_by_group(two_groups(spark, sf).select("repo", F.col("toxic").cast("double").alias("y"), (F.log1p("n_chars") - 7).alias("x")), "y", "x", "repo"))


@query("""SELECT event_type, sum((ts > TIMESTAMP '2024-02-01')::INT)::BIGINT AS leaked_rows, CASE WHEN sum((ts > TIMESTAMP '2024-02-01')::INT) = 0 THEN 'pass' ELSE 'warn' END AS status FROM events GROUP BY event_type""")
def leakage_guard(spark, sf):
    e = load(spark, sf, "events").groupBy("event_type").agg(F.sum((F.col("ts") > F.lit("2024-02-01").cast("timestamp")).cast("int")).alias("leaked_rows"))
    return e.withColumn("status", F.when(F.col("leaked_rows") == 0, "pass").otherwise("warn"))


@query("SELECT count(*) AS n_rows, count(DISTINCT (user_id, event_type)) AS n_keys, count(*) - count(DISTINCT (user_id, event_type)) AS n_duplicates FROM events")
def duplicate_keys(spark, sf):
    return tb.duplicate_keys(load(spark, sf, "events"), ["user_id", "event_type"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedupe_keep_first(spark, sf):
    return tb.keep_first(load(spark, sf, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("event_id", "user_id", "event_type")


@query("""WITH s AS (SELECT lang, 'n_docs' AS metric, count(*)::DOUBLE AS v FROM documents GROUP BY lang UNION ALL SELECT lang, 'mean_chars', avg(n_chars) FROM documents GROUP BY lang),
  z AS (SELECT lang, 'n_docs' AS metric, count(*)::DOUBLE AS v FROM documents WHERE n_chars > 500 GROUP BY lang UNION ALL SELECT lang, 'mean_chars', avg(n_chars) FROM documents WHERE n_chars > 500 GROUP BY lang)
  SELECT coalesce(s.lang, z.lang) AS lang, coalesce(s.metric, z.metric) AS metric, round(s.v, 6) AS strict_value, round(z.v, 6) AS fuzzy_value, round(z.v - s.v, 6) AS delta FROM s FULL JOIN z ON s.lang = z.lang AND s.metric = z.metric""")
def strict_vs_fuzzy_delta(spark, sf):
    d = load(spark, sf, "documents")
    melt = lambda x, name: x.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("n_chars").alias("mean_chars")).unpivot(["lang"], ["n_docs", "mean_chars"], "metric", name)
    j = melt(d, "strict_value").join(melt(d.filter("n_chars > 500"), "fuzzy_value"), ["lang", "metric"], "full")
    return rounded(j.withColumn("delta", F.col("fuzzy_value") - F.col("strict_value")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def partitioned_round_trip(spark, sf):
    """Written partitioned and read back with one partition: the filter prunes the others."""
    path = new_path(spark, "nation")
    n = load(spark, sf, "nation")
    io.write_table(n, path, partition_by=["n_regionkey"], order=["n_nationkey"], dedupe=["n_nationkey"])
    return spark.read.schema(n.schema).parquet(path).filter("n_regionkey = 1").select("n_nationkey", "n_name", "n_regionkey")


@query("""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%dT%H:%M:%S') AS window_start, event_type, count(*) AS n_events FROM events GROUP BY ALL""")
def event_windows(spark, sf):
    a = activity(load(spark, sf, "events"))
    return a.select(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "event_type", "n_events")


@query(f"""WITH {_BASE} SELECT source, count(*) AS n, sum((toxic = 1)::INT)::BIGINT AS n_case, round(sum((toxic = 1)::INT) / nullif(count(toxic), 0), 6) AS case_rate, round(median(n_chars), 6) AS median_chars FROM b GROUP BY source""")
def repo_qa_summary(spark, sf):
    b = base(spark, sf)
    g = b.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("n_case"), F.count("toxic").alias("k"))
    middle = st.grouped_medians(b, ["source"], "n_chars").select(F.col("source").alias("_s"), F.col("median").alias("median_chars"))
    g = g.join(middle, F.col("source").eqNullSafe(F.col("_s")), "left")
    return rounded(g.select("source", "n", "n_case", safe_divide(F.col("n_case"), F.col("k")).alias("case_rate"), "median_chars"))
