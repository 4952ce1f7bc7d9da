"""Operators on small rows whose results are known."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from provenant.functions import numbers as nm
from provenant.functions import text as tx
from provenant.operators import cohort as co
from provenant.operators import discussion as d
from provenant.operators import identity as idn
from provenant.operators import ownership as ow
from provenant.operators import similarity
from provenant.operators import statistics as st
from provenant.operators import tables as tb
from provenant.sources import io
from provenant.streaming import windows


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr.alias("x")).first()["x"]


def test_polarity_default_lexicon(spark):
    score = lambda t: one(spark, tx.polarity("t"), t=t).asDict()
    assert score("") == {"neg": 0.0, "neu": 1.0, "pos": 0.0, "compound": 0.0}
    assert score("This is good")["compound"] == 0.5
    assert score("not good")["compound"] == -0.5
    assert math.isclose(score("very bad, great")["compound"], (1 - 1.5) / 3.5)
    assert score("good bad")["neu"] == 0.0


def test_cleaning(spark):
    assert one(spark, tx.clean_text("t"), t="  a \n") == "a"
    assert one(spark, tx.clean_text("t"), t=" \n ") is None
    assert one(spark, tx.has_real_value("t"), t=" NaN ") is False
    assert one(spark, tx.normalize_label("t"), t="Won’t-Fix_ now") == "wont fix now"
    assert one(spark, tx.parse_labels("t"), t="['Bug', 'UI ']") == ["bug", "ui"]
    assert one(spark, tx.parse_labels("t"), t="Bug|UI;x") == ["bug", "ui", "x"]
    assert one(spark, tx.clip_snippet("t"), t="a" * 300) == "a" * 237 + "..."
    assert one(spark, tx.login_of_noreply("t"), t="12+Some-One@users.noreply.github.com") == "some-one"
    assert one(spark, tx.bot_flag(F.col("t")), t="Abbott") is True


def test_references_and_mentions(spark):
    body = "Fixes #12 and o/r#7; see gh-9. Also closes: #12, #30\nresolves nothing"
    assert one(spark, tx.issue_references("t"), t=body) == [12, 7, 9, 30]
    assert one(spark, tx.closing_references("t"), t=body) == [12, 7, 30]
    assert one(spark, tx.file_mentions("t"), t="see `src/a.py`, ./lib/b.c and main.go.") == ["src/a.py", "lib/b.c", "main.go"]


def plain_jaro_winkler(s, t):
    if s == t:
        return 1.0 if s else 0.0
    reach, free, mine = max(max(len(s), len(t)) // 2 - 1, 0), list(t), []
    places = []
    for i, ch in enumerate(s):
        j = next((j for j in range(max(0, i - reach), min(len(t), i + reach + 1)) if free[j] == ch), None)
        if j is not None:
            free[j] = None
            mine.append(ch)
            places.append(j)
    if not mine:
        return 0.0
    moved = sum(x != t[j] for x, j in zip(mine, sorted(places), strict=True)) / 2
    jaro = (len(mine) / len(s) + len(mine) / len(t) + (len(mine) - moved) / len(mine)) / 3
    prefix = next((k for k in range(min(4, len(s), len(t))) if s[k] != t[k]), min(4, len(s), len(t)))
    return jaro + 0.1 * prefix * (1 - jaro)


def test_jaro_winkler(spark):
    import random

    random.seed(2)
    words = ["martha", "marhta", "dixon", "dicksonx", "same", "é😀a", "a", "", *("".join(random.choice("abcd ") for _ in range(random.randint(1, 12))) for _ in range(60))]
    rows = [(a, b) for a in words for b in words] + [(None, "x")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", tx.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r["s"] - (plain_jaro_winkler(r["a"], r["b"]) if r["a"] else 0.0)) < 1e-12 for r in got)
    known = {(r["a"], r["b"]): round(r["s"], 4) for r in got}
    assert known[("martha", "marhta")] == 0.9611 and known[("dixon", "dicksonx")] == 0.8133 and known[(None, "x")] == 0.0


@pytest.mark.parametrize("at", [0.94, 0.9])
def test_similar_values_are_all_pairs(spark, at):
    import random

    random.seed(int(at * 100))
    base = ["jon smith", "john smith", "john smyth", "maria de la cruz", "x", "ab", "abc", "abd", "Zoë Ünal", "a b c d e f g h i j k l m n o p q r s t u v w x y z"]
    names = set(base)
    for b in [*base, *("".join(random.choice("abcdefgh ") for _ in range(random.randint(2, 18))) for _ in range(25))] * 6:
        t = list(b)
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(t) + 1)
            t[i : i + random.randint(0, 1)] = random.choice(["", "a", "e", "z"])
            if len(t) > 3 and random.random() < 0.5:
                j = random.randrange(len(t) - 1)
                t[j], t[j + 1] = t[j + 1], t[j]
        names.add("".join(t))
    names = sorted(names - {""})
    rows = [(s, n) for s in (1, None) for n in names] + [(2, "jon smith"), (1, None), (1, ""), (1, names[0])]
    got = similarity.similar_values(spark.createDataFrame(rows, "repo int, name string"), "repo", "name", at).collect()
    want = {(s, a, b) for s in (1, None) for a in names for b in names if a < b and plain_jaro_winkler(a, b) >= at}
    assert len(got) == len(want) and {(r["scope"], r["left"], r["right"]) for r in got} == want and len(want) > 50


def test_similar_pairs_and_long_names(spark):
    long = "ab cd" * 60
    rows = [(1, 1, "jon smith"), (1, 2, "john smith"), (1, 3, "john smyth"), (1, 4, "jon smith"), (2, 5, "jon smith"), (1, 6, long), (1, 7, long + "x"), (1, 8, None), (1, 1, "someone else")]
    df = spark.createDataFrame(rows, "repo int, k int, name string")
    got = {(r["a"], r["b"]): round(r["similarity"], 4) for r in similarity.similar_pairs(df, "k", "name", "repo", 0.94).collect()}
    assert {p for p in got if max(p) < 6} == {(1, 2), (1, 4), (2, 3), (2, 4)} and got[(1, 4)] == 1.0 and (6, 7) in got
    assert similarity.similar_pairs(df.limit(0), "k", "name", "repo").count() == 0


def test_rows_that_name_the_same_third_are_no_pair(spark):
    rows = spark.createDataFrame([(1, 1, "u", None), (1, 2, None, "u"), (1, 3, None, "u")], "scope int, key int, login string, hidden string")
    assert {tuple(r) for r in idn.candidate_pairs(rows, {"login": (("login",), ("hidden",))}).collect()} == {(1, 1, 2), (1, 1, 3)}


def test_numbers(spark):
    assert one(spark, nm.safe_divide(F.col("a"), F.col("b"), 0.0), a=1, b=0) == 0.0
    assert one(spark, nm.churn_weight(F.col("a"), F.col("b").cast("int")), a=-3, b=2) == 5.0
    assert one(spark, nm.count_bin(F.col("a"), [0, 1, 3, 6]), a=4) == "3-5"
    assert one(spark, nm.confidence_rank(F.col("a")), a="High") == 4


def test_issue_without_resolved_commenters(spark):
    issues = spark.createDataFrame([(1, "u"), (2, "u"), (3, None)], "issue int, issue_author string")
    comments = spark.createDataFrame([(1, 1, None), (3, 1, "a"), (3, 2, "b"), (3, 3, "a")], "issue int, seq int, author string")
    got = {r["issue"]: r for r in d.issue_participation(issues, comments).collect()}
    assert [got[i]["participation_coverage_flag"] for i in (1, 2, 3)] == ["no_resolved_comment_authors", "zero_comments", "missing_issue_author_key"]
    assert got[1]["single_commenter_flag"] is None and got[3]["issue_author_commented_flag"] is None
    assert got[3]["top_commenter_share"] == 2 / 3 and got[3]["num_distinct_non_author_commenters"] == 2


def test_entropy_and_continuity(spark):
    e = spark.createDataFrame([("i", "a", 1.0, 1), ("i", "b", 1.0, 2)], "issue string, c string, churn double, sha int")
    assert math.isclose(ow.concentration(e, "issue", "c", "churn", "sha").first()["churn_entropy"], math.log(2))
    r = spark.createDataFrame([("i", "a", "pre_issue"), ("i", "a", "post_issue"), ("i", "b", "post_issue")], "issue string, c string, bucket string")
    assert ow.continuity(r, "issue", "c", "bucket").first()["owner_jaccard"] == 0.5


def test_greedy_controls_equal_a_loop(spark):
    rows = [("r", i, i * 86400 * 3, i % 4 == 0, "k%d" % (i % 2), i % 5, i % 3 == 0, "open") for i in range(40)]
    df = spark.createDataFrame(rows, "repo string, issue int, s long, is_case boolean, kind string, comments int, linked boolean, bucket string").withColumn("created", F.timestamp_seconds("s")).drop("s")
    scored = co.candidates(df, 30)
    got = sorted((r["case_issue"], r["control_issue"]) for r in co.greedy_controls(scored).collect())
    used, want = set(), []
    for case in sorted(r[1] for r in rows if r[3]):
        own = sorted(((r["score"], not r["q_linked"], r["q_comments"], r["q_created"], r["q_issue"]) for r in scored.filter(F.col("p_issue") == case).collect()))
        for o in [o for o in own if o[4] not in used][:3]:
            used.add(o[4])
            want.append((case, o[4]))
    assert got == sorted(want)


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_clusters_of_long_chains_and_stars(spark, monkeypatch, few):
    """Chains of 3,000 nodes in random order, a star, loops, copies of links and links to what is no node; the tables that are written are few."""
    import random

    written, keep = [], idn.stored
    monkeypatch.setattr(idn, "stored", lambda df, name: written.append(name) or keep(df, name))
    random.seed(5)
    names = random.sample(range(100_000), 9_000)
    edges = [(a, b) for chain in (names[:3000], names[3000:6000]) for a, b in zip(chain, chain[1:], strict=False)] + [(names[6000], n) for n in names[6001:7000]] + [(n, n) for n in names[7000:7100]]
    edges += [(b, a) for a, b in edges[:500]] + edges[:200] + [(names[0], -1), (-1, names[3000])]
    nodes = spark.createDataFrame([(n,) for n in names], "node long")
    got = {r["node"]: r["cluster"] for r in idn.clusters(spark, nodes, spark.createDataFrame(edges, "a long, b long"), few).collect()}
    want = {n: n for n in names} | {n: min(part) for part in (names[:3000], names[3000:6000], names[6000:7000]) for n in part}
    assert got == want and len(written) < 60


def test_clusters(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a int, b int")
    got = {r["node"]: r["cluster"] for r in idn.clusters(spark, nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    small = idn.without_large(spark.createDataFrame(list(got.items()), "node int, cluster int"), most=3)
    assert {r["node"]: r["cluster"] for r in small.collect()}[3] == 3


def test_pairs_of_single_rows_equal_those_of_sets(spark):
    """Pairs by shared and alike values, each once, with the scores that sets of one value give."""
    import random

    random.seed(11)
    pick = random.choice
    login = lambda: pick([None, None, *(f"u{i}" for i in range(8))])
    rows = [(pick(["s", "t"]), k, pick(["ann lee", "ann lea", "anne lee", "bob ray", "bob rai", "cy", None]), login(), pick([None, f"m{k % 7}"]), login(), login(), k % 4, login(), k % 2, [k % 5, 10 + k % 3], k % 9 == 0) for k in range(120)]
    df = spark.createDataFrame(rows, "scope string, key long, typed string, login string, email string, noreply string, pr string, pr_count long, talk string, source long, issues array<long>, bot boolean")
    df = df.withColumn("name", F.when(F.col("key") % 5 > 0, F.col("typed")))
    keys = {"email": ("email", ()), "login": ("login", ("noreply", "pr"))}
    of = F.when(F.col("l_name").isNotNull() & F.col("r_name").isNotNull(), F.col("similarity")).otherwise(0.0)
    single = idn.single_pairs(df, keys, "typed", 0.9, of >= 0.9).withColumn("name_similarity", of).withColumn("localpart_similarity", F.lit(0.0))
    columns = ["scope", "a", "b", "name_similarity", "score", "families", "decision", "admitted_by"]
    got = idn.pair_decisions(idn.single_signals(single, name_at=0.9).withColumnsRenamed({"l_key": "a", "r_key": "b"})).select(*columns)
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    counts = lambda c, n: F.when(F.col(c).isNotNull(), F.create_map(c, n)).otherwise(F.create_map().cast("map<string,bigint>"))
    sets = df.select("key", some("email").alias("emails"), some("login").alias("logins"), some("noreply").alias("noreply"), some("name").alias("names"), F.array("source").alias("sources"), "issues", counts("pr", F.col("pr_count")).alias("pr"), counts("talk", F.lit(1).cast("long")).alias("talk"), "bot")
    side = lambda p, key: sets.select(F.col("key").alias(key), *(F.col(c).alias(f"{p}{c}") for c in sets.columns[1:]))
    pairs = idn.candidate_pairs(df, {"email": (("email",), ()), "login": (("login",), ("noreply", "pr"))}, {"name": 0.9}).join(side("l_", "a"), "a").join(side("r_", "b"), "b")
    pairs = pairs.withColumn("name_similarity", idn.best_similarity(F.col("l_names"), F.col("r_names"))).withColumn("localpart_similarity", F.lit(0.0))
    want = idn.pair_decisions(idn.pair_scores(pairs, name_at=0.9)).select(*columns)
    have = sorted(map(tuple, got.collect()), key=repr)
    assert have == sorted(map(tuple, want.collect()), key=repr) and len(have) > 200
    assert not any(n in got._jdf.queryExecution().optimizedPlan().toString() for n in ("Aggregate", "Deduplicate"))  # pairs leave their joins as they are


def test_similar_pairs_of_keys_with_one_name_and_more(spark):
    rows = [("s", k, n) for k in range(60) for n in [("ann lee", "ann lea", "bob ray")[k % 3], ("ann lee", "bob rai")[k % 2]][: 1 + (k % 4 == 0)]] + [(None, 1, "cy"), (None, 2, "cy"), ("s", 99, "")]
    got = similarity.similar_pairs(spark.createDataFrame(rows, "scope string, k int, name string"), "k", "name", "scope", 0.9).collect()
    jw = {tuple(r)[:2]: r["v"] for r in spark.createDataFrame([(a, b) for _, _, a in rows for _, _, b in rows], "a string, b string").distinct().withColumn("v", tx.jaro_winkler(F.col("a"), F.col("b"))).collect()}
    want = {}
    for s, a, n in rows:
        for t, b, m in rows:
            if s == t and a < b and n and m and (v := jw[min(n, m), max(n, m)]) >= 0.9:
                want[s, a, b] = max(v, want.get((s, a, b), 0))
    assert {tuple(r)[:3]: r["similarity"] for r in got} == want and len(got) == len(want)
    one = similarity.similar_pairs(spark.createDataFrame(rows, "scope string, k int, name string").filter("k % 4 > 0"), "k", "name", "scope", 0.9, digits=3)
    assert one.count() == len({p for p in want if p[1] % 4 and p[2] % 4})


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (0, 2.0), (0, 3.0)], "g int, x double")
    r = st.rank_statistics(df, "g", "x").first()
    pairs = [(a > b) - (a < b) for a in (1, 2, 2) for b in (2, 3)]
    assert math.isclose(r["cliffs_delta"], sum(pairs) / 6)
    bh = st.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double"), "p")
    assert [None if r["p"] is None else (r["p"], round(r["p_adj"], 6)) for r in sorted(bh.collect(), key=lambda r: (r["p"] is None, r["p"]))] == [(0.01, 0.03), (0.03, 0.04), (0.04, 0.04), None]
    two = spark.createDataFrame([("r", 1.0, 1.0)] * 3 + [("r", 0.0, 1.0)] + [("r", 1.0, 0.0)] + [("r", 0.0, 0.0)] * 3 + [("all one", 1.0, 1.0)] * 4, "repo string, y double, x double")
    (r,) = st.logit_by_group(two, "y", "x", "repo").collect()
    assert r["repo"] == "r" and math.isclose(r["intercept"], math.log(1 / 3), abs_tol=1e-6) and math.isclose(r["slope"], math.log(9), abs_tol=1e-6)
    assert math.isclose(st.odds_two_by_two(3, 1, 1, 3), 0.4857142857, abs_tol=1e-9) and st.odds_two_by_two(0, 0, 0, 0) == 1.0
    assert math.isclose(spark.range(1).select(st.two_sided_normal(F.lit(1.959963985))).first()[0], 0.05, rel_tol=1e-5)


def test_rank_statistics_over_many_ranges(spark):
    """Equal to a plain loop with eight partitions, adaptive execution on and off."""
    import random

    rng = random.Random(1)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 400))) for _ in range(3000)]
    a, b = sorted(x for g, x in rows if g), sorted(x for g, x in rows if not g)
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    ps = [rng.random() ** 2 for _ in range(500)] + [0.25] * 20
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    want, least = {}, 1.0
    for r in range(len(ps), 0, -1):
        least = min(least, ps[order[r - 1]] * len(ps) / r)
        want[order[r - 1]] = least
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for aqe in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            r = st.rank_statistics(spark.createDataFrame(rows, "g int, x double").repartition(5), "g", "x").first()
            assert r["mann_whitney_u"] == u and math.isclose(r["cliffs_delta"], 2 * u / (len(a) * len(b)) - 1)
            got = st.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double").repartition(5), "p").collect()
            assert len(got) == len(ps) and all(math.isclose(x["p_adj"], want[x["i"]], abs_tol=1e-12) for x in got)
            c = st.spearman(spark.createDataFrame([(x, x * x + 1) for _, x in rows], "x double, y double"), "x", "y").first()
            assert math.isclose(c["spearman"], 1.0)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_parsers_on_awkward_text(spark):
    refs = lambda t: one(spark, tx.issue_references("t"), t=t)
    assert refs("see https://github.com/o/r/issues/41, #12345678901234567890 and GH-3") == [41, 3]
    assert one(spark, tx.closing_references("t"), t="Closes https://github.com/o/r/issues/8") == []  # a clause ends at a full stop
    assert one(spark, tx.parse_labels("t"), t='["won\'t fix", "Bug"]') == ["won't fix", "bug"]
    assert one(spark, tx.parse_labels("t"), t="['it\\'s', \"a'b\"]") == ["it's", "a'b"]
    assert one(spark, tx.parse_labels("t"), t="[open, b]") == ["[open", "b]"]
    assert one(spark, tx.parse_labels("t"), t="[]") == [] == one(spark, tx.parse_labels("t"), t=" ")
    assert one(spark, tx.normalize_label("t"), t="Won`t\u2010Fix") == "wont fix"
    ambiguous = lambda t: one(spark, tx.is_ambiguous_name(F.col("t")), t=t)
    assert [ambiguous(x) for x in ("renovate", "bob", "dev", "none", "jo lee", "li")] == [True, True, True, False, False, True]


def test_bots_keep_their_own_identity(spark):
    rows = spark.createDataFrame([(1, "ann", "a@x", "ann lee"), (2, None, "a@x", "tool[bot]"), (3, "ci-bot", "b@x", None), (4, None, "b@x", "carl poe")], "row_id int, login string, email string, name string")
    got = {r["row_id"]: r["identity"] for r in idn.strict_identities(rows).collect()}
    assert got == {1: "login:ann", 2: "email:a@x", 3: "login:ci-bot", 4: "email:b@x"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g int, x double")
    assert st.rank_statistics(empty, "g", "x").first()["cliffs_delta"] is None
    assert tb.missingness(empty, ["g", "x"]).count() == 2
    assert d.comment_features(spark.createDataFrame([], "issue int, seq int, author string, body string")).count() == 0


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b", 'x"y\nz'), (2, "a/b", None), (2, "a/b", "later"), (3, "c/d", "w")], "id int, repo_full_name string, v string")
    io.write_table(df, f"{tmp_path}/t", partition_by=["repo_full_name"], dedupe=["id"], order=["id", "v"])
    assert sorted(r["id"] for r in io.read_repo(spark, f"{tmp_path}/t", "a/b").collect()) == [1, 2]
    io.write_table(df, f"{tmp_path}/c.csv", "csv")
    assert io.read_table(spark, f"{tmp_path}/c.csv").count() == 4
    assert io.read_if_exists(spark, f"{tmp_path}/none", "a int").count() == 0
    assert io.repo_filter(df, "c/d").count() == 1 and io.repo_filter(df.drop("repo_full_name"), "c/d").count() == 0
    io.write_manifest(spark, f"{tmp_path}/m", {"rows": 4})
    assert io.merge_groups([df, df.drop("v")]).count() == 8


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(1700000000 + id * 600) as ts, if(id % 2 = 0, 'a', 'b') as event_type from range(60)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windows.activity(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("act")) == key(windows.activity(rows))


def test_rank_tests_equal_known_values(spark):
    """H and W of small groups worked out by hand; p of W by the normal approximation."""
    h = st.kruskal_wallis(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 5.0), ("c", 6.0), (None, 9.0), ("a", None)], "g string, v double"), "g", "v").first()
    assert (h["n_groups"], h["n"], h["df"]) == (3, 6, 2) and abs(h["kruskal_h"] - 32 / 7) < 1e-9
    pairs = [("x", 3.0, 1.0), ("x", 1.0, 2.0), ("x", 5.0, 2.0), ("x", 4.0, 4.0), ("y", 1.0, 3.0), ("y", 3.0, 1.0), (None, 1.0, 0.0)]
    w = {r["g"]: r for r in st.wilcoxon(spark.createDataFrame(pairs, "g string, l double, e double"), "l", "e", "g").collect()}
    assert (w["x"]["n_pairs"], w["x"]["wilcoxon_w"]) == (3, 1.0) and (w["y"]["n_pairs"], w["y"]["wilcoxon_w"]) == (2, 1.5)
    assert abs(w["y"]["wilcoxon_p"] - 1) < 1e-6
    assert st.kruskal_wallis(spark.createDataFrame([], "g string, v double"), "g", "v").first()["kruskal_h"] is None


def test_quantiles_are_exact_over_many_ranges(spark):
    import numpy as np

    values = [float((i * 7919) % 1009) / 3 for i in range(4000)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(8)
    got = tb.quantiles(df, "v", [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]).first()["q"]
    assert np.allclose(got, np.quantile(values, [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]), atol=1e-9)
    assert tb.quantiles(df.filter("v < 0"), "v", [0.5]).first()["q"] == [None]


def test_fallback_by_number_and_screen_limits(spark):
    from provenant.operators import dataset as ds

    base = spark.createDataFrame([(1, "a", 1, "keep"), (1, None, 2, "keep"), (1, "c", None, "keep"), (2, "a", 1, "keep")], "repo int, issue_id string, issue_number int, own string")
    more = spark.createDataFrame([(1, "a", None, 10, "x"), (1, None, 2, 20, "x"), (1, None, 1, 30, "x")], "repo int, issue_id string, issue_number int, v int, own string")
    got = {(r["repo"], r["issue_id"], r["issue_number"]): (r["v"], r["own"]) for r in ds.merge_by_id_or_number(base, more).collect()}
    assert got == {(1, "a", 1): (10, "keep"), (1, None, 2): (20, "keep"), (1, "c", None): (None, "keep"), (2, "a", 1): (None, "keep")}
    rows = spark.createDataFrame([("a", 5), ("b", 2), ("c", 9)], "k string, n int")
    assert [r["k"] for r in ds.count_screen(rows, "n", 3, ["n"], "k", None).collect()] == ["c", "a"]
    assert [r["k"] for r in ds.count_screen(rows, "n", 3, ["n"], "k", 1).collect()] == ["c"]


def test_differences_hold_null_keys_and_emotions_fall_back(spark):
    from provenant.operators import participants as pt

    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "sha string")
    b = spark.createDataFrame([("y",), ("z",)], "sha string")
    assert {tuple(r) for r in pt.differences(a, b, ["sha"]).collect()} == {("x", "first"), (None, "first"), ("z", "second")}
    e = spark.createDataFrame([("comment", "joy"), ("comment", None), ("summary", "anger")], "level string, emotion string")
    assert [r["emotion"] for r in pt.issue_emotions(e).collect()] == ["anger"]
    assert [r["emotion"] for r in pt.issue_emotions(e.filter("level = 'comment'")).collect()] == ["joy"]


def test_roles_of_issues_without_comments_or_history(spark):
    from provenant.operators import participants as pt

    issues = spark.createDataFrame([(1, "a"), (2, None)], "issue int, author string")
    comments = spark.createDataFrame([(1, 1, "b"), (1, 2, None), (1, 3, "b"), (1, 4, "a")], "issue int, seq int, author string")
    roles = spark.createDataFrame([(1, "b", 5, 2, 1, 0.5, 1)], "issue int, contributor string, commits int, days int, rank int, share double, major int")
    got = {r["issue"]: r for r in pt.participant_roles(issues, comments, roles).collect()}
    one, two = got[1], got[2]
    assert (one["author_is_major"], one["commenter_count"], one["major_commenter_count"], one["top_commenter_is_major"]) == (0, 2, 1, 1)
    assert abs(one["comment_share_by_major"] - 2 / 3) < 1e-9 and one["major_commenter_share"] == 0.5
    assert (two["commenter_count"], two["any_commenter_is_major"], two["major_commenter_share"]) == (0, 0, None)
