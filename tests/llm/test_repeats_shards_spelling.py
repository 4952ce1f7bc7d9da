"""Periodic runs, rendezvous sharding and spelling variants: brute force, SQL, and awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.llm import repeats, sharding, spelling
from provenant.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(w, shortest=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(shortest, 2 * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 40), st.integers(1, 20), st.sampled_from([2, 3, 7, 12]))
def test_runs_are_brute_force_ones(w, a, p, shortest):
    w = [w[a + (i - a) % p] if a <= i and a + p <= len(w) else x for i, x in enumerate(w)]
    assert repeats.runs_of(w, shortest) == brute_runs(w, shortest)


def test_runs_of_long_texts():
    random.seed(3)
    block = [str(random.randrange(10**6)) for _ in range(300)]
    w = [*block, *block[:150] * 7, "x", *["la"] * 500, *block]
    assert repeats.runs_of(w) == brute_runs(w)
    assert repeats.runs_of(["a"] * 20_000) == [(0, 20_000, 1)]
    assert repeats.runs_of([str(i) for i in range(200_000)]) == []


def test_op11(spark):
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows) and any(r["n_runs"] for r in got.values())
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + math.floor((len(w) - a) / (3 + g % 8))
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want = dict(doc_id=i, n_runs=len(runs), start=top[0], length=top[1], period=top[2], exponent_milli=top[1] and 1000 * top[1] // top[2])
        want["runs_sha256"] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        want["collapsed_sha256"] = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        assert want == {k: got[i][k] for k in want}


AWKWARD = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (None, "a b " * 10, 5), (4, "a b " * 10, 5), (4, "a b " * 10, 5), (5, "one word only", 5), (6, "x " * 5000 + "y", 5)]


def test_periodic_runs_on_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, runs long")
    got = repeats.periodic_runs(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "runs", "n_words", "_runs", "collapsed_text"}
    by = {(r["doc_id"], r["text"]): (r["n_words"], [tuple(x) for x in r["_runs"]], r["collapsed_text"]) for r in got}
    assert len(got) == len(AWKWARD) and by[(1, None)] == by[(2, "")] == by[(3, " \t\n")] == (0, [], "")
    assert by[(4, "a b " * 10)] == by[(None, "a b " * 10)] == (20, [(0, 20, 2)], "a b") and by[(6, "x " * 5000 + "y")] == (5001, [(0, 5000, 1)], "x y")
    assert by[(5, "one word only")][0] == 2
    empty = repeats.periodic_runs(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "runs", "n_words", "_runs", "collapsed_text"]


def test_shards_move_only_to_the_new_one(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    got = sharding.with_shards(keys, ["a", "b", "c"], weights=[1.0, 1.0, 2.0], more=["d"]).toPandas()
    assert (((got.grown_shard == got["shard"]) | (got.grown_shard == 3)).all()) and abs((got.grown_shard == 3).mean() - 0.2) < 0.02
    assert all(abs((got["shard"] == k).mean() - w / 4) < 0.02 for k, w in enumerate((1, 1, 2)))
    # without a shard only its own keys move
    less = sharding.with_shards(keys, ["a", "c"], weights=[1.0, 2.0]).toPandas().set_index("doc_id")["shard"].map({0: 0, 1: 2})
    same = got.set_index("doc_id")["shard"]
    assert (less[same != 1] == same[same != 1]).all()
    for bad in ({"weights": [1.0]}, {"weights": [1.0, 0.0]}):
        with pytest.raises(ValueError):
            sharding.with_shards(keys, ["a", "b"], **bad)
    with pytest.raises(ValueError):
        sharding.with_shards(keys, ["a", "a"])


def test_slots_have_no_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(None, "x", 1)] * 60 + [(7, "y", None)] * 3 + [(k, f"t{k}", k) for k in range(200)] + [(5, None, 1), (5, "", 1)]
    df = sharding.with_shards(spark.createDataFrame(rows, "doc_id long, text string, slot long"), [str(k) for k in range(5)])
    got = sharding.with_slots(df, ["shard"], spread_by=F.md5(F.to_json(F.struct("doc_id", "text", "slot")).cast("binary")))
    out = got.collect()
    assert got.columns == ["doc_id", "text", "slot", "shard", "_slot"] and collections.Counter((r[0], r[1], r[2]) for r in out) == collections.Counter(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 5
    key_shards = {(r["doc_id"], r["shard"]) for r in out}
    assert len(key_shards) == len({k for k, _ in key_shards})
    assert sharding.with_slots(df.limit(0), ["shard"], spread_by=F.lit("0")).count() == 0
    sharding.write_shards(got.drop("slot").withColumnRenamed("_slot", "slot"), str(tmp_path / "s"), rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and {r["shard"] for r in back.select("shard").distinct().collect()} == set(by)


def test_op12(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_rendezvous_sharding"](spark, SF).collect()}
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        data = (t or "").encode()
        drawn = [-1 / math.log((int(hashlib.md5(f"{i}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for k in range(17)]
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == drawn.index(max(drawn[:16])) and r["grown_shard"] == drawn.index(max(drawn))


def brute_variants(counts, factor=5):
    v = dict(counts)
    near = {w: set() for w in v}
    for a in v:
        for b in v:
            if a != b and abs(len(a) - len(b)) <= 1:
                k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                if a[k + 1 :] == b[k + 1 :] and len(a) == len(b) or a[k + 1 :] == b[k:] and len(a) > len(b) or a[k:] == b[k + 1 :] and len(a) < len(b):
                    near[a].add(b)
    form = {w: (best if (best := min(near[w], key=lambda x: (-v[x], x), default=None)) and v[best] >= factor * v[w] else None) for w in v}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near[w]), form[w], form[w] and v[form[w]], root(w)) for w, n in v.items()}


def variants_of(spark, rows):
    vocab = spark.createDataFrame(rows, "word string, n long")
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.grouped(vocab, spelling.near_words(vocab)).collect()}


def test_variants_are_brute_force_ones(spark):
    random.seed(5)
    words = {"".join(random.choice("abé") for _ in range(random.randint(1, 6))) for _ in range(250)}
    long = "".join(random.choice("abcdefgh") for _ in range(3000))
    words |= {long, long[:1000] + long[1001:], long[:2000] + "z" + long[2001:], long + "q", "y" * 5000, "naïves", "naives", "naive", "çava×÷", "çava×"}
    rows = [(w, random.choice([5, 5, 6, 25, 30, 150, 900, 5000])) for w in sorted(words)]
    assert variants_of(spark, rows) == brute_variants(rows)
    # a map that lets everything through changes nothing
    assert variants_of(spark, rows[:1]) == brute_variants(rows[:1]) and variants_of(spark, []) == {}


def test_variants_with_a_full_map(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MAP_BITS", 6)
    rows = [(f"word{k:03d}", 5 * 7 ** (k % 3)) for k in range(300)]
    assert variants_of(spark, rows) == brute_variants(rows)
    with pytest.raises(ValueError):
        spelling.grouped(spark.createDataFrame(rows, "word string, n long"), None, factor=1)


def test_words_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "ABCdef ÉCOLES"), (3, "x" * 400_000), (4, "don't9stopping"), (4, "don't9stopping")]
    got = spelling.word_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["id"], r["run"]) for r in got) == collections.Counter([(None, "abcdef"), (None, "ÉcolES".lower().replace("é", "É")), (3, "x" * 400_000), (4, "stopping"), (4, "stopping")])
    typo = spelling.with_typos(spark.createDataFrame([(None, "abcdef")] + [(i, "abcdef") for i in range(2000)], "id long, run string"))
    want = collections.Counter()
    for i in ["", *range(2000)]:
        h = zlib.crc32(f"{i}:abcdef".encode())
        want["abcdef" if h % 199 else "abcdef"[: h % 6] + "abcdef"[h % 6 + 1 :]] += 1
    assert collections.Counter(r["word"] for r in typo.collect()) == want and len(want) > 1
    assert spelling.vocabulary(typo.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_rendezvous_sharding", "op13_spelling_variants"])
def test_new_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    have = sorted((tuple(r) for r in got.select(*cols).collect()), key=repr)
    assert have and have == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
