"""Similarity joins of names by Jaro-Winkler, without comparing all pairs and without losing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.functions.text import jaro_winkler
from provenant.sources.scratch import stored

#: Common prefixes are looked at by their least and greatest length; the prefix counts up to 4 characters.
PREFIXES = ((0, 0), (1, 2), (3, 4))
#: Above so many letters that may differ, groups of letters tell little (names of some 45 letters): the block is the prefix and the lengths alone.
MOST_DIFFERENT = 14


def _least_jaro(at: float, prefix: int) -> float:
    """The Jaro similarity that a pair with so long a common prefix needs for a Jaro-Winkler similarity."""
    return (at - 0.1 * prefix) / (1 - 0.1 * prefix)


def block_keys(values: DataFrame, at: float) -> DataFrame:
    """values (scope, name, distinct) with block: two names of a scope that are alike have a block in common.

    A Jaro similarity of j asks that m of the characters match with m / |s| + m / |t| >= 3 j - 1. So for each pair of lengths the names differ in d characters at most,
    counting both sides. Dealt by their code to d + 2 groups, the characters of two groups at least are the same in both names, as a bag. A block is the common prefix,
    both lengths, and the bags of two groups (of all, where no character may differ; none, where more than MOST_DIFFERENT may).
    """
    chars = values.withColumn("n", F.length("name")).withColumn("cs", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring(F.col("name"), i, F.lit(1))))
    lengths = values.select(F.length("name").alias("m")).distinct()
    classes = F.array(*(F.struct(F.lit(lo).alias("p"), F.lit(_least_jaro(at, hi)).alias("j")) for lo, hi in PREFIXES if _least_jaro(at, hi) > 0))
    rows = chars.withColumn("c", F.explode(classes)).filter("n >= c.p")
    # 1 + shorter / longer >= 3 j - 1
    ratio = F.greatest(3 * F.col("c.j") - 2, F.lit(0.01))
    reach = F.sequence(F.ceil(F.col("n") * ratio - 1e-9).cast("int"), F.floor(F.col("n") / ratio + 1e-9).cast("int"))
    rows = rows.withColumn("m", F.explode(reach)).join(lengths, "m")  # lengths that some name has
    need = F.ceil((3 * F.col("c.j") - 1) * F.col("n") * F.col("m") / (F.col("n") + F.col("m")) - 1e-9)
    rows = rows.withColumn("d", (F.col("n") + F.col("m") - 2 * need).cast("int")).filter((need <= F.col("n")) & (need <= F.col("m")))
    some = (F.col("d") > 0) & (F.col("d") <= MOST_DIFFERENT)
    groups = F.when(some, F.col("d") + 2).otherwise(F.lit(1))
    bags = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.array_join(F.array_sort(F.filter("cs", lambda x: F.pmod(F.ascii(x), groups) == g)), ""))
    rows = rows.withColumn("bags", bags)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.size("bags") - 2), lambda a: F.transform(F.sequence(a + 1, F.size("bags") - 1), lambda b: F.concat_ws("\x01", a.cast("string"), F.get("bags", a), b.cast("string"), F.get("bags", b)))))
    found = rows.withColumn("bag", F.explode(F.when(some, two).when(F.col("d") > 0, F.array(F.lit(""))).otherwise(F.col("bags"))))
    return found.select("scope", "name", F.struct(F.substring(F.col("name"), F.lit(1), F.col("c.p")).alias("prefix"), F.col("c.p").alias("p"), F.least("n", "m").alias("short"), F.greatest("n", "m").alias("long"), F.xxhash64("bag").alias("bag")).alias("block"))


def similar_values(rows: DataFrame, scope: str, name: str, at: float = 0.94) -> DataFrame:
    """scope, left, right (left < right), similarity: the different values of a scope with a Jaro-Winkler similarity of at least `at`.

    Null and empty values are like nothing. Each value counts once, however many rows have it.
    """
    values = rows.select(F.col(scope).alias("scope"), F.col(name).alias("name")).filter("name <> ''").distinct()
    keys = block_keys(values, at)
    a, b = keys.select("scope", F.col("name").alias("left"), "block"), keys.select("scope", F.col("name").alias("right"), "block")
    pairs = a.join(b, (a.block == b.block) & a["scope"].eqNullSafe(b["scope"]) & (F.col("left") < F.col("right"))).select(a["scope"], "left", "right").distinct()
    return pairs.withColumn("similarity", jaro_winkler(F.col("left"), F.col("right"))).filter(F.col("similarity") >= at)


def similar_links(rows: DataFrame, at: float) -> DataFrame:
    """x, y: the values that some scope of rows (scope, name) has both of and that have a similarity of at least `at`, in both orders, and each value with itself. Values of many scopes are compared once."""
    values = rows.filter("name <> ''").distinct()
    keys = block_keys(values, at)
    a, b = keys.select(F.col("scope").alias("s"), F.col("name").alias("x"), "block"), keys.select(F.col("scope").alias("t"), F.col("name").alias("y"), F.col("block").alias("other"))
    pairs = stored(a.join(b, (F.col("block") == F.col("other")) & F.col("s").eqNullSafe(F.col("t")) & (F.col("x") < F.col("y"))).select("x", "y").distinct(), "blocks")
    alike = pairs.filter((jaro_winkler(F.col("x"), F.col("y")) >= at) | (jaro_winkler(F.col("y"), F.col("x")) >= at))
    one = values.select(F.col("name").alias("x"), F.col("name").alias("y")).distinct()
    return stored(alike.select("x", "y", F.lit(True).alias("turn")).union(one.withColumn("turn", F.lit(False))).select(F.explode(F.when(F.col("turn"), F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).otherwise(F.array(F.struct("x", "y")))).alias("l")).select("l.x", "l.y"), "links")


def similar_pairs(rows: DataFrame, key: str, name: str, scope: str, at: float = 0.94, digits: int | None = None) -> DataFrame:
    """scope, a, b (a < b), similarity: the best similarity of any names of two keys of a scope, of at least `at`; equal names have 1. digits: rounded to so many.

    Two keys of one name each are a pair once at most, so these pairs, mostly all, leave their join as they are; only pairs of keys with more names are grouped.
    """
    named = rows.select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.col(name).alias("name")).filter("name <> ''").distinct()
    named = named.withColumn("names", F.count(F.lit(1)).over(Window.partitionBy("scope", "key")))
    alike = similar_values(named, "scope", "name", at)
    if digits is not None:
        alike = alike.withColumn("similarity", F.round("similarity", digits))
    alike = stored(alike, "alike")
    links = alike.union(alike.select("scope", F.col("right").alias("left"), F.col("left").alias("right"), "similarity")).union(named.select("scope", F.col("name").alias("left"), F.col("name").alias("right"), F.lit(1.0).alias("similarity")).distinct())
    left, right = (named.select(F.col("scope").alias(f"{p}s"), F.col("key").alias(into), F.col("name").alias(f"{p}n"), F.col("names").alias(f"{p}c")) for p, into in (("l", "a"), ("r", "b")))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return links.join(left, F.col("scope").eqNullSafe(F.col("ls")) & (F.col("left") == F.col("ln"))).join(right, F.col("scope").eqNullSafe(F.col("rs")) & (F.col("right") == F.col("rn")) & (F.col("a") < F.col("b") if left is one else F.col("a") != F.col("b")))

    one = left.filter("lc = 1")
    single = met(one, right.filter("rc = 1")).select("scope", "a", "b", "similarity")
    more = met(left.filter("lc > 1"), right).select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return single.union(more.groupBy("scope", "a", "b").agg(F.max("similarity").alias("similarity")))


def admission(*, talked: Column, shared_issues: Column, pr_bridge: Column, similar_name: Column, similar_localpart: Column) -> Column:
    """Why a pair that talked in the same issues is looked at; null if it isn't. With two shared issues or more the bridge by pull requests is asked first, else the names."""
    reason = lambda start, kinds: F.coalesce(*(F.when(c, F.lit(f"{start}_{n}")) for n, c in kinds))
    bridge, name, part = ("plus_pr_bridge", pr_bridge), ("plus_name_similarity", similar_name), ("plus_email_localpart_similarity", similar_localpart)
    few = reason("discussion", (name, part, bridge))
    return F.when(shared_issues >= 3, reason("discussion_three_plus_shared_issues", (bridge, name, part))).when(shared_issues >= 2, reason("discussion_two_shared_issues", (bridge, name, part))).when(talked | (shared_issues >= 1), few)
