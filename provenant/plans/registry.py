"""Registration of queries with their DuckDB equivalents, and how the given tables stand for issues and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A lexicon of words that the tables' texts hold; the default one has none of them.
LEXICON = {"positive": ["the", "and", "for", "was"], "negative": ["of", "to", "der", "la"], "intensifiers": ["a", "is"], "negators": ["in", "it"]}


def query(sql: str | None = None):
    """Register a function under its name; sql is the same query for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, name: str, *, placed: bool = False) -> DataFrame:
    """A table; its times as plain timestamps. placed: with the file and the row in it (in_file, in_row) that each row is from."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    at = [F.col("_metadata.file_path").alias("in_file"), F.col("_metadata.row_index").alias("in_row")] if placed else []
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes), *at)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def iso_times(df: DataFrame) -> DataFrame:
    """df with timestamps as ISO text, as reports keep them."""
    return df.select(*(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as issue comments: issue, seq, author, body."""
    c = load(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("issue"), (F.col("turn") + 1).cast("int").alias("seq"), F.col("role").alias("author"), F.col("text").alias("body"))


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a region as commits of a repository, with their lines as files: repo, sha, contributor, ts, file, churn."""
    o, li, c, n, r = (load(spark, sf, t) for t in ("orders", "lineitem", "customer", "nation", "region"))
    repos = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("repo"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(repos, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("repo", F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("contributor"), F.col("o_orderdate").alias("ts"), F.col("l_partkey").alias("file"), (F.abs("l_quantity") + F.abs("l_extendedprice")).alias("churn"))


COMMITS_SQL = "SELECT r_name AS repo, o_orderkey AS sha, o_custkey AS contributor, o_orderdate AS ts, l_partkey AS file, abs(l_quantity) + abs(l_extendedprice) AS churn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def polarity_sql(table: str, text: str, keep: str) -> str:
    """A subquery with keep, t (clean text), tok, sp, sn (weights of positive and negative hits), neg, neu, pos, compound."""
    lx = LEXICON
    hit = f"""(CASE WHEN tok[i] IN {_listed(lx['positive'])} THEN 1.0 WHEN tok[i] IN {_listed(lx['negative'])} THEN -1.0 ELSE 0.0 END)
      * (CASE WHEN i > 1 AND tok[i - 1] IN {_listed(lx['intensifiers'])} THEN 1.5 ELSE 1.0 END)
      * (CASE WHEN i > 1 AND tok[i - 1] IN {_listed(lx['negators'])} THEN -1.0 ELSE 1.0 END)"""
    return f"""(SELECT *, CASE WHEN sp + sn > 0 THEN sn / (sp + sn) ELSE 0.0 END AS neg,
      CASE WHEN sp + sn > 0 THEN greatest(0.0, 1.0 - least(1.0, sp / (sp + sn) + sn / (sp + sn))) ELSE 1.0 END AS neu,
      CASE WHEN sp + sn > 0 THEN sp / (sp + sn) ELSE 0.0 END AS pos,
      CASE WHEN sp + sn > 0 THEN (sp - sn) / (sp + sn + 1.0) ELSE 0.0 END AS compound
    FROM (SELECT *, coalesce(list_sum(list_filter(hits, lambda h: h > 0)), 0)::DOUBLE AS sp, -coalesce(list_sum(list_filter(hits, lambda h: h < 0)), 0)::DOUBLE AS sn
    FROM (SELECT *, list_transform(range(1, len(tok) + 1), lambda i: ({hit})::DOUBLE) AS hits
    FROM (SELECT *, list_transform(regexp_extract_all(t, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: lower(x)) AS tok
    FROM (SELECT {keep}, regexp_replace(coalesce({text}, ''), '^\\s+|\\s+$', '', 'g') AS t FROM {table})))))"""
