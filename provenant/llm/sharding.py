"""Sharding by rendezvous hashing of record keys over weighted shards, and gapless numbers within shards.

Every shard draws a number for a key from the MD5 of both; a key belongs to the shard whose draw u, weighed as weight / -ln(u), is
greatest. The choice rests on the key and the shards alone: no table of keys, no order of rows, no other row. A new shard takes keys only
into itself, in proportion to its weight, and a removed one gives away only its own. DataFrame functions alone; no row is moved for it.

Slots number the rows of a shard without gaps. Equal rows are counted first, so that a row that is repeated a billion times is one
row with a count; different rows are dealt by the MD5 of all their columns to 16 ** PREFIX groups of a shard, whose sizes give each group's
first slot, and are numbered within it. Copies get their slots by adding to their row's first one, at most COPIES in a task at once. No
task holds a shard, whatever the keys.

Defined cases: a null key is one key, like the empty one. Equal keys are in one shard, and their share of it is not bounded: with one key in a third
of the rows, a shard has that third. Weights are positive; shards of equal draw (which two keys in 2 ** 52 have) go to the first. Texts that are null count no bytes, and
empty and null texts are different rows. Texts may have any length; only their bytes are counted. Columns of the input with a new name keep it; the new ones get underscores. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.common import free_name, table

#: Hex digits of the hash prefix by which the rows of a shard are dealt for numbering.
PREFIX = 3
#: Copies of one row that are made in one go.
COPIES = 1 << 16
SHARDS = 16


def draws(key: Column, shards: list[str], weights: list[float]) -> Column:
    """An array with the weighed draw of each shard for a key."""
    if len(shards) != len(set(shards)) or len(shards) != len(weights) or not shards or min(weights) <= 0:
        raise ValueError("shards need different names and positive weights")
    text = F.coalesce(key.cast("string"), F.lit(""))
    # 52 bits, and a half so that no draw is 0 or 1
    unit = lambda name: (F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{name}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.array(*(F.lit(float(w)) / -F.log(unit(n)) for n, w in zip(shards, weights, strict=True)))


def choice(drawn: Column) -> Column:
    """Place of the greatest draw, from 0; the first of equal ones."""
    return (F.array_position(drawn, F.array_max(drawn)) - 1).cast("int")


def with_shards(docs: DataFrame, shards: list[str], *, key: str = "doc_id", weights: list[float] | None = None, more: list[str] | None = None) -> DataFrame:
    """docs with shard (place in shards) and, if more shards are named, grown_shard (place in shards + more, each of weight 1)."""
    more = more or []
    w = weights or [1.0] * len(shards)
    drawn, a, b = (free_name(docs, c) for c in ("draws", "shard", "grown_shard"))
    out = docs.withColumn(drawn, draws(F.col(key), [*shards, *more], [*w, *[1.0] * len(more)]))
    own = choice(F.slice(drawn, 1, len(shards))).alias(a)
    return out.select(*docs.columns, own, *([choice(F.col(drawn)).alias(b)] if more else []))


def with_slots(rows: DataFrame, within: list[str], *, spread_by: Column, into: str = "slot") -> DataFrame:
    """rows with their number, from 0, among the rows of the columns within, by spread_by: a hash in hex of all columns that differ."""
    n, hx, pre, before, first = (free_name(rows, c) for c in ("row_copies", "row_hash", "row_prefix", "rows_before", "first_slot"))
    into = free_name(rows, into)
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(n)).withColumn(hx, spread_by).withColumn(pre, F.substring(hx, 1, PREFIX))
    counts = distinct.groupBy(*within, pre).agg(F.sum(n).alias("_n"))
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in within), F.col(pre).alias("_pre"), (F.sum("_n").over(Window.partitionBy(*within).orderBy(pre).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias(before))
    w = Window.partitionBy(*within, pre).orderBy(hx, *rows.columns).rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn(first, F.sum(n).over(w) - F.col(n))
    same = F.col(pre).eqNullSafe(F.col("_pre"))
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = ranked.join(starts, same).select(*rows.columns, n, (F.col(before) + F.col(first)).alias(first))
    # rows with many copies are cut and dealt anew before they are written out
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES).cast("long")))
    many = placed.filter(F.col(n) > COPIES).withColumn("_from", part).select(*rows.columns, F.least(F.col(n) - F.col("_from"), F.lit(COPIES)).alias(n), (F.col(first) + F.col("_from")).alias(first)).repartition(*within, first)
    return placed.filter(F.col(n) <= COPIES).union(many).select(*rows.columns, F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1)).alias(into))


def write_shards(rows: DataFrame, path: str, *, shard: str = "shard", slot: str = "slot", rows_per_file: int = 1_000_000) -> None:
    """Parquet below path, a folder for each shard, files of at most about rows_per_file rows, each a range of slots in order."""
    part = free_name(rows, "file_of_shard")
    cut = rows.withColumn(part, F.floor(F.col(slot) / rows_per_file))
    cut.repartition(shard, part).sortWithinPartitions(shard, slot).drop(part).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard).parquet(path)


def op12_rendezvous_sharding(spark, sf_dir):
    """Contract query: the shard and slot of every document, and its shard with one shard more."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    names = [str(k) for k in range(SHARDS)]
    placed = with_shards(narrow, names, more=[str(SHARDS)])
    whole = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32").cast("binary"))
    return with_slots(placed, ["shard"], spread_by=whole).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 of a text in SQL: the table of 256 remainders by its rule, then a fold over the bytes.
OP12_SQL = f"""
WITH t AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce([CAST(b AS BIGINT)] || list_transform(range(8), lambda x: CAST(0 AS BIGINT)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(b))),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hex FROM documents),
s AS (SELECT doc_id, CAST(length(hex) // 2 + 1 AS BIGINT) AS size,
  xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(length(hex) // 2), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM d, t),
k AS (SELECT *, list_transform(range({SHARDS + 1}), lambda i: -1 / ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) AS draws FROM s),
p AS (SELECT doc_id, size, text_crc32, CAST(list_position(draws[1:{SHARDS}], list_max(draws[1:{SHARDS}])) - 1 AS INT) AS shard, CAST(list_position(draws, list_max(draws)) - 1 AS INT) AS grown_shard FROM k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), size, text_crc32)), doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM p
"""
