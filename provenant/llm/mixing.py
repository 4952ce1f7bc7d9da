"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

Each source's documents are cut into blocks of equal rows. A source of weight p gets p slots in each cycle of slots; block k of
the q it has in a cycle of c slots is released at floor(k * c / q) and due at ceil((k + 1) * c / q), and each slot
takes, among released blocks, the one due first. Such windows can always be met on one sequence of slots, so
a source is never a whole block ahead of or behind its share. When a source runs out, the others share its
slots by their weights from the next cycle on; nothing is dropped and nothing repeated.

Cycles with the same blocks have the same pattern, and the pattern changes only where a source runs out: at most two
patterns for each source, and one more, are computed by a fold over the slots of one cycle. Blocks find their slots by
arithmetic and a join with that table, whose size depends on the weights alone. A row's place within its source
comes from counts by hash prefix and a row number within the prefix, so a large source is dealt to many tasks.

Defined cases: sources without a weight, and null, are one further source with the weight of others. A weight below 1 is an error,
as a source without slots could not be placed, and so are weights whose sum, after division by their common divisor, is above
MAX_CYCLE: the table of patterns has up to that many rows for each source and is broadcast. New columns get
underscores before names that the table has. Texts are not read. Repeated rows keep their number. Rows are ordered by the MD5 of their id, the id, and a hash of the row. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.common import free_name, table

BLOCK_ROWS = 16
#: Slots of a cycle at most.
MAX_CYCLE = 10_000
#: Hex digits of the hash prefix: sources are dealt to 16 ** PREFIX groups.
PREFIX = 3


def target_weights() -> dict[str, int]:
    """The registered query's target: src0 gets ten slots of a cycle, the other nineteen one to three."""
    return {"src0": 10} | {f"src{i}": 1 + i % 3 for i in range(1, 20)}


def patterns(blocks: DataFrame) -> DataFrame:
    """src, jj, c_from, c_to, base, per_cycle, off from src, p, nb (blocks of each source; as many rows as weights at most).

    In cycles c_from to c_to (exclusive) the source's jj-th block of the cycle has the slot base + (c - c_from) * per_cycle + off.
    """
    one = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct("src", "p", "nb"))).alias("all")).filter("size(all) > 0")
    cuts = one.select("all", F.expr("array_sort(array_distinct(concat(array(0L), transform(all, x -> x.nb div x.p), transform(all, x -> (x.nb + x.p - 1) div x.p))))").alias("cuts"))
    spans = cuts.select("all", F.expr("explode(transform(slice(cuts, 1, greatest(size(cuts) - 1, 0)), (c, k) -> struct(c as c_from, cuts[k + 1] as c_to)))").alias("span")).select("all", "span.*")
    spans = spans.select("c_from", "c_to", F.expr("transform(all, x -> x.src)").alias("srcs"), F.expr("transform(all, x -> least(x.p, greatest(0L, x.nb - c_from * x.p)))").alias("q"), F.expr("aggregate(all, 0L, (s, x) -> s + least(x.nb, c_from * x.p))").alias("base"))
    spans = spans.withColumn("n", F.expr("aggregate(q, 0L, (s, x) -> s + x)")).filter("n > 0")
    # the fold's state: blocks done by source, and the source and block of each slot so far
    due = "array_min(filter(transform(q, (w, i) -> if(w > acc.done[i] and acc.done[i] * n div w <= t, struct(((acc.done[i] + 1) * n + w - 1) div w as due, i as i), null)), x -> x is not null)).i"
    step = f"transform(array({due}), i -> struct(transform(acc.done, (d, k) -> if(k = i, d + 1L, d)) as done, concat(acc.slots, array(struct(i as i, acc.done[i] as jj))) as slots))[0]"
    fold = f"aggregate(sequence(0L, n - 1), struct(transform(q, x -> 0L) as done, cast(array() as array<struct<i:int,jj:bigint>>) as slots), (acc, t) -> {step}, acc -> acc.slots)"
    made = spans.select("srcs", "c_from", "c_to", "base", F.col("n").alias("per_cycle"), F.posexplode(F.expr(fold)).alias("off", "at"))
    return made.select(F.expr("srcs[at.i]").alias("src"), F.col("at.jj").alias("jj"), "c_from", "c_to", "base", "per_cycle", F.col("off").cast("long").alias("off"))


def mix(docs: DataFrame, weights: dict[str, int], *, others: int = 1, source: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with block (number within the source), slot (place of the block in the mixture) and position (order of rows)."""
    src, hx, pre, idx, tie = (free_name(docs, c) for c in ("mix_src", "mix_hash", "mix_prefix", "mix_index", "mix_tie"))
    names = sorted(weights)
    if min([others, *weights.values()]) < 1:
        raise ValueError("weights must be 1 or more")
    divisor = math.gcd(others, *weights.values())
    weights, others = {k: v // divisor for k, v in weights.items()}, others // divisor
    if sum(weights.values()) + others > MAX_CYCLE:
        raise ValueError(f"the weights make a cycle of more than {MAX_CYCLE} slots; round them")
    known = F.when(F.col(source).isin(names), F.col(source)) if names else F.lit(None).cast("string")
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, int(weights[n]))]), F.col("src")), F.lit(int(others))) if names else F.lit(int(others))
    rows = docs.withColumn(src, F.coalesce(known, F.lit(""))).withColumn(hx, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))).withColumn(pre, F.substring(hx, 1, PREFIX)).withColumn(tie, F.xxhash64(*docs.columns))

    counts = rows.groupBy(F.col(src).alias("src"), F.col(pre).alias("pre")).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("src").orderBy("pre")
    # at most 16 ** PREFIX rows for each source
    offsets = counts.select("src", "pre", (F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    blocks = counts.groupBy("src").agg(F.ceil(F.sum("n") / block_rows).alias("nb")).select("src", weight.cast("long").alias("p"), "nb")
    slots = patterns(blocks)

    ranked = rows.withColumn(idx, F.row_number().over(Window.partitionBy(src, pre).orderBy(hx, id_col, tie)) - 1)
    keyed = ranked.join(F.broadcast(offsets), (F.col(src) == F.col("src")) & (F.col(pre) == F.col("pre"))).select(*docs.columns, F.col(src).alias(src), (F.col("before") + F.col(idx)).alias(idx))
    p = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, int(weights[n]))]), F.col(src)), F.lit(int(others))).cast("long") if names else F.lit(int(others)).cast("long")
    blk, cyc = free_name(docs, "mix_block"), free_name(docs, "mix_cycle")
    keyed = keyed.withColumn(blk, F.expr(f"`{idx}` div {int(block_rows)}L")).withColumn(cyc, F.floor(F.col(blk) / p)).withColumn(hx, F.col(blk) - F.col(cyc) * p)
    placed = keyed.join(F.broadcast(slots), (F.col(src) == F.col("src")) & (F.col(hx) == F.col("jj")) & (F.col(cyc) >= F.col("c_from")) & (F.col(cyc) < F.col("c_to")))
    slot = F.col("base") + (F.col(cyc) - F.col("c_from")) * F.col("per_cycle") + F.col("off")
    out = [free_name(docs, c) for c in ("block", "slot", "position")]
    return placed.select(*docs.columns, F.col(blk).alias(out[0]), slot.alias(out[1]), (slot * int(block_rows) + F.pmod(F.col(idx), F.lit(int(block_rows)))).alias(out[2]))


def with_position(docs: DataFrame, weights: dict[str, int] | None = None, **how) -> DataFrame:
    """Pipeline stage: the rows of docs in the order of the mixture, with their position in it, which later stages carry on."""
    got = mix(docs, target_weights() if weights is None else weights, **how)
    return got.orderBy(got.columns[-1]).select(*docs.columns, got.columns[-1])


def op10_mixing(spark, sf_dir):
    """Every document's source, block, slot and position in the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, target_weights()).select("doc_id", "source", "block", "slot", "position")


_W = " ".join(f"WHEN '{n}' THEN {w}" for n, w in target_weights().items())
OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IN ({', '.join(f"'{n}'" for n in target_weights())}) THEN source ELSE '' END AS src FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx FROM d),
s AS (SELECT src, CASE src {_W} ELSE 1 END AS p, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS nb FROM r GROUP BY src),
cuts AS (SELECT 0 AS c UNION SELECT nb // p FROM s UNION SELECT (nb + p - 1) // p FROM s),
spans AS (SELECT c AS c_from, lead(c) OVER (ORDER BY c) AS c_to FROM cuts),
q AS (SELECT c_from, c_to, src, least(p, greatest(0, nb - c_from * p)) AS q, least(nb, c_from * p) AS before FROM spans, s WHERE c_to IS NOT NULL),
cyc AS (SELECT c_from, CAST(sum(q) AS BIGINT) AS n, CAST(sum(before) AS BIGINT) AS base, list(CAST(q AS BIGINT) ORDER BY src) AS qs, list(src ORDER BY src) AS srcs FROM q GROUP BY c_from HAVING sum(q) > 0),
run AS (
  SELECT c_from, CAST(0 AS BIGINT) AS t, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS jj FROM cyc
  UNION ALL
  SELECT c_from, t + 1, list_transform(range(1, len(done) + 1), lambda k: done[k] + CASE WHEN k = pick THEN 1 ELSE 0 END), pick, done[pick]
  FROM (SELECT run.c_from, run.t, run.done,
               list_min(list_filter(list_transform(range(1, len(done) + 1), lambda k:
                 CASE WHEN qs[k] > done[k] AND done[k] * n // qs[k] <= t THEN ((done[k] + 1) * n + qs[k] - 1) // qs[k] * 1000 + k END), lambda v: v IS NOT NULL)) % 1000 AS pick
        FROM run JOIN cyc ON run.c_from = cyc.c_from WHERE t < n)),
b AS (SELECT r.doc_id, r.source, r.src, r.idx, r.idx // {BLOCK_ROWS} AS block, s.p FROM r JOIN s ON r.src = s.src)
SELECT b.doc_id, b.source, CAST(block AS BIGINT) AS block,
       CAST(cyc.base + (block // p - q.c_from) * cyc.n + run.t - 1 AS BIGINT) AS slot,
       CAST((cyc.base + (block // p - q.c_from) * cyc.n + run.t - 1) * {BLOCK_ROWS} + b.idx % {BLOCK_ROWS} AS BIGINT) AS position
FROM b
JOIN q ON q.src = b.src AND block // p >= q.c_from AND block // p < q.c_to
JOIN cyc ON cyc.c_from = q.c_from
JOIN run ON run.c_from = q.c_from AND run.t > 0 AND cyc.srcs[run.i] = b.src AND run.jj = block % p
"""
