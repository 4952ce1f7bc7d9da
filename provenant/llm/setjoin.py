"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of hashes of its word shingles. Documents with the same set form a class; only classes
are compared. Two sets link when den * |x & y| >= num * |x | y|; then under any order of all tokens, each has one of the
other's tokens among its first n - ceil(n * num / den) + 1 (its prefix). The join goes through these steps:

1. Tokens that one class alone holds come first in every order. On a fixed share of the token space, such tokens are
   counted over all documents; a class whose prefix they fill has no partner and goes no further.
2. The classes left are read again, and the same is done with all of their tokens. What is kept of a set
   is its shared tokens; the prefix shrinks by the number of the others.
3. Three orders remain: by rarity, and by two hashes. Candidates share a prefix token under the first; among them, those that
   share none under the second or third are dropped before the sets are compared.
4. In a group of classes that hold the same prefix token, the class with the fewest own tokens leads and is
   compared with all others. Classes that it links are one component and need no links among
   themselves. After LEADER_ROUNDS, groups whose classes (those removed with a leader too) still span components compare just their
   pairs across components, so a group of near copies isn't expanded into all pairs and no link between components is lost.

Defined cases: words are maximal runs of bytes other than ASCII white space, with A-Z lower-cased. Fewer words than a
shingle are one shingle; null or blank text has the empty set and links with nothing. Repeated rows are members of
one class. A null id counts as smaller than any other only within its own class, whose id it isn't; a row with a null id keeps it.
Very long texts have as many shingles. Only the id and the text are read, so other columns, of whatever name, don't matter; keep_one
returns them as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import free_name, stored, table
from provenant.llm.components import components

#: Leaders that are compared with their whole group before pairs across components are.
LEADER_ROUNDS = 3
#: Share of the token space, in 1/1024, on which the first pass counts tokens: enough that tokens of their own fill the prefix of most documents.
SAMPLED = {True: 320, False: 184}

_BASE = 0x9E3779B97F4A7C55
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for texts to come."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, b in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers[at] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))])
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _powers_to(len(line) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((line.astype(np.uint64) + np.uint64(1)) * power[: len(line)])])
    gaps = np.flatnonzero(line == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    k = min(size, len(start))
    a, b = start[: len(start) - k + 1], end[k - 1 :]
    with np.errstate(over="ignore"):
        h = _mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
    return np.unique(h.view(np.int64))


def class_of(tokens: np.ndarray) -> int:
    """Hash of a whole set."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def members_of(docs: DataFrame, size: int, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """i, n, cls of each row."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"i": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int32()), "cls": pa.array([class_of(s) for s in sets], pa.int64())})

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "i long, n int, cls long")


def _own_tokens(docs: DataFrame, size: int, sampled: int, text: str) -> DataFrame:
    """cls, own: for each class the tokens, in the sampled share of the token space, that no other class has."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                cls, toks = [], []
                for t in batch.column(0).slice(lo, 512).to_pylist():
                    s = shingles(t, size)
                    if len(s):
                        some = s[(s.view(np.uint64) >> np.uint64(20)) & np.uint64(1023) < sampled]
                        toks.append(some)
                        cls.append(np.full(len(some), class_of(s), np.int64))
                if cls:
                    yield pa.RecordBatch.from_pydict({"tok": pa.array(np.concatenate(toks)), "cls": pa.array(np.concatenate(cls))})

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "tok long, cls long")
    alone = rows.groupBy("tok").agg(F.min("cls").alias("cls"), F.max("cls").alias("most")).filter("cls = most")
    return alone.groupBy("cls").agg(F.count(F.lit(1)).cast("int").alias("own"))


def _prefix(n, num: int, den: int):
    return n - F.ceil(n * num / den).cast("int") + 1


def link_classes(sets: DataFrame, num: int, den: int, by_length: bool = False) -> DataFrame:
    """a, b: links between classes (cls, n, toks) that span their components; every pair compared exactly.

    by_length: prefix tokens count by partition of set length too. Partitions grow by den / num, so sets that link are in the
    same or neighbouring ones, and each set stands in its own and the next one.
    """
    # counted with partial sums and stored, so that the join deals both sides itself and Spark can split a token that many classes hold
    tokens = sets.select("cls", F.explode("toks").alias("tok"))
    shared = stored(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    held = tokens.join(shared.hint("merge"), "tok").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("s"))
    held = held.join(sets.select("cls", "n"), "cls").withColumn("r", _prefix(F.col("n"), num, den) - (F.col("n") - F.size("s"))).filter("r > 0")
    by_hash = lambda seed: F.transform(F.slice(F.sort_array(F.transform("s", lambda x: F.struct(F.xxhash64(x["tok"], F.lit(seed)).alias("h"), x["tok"].alias("tok")))), F.lit(1), F.col("r")), lambda x: x["tok"])
    first = F.transform(F.slice("s", F.lit(1), F.col("r")), lambda x: x["tok"])
    if by_length:
        part = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)))
        first = F.flatten(F.transform(first, lambda t: F.array(F.xxhash64(t, part), F.xxhash64(t, part + 1))))
    nodes = stored(held.select("cls", "n", (F.col("n") - F.size("s")).alias("own"), first.alias("p1"), by_hash(1).alias("p2"), by_hash(2).alias("p3"), F.transform("s", lambda x: x["tok"]).alias("toks")), "nodes")
    entries = stored(nodes.select(F.explode("p1").alias("tok"), "cls", "n", "own"), "entries")

    def possible(x: str, y: str):
        """Lengths and tokens of their own let the pair link; two different sets of equal length differ in a token at least."""
        most = F.least(F.col(f"{x}n") - F.col(f"{x}own"), F.col(f"{y}n") - F.col(f"{y}own"), F.col(f"{x}n") - (F.col(f"{x}n") == F.col(f"{y}n")).cast("int"))
        return most * den >= (F.col(f"{x}n") + F.col(f"{y}n") - most) * num

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs a, b: those that pass the second and third order's filter and then link."""
        x = nodes.select(F.col("cls").alias("a"), F.col("n").alias("x_n"), *(F.col(c).alias(f"x_{c}") for c in ("p2", "p3", "toks")))
        y = nodes.select(F.col("cls").alias("b"), F.col("n").alias("y_n"), *(F.col(c).alias(f"y_{c}") for c in ("p2", "p3", "toks")))
        both = pairs.join(x, "a").join(y, "b").filter(F.arrays_overlap("x_p2", "y_p2") & F.arrays_overlap("x_p3", "y_p3"))
        both = both.withColumn("o", F.size(F.array_intersect("x_toks", "y_toks")))
        return both.filter(F.col("o") * den >= (F.col("x_n") + F.col("y_n") - F.col("o")) * num).select("a", "b")

    links, comp, left = None, None, entries
    for _ in range(LEADER_ROUNDS):
        lead = stored(left.groupBy("tok").agg(F.min(F.struct("own", "cls", "n")).alias("l"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("tok", F.col("l.cls").alias("b"), F.col("l.n").alias("y_n"), F.col("l.own").alias("y_own")), "leaders")
        here = entries.join(lead, "tok") if comp is None else entries.join(lead, "tok").join(comp.select(F.col("v").alias("cls"), F.col("c").alias("ca")), "cls", "left").join(comp.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left").filter("ca is null or cb is null or ca <> cb")
        pairs = here.filter("cls <> b").select("cls", "b", F.col("n").alias("x_n"), F.col("own").alias("x_own"), "y_n", "y_own").filter(possible("x_", "y_")).select(F.col("cls").alias("a"), "b").distinct()
        found = verified(stored(pairs, "pairs"))
        links = stored(found if links is None else links.union(found), "links")
        comp = components(links)
        # go on with groups that span components, without their leader and what is one component with it
        at = left.join(comp, left.cls == comp.v, "left").select("tok", "cls", "n", "own", F.coalesce("c", "cls").alias("c"))
        led = lead.join(comp, lead.b == comp.v, "left").select(F.col("tok").alias("lead_tok"), F.col("b").alias("lead"), F.coalesce("c", "b").alias("lead_c"))
        left = stored(at.join(led, at.tok == led.lead_tok).filter("cls <> lead and c <> lead_c").select("tok", "cls", "n", "own"), "left")
    # each group that spans components compares its classes outside its largest component with all of it that is in another one:
    # every pair across components has such a class, so none is left out, and a group of near copies isn't squared
    c = comp.select(F.col("v").alias("cls"), "c")
    placed = stored(entries.join(c, "cls", "left").withColumn("c", F.coalesce("c", "cls")), "placed")
    spans = placed.groupBy("tok", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("tok").agg(F.max(F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("cs")).filter("cs > 1").select("tok", F.col("top.c").alias("top_c"))
    group = stored(placed.join(spans, "tok"), "spans")
    side = lambda rows, p: rows.join(nodes.select("cls", "p1", "p2"), "cls").select(*(F.col(c).alias(f"{p}{c}") for c in ("tok", "cls", "n", "own", "p1", "p2", "c")))
    x, y = stored(side(group.filter("c <> top_c"), "x_"), "outside"), stored(side(group, "y_"), "group")
    pairs = x.join(y, (F.col("x_tok") == F.col("y_tok")) & (F.col("x_c") != F.col("y_c")) & possible("x_", "y_") & (F.array_intersect("x_p1", "y_p1")[0] == F.col("x_tok")) & F.arrays_overlap("x_p2", "y_p2"))
    pairs = pairs.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()
    return stored(links.union(verified(stored(pairs, "pairs"))), "links")


def jaccard_components(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    members = stored(members_of(docs, size, id_col=id_col, text=text), "members")
    classes = stored(members.filter("n > 0").groupBy("cls").agg(F.min("i").alias("rep"), F.min("n").alias("n")), "classes")
    own = _own_tokens(docs, size, SAMPLED[num * 100 < den * 85], text)
    left = stored(classes.join(own, "cls", "left").filter(F.coalesce("own", F.lit(0)) < _prefix(F.col("n"), num, den)).select("cls", "rep"), "survivors")

    def read(batches):
        for batch in batches:
            got = [(c, s) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(s := shingles(t, size)) and class_of(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([len(g[1]) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["cls", "n", "toks"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t"))
    # dealt by id at every size: survivors grow with the documents
    sets = rows.join(left.hint("merge"), rows.i.eqNullSafe(left.rep)).select("cls", "t").mapInArrow(read, "cls long, n int, toks array<long>").dropDuplicates(["cls"])
    return with_components(members, classes, link_classes(stored(sets, "sets"), num, den))


def with_components(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of members (i, n, cls), by links between classes (cls, rep)."""
    comp = components(links)
    named = classes.join(comp, classes.cls == comp.v, "left").select("cls", "rep", F.coalesce("c", "cls").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_class = stored(named.join(stored(least, "least"), "c").select("cls", "component_id"), "component-ids")
    return members.join(of_class.hint("merge"), "cls", "left").select(F.col("i").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("i")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Pipeline stage: docs with one document of each component, the one with the smallest id; documents with null ids or empty sets stay."""
    got = jaccard_components(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone := free_name(docs, "gone"))).distinct()
    return docs.join(stored(got, "gone").hint("merge"), docs[how.get("id_col", "doc_id")] == F.col(gone), "left_anti")


def op9_ngram_jaccard(spark, sf_dir):
    """Contract query: 3-word shingles, links at Jaccard of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, num=90, den=100)
