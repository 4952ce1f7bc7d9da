"""SpotSigs fingerprints: chains of content words after common anchor words.

Every anchor word opens a spot; with the next CHAIN words that are no anchors it forms a signature, hashed to 64 bits.
A document's fingerprint is the sorted set of its signatures, written as base64 of big-endian words. Near duplicates are sets of
Jaccard similarity of a threshold or more: sets are partitioned by length, only sets of the same or the next partition that share
a rare signature are paired, pairs whose lengths and shared signatures alone keep them below the threshold are pruned, and
the others are compared exactly.

Defined cases: a text with words but without a whole spot uses every run of CHAIN + 1 of its words (all words, if fewer);
a text without words uses its own hash, and null or empty text has the empty fingerprint. Two empty sets are
alike with 1.0, an empty and another set with 0.0. Equal texts have equal fingerprints. A very long text has a set of as many
signatures. Documents follow each other in descending id, rows of equal id by a hash of the text, null ids last; one row alone is its
own next. New columns get underscores before names that the table has. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import append_arrow, free_name, slices, stored, table
from provenant.llm.setjoin import class_of, link_classes, with_components

CHAIN = 2
#: Common words of English, German, French and Spanish that open spots.
ANCHORS = frozenset(
    "the a an and of to in is was it that for with on as are be by this at from or "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch im "
    "le la les de des un une et est en que qui dans pour par sur du au il elle "
    "el los las y que en un una por con para del se lo no es su al".split()
)
_WORD = re.compile(r"\w+")


def signatures(text: str | None, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 64-bit signatures of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    words = _WORD.findall(text.lower())
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in words:
        if w in anchors:
            spots.append((w, len(content)))
        else:
            content.append(w)
    top = len(content) - chain
    keys = {" ".join((w, *content[k : k + chain])) for w, k in spots if k <= top}
    if not keys:
        keys = {" ".join(words[i : i + chain + 1]) for i in range(max(1, len(words) - chain))} if words else {text}
    return np.unique(np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace")) for k in keys], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 below the threshold, which the lengths alone often tell."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    got = shared / (len(a) + len(b) - shared)
    return got if got >= threshold else 0.0


def to_text(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype(">u8").tobytes()).decode()


def fingerprint(docs: DataFrame, *, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column."""
    at = docs.columns.index(text)

    def start():
        return lambda batch: [pa.array([to_text(signatures(t)) for t in batch.column(at).to_pylist()], pa.string())]

    return append_arrow(docs, T.StructType([T.StructField(free_name(docs, into), T.StringType())]), start)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows sorted within partitions so that every document is followed by the next one in descending id.

    Columns: bucket (one in each partition), ahead (1: a copy of the first document of the bucket after, only there to be looked at),
    i, t. Ids are cut into buckets at their quantiles, as many as Spark's shuffle partitions if not given; the rows of an id that
    fills several are dealt among them by the hash of their text. Of each bucket one bound and its first row's id and hash reach the
    driver. After the last document comes the first.
    """
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("k"), F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    at = F.percentile_approx("k", [k / n for k in range(1, n)], max(10_000, 20 * n)) if n > 1 else F.array().cast("array<long>")
    cuts = np.array(sorted(rows.agg(at.alias("q")).first()["q"] or []), np.int64)

    def bucket_of(k: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Ascending in k; of an id that fills several buckets, descending in h."""
        lo, hi = np.searchsorted(cuts, k, side="left"), np.searchsorted(cuts, k, side="right")
        share = np.minimum((h.astype(np.float64) / 2.0**64 + 0.5), 1 - 1e-9)
        return np.where(hi - lo > 1, hi - np.floor(share * (hi - lo)).astype(np.int64), hi)

    @F.arrow_udf("int")
    def bucket(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(bucket_of(k.to_numpy(), h.to_numpy()), pa.int32())

    first = {r["b"]: r["top"] for r in rows.select(bucket("k", "h").alias("b"), "k", F.bitwise_not("h").alias("g")).groupBy("b").agg(F.max(F.struct("k", "g")).alias("top")).collect()}
    order = sorted(first)
    # the first document of each bucket is looked at from the bucket above; that of the highest, from the lowest
    top_k, top_h, above = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
    for k, b in enumerate(order):
        top_k[b], top_h[b], above[b] = first[b]["k"], ~first[b]["g"], order[(k + 1) % len(order)]

    @F.arrow_udf("array<int>")
    def targets(k: pa.Array, h: pa.Array) -> pa.Array:
        kk, hh = k.to_numpy(), h.to_numpy()
        own = bucket_of(kk, hh)
        seen = (kk == top_k[own]) & (hh == top_h[own])
        ends = np.concatenate([[0], np.cumsum(1 + seen)])
        out = np.repeat(2 * own, 1 + seen)
        out[ends[1:][seen] - 1] = 2 * above[own[seen]] + 1
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))

    placed = rows.withColumn("to", F.explode(targets("k", "h"))).select(F.shiftright("to", 1).alias("bucket"), F.col("to").bitwiseAND(1).alias("ahead"), "i", "t", "k", "h")
    return placed.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.desc("k"), "h", "t").select("bucket", "ahead", "i", "t")


def near_duplicates(docs: DataFrame, *, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_signatures, component_id: documents linked where the Jaccard similarity of their signatures is num / den or more.

    Sets are partitioned by length, and only sets of the same or the next partition that share a rare signature are compared;
    equal sets are one class. A document without signatures links with nothing.
    """

    def run(batches):
        for batch in batches:
            sets = [signatures(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["i", "n", "cls", "toks"])

    rows = stored(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "i long, n int, cls long, toks array<long>"), "signatures")
    members = rows.select("i", "n", "cls")
    classes = stored(members.filter("n > 0").groupBy("cls").agg(F.min("i").alias("rep"), F.min("n").alias("n")), "classes")
    sets = stored(rows.filter("n > 0").select("cls", "n", "toks").dropDuplicates(["cls"]), "sets")
    return with_components(members, classes, link_classes(sets, num, den, by_length=True)).withColumnRenamed("n_shingles", "n_signatures")


def edited(text: str, after: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def op6_spotsigs(spark, sf_dir):
    """Contract query: fingerprints of every document and of its edited text, and their likeness."""
    ordered = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        pending = None
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for b, ahead, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sig = signatures(t)
                if pending is not None:
                    _, own_id, own, own_sig = pending
                    e = edited(own, t)
                    e_sig = signatures(e)
                    out.append((own_id, len(own), hashlib.sha256(e.encode("utf-8")).hexdigest(), to_text(own_sig), to_text(e_sig), jaccard(own_sig, e_sig), jaccard(own_sig, sig), len(own_sig)))
                pending = None if ahead else (b, i, t, sig)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], ty) for ty in types], names=names)

    return ordered.mapInArrow(run, schema)
