"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and the first STEM letters of longer ones, hashed into BINS bins. A text's vector is
(1 + log tf) * idf * relation over its bins, scaled to unit length. Inverse document frequencies count all documents. The relation
of a bin to the label is a weight from FLOOR to 1 by the log-likelihood ratio of its counts in the two labels: it lets
a few telling words count beside many others, and drops none.

The vectors of a bounded sample of labelled rows form a block-max inverted index: posting lists by bin, cut into blocks of examples,
with the largest weight of each bin in each block. A query bounds each block by the sum of query weight times block
maximum, reads the postings of the blocks of highest bound, and then of all others whose bound reaches the k-th best cosine: the
neighbours are exact. Like examples share blocks.

The score is the vote of the k nearest examples, each weighing 1 / (NEAR + distance), calibrated by isotonic regression
on rows of the sample that took no part in the relation and are not in the index, weighted to the labels' shares among all labelled rows.

Defined cases: null or empty text, and text without a word, has no vector; its score is the share of label 1. So is that of a text without
any neighbour. Ties in cosine go to the example first in index order. Equal texts have equal scores. Repeated label rows of a document
count once, the largest label holding. With no labelled row every score is 0. Very long texts are one vector like others. New
columns get underscores before names that the table has. An empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import append_arrow, crc_mod, free_name, sampled_by_hash, slices, spread, table

#: Upper bounds, for each label, of the labelled sample and of the examples in the index.
SAMPLE_PER_LABEL, EXAMPLES_PER_LABEL = 3000, 400
BINS = 1 << 20
STEM = 5
#: Weight of a bin that has no relation to the label.
FLOOR = 0.05
#: A log-likelihood ratio up to the first is chance among the bins of a corpus; from the second on it is none at all.
CHANCE, CERTAIN = 6.0, 16.0
#: Distance at which a neighbour weighs half of what a copy does.
NEAR = 0.05
NEIGHBOURS = 9
BLOCK = 64
#: Blocks that are read before any can be passed over.
FIRST_BLOCKS = 2
PREDICT_AT = 0.3
_WORD = re.compile(r"\w+")
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.StringType())])


#: A word's bins as one number: its own in the lowest bits, then its stem's, then whether it has one.
_BITS = BINS.bit_length() - 1
_HAS_STEM = 1 << 2 * _BITS


class Bins(dict):
    """The bins of words met before in this process, and of their stems."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        raw = word.encode("utf-8", "replace")
        code = zlib.crc32(raw) & (BINS - 1)
        if len(word) > STEM:
            stem = raw[:STEM] if len(raw) == len(word) else word[:STEM].encode("utf-8", "replace")
            code |= _HAS_STEM | (zlib.crc32(stem, 1) & (BINS - 1)) << _BITS
        self[word] = code
        return code

    def of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The bins of distinct words, then those of their stems, and the places of the words that have one."""
        code = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        stem = np.flatnonzero(code >= _HAS_STEM)
        return np.concatenate([code, code[stem] >> _BITS]) & (BINS - 1), stem


def term_counts(text: str | None, known: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bins of a text and how often each occurs."""
    words = Counter(_WORD.findall((text or "").lower()))
    at, stem = known.of(words)
    n = np.fromiter(words.values(), np.int64, len(words))
    # sorted by bin; the counts lie below
    both = np.sort(at << 32 | np.concatenate([n, n[stem]]))
    at = both >> 32
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at[first], np.add.reduceat(both & 0xFFFFFFFF, first) if len(at) else first


def bins_held(text: str | None, known: Bins) -> np.ndarray:
    """The bins of a text, in no order; one may be there twice."""
    return known.of(set(_WORD.findall((text or "").lower())))[0]


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all rows: documents that hold each bin, and documents. A task sends a count for each bin it met; BINS of them reach the driver at most."""

    def count(batches):
        df, n, known = np.zeros(BINS, np.int32), 0, Bins()
        for batch in batches:
            for part in slices(batch):
                for t in part.column(0).to_pylist():
                    df[bins_held(t, known)] += 1  # once, however often a bin is named
                    n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.concatenate([[-1], some]), pa.int32()), "n": pa.array(np.concatenate([[n], df[some]]), pa.int64())})

    got = docs.select(F.col(text)).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("bin").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(BINS, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i], ..., start[i] + n[i] - 1 for all i, one after another; no n is 0."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    step = np.ones(ends[-1], np.int64)
    step[0] = start[0]
    step[ends[:-1]] = start[1:] - start[:-1] - n[:-1] + 1
    return np.cumsum(step)


@dataclass(frozen=True)
class BlockMaxIndex:
    """Posting lists by bin. place_of has the row of each bin that occurs, else -1 (as its last value is, for all bins beyond). most: for
    each row and block the bin's largest weight in the block. Postings (example, weight) lie in order of rows and blocks; begin: where those of each begin."""

    rows: int
    place_of: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    size: int = BLOCK

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], size: int | None = None) -> BlockMaxIndex:
        size = size or BLOCK
        n = np.array([len(v[0]) for v in vectors], np.int64)
        at = np.concatenate([v[0] for v in vectors]) if len(n) else np.zeros(0, np.int64)
        w = np.concatenate([v[1] for v in vectors]).astype(np.float32) if len(n) else np.zeros(0, np.float32)
        ex = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((ex, at))
        at, w, ex = at[order], w[order], ex[order]
        blocks = -(-len(n) // size)
        terms, row = np.unique(at, return_inverse=True)
        place_of = np.full(int(terms[-1]) + 2 if len(terms) else 1, -1, np.int32)
        place_of[terms] = np.arange(len(terms))
        cell = row * blocks + ex // size
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(at) else np.zeros(0, np.int64)
        most = np.zeros((len(terms), blocks), np.float32)
        most.ravel()[cell[first]] = np.maximum.reduceat(w, first) if len(at) else w
        begin = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=most.size))]).astype(np.int32)
        return cls(len(n), place_of, most, begin, ex.astype(np.int32), w, size)

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and cosines of the k nearest examples of positive cosine; blocks that can't reach them stay unread."""
        ids, sims = np.zeros(0, np.int64), np.zeros(0)
        place = self.place_of.take(at, mode="clip")
        held = place >= 0
        place, weight = place[held].astype(np.int64), weight[held]
        if not len(place):
            return ids, sims
        bound = weight @ self.most[place]
        first = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        left = bound > 0
        best_blocks = np.zeros(len(bound), bool)
        best_blocks[first] = True
        # the best blocks first; then, at once, all others whose bound reaches the k-th best cosine found there
        for taken in (best_blocks & left, None):
            if taken is None:
                taken = left & (bound >= sims[-1] - 1e-6) if len(sims) == k else left
            left = left & ~taken
            own = np.flatnonzero(taken)
            cells = (place[:, None] * len(bound) + own).ravel()
            start = self.begin[cells]
            m = self.begin[cells + 1] - start
            some = np.flatnonzero(m)
            m = m[some]
            post = _ranges(start[some], m)
            got = np.bincount(self.example[post], np.repeat(weight[some // max(1, len(own))], m) * self.weight[post], self.rows)
            new = np.flatnonzero(got > 0)
            ids, sims = np.concatenate([ids, new]), np.concatenate([sims, got[new]])
            best = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[best], sims[best]
        return ids, sims


def isotonic(x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x with weights: the largest x and the value of each pool."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        if pools and pools[-1][2] == x[i]:
            pools[-1][0] += mass[i] * y[i]
            pools[-1][1] += mass[i]
        else:
            pools.append([float(mass[i] * y[i]), float(mass[i]), float(x[i])])
    out: list[list[float]] = []
    for p in pools:
        out.append(p)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            s, n, top = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + n, top]
    return np.array([p[2] for p in out]), np.array([p[0] / p[1] for p in out])


@dataclass
class ToxicityModel:
    """scale: idf * relation of every bin. curve: votes and their calibrated scores, between which scores are drawn straight."""

    scale: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    label: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]
    blank: float
    neighbours: int = NEIGHBOURS

    def vector(self, text: str | None, known: Bins) -> tuple[np.ndarray, np.ndarray]:
        """Bins and unit weights of a text."""
        at, tf = term_counts(text, known)
        w = (1 + np.log(tf)) * self.scale[at]
        return at, w / max(float(np.linalg.norm(w)), 1e-30)

    def vote(self, at: np.ndarray, weight: np.ndarray) -> tuple[float | None, np.ndarray, np.ndarray]:
        ids, sims = self.index.nearest(at, weight, self.neighbours)
        if not len(ids):
            return None, ids, sims
        pull = 1 / (NEAR + np.maximum(0.0, 1 - sims))
        return float((pull * self.label[ids]).sum() / pull.sum()), ids, sims

    def score(self, text: str | None, known: Bins, memo: dict) -> tuple[float, str]:
        """Score and evidence. memo: results of texts met before in this process."""
        key = xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace")), len(text or "")
        if (got := memo.get(key)) is None:
            at, weight = self.vector(text, known)
            v, ids, sims = self.vote(at, weight)
            got = (self.blank, "") if v is None else (float(np.interp(v, *self.curve)), " ".join(f"{self.ids[i]}:{self.label[i]:.0f}:{s:.3f}" for i, s in zip(ids[:3].tolist(), sims[:3].tolist(), strict=True)))
            if len(memo) < 50_000:
                memo[key] = got
        return got


def relation(counts: list[np.ndarray], n: list[int]) -> np.ndarray:
    """Weight of each bin by the log-likelihood ratio of the documents that hold it, in the two labels."""
    a, b = (c.astype(np.float64) for c in counts)
    if not n[0] or not n[1]:
        return np.full(len(a), FLOOR)
    m = (a + b) / (n[0] + n[1])
    g = np.zeros(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for c, k in ((a, n[0]), (b, n[1])):
            g += np.where(c > 0, c * np.log(c / k / m), 0.0) + np.where((c < k) & (m < 1), (k - c) * np.log((1 - c / k) / (1 - m)), 0.0)
    return FLOOR + (1 - FLOOR) * np.clip((g - CHANCE) / (CERTAIN - CHANCE), 0, 1)


def _grouped(vectors: list[tuple[np.ndarray, np.ndarray]], pivots: int = 32) -> list[int]:
    """An order in which like examples lie together: by the nearest of some examples."""
    index = BlockMaxIndex.build([v for v in vectors[:: max(1, len(vectors) // pivots)]], 1)
    near = [got[0] if len(got := index.nearest(at, w, 1)[0]) else -1 for at, w in vectors]
    return sorted(range(len(vectors)), key=lambda i: (near[i], i))


def fit_examples(examples: list[tuple[int, str | None, int]], idf: np.ndarray, shares: tuple[float, float] | None = None, *, per_label: int = EXAMPLES_PER_LABEL, neighbours: int = NEIGHBOURS) -> ToxicityModel:
    """Model of (id, text, label 0 or 1) rows held on the driver. shares: labels 0 and 1 among all labelled rows, if not as in the examples."""
    known = Bins()
    # in an order without meaning; two thirds make the relation and, as far as they go in, the index; the others calibrate
    examples = sorted(examples, key=lambda e: (zlib.crc32(str(e[0]).encode()), e[0], e[1] or ""))
    picks = [zlib.crc32(str(e[0]).encode()) // 64 % 3 > 0 for e in examples]
    terms = [term_counts(e[1], known) for e in examples]
    counts, n, seen = [np.zeros(BINS, np.int32), np.zeros(BINS, np.int32)], [0, 0], set()
    for (_, text, label), pick, (at, _) in zip(examples, picks, terms, strict=True):
        if pick and text not in seen:  # copies are one piece of evidence
            seen.add(text)
            counts[label][at] += 1
            n[label] += 1
    total = [sum(e[2] == v for e in examples) for v in (0, 1)]
    shares = shares or (total[0], total[1])
    blank = shares[1] / sum(shares) if sum(shares) else 0.0
    model = ToxicityModel((idf * relation(counts, n)).astype(np.float32), BlockMaxIndex.build([]), np.zeros(0, np.int64), np.zeros(0), (np.zeros(1), np.full(1, blank)), blank, neighbours)
    chosen, taken = [], [0, 0]
    for e, pick in zip(examples, picks, strict=True):
        if pick and taken[e[2]] < per_label:
            taken[e[2]] += 1
            chosen.append(e)
    vectors = [model.vector(e[1], known) for e in chosen]
    if chosen:
        order = _grouped(vectors)
        model.index = BlockMaxIndex.build([vectors[i] for i in order])
        model.ids, model.label = np.array([chosen[i][0] for i in order]), np.array([float(chosen[i][2]) for i in order])
    votes = [(v, e[2]) for e, pick in zip(examples, picks, strict=True) if not pick and (v := model.vote(*model.vector(e[1], known))[0]) is not None]
    if votes:
        mass = [shares[v] / total[v] if total[v] else 0.0 for v in (0, 1)]
        model.curve = isotonic(np.array([v for v, _ in votes]), np.array([y for _, y in votes]), np.array([mass[y] for _, y in votes]))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Model of a bounded sample of labelled rows, half of it (if there are enough) of each label; document frequencies are those of docs."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    chosen = sampled_by_hash(rows, F.col("y"), ["i"], sample)
    # the sample is bounded by its parameter, so it is small enough to send everywhere
    got = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").collect()
    df, total = document_frequencies(docs, text)
    idf = np.log((1 + total) / (1 + df)) + 0.1
    return fit_examples([(r["i"], r["t"], r["y"]) for r in {(r["i"], r["t"]): r for r in got}.values()], idf, (n.get(0, 0), n.get(1, 0)))


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", predict_at: float = PREDICT_AT) -> DataFrame:
    """docs with score, predicted and evidence (id:label:cosine of the three nearest examples)."""
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of examples and of bins
    fields = T.StructType([T.StructField(free_name(docs, f.name), f.dataType) for f in FIELDS])

    def start():
        m, known, memo = held.value, Bins(), {}

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            got = [m.score(t, known, memo) for t in batch.column(at).to_pylist()]
            return [pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= predict_at) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())]

        return each

    return append_arrow(docs, fields, start)


def op5_toxicity(spark, sf_dir):
    """Contract query: learn from labels whose crc32(doc_id) mod 4 is not 2, score every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "evidence")
