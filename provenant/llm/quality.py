"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j | text) = logistic(theta_j - w.x): all thresholds theta share one weight vector w over
hashed features of the text, and theta is kept in order. x holds hashed words, word shapes, repeats of
the word before, and coarse length and variety bins; word features are scaled to unit length. The expected
grade and the tail probability P(grade >= g) rank and select documents. Weights are fitted on a bounded
sample of rated rows by full-batch gradient steps on the driver; every document is scored.

Defined cases: null or empty text has only the bias-like length features. Repeated rating rows of one
document count once, the largest grade holding. With no rated row every grade is equally likely. Very long texts and words are
read whole. Equal texts have equal scores, so ties stay ties. New columns get underscores before names that the table has. An
empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import append_arrow, crc_mod, free_name, sampled_by_hash, spread, table

BINS = 1 << 15
#: Upper bound of the rated sample, for each grade.
SAMPLE_PER_GRADE = 1500
FIELDS = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("keep", T.BooleanType())])
_RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"[^\w\s]+"), "."))


def _bin(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & (BINS - 1)


def shape_of(word: str) -> str:
    """Case and make-up of a word: 'Abc,' -> 'Aa.'; letters all capital -> 'A'."""
    out = word
    for pattern, to in _RUNS:
        out = pattern.sub(to, out)
    return ("A" if word.isupper() else "t" if word[:1].isupper() else "") + out[:6]


def features(text: str | None, known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bins and values. known: bins of words met before."""
    ws = (text or "").split()
    count = Counter(ws)
    value: dict[int, float] = {}
    shapes: dict[int, int] = {}
    norm = 0.0
    for w, n in count.items():
        if (at := known.get(w)) is None:
            at = _bin("w " + w.lower()), _bin("s " + shape_of(w))
            if len(known) < 400_000:
                known[w] = at
        x = 1 + np.log(n) if n > 1 else 1.0
        value[at[0]] = value.get(at[0], 0.0) + x
        shapes[at[1]] = shapes.get(at[1], 0) + n
        norm += x * x
    scale = 1 / np.sqrt(norm) if norm else 0.0
    value = {k: v * scale for k, v in value.items()}
    total = max(len(ws), 1)
    for k, n in shapes.items():
        value[k] = value.get(k, 0.0) + n / total
    again = sum(map(str.__eq__, ws[1:], ws)) / total
    for name, v in (("again", 3 * again), (f"length {int(np.log2(total))}", 0.5), ("variety", len(count) / total), (f"variety {int(8 * len(count) / total)} {int(np.log2(total)) // 2}", 0.5), ("bias", 1.0)):
        k = _bin("m " + name)
        value[k] = value.get(k, 0.0) + v
    at = np.array(sorted(value), np.int64)
    return at, np.array([value[k] for k in at.tolist()])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    """weights over bins; thresholds in ascending order, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return _logistic(float(self.weights[at] @ x) - self.thresholds)


def fit_examples(examples: list[tuple[str | None, int]], grades: int, *, steps: int = 250, rate: float = 0.15, ridge: float = 2e-4) -> OrdinalModel:
    """Adam on the mean negative log-likelihood of the cumulative-link model, each grade of equal weight in sum."""
    start = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(max(grades - 1, 0))
    if not examples or grades < 2:
        p = np.arange(1, grades) / grades
        return OrdinalModel(np.zeros(BINS), np.log(p / (1 - p)))
    known: dict = {}
    rows = [features(t, known) for t, _ in examples]
    y = np.array([g for _, g in examples])
    at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    mass = 1 / np.bincount(y, minlength=grades).clip(1)[y]
    mass /= mass.sum()
    # theta_0, then logs of the gaps between thresholds: the order holds by construction
    p = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.diff(start))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(used)
    for step in range(1, steps + 1):
        theta = p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))])
        z = np.bincount(row, p[at] * x, len(rows))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _logistic(edges[y + 1] - z), _logistic(edges[y] - z)
        like = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / like * mass, lo * (1 - lo) / like * mass
        g_theta = np.array([(-d_hi[y == j]).sum() + d_lo[y == j + 1].sum() for j in range(grades - 1)])
        g = np.concatenate([np.bincount(at, (d_hi - d_lo)[row] * x, k) + ridge * p[:k], [g_theta.sum()], [g_theta[j:].sum() * np.exp(p[k + j]) for j in range(1, grades - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w = np.zeros(BINS)
    w[used] = p[:k]
    return OrdinalModel(w, p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, *, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE_PER_GRADE) -> OrdinalModel:
    """Fit on a bounded sample of ratings, whose grade is an integer from 0; rows of other grades are ignored."""
    rows = ratings.select(F.col(id_col).alias("i"), grade.cast("int").alias("g")).filter(f"i is not null and g between 0 and {grades - 1}").groupBy("i").agg(F.max("g").alias("g"))
    chosen = sampled_by_hash(rows, F.col("g"), ["i"], sample)
    # bounded by the sample's parameter
    got = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").select("i", "t", "g").collect()
    return fit_examples([(r["t"], r["g"]) for r in sorted(set(got), key=lambda r: (r["i"], r["t"] or ""))], grades)


def score(docs: DataFrame, model: OrdinalModel, *, text: str = "text", tail: int = 1, keep_at: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability = P(grade >= tail), and keep (that is at least keep_at)."""
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField(free_name(docs, f.name), f.dataType) for f in FIELDS])

    def start():
        m, known = held.value, {}

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            tails = [m.tails(*features(t, known)) for t in batch.column(at).to_pylist()]
            p = [1.0 if tail < 1 else float(t[tail - 1]) for t in tails]
            return [pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array(p, pa.float64()), pa.array([x >= keep_at for x in p], pa.bool_())]

        return each

    return append_arrow(docs, fields, start)


def op3_quality(spark, sf_dir):
    """Grades: 0 poor quality, 1 good but toxic, 2 good and not toxic. Learns from labels whose crc32(doc_id) mod 5 is not 0."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ratings = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    model = fit(docs, ratings, F.col("quality") * (2 - F.col("toxic")), 3)
    got = score(docs, model, tail=1)
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail_probability", "keep")
