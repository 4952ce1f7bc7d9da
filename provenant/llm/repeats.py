"""Periodic runs of words, by Main and Lorentz' divide and conquer, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q, at least max(shortest, 2 * q) words long, that no neighbouring
word extends keeping period q. The words of a text become numbers, equal words equal numbers. The sequence is halved again and
again; at each midpoint four Z-functions tell, for every period at once, how far the words on both sides agree with those one
period away, and so all repetitions that cross the midpoint. Of equal intervals the smallest period is kept. A repetition that
goes on beyond its half is dropped there, as the enclosing part has it whole.

A run of 12 words or more holds two equal grams of 6 words within it. Only the stretches that such grams
cover are halved, and a part without a pair of its own is not looked at; most texts end before, after one sort of their grams' hashes.

The work on a text of n words grows as n * log n; no row meets another one, so nothing is shuffled and nothing can be skewed but a
single text. Defined cases: null or empty text, or text without a word, has no words, no runs, and collapses to the empty text. Texts
without a run collapse to their words joined by single spaces. Overlapping runs are all reported; a word is dropped where any
of them repeats it. The greatest run is the longest, then the first, then that of the smaller period. Repeated rows get equal
results, and null ids are read as empty. New columns get underscores before names that the table has. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import append_arrow, free_name, spread, table

#: Fewest words of a run.
SHORTEST = 12
Run = tuple[int, int, int]  # start, length, period


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: stretches of UTF-8 without space or the characters 9 to 13."""
    return (text or "").encode("utf-8", "replace").split()


def z_function(s: list[int], upto: int) -> dict[int, int]:
    """How many elements from i on agree with the beginning, for 0 < i < upto where any do. Only places that hold the first element are visited."""
    n, step = len(s), 32
    z: dict[int, int] = {}
    first, i, left, right = s[0], 0, 0, 0
    while True:
        try:
            i = s.index(first, i + 1, upto)
        except ValueError:
            return z
        k = 1
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k + step <= n and s[k : k + step] == s[i + k : i + k + step]:
            k += step
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k


def crossing(s: list[int], lo: int, mid: int, hi: int, shortest: int) -> list[Run]:
    """Repetitions of s[lo:hi] with words on both sides of mid, each as long as it is within lo and hi."""
    u, v = s[lo:mid], s[mid:hi]
    nu, nv = len(u), len(v)
    back_u = u[::-1]
    # Z-functions of each half by itself, and then of the words of the other half, against the words from the midpoint on
    left = z_function([*back_u, -1, *v[::-1], *back_u], nu + 1 + nv)
    right = z_function([*v, -1, *u, *v], nv + 1 + nu)
    out: list[Run] = []
    # words that agree with those one period later, where the period begins at the midpoint; a whole half agrees with nothing beyond it
    for i, back in left.items():
        if i > nu:
            q, back = nu + 1 + nv - i, min(back, nu)
            on = right.get(q, 0) if q < nv else 0
            if on + back >= q and on + back + q >= shortest:
                out.append((mid - back, back + on + q, q))
    # words that agree with those one period before, where the period ends at the midpoint
    for i, on in right.items():
        if i > nv:
            q, on = nv + 1 + nu - i, min(on, nv)
            back = left.get(q, 0) if q < nu else 0
            if on + back >= q and on + back + q >= shortest:
                out.append((mid - back - q, back + on + q, q))
    return out


def _before(ids: np.ndarray, gram: int) -> np.ndarray | None:
    """Where each gram of so many words occurred last before (-1: nowhere); None if all are different. Unequal grams of equal hash only add work."""
    h = np.zeros(len(ids) - gram + 1, np.uint64)
    for k in range(gram):
        h = (h ^ ids[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return None
    last = np.full(len(h), -1, np.int64)
    last[order[1:][same]] = order[:-1][same]
    return last


def _stretches(words: list, gram: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The stretches that repeated grams cover: bounds, and of grams with an equal one before, their places and those of the last equal one."""
    last = _before(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), gram)
    if last is None:
        return []
    at = np.flatnonzero(last >= 0)
    of = last[at]
    twice = np.union1d(at, of)
    cuts = np.flatnonzero(np.diff(twice) > gram)
    out = []
    for lo, hi in zip(twice[np.append(0, cuts + 1)].tolist(), (twice[np.append(cuts, len(twice) - 1)] + gram).tolist(), strict=True):
        a, b = np.searchsorted(at, (lo, hi))
        if a < b and of[a:b].max() >= lo:
            out.append((lo, hi, at[a:b] - lo, of[a:b] - lo))
    return out


def runs_of(words: list, shortest: int = SHORTEST) -> list[Run]:
    """All runs of a sequence of words, by start and period."""
    if len(words) < max(2, shortest):
        return []
    # a run of period q has length - q >= half of shortest places that agree with those q later: grams of so many words that occur twice
    gram = max(1, shortest // 2)
    found: dict[tuple[int, int], int] = {}
    for begin, end, at, of in _stretches(words, gram):
        n = end - begin
        known: dict = {}
        s = [known.setdefault(w, len(known)) for w in words[begin:end]]
        far = at - of  # a run's grams have an equal one no farther than its period, and the run is two periods long
        parts = [(0, n)]
        while parts:
            lo, hi = parts.pop()
            a, b = np.searchsorted(at, (lo, hi - gram + 1))
            if hi - lo < shortest or not ((of[a:b] >= lo) & (far[a:b] <= (hi - lo) // 2)).any():
                continue
            mid = (lo + hi) // 2
            for start, length, q in crossing(s, lo, mid, hi, shortest):
                stop = start + length
                if (start == lo and lo and s[lo - 1] == s[lo - 1 + q]) or (stop == hi and hi < n and s[hi] == s[hi - q]):
                    continue
                key = (begin + start, length)
                if q < found.get(key, n):
                    found[key] = q
            parts += [(lo, mid), (mid, hi)]
    return sorted((start, length, q) for (start, length), q in found.items())


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words are in no run after the first period of it."""
    step = np.zeros(n + 1, np.int32)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that are kept, joined by single spaces."""
    return b" ".join(words if not runs else [words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()])


def greatest(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed_text", T.StringType()),
])


def periodic_runs(docs: DataFrame, *, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """docs with n_words, runs (start, length, period) and collapsed_text."""
    at = docs.columns.index(text)
    fields = T.StructType([T.StructField(free_name(docs, f.name), f.dataType) for f in FIELDS])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def start() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            words = [words_of(t) for t in batch.column(at).to_pylist()]
            runs = [runs_of(w, shortest) for w in words]
            return [pa.array([len(w) for w in words], pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], kind), pa.array([collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)], pa.string())]

        return each

    return append_arrow(docs, fields, start)


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's texts: every tenth document, by the CRC of its id, goes in circles from some word on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def op11_periodic_runs(spark, sf_dir):
    """Contract query: the runs of every document's words, its greatest run, and the digest of its text without repeats."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.arrow_udf("string")
    def edited(i: pa.Array, t: pa.Array) -> pa.Array:
        # words hold no white space, so a joined text has the same words
        return pa.array([b" ".join(looped(words_of(x), k)).decode() for k, x in zip(i.to_pylist(), t.to_pylist(), strict=True)], pa.string())

    got = periodic_runs(docs.select("doc_id", edited("doc_id", "text").alias("text")))
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    top = F.get(order, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = got.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed_text")).alias("collapsed_sha256"))
    length, period = -F.col("top.l"), F.col("top.period")
    return out.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
