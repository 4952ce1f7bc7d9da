"""Language identification by nearest centroid of TF-IDF byte trigrams.

Text is lower-cased, ASCII characters other than letters become spaces, and byte trigrams are
hashed into a fixed number of bins. A document's vector is (1 + log tf) * idf, scaled to unit
length. Each language has several centroids, found by spherical k-means over a bounded
sample of labelled rows; inverse document frequencies count all labelled training rows. A document gets
the language of the centroid with the highest cosine. It is rejected if it has no letter, or
if its cosine distance exceeds every distance that the training sample shows, by a margin.

Defined cases: null or empty text, or text without a letter -> "und", score 0, rejected.
Ties between centroids go to the language first in order. Repeated rows get equal results. A very long text is one vector like
others. New columns get underscores before names that the table has.
An empty table gives an empty result; with no labelled row every document is "und".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import append_arrow, crc_mod, free_name, sampled_by_hash

BINS = 1 << 13
#: Upper bound of the sample of labelled rows per language that the centroids are fitted on.
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
#: A document is rejected below this share of the smallest cosine among the training sample.
REJECT_SHARE = 0.25

_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def trigram_bins(text: str) -> np.ndarray:
    """Bin of each byte trigram of a text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    blank = (b[:-2] == 32) & (b[1:-1] == 32)
    return (key[~blank] * np.uint32(2654435761)) >> np.uint32(32 - 13)


def term_counts(text: str) -> np.ndarray:
    return np.bincount(trigram_bins(text), minlength=BINS).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit rows; a text without trigrams has a zero row."""
    x = np.zeros((len(texts), BINS), np.float32)
    for i, t in enumerate(texts):
        x[i] = term_counts(t)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k unit centroids; starts are chosen farthest first from the mean."""
    mean = x.mean(axis=0)
    centers = [mean / max(float(np.linalg.norm(mean)), 1e-12)]
    while len(centers) < min(k, len(x)):
        centers.append(x[int(np.argmin((x @ np.array(centers).T).max(axis=1)))])
    c = np.array(centers, np.float32)
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own := x[at == j]).size and (n := float(np.linalg.norm(s := own.sum(axis=0)))) > 0:
                c[j] = s / n
    return c


@dataclass(frozen=True)
class LanguageModel:
    """Centroids of all languages, their labels, idf, and the cosine below which a document is rejected."""

    labels: tuple[str, ...]
    centroids: np.ndarray
    idf: np.ndarray
    floor: float

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not len(self.labels):
            return lang, score, rejected
        for start in range(0, len(texts), 64):
            some = [i for i in range(start, min(start + 64, len(texts))) if texts[i] and any(map(str.isalpha, texts[i]))]
            if not some:
                continue
            sims = vectors([texts[i] for i in some], self.idf) @ self.centroids.T
            best = sims.argmax(axis=1)
            for i, j, s in zip(some, best, sims[np.arange(len(some)), best], strict=True):
                lang[i], score[i] = self.labels[j], float(min(1.0, max(0.0, s)))
                rejected[i] = bool(s < self.floor)
        return lang, score, rejected


def document_frequencies(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all rows: documents that hold each bin, and documents. Each task sends one count per bin."""

    def count(batches):
        df, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen = np.zeros(BINS, bool)
                    seen[trigram_bins(t)] = True
                    df += seen
                    n += 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(-1, BINS), pa.int32()), "n": pa.array(np.concatenate([[n], df]), pa.int64())})

    got = rows.select(F.col(text)).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BINS, np.int64)
    n = 0
    for r in got:
        if r["bin"] < 0:
            n = r["n"]
        else:
            df[r["bin"]] = r["n"]
    return df, n


def fit(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on the rows given; rows with null text or null lang are ignored."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    chosen = sampled_by_hash(rows, F.col("l"), ["i"], sample).select("t", "l").collect()
    df, n = document_frequencies(rows, "t")
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    labels, parts, lows = [], [], []
    for name in sorted({r["l"] for r in chosen}):
        texts = sorted(r["t"] for r in chosen if r["l"] == name and any(map(str.isalpha, r["t"])))
        if texts:
            x = vectors(texts, idf)
            parts.append(spherical_kmeans(x, centroids))
            labels += [name] * len(parts[-1])
            lows.append(float((x @ parts[-1].T).max(axis=1).min()))
    if not parts:
        return LanguageModel((), np.zeros((0, BINS), np.float32), idf, 0.0)
    return LanguageModel(tuple(labels), np.concatenate(parts), idf, REJECT_SHARE * min(lows))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; a column of docs with such a name keeps it, the new one gets underscores."""
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BINS x centroids: a fixed size per language
    fields = T.StructType([T.StructField(free_name(docs, f.name), f.dataType) for f in FIELDS])

    def start():
        m = held.value

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            lang, score, rejected = m.classify(batch.column(at).to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

        return each

    return append_arrow(docs, fields, start)


def op4_language_id(spark, sf_dir):
    """Contract query: learn from documents whose crc32(doc_id) mod 5 is not 0, predict every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(crc_mod("doc_id", 5) != 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Pipeline stage: the columns of docs, without the documents that are rejected."""
    got = identify(docs, model)
    flag = got.columns[-1]
    return got.filter(~F.col(flag)).select(*docs.columns)


__all__ = ["LanguageModel", "fit", "identify", "keep_identified", "op4_language_id"]
