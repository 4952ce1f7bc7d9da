"""Line dedup by winnowing over line hashes.

A document is its sequence of lines that hold a word. At every line begins a gram: the shortest run of lines of GRAM_WORDS
words or more. Among the grams that begin in each window (the shortest run of lines of WINDOW_WORDS words or more) the
one with the smallest hash is a fingerprint. A run of lines with GRAM_WORDS + WINDOW_WORDS words or more that occurs twice has
a fingerprint at the same place in both, because its first window and all grams of that window lie inside the run.

Fingerprints carry the line hashes around them, back to the fingerprint before and on to the end of the next one's gram.
Each is joined with the first occurrence of its hash, in order of document id and line; the match is
extended both ways as far as the lines agree, and the later run is deleted. The first occurrence of a line
anywhere is never deleted. No pair of later occurrences is formed, so a line in every document costs one row for each.

Defined cases: null or empty text stays as it is. Lines without a word are never matched and stay. Where a run repeats within one
document and overlaps itself, the lines of the first gram stay. Rows with equal id and text are the same document and
are treated alike. Null ids come before all others. A very long text has as many lines and fingerprints; one long line is a
gram by itself. New columns get underscores before names that the table has. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import free_name, stored, table

GRAM_WORDS = 25
WINDOW_WORDS = 25


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def lines_of(text: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """All lines; and of those with a word: their numbers, hashes and counts of words."""
    lines = (text or "").split("\n")
    at, hashes, words = [], [], []
    for i, line in enumerate(lines):
        if n := len(line.split()):
            at.append(i)
            hashes.append(_hash(line.strip().encode("utf-8", "replace")))
            words.append(n)
    return lines, at, hashes, words


def winnow(hashes: list[int], words: list[int], gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first line, end line) of each fingerprint, in order. Ties in a window go to the first."""
    n = len(hashes)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + gram, side="left")  # one past the gram's last line; beyond n: none
    wide = np.searchsorted(total, total[:-1] + window, side="left")
    packed = np.array(hashes, np.int64).tobytes()
    grams = [_hash(packed[8 * i : 8 * e]) if e <= n else None for i, e in enumerate(ends.tolist())]
    chosen = set()
    for i, e in enumerate(wide.tolist()):
        if e > n:
            break
        if own := [(g, k) for k in range(i, e) if (g := grams[k]) is not None]:
            chosen.add(min(own)[1])
    return [(grams[k], k, int(ends[k])) for k in sorted(chosen)]


def fingerprints_of(text: str | None, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(hash, line, lines of the gram, hashes before it nearest first, hashes from it on), lines counted among those with a word."""
    _, _, hashes, words = lines_of(text)
    found = winnow(hashes, words, gram, window)
    out = []
    for k, (h, a, e) in enumerate(found):
        low = found[k - 1][1] if k else 0
        high = found[k + 1][2] if k + 1 < len(found) else len(hashes)
        # bounded: where no neighbour is near, a run reaches no farther than a window and a gram without another fingerprint
        out.append((h, a, e - a, hashes[max(low, a - gram - window) : a][::-1], hashes[a : min(high, e + 2 * (gram + window))]))
    return out


def extended(own: tuple[int, list[int], list[int]], first: tuple[int, list[int], list[int]], same: bool, gram: int) -> tuple[int, int]:
    """Lines [s, e) of a later occurrence that agree with the first one; own and first are (line, before, after)."""
    back = next((k for k, (x, y) in enumerate(zip(own[1], first[1], strict=False)) if x != y), min(len(own[1]), len(first[1])))
    on = next((k for k, (x, y) in enumerate(zip(own[2], first[2], strict=False)) if x != y), min(len(own[2]), len(first[2])))
    s, e = own[0] - back, own[0] + on
    return (max(s, first[0] + gram), e) if same else (s, e)


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """row (hash of id and text), runs: the runs of lines with a word to delete from each document that has any."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(id_col, text).alias("row"), F.col(text).alias("t"))

    def scan(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [(h, i, row, a, n, before, after) for i, row, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for h, a, n, before, after in fingerprints_of(t, gram, window)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "i", "row", "line", "n", "before", "after"])

    prints = stored(rows.mapInArrow(scan, "h long, i long, row long, line int, n int, before array<long>, after array<long>"), "fingerprints")
    many = stored(prints.groupBy("h").agg(F.min(F.struct("i", "row", "line")).alias("f"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("h", F.col("f.i").alias("i0"), F.col("f.row").alias("row0"), F.col("f.line").alias("line0")), "first")
    first = prints.join(many.hint("merge"), "h").filter("i <=> i0 and row = row0 and line = line0").select("h", "row0", "line0", F.col("before").alias("before0"), F.col("after").alias("after0")).dropDuplicates(["h"])
    pairs = prints.join(stored(first, "first").hint("merge"), "h").filter("row <> row0 or line <> line0").select("row", "line", "n", "before", "after", "row0", "line0", "before0", "after0")

    def extend(batches):
        for batch in batches:
            got = [(row, *extended((line, b, a), (line0, b0, a0), row == row0, n)) for row, line, n, b, a, row0, line0, b0, a0 in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            got = [g for g in got if g[1] < g[2]]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["row", "s", "e"])

    return pairs.mapInArrow(extend, "row long, s int, e int").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("runs"))


def without_runs(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the lines of its runs, how many lines it had, and how many went."""
    if text is None or not runs:
        return text, 0 if text is None else text.count("\n") + 1, 0
    lines, at, _, _ = lines_of(text)
    gone = {at[k] for r in runs for k in range(r["s"], min(r["e"], len(at)))}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """docs with clean_text, n_lines and n_removed (with underscores before a name that docs has)."""
    runs = stored(repeated_runs(docs, id_col=id_col, text=text, gram=gram, window=window), "runs")
    key, mine = free_name(docs, "row_key"), free_name(docs, "runs_of_row")
    names = [free_name(docs, c) for c in ("clean_text", "n_lines", "n_removed")]
    # both sides are dealt by key at every size: runs grow with the documents
    joined = docs.withColumn(key, F.xxhash64(id_col, text)).join(runs.select(F.col("row").alias(key), F.col("runs").alias(mine)).hint("merge"), key, "left").select(*docs.columns, mine)
    at, all_names = docs.columns.index(text), [*docs.columns, *names]

    def run(batches):
        for batch in batches:
            got = [without_runs(t, r) for t, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=all_names)

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.IntegerType())]))


def rewrite_lines(docs: DataFrame, **how) -> DataFrame:
    """Pipeline stage: the columns of docs, the text cleaned and n_chars (if there) counted again."""
    text = how.get("text", "text")
    got = dedup_lines(docs, **how)
    clean = F.col(got.columns[-3])
    return got.select(*(clean.alias(c) if c == text else F.coalesce(F.length(clean), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def op8_line_dedup(spark, sf_dir):
    """Every document without the later copies of repeated runs of lines, as digests."""
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("n_chars_kept"), F.sha2(F.encode("clean_text", "UTF-8"), 256).alias("clean_sha256"))
