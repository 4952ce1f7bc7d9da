"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion, replacement or insertion over the observed alphabet makes
of it; the strings are joined with the vocabulary by equality, and whatever meets is near, without a look at distances. Of its near
words a word takes the commonest as its form, if that is common enough, and forms are followed to the last, the root.

A word of n letters has about 2 * n * alphabet neighbours, nearly all of which are no words. So that they need neither be made nor
shuffled, each is first looked up, by a hash that is computed for all edits of a block of words at once, in a bit map of the vocabulary's hashes. The map
holds BITS_PER_WORD bits a word and MAP_BITS at most (its proven bound as a broadcast); it only leaves out strings that are no words. Beyond its bound it leaves out fewer, and
the join does the rest. Edits to lengths that no other word has are not made, so a single very long word costs nothing.

The vocabulary is counted by Spark's partial aggregation, so a word in every line is a row for each task. Neighbours are keyed by the
string, each of which is one word of the vocabulary and at most its neighbourhood's size in candidates.

Defined cases: null or empty text has no words. Near words that are equally common go by code points, least first. A word without a near word has n_near 0 and is its own root.
Only a commoner word is a form (the factor must be above 1), so following forms ends. Repeated rows count as often as they are
there; null ids are read as empty where ids matter. Long texts are read whole, words of any length included. Names of other columns of the input don't matter, as only id and
text are read. An empty table, or one without a word often enough, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import stored, table

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is at least so many times as common as its word.
FACTOR = 5
BITS_PER_WORD = 16
#: The map has at most 2 ** MAP_BITS bits (16 MB).
MAP_BITS = 27
#: Edits that are hashed at once.
BLOCK = 1 << 20
#: Letters of words.
LETTERS = "A-Za-zÀ-ÿ"

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_Edit = tuple[int, int, int, int]  # row of the block, kind, place, letter


def word_runs(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = MIN_LETTERS) -> DataFrame:
    """id, run: the maximal stretches of at least so many letters, A to Z in lower case."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def vocabulary(words: DataFrame, *, word: str = "word", least: int = MIN_LETTERS, often: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.filter(F.length(word) >= least).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def _codes(words: list[str]) -> np.ndarray:
    """A row of code points for each of the words, which have equal lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(_MIX)
    h ^= h >> np.uint64(32)
    return h * np.uint64(_BASE)


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all beginnings (by length) and of all ends (by start) of each word; a hash is the sum of letters times powers, modulo 2 ** 64."""
    k, n = codes.shape
    begin, end = np.zeros((k, n + 1), np.uint64), np.zeros((k, n + 1), np.uint64)
    power = _powers(n)
    for i in range(n):
        begin[:, i + 1] = begin[:, i] * np.uint64(_BASE) + codes[:, i]
    for i in range(n - 1, -1, -1):
        end[:, i] = end[:, i + 1] + codes[:, i] * power[n - 1 - i]
    return begin, end


def hashes(words: list[str]) -> np.ndarray:
    """The hash of each word, in order; words of any lengths."""
    out = np.zeros(len(words), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        out[at] = _mixed(_sums(_codes([words[i] for i in at]))[0][:, n] if n else np.zeros(len(at), np.uint64))
    return out


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set in a map of a power of two bits."""
    mask = np.uint64(len(bits) * 64 - 1)
    a, b = (h >> np.uint64(5)) & mask, (h >> np.uint64(33)) & mask
    one, low, six = np.uint64(1), np.uint64(63), np.uint64(6)
    found = ((bits[a >> six] >> (a & low)) & one).astype(bool)
    found[found] = ((bits[b[found] >> six] >> (b[found] & low)) & one).astype(bool)
    return found


def edits(words: list[str], alphabet: np.ndarray, kinds: list[tuple[bool, bool, bool]], bits: np.ndarray) -> list[tuple[int, str]]:
    """(row, string) of the distinct strings one edit from each word that the map lets through. Words have equal lengths; kinds tell which of deletion, replacement and insertion each needs."""
    codes = _codes(words)
    n = codes.shape[1]
    begin, end = _sums(codes)
    power, wanted = _powers(n + 1), np.array(kinds, bool).reshape(-1, 3)
    found: set[tuple[int, str]] = set()

    def look(kind: int, rows: np.ndarray, h: np.ndarray, lo: int, letters: np.ndarray) -> None:
        """h: hashes by row, place from lo on, and letter."""
        for r, i, c in zip(*np.nonzero(in_map(bits, _mixed(h))), strict=True):
            w, at = words[rows[r]], lo + int(i)
            s = w[:at] + (chr(int(letters[c])) if kind else "") + w[at + (kind < 2) :]
            if s != w:
                found.add((int(rows[r]), s))

    for kind, letters in ((0, np.zeros(1, np.uint64)), (1, alphabet), (2, alphabet)):
        rows = np.flatnonzero(wanted[:, kind])
        places = n + (kind == 2)
        step = max(1, BLOCK // max(1, len(rows) * len(letters)))
        for lo in range(0, places if len(rows) and len(letters) else 0, step):
            i = np.arange(lo, min(places, lo + step))
            left = begin[np.ix_(rows, i)] * (power[n - 1 - i] if kind == 0 else power[n - i] if kind == 1 else power[n + 1 - i])
            right = end[np.ix_(rows, i + (kind < 2))]
            base = left + right
            new = letters[None, None, :] * (power[n - 1 - i] if kind == 1 else power[n - i])[None, :, None] if kind else np.zeros((1, 1, 1), np.uint64)
            look(kind, rows, base[:, :, None] + new, lo, letters)
    return sorted(found)


def _hash_column() -> object:
    @F.arrow_udf("long")
    def hashed(w: pa.Array) -> pa.Array:
        return pa.array(hashes(w.to_pylist()).view(np.int64), pa.int64())

    return hashed


def bit_map(words: DataFrame, n: int) -> np.ndarray:
    """The map of the hashes of a column word: of BITS_PER_WORD bits a word, at most 2 ** MAP_BITS. Its set 64-bit words, at most all of them, reach the driver."""
    size = min(MAP_BITS, max(10, (n * BITS_PER_WORD - 1).bit_length()))
    h, mask = F.col("h"), F.lit((1 << size) - 1).cast("long")
    places = F.array(F.shiftrightunsigned(h, 5).bitwiseAND(mask), F.shiftrightunsigned(h, 33).bitwiseAND(mask))
    at = words.select(_hash_column()("word").alias("h")).select(F.explode(places).alias("at"))
    # shiftleft of a long takes the count modulo 64
    part = at.select(F.shiftrightunsigned("at", 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("v"))
    got = part.toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[got.column("i").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return bits


def near_words(vocab: DataFrame) -> DataFrame:
    """word, near, near_n: all words of the vocabulary (word, n, distinct) that one edit makes of each word. vocab is read several times: store it first."""
    spark = vocab.sparkSession
    n = vocab.count()
    if not n:
        return vocab.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.lit(1)).select("c")
    # as many rows as there are letters in use: the caller's pattern bounds them, Unicode at last
    alphabet = spark.sparkContext.broadcast(np.array(sorted(ord(r[0]) for r in letters.collect()), np.uint64))
    bits = spark.sparkContext.broadcast(bit_map(vocab, n))
    size = F.length("word")
    # one row for each length
    lengths = stored(vocab.groupBy(size.alias("len")).agg(F.count(F.lit(1)).alias("k")), "lengths")
    rows = vocab.select("word", size.alias("len"))
    for name, off, least in (("shorter", -1, 1), ("equal", 0, 2), ("longer", 1, 1)):
        rows = rows.join(lengths.filter(F.col("k") >= least).select((F.col("len") - off).alias("len"), F.lit(True).alias(name)), "len", "left")
    rows = rows.select("word", "len", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("shorter", "equal", "longer"))).filter("shorter or equal or longer")

    def emit(batches):
        for batch in batches:
            by_length: dict[int, list[tuple]] = {}
            for w, k, *kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_length.setdefault(k, []).append((w, kinds))
            for k, own in by_length.items():
                step = max(1, BLOCK // ((k + 1) * max(1, len(alphabet.value))))
                for lo in range(0, len(own), step):
                    words = [w for w, _ in own[lo : lo + step]]
                    got = edits(words, alphabet.value, [x for _, x in own[lo : lo + step]], bits.value)
                    yield pa.RecordBatch.from_arrays([pa.array([words[r] for r, _ in got], pa.string()), pa.array([s for _, s in got], pa.string())], names=["word", "near"])

    made = rows.repartition("word").mapInArrow(emit, "word string, near string")
    return made.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def grouped(vocab: DataFrame, near: DataFrame, *, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root. Roots take as many rounds of joins as the logarithm of the longest chain of forms, which factors bound."""
    if factor <= 1:
        raise ValueError("a form is commoner than its word: factor must be above 1")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    fits = -F.col("b.m") >= factor * F.col("n")
    rows = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.w")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n"))
    rows = stored(rows.withColumn("root", F.coalesce("form", "word")), "forms")
    while True:
        up = rows.filter("root <> word").select(F.col("word").alias("at"), F.col("root").alias("above"))
        after = stored(rows.join(up, rows.root == up.at, "left").select(*rows.columns[:-1], F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "forms")
        if after.filter("moved").limit(1).count() == 0:
            return after.drop("moved")
        rows = after.drop("moved")


def with_typos(runs: DataFrame) -> DataFrame:
    """The contract's words: of one run in 199, by the CRC of id and run, one letter is left out."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    return runs.select(F.when(h % 199 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run")).alias("word"))


def op13_spelling_variants(spark, sf_dir):
    """Contract query: every frequent word with its form, root and near words."""
    vocab = stored(vocabulary(with_typos(word_runs(table(spark, sf_dir, "documents")))), "vocabulary")
    return grouped(vocab, near_words(vocab)).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words by deletion: two words of one length that are equal without the letter at some place, or a word that is another one without a letter.
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce([CAST(b AS BIGINT)] || list_transform(range(8), lambda x: CAST(0 AS BIGINT)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(b))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= {MIN_LETTERS} GROUP BY ALL),
b AS (SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS hex FROM g),
h AS (SELECT run, k, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(length(hex) // 2), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.s = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.s = v.word),
q AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rn FROM p),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * v.n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * v.n THEN near_n END AS form_n FROM v LEFT JOIN q ON v.word = q.word AND rn = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON f.word = e.word
"""
