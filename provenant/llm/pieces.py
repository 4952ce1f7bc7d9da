"""SentencePiece encoding and decoding by a relational lattice.

A text is cut into words at its spaces, which become word marks, and words at line ends: no piece reaches across either. Words are cut further
between characters that no piece has side by side. Each distinct part of a word in the corpus is encoded once. Its substrings up to the longest
piece are exploded and joined with the piece table by equality; the edges found are grouped by word; and a fold with Spark's
higher-order aggregate walks the lattice:

- "viterbi" (the default) keeps the best path to every position. Pieces' scores add up; a character without a piece costs UNKNOWN_PENALTY
  more than the worst piece. Of equal scores the edge that starts first wins.
- "merge" joins, again and again, the two neighbours whose union is the edge of highest score, the leftmost first, as encoders of
  BPE models do.

Characters without a piece become byte pieces. The words of a part of the documents (a chunk) are its dictionary: (chunk, word) pairs
are dealt by word, encoded there, and sent on in bundles to the chunk's texts, which travel compressed too. A word has one pair for each chunk at
most, and a chunk has thousands of words, so no word holds a large share of the pairs.

Defined cases: null or empty text has no ids, and decodes to the empty string. Decoding is the exact inverse for every
text that doesn't hold the word mark itself. Repeated rows are encoded alike. A very long text is many words; a word of n characters
that can't be cut takes n * longest piece edges in one row of the lattice. New columns get underscores before names that the table
has. An empty table gives an empty one. Null ids decode to the empty string.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from provenant.llm.common import append_arrow, free_name, slices, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_RUNS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_SPACE = re.compile("(?<=[^ ]) ")
_ENDS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Lower than the worst piece by this: a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Words of more characters are cut wherever no piece crosses, others before the punctuation at their end only, which is what many share.
CUT_FROM = 32
#: Bytes of text in a chunk, if its texts are alike.
CHUNK_BYTES = 48 << 20
#: Rows of encoded words that are bundled by chunk at once.
BUNDLED_ROWS = 500_000
#: Parts of the lattice for each of Spark's shuffle partitions.
PARTS = 4


def words_of(text: str | None) -> list[str]:
    """A text's words in order: what lies between spaces, and with a word all spaces before it but one."""
    return [] if not text else text.split(" ") if "  " not in text and text[0] != " " else _SPACE.split(text)


def words_in(texts: pa.Array) -> pa.ListArray:
    """words_of for each text: by Arrow, but for texts in which spaces are more than one apart, or first."""
    texts = texts.cast(pa.string())
    plain = pc.invert(pc.or_(pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " ")), pc.match_substring(texts, "  "))).fill_null(False)
    return _either(plain, pc.split_pattern(texts.filter(plain), " "), lambda: map(words_of, texts.filter(pc.invert(plain)).to_pylist()))


def _either(plain: pa.BooleanArray, fast: pa.ListArray, slow: Callable[[], Iterable[list[str]]]) -> pa.ListArray:
    """The lists of fast where plain is true and those of slow where it is not, in order."""
    if len(fast) == len(plain):
        return fast
    is_fast = plain.to_numpy(zero_copy_only=False)
    at = np.empty(len(plain), np.int64)
    at[is_fast], at[~is_fast] = np.arange(len(fast)), np.arange(len(fast), len(plain))
    return pa.concat_arrays([fast, pa.array(list(slow()), fast.type)]).take(pa.array(at))


def _starts(a: pa.Array) -> np.ndarray:
    """The offsets of an array of strings or binaries."""
    return np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)


def _bytes(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)


def _strings(lengths: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(data))


class Pieces:
    """The vocabulary of a model file: scores and ids by piece, the byte pieces, and the bytes of each id."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.by_piece = {p.piece: (p.score, i) for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        if any(len(_RUNS.findall(p)) != 1 for p in self.by_piece):
            raise ValueError("a piece reaches across words")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        self.longest = max(map(len, self.by_piece), default=1)
        self.lowest = min((s for s, _ in self.by_piece.values()), default=0.0)
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [p.piece.encode() if p.type in (1, 4) else byte_of.get(i, b"") for i, p in enumerate(m.pieces)]
        self.all_raw = pa.array(self.raw, pa.binary())
        self.within = {p[i : i + 2] for p in self.by_piece for i in range(len(p) - 1)}

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, score, id: as many rows as the vocabulary has."""
        return spark.createDataFrame([(p, float(s), i) for p, (s, i) in self.by_piece.items()], "piece string, score double, id int")

    def parts_of(self, word: str) -> list[str]:
        """What the lattice encodes of a word: its runs of marks and characters and its line ends, each cut where no piece crosses."""
        if len(word) < CUT_FROM and word.isalpha():
            return [MARK + word]
        return [part for run in _RUNS.findall(MARK + word.replace(" ", MARK)) for part in self._parts(run)]

    def parts_in(self, words: pa.Array) -> pa.ListArray:
        """parts_of for each word: by Arrow, but for long ones and those with line ends, marks or further spaces."""
        plain = pc.and_(pc.less(pc.utf8_length(words), CUT_FROM), pc.invert(pc.match_substring_regex(words, f"[ \n{MARK}]")))
        run = pc.binary_join_element_wise(MARK, words.filter(plain), "")
        core = pc.utf8_rtrim(run, characters=_ENDS)
        size = np.diff(_starts(run)) - np.diff(_starts(core))
        has = np.flatnonzero(size)
        size = size[has]
        tail = _strings(size, _bytes(run)[np.repeat(_starts(run)[1:][has] - np.cumsum(size), size) + np.arange(size.sum())])
        crossing = pc.binary_join_element_wise(pc.utf8_slice_codeunits(core.take(pa.array(has)), -1), pc.utf8_slice_codeunits(tail, 0, 1), "")
        apart = ~pc.is_in(crossing, value_set=pa.array(list(self.within), pa.string())).to_numpy(zero_copy_only=False)
        has, tail = has[apart], tail.filter(pa.array(apart))
        cut = np.zeros(len(run), bool)
        cut[has] = True
        ends = np.concatenate([[0], np.cumsum(1 + cut)])
        order = np.empty(ends[-1], np.int64)
        order[ends[:-1]] = np.arange(len(run))
        order[ends[has] + 1] = np.arange(len(run), len(run) + len(has))
        flat = pa.concat_arrays([pc.if_else(pa.array(cut), core, run), tail]).take(pa.array(order))
        fast = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return _either(plain, fast, lambda: map(self.parts_of, words.filter(pc.invert(plain)).to_pylist()))

    def _parts(self, run: str) -> tuple[str, ...] | list[str]:
        """Before the punctuation at its end, and anywhere in a long run."""
        if len(run) > CUT_FROM:
            return self._cut(run)
        core = run.rstrip(_ENDS)
        if len(core) in (0, len(run)) or run[len(core) - 1 : len(core) + 1] in self.within:
            return (run,)
        return core, run[len(core) :]

    def _cut(self, word: str) -> list[str]:
        out, a = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.within:
                out.append(word[a:i])
                a = i
        return [*out, word[a:]]

    def of_char(self, char: str) -> list[int]:
        """The ids of a character: its piece, else its bytes, else the unknown piece."""
        at = self.by_piece.get(char)
        return [at[1]] if at else [self.bytes[b] for b in char.encode("utf-8")] if self.bytes else [self.unknown]

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids, without the mark that encoding puts before it."""
        return self._text(b"".join(map(self.raw.__getitem__, ids or [])))

    def decode_in(self, ids: pa.Array, ends: np.ndarray) -> list[str]:
        """The texts of consecutive ids, each from one of ends to the next."""
        flat = self.all_raw.take(ids)
        data, at = memoryview(_bytes(flat)), _starts(flat)[ends].tolist()
        return [self._text(bytes(data[a:b])) for a, b in zip(at, at[1:], strict=False)]

    def _text(self, raw: bytes) -> str:
        return raw.replace(MARK.encode(), b" ").decode("utf-8", "replace").removeprefix(" ")


# cuts of a word by merging: positions that remain, from all of them; sc: for each inner cut the score of joining what it parts,
# of which a step renews just the two beside the cut that goes. edge: the map from s * 2^20 + e to (score, id)
_MERGE = """
if(length(unit) < 2, sequence(0, length(unit)), aggregate(sequence(1, length(unit) - 1),
  struct(sequence(0, length(unit)) AS cuts, transform(sequence(1, length(unit) - 1), k -> coalesce(try_element_at(edge, (k - 1) * 1048576L + k + 1).sc, -1e300D)) AS sc), (acc, step) ->
  transform(array(coalesce(array_max(acc.sc), -1e300D)), top -> if(top <= -1e300D, acc,
    transform(array(int(array_position(acc.sc, top))), p -> struct(
      concat(slice(acc.cuts, 1, p), slice(acc.cuts, p + 2, size(acc.cuts))) AS cuts,
      concat(slice(acc.sc, 1, greatest(p - 2, 0)),
        if(p >= 2, array(coalesce(try_element_at(edge, acc.cuts[p - 2] * 1048576L + acc.cuts[p + 1]).sc, -1e300D)), cast(array() AS array<double>)),
        if(p < size(acc.sc), array(coalesce(try_element_at(edge, acc.cuts[p - 1] * 1048576L + acc.cuts[p + 2]).sc, -1e300D)), cast(array() AS array<double>)),
        slice(acc.sc, p + 2, size(acc.sc))) AS sc))[0]))[0], acc -> acc.cuts))
"""
# an edge: its end e, minus its length b, its score sc, its id. The ids between cuts; the map and the cuts are elements of one-element
# arrays, so that each is made once and not again at every use
_MERGE_IDS = f"""
transform(array(map_from_entries(transform(found, x -> struct((x.e + x.b) * 1048576L + x.e, struct(x.sc AS sc, x.id AS id))))), edge ->
  transform(array({_MERGE}), cuts -> transform(sequence(1, size(cuts) - 1), k -> edge[cuts[k - 1] * 1048576L + cuts[k]].id))[0])[0]
"""
# best path over edges in order of their end, the longest first. w: score and ids of the best path to each of the last positions, as
# far back as a piece reaches; e, sc, b, id: the position in work and its best edge so far
_STEP_BACK = "element_at(acc.w, x.b).sc + x.sc"
_DONE = "concat(element_at(acc.w, acc.b).ids, array(acc.id))"
_VITERBI_IDS = f"""
aggregate(sort_array(found), named_struct('w', array(named_struct('sc', 0.0D, 'ids', cast(array() AS array<int>))), 'e', 1, 'sc', -1e300D, 'b', 0, 'id', 0), (acc, x) ->
  if(x.e = acc.e,
    if({_STEP_BACK} > acc.sc, named_struct('w', acc.w, 'e', acc.e, 'sc', {_STEP_BACK}, 'b', x.b, 'id', x.id), acc),
    transform(array(concat(if(size(acc.w) < {{reach}}, acc.w, slice(acc.w, 2, {{reach}} - 1)), array(named_struct('sc', acc.sc, 'ids', {_DONE})))), w ->
      named_struct('w', w, 'e', acc.e + 1, 'sc', {_STEP_BACK.replace("acc.w", "w")}, 'b', x.b, 'id', x.id))[0]),
  acc -> {_DONE})
"""


def lattice(units: DataFrame, pieces: DataFrame, *, kind: str, longest: int, lowest: float) -> DataFrame:
    """unit, ids for the distinct units; -1 - c stands for the single character c without a piece.

    pieces is broadcast: its size is the vocabulary's. The edges of a unit are found and grouped where the unit is.
    """
    # substrings are taken from blocks of a unit, as taking one from a long text walks to its place
    blocks = units.select("unit", F.explode(F.expr("sequence(0, greatest(length(unit) - 1, 0) div 64)")).alias("b"))
    blocks = blocks.select("unit", "b", F.expr(f"substring(unit, b * 64 + 1, {63 + longest})").alias("part"))
    spots = blocks.select("unit", "b", "part", F.explode(F.expr("sequence(1, least(64, length(part)))")).alias("p"))
    subs = spots.select("unit", F.expr("int(b * 64 + p - 1)").alias("s"), "part", "p", F.explode(F.expr(f"sequence(1, least({longest}, length(part) - p + 1))")).alias("n"))
    subs = subs.select("unit", "s", "n", F.expr("substring(part, p, n)").alias("sub"))
    edges = subs.join(F.broadcast(pieces), subs["sub"] == pieces["piece"], "left").filter("id is not null or n = 1")
    edges = edges.select("unit", F.expr("s + n").alias("e"), F.expr("-n").alias("b"), F.expr(f"coalesce(score, {lowest - UNKNOWN_PENALTY!r}D)").alias("sc"), F.expr("coalesce(id, -1 - ascii(sub))").alias("id"))
    found = edges.groupBy("unit").agg(F.collect_list(F.struct("e", "b", "sc", "id")).alias("found"))
    return found.select("unit", F.expr(_MERGE_IDS if kind == "merge" else _VITERBI_IDS.format(reach=longest)).alias("ids"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches, each with a number by its rows and its texts (the first column)."""
    for batch in batches:
        step = -(-batch.num_rows // min(max(1, batch.num_rows), 1 + batch.column(0).nbytes // CHUNK_BYTES))
        for lo in range(0, batch.num_rows, max(1, step)):
            part = batch.slice(lo, step)
            texts = part.column(0).fill_null("")
            h = xxhash.xxh64(str(part.num_rows))
            for t, n in zip(pc.utf8_slice_codeunits(texts, 0, 64).to_pylist(), pc.utf8_length(texts).to_pylist(), strict=True):
                h.update(t.encode() + b"|%d" % n)
            yield h.intdigest() - (1 << 63), part


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some batches of (chunk, unit, ids) at once, the rows of each chunk as one compressed row."""

    def bundles(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(np.argsort(rows.column("chunk").to_numpy(), kind="stable")).combine_chunks()
        chunk = rows.column("chunk").to_numpy()
        units, lists = rows.column("unit").chunk(0), rows.column("ids").chunk(0)
        letters, begin = _bytes(units), _starts(units)
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4")
        ends = np.flatnonzero(np.append(chunk[1:] != chunk[:-1], True)) + 1
        out = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            flat = values[at[a] : at[b]]
            held_here = (np.diff(begin[a : b + 1]), letters[begin[a] : begin[b]], np.diff(at[a : b + 1]), flat.view(np.uint8).reshape(-1, 4).T)
            out.append(zstd.ZstdCompressor(level=3).compress(pickle.dumps([x.tobytes() for x in held_here])))
        return pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[ends - 1], pa.int64()), "data": pa.array(out, pa.binary())})

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BUNDLED_ROWS:
            yield bundles(held)
            held, n = [], 0
    if n:
        yield bundles(held)


def _unbundled(bundles: list[bytes], own: Pieces) -> tuple[pa.Array, pa.ListArray]:
    """The units of a chunk's bundles and the ids of each, with those of characters without a piece."""
    got = [pickle.loads(zstd.ZstdDecompressor().decompress(data)) for data in bundles]
    sizes, letters, counts, planes = zip(*got, strict=True) if got else [(b"",)] * 4
    ids = np.concatenate([np.frombuffer(p, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel() for p in planes])
    at = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(counts), np.int32), dtype=np.int64)])
    bare = ids < 0
    if bare.any():
        chars, which = np.unique(ids[bare], return_inverse=True)
        instead = [own.of_char(chr(-1 - c)) for c in chars.tolist()]
        n = np.ones(len(ids), np.int64)
        n[bare] = np.array([len(x) for x in instead])[which]
        at = np.concatenate([[0], np.cumsum(n)])[at]
        ids, bare = np.repeat(ids, n), np.repeat(bare, n)
        ids[bare] = np.concatenate([instead[k] for k in which.tolist()])
    return _strings(np.frombuffer(b"".join(sizes), np.int32), b"".join(letters)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, pieces: Pieces, *, text: str = "text", keep: list[str] | None = None, kind: str = "viterbi", digests: bool = False, settled: bool = False) -> DataFrame:
    """The columns to keep (all, if not given) with ids; or, for digests, with n_tokens, ids_sha256, decoded_sha256 and exact.

    docs is read twice and must give the same rows in the same order. settled: it does (a table of files); else it is stored first.
    """
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(kept)))
    if not settled:
        rows = stored(rows, "texts")

    def give_back():
        pa.default_memory_pool().release_unused()  # else workers keep what one chunk took

    def pairs(batches):
        own = pickle.loads(held.value)
        for chunk, part in _chunks(batches):
            units = own.parts_in(words_in(part.column(0)).flatten().unique()).flatten().unique()
            units = units.take(pc.array_sort_indices(units))
            give_back()
            for lo in range(0, len(units), 65536):
                some = units.slice(lo, 65536)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), some], names=["chunk", "unit"])

    def packed(batches):
        for chunk, part in _chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            data = zstd.ZstdCompressor(level=3).compress(sink.getvalue())
            del sink
            give_back()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "data": pa.array([data], pa.binary())})

    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(pieces))  # the vocabulary
    # dealt by unit once, for the lattice and for the join with it: both read the same two columns, so that Spark reuses the exchange.
    # A unit has some twenty edges, which a task sorts: hence more parts than usual
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looked_up = rows.mapInArrow(pairs, "chunk long, unit string").filter("unit is not null").repartition(parts, "unit")
    distinct = looked_up.groupBy("unit").agg(F.min("chunk").alias("some")).filter("some is not null").select("unit")
    coded = lattice(distinct, pieces.table(docs.sparkSession), kind=kind, longest=pieces.longest, lowest=pieces.lowest)
    words = looked_up.join(coded.hint("merge"), "unit").select("chunk", "unit", "ids").mapInArrow(_bundled, "chunk long, data binary")
    texts = rows.mapInArrow(packed, "chunk long, data binary")

    fields = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "exact boolean"] if digests else ["ids array<int>"]
    out_schema = T.StructType([T.StructField(f"_{k}", docs.schema[c].dataType) for k, c in enumerate(kept)] + list(T._parse_datatype_string(", ".join(fields)).fields))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        own = pickle.loads(held.value)
        units, ids_of = _unbundled(left.column("data").to_pylist(), own)
        tables = []
        for data in right.column("data").to_pylist():
            whole = pa.ipc.open_stream(zstd.ZstdDecompressor().decompress(data)).read_all().to_batches()[0]
            words = words_in(whole.column(0))
            ends, said = words.offsets.to_numpy(), words.flatten().dictionary_encode()
            del words
            give_back()
            parts = own.parts_in(said.dictionary)
            found = ids_of.take(pc.index_in(parts.flatten(), value_set=units))
            if found.null_count:
                raise KeyError("a part of a word was not encoded")
            coded_words = pa.ListArray.from_arrays(found.offsets.take(parts.offsets), found.values)
            del parts, found
            give_back()
            row = 0
            for batch in slices(whole):
                here = ends[row : row + batch.num_rows + 1]
                row += batch.num_rows
                coded = coded_words.take(said.indices.slice(here[0], here[-1] - here[0]))
                ids, at = coded.values, coded.offsets.to_numpy()[here - here[0]]
                if digests:
                    back = own.decode_in(ids, at)
                    raw, bounds = memoryview(ids.to_numpy().astype("<i4")).cast("B"), (at * 4).tolist()
                    shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
                    cols = [pa.array(np.diff(at), pa.int64()), pa.array(shas, pa.string()), pa.array([hashlib.sha256(b.encode("utf-8")).hexdigest() for b in back], pa.string()), pa.array([b == (t or "") for b, t in zip(back, batch.column(0).to_pylist(), strict=True)], pa.bool_())]
                else:
                    cols = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids)]
                tables.append(pa.Table.from_arrays([*batch.columns[1:], *cols], names=out_schema.names))
        return pa.concat_tables(tables) if tables else empty.empty_table()

    empty = to_arrow_schema(out_schema)
    got = words.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(apply, out_schema)
    names = T._parse_datatype_string(", ".join(fields)).names
    return got.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(kept)), *(F.col(n).alias(free_name(docs.select(*kept), n)) for n in names))


def decode(df: DataFrame, pieces: Pieces, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of a column of ids."""
    at = df.columns.index(ids)

    def start():
        return lambda batch: [pa.array([pieces.decode(i) for i in batch.column(at).to_pylist()], pa.string())]

    return append_arrow(df, T.StructType([T.StructField(free_name(df, into), T.StringType())]), start)


def encoded_stage(docs: DataFrame, model: str = MODEL, settled: bool = False) -> DataFrame:
    """Last pipeline stage: the documents' columns without the text, and their ids."""
    return encode(docs, Pieces(model), keep=[c for c in docs.columns if c != "text"], settled=settled)


def op2_sentencepiece(spark, sf_dir):
    """Every whole document encoded by the best path over its lattice and decoded again, as digests."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Pieces(), keep=["doc_id"], digests=True, settled=True)
