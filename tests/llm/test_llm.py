"""The llm operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from provenant.llm import flac, language, linededup, mixing, pieces, quality, setjoin, spotsigs, toxicity, warc
from provenant.llm.components import components

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "12345 !!"), (5, "a" * 5000), (5, "a" * 5000), (6, "the cat " * 3000), (None, "Null id, some words"), (7, "ünï 語 \U0001f600 x")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# --- FLAC


def test_flac_round_trip_and_seek():
    rng = np.random.default_rng(1)
    samples = [b"", b"x" * 64, b"plain text, not very long " * 700, rng.integers(0, 256, 9000, np.uint8).tobytes(), (np.cumsum(rng.integers(-2, 3, 6000)) % 256).astype(np.uint8).tobytes()]
    streams = flac.flac_streams(samples)
    for payload, stream, blocks in zip(map(flac.padded, samples), streams, flac.pcm_blocks(streams), strict=True):
        assert b"".join(b["pcm"] for b in blocks).translate(flac._BACK) == payload
        assert [b["sample_offset"] for b in blocks] == list(range(0, len(payload), flac.BLOCK))
        at = len(payload) - 1
        offset, pcm = flac.seek_block(stream, at)
        assert offset == at // flac.BLOCK * flac.BLOCK and (int(pcm[at - offset, 0]) & 255) ^ 128 == payload[at]
    kinds = {s[flac.Stream(s).first + 7] >> 1 if s[flac.Stream(s).first + 2] == 0x70 else s[flac.Stream(s).first + 6] >> 1 for s in streams}
    assert len(kinds) >= 2


def test_flac_frames_without_seek_points():
    """The same frames behind a header without a SEEKTABLE: a stream as other encoders write it."""
    payload = flac.padded(bytes(range(256)) * 70 + b"\xff\xf8" * 900)
    (stream,) = flac.encode_batch([payload])
    p = flac.Stream(stream)
    plain = stream[:4] + bytes([0x80]) + stream[5:42] + stream[p.first :]
    (blocks,) = flac.pcm_blocks([plain])
    assert b"".join(b["pcm"] for b in blocks).translate(flac._BACK) == payload
    assert [b["sample_offset"] for b in blocks] == list(range(0, len(payload), flac.BLOCK))
    broken = plain[:-5] + bytes([plain[-5] ^ 8]) + plain[-4:]
    with pytest.raises(ValueError):
        flac.pcm_blocks([broken])
    assert flac.pcm_blocks([broken, plain, None], "null")[0::2] == [None, None]
    with pytest.raises(ValueError):
        flac._parse_header(bytes([0xFF, 0xF8, 0x02, 0x00, 0, 0, 0, 0]), 8)


def _bits(fields):
    text = "".join(f"{v & ((1 << n) - 1):0{n}b}" for v, n in fields if n)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def test_flac_reads_partitions_escapes_and_stereo():
    """Frames by hand: 16-bit mid/side, Rice partitions of their own parameter, one of them raw."""
    n = 16
    left = np.array([10, 12, 15, 13, 11, 9, 8, 8, 7, 7, 9, 12, 14, 15, 15, 13]) * 100
    right = left + np.array([0, 1, -1, 2, 0, 0, -3, 1, 5, 0, 0, 0, 1, 1, 2, 0])
    mid, side = (left + right) >> 1, left - right
    head = bytes([0xFF, 0xF8, 0x60, (10 << 4) | (4 << 1), 0, n - 1])
    head += bytes([flac.crc8(head)])
    fields = []
    for x, depth in ((mid, 16), (side, 17)):
        res = np.concatenate([x[:1], np.diff(x)])
        fields += [(8 + 1, 7), (0, 1), (int(x[0]), depth), (0, 2), (1, 4)]
        for part, lo, hi in ((0, 1, 8), (1, 8, 16)):
            if part:
                fields += [(15, 4), (11, 5)] + [(int(v), 11) for v in res[lo:hi]]
            else:
                fields += [(5, 4)]
                for v in res[lo:hi]:
                    u = int(v) * 2 if v >= 0 else -2 * int(v) - 1
                    fields += [(1, (u >> 5) + 1), (u & 31, 5)]
    fields = [(v, k) for v, k in fields]
    flat = []
    for v, k in fields:
        flat.append((v, k))
    body = head + _bits(flat)
    frame = body + int(flac.crc16_each([body])[0]).to_bytes(2, "big")
    got = flac.decode_frames([frame], 16)[0]
    assert (got[:, 0] == left).all() and (got[:, 1] == right).all()
    with pytest.raises(ValueError):
        flac.decode_frames([frame[:-3] + bytes([frame[-3] ^ 1]) + frame[-2:]], 16)


def test_flac_checksums_and_codes_in_step_equal_those_one_by_one():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 255, 256, 257, 512, 5000)]
    assert flac.crc16_each(parts).tolist() == [flac._crc16_on(0, p) for p in parts] and not len(flac.crc16_each([]))
    k = np.array([3, 0, 9])
    values = [rng.integers(-60, 60, n) for n in (300, 300, 7)]
    codes = [[(int(v) << 1) ^ (int(v) >> 31) for v in vs] for vs in values]
    texts = ["".join("0" * (u >> w) + "1" + (format(u & ((1 << w) - 1), f"0{w}b") if w else "") for u in us) for us, w in zip(codes, k.tolist(), strict=True)]
    bits = flac._Bits([np.packbits(np.array(list(map(int, t)), np.uint8)).tobytes() for t in texts])
    got, ends = flac._rice_whole(bits, bits.start[:-1].astype(np.int64), np.array([300, 300, 7]), k, 300)
    assert all(got[: len(v), i].tolist() == v.tolist() and not got[len(v) :, i].any() for i, v in enumerate(values))
    assert (ends - bits.start[:-1]).tolist() == [len(t) for t in texts]


def test_flac_columns(spark, awkward):
    df = awkward.withColumnRenamed("doc_id", "flac")  # a clashing name
    out = flac.read_flac(flac.write_flac(df, "text"), "_flac")
    for r in out.collect():
        assert b"".join(b["pcm"] for b in r["blocks"]).translate(flac._BACK) == flac.padded((r["text"] or "").encode())


def test_op1(spark, docs):
    want = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = flac.op1_flac(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        p = flac.padded(want[r["doc_id"]])
        x = np.frombuffer(p, np.uint8).astype(int) - 128
        media = flac.flac_streams([want[r["doc_id"]]])[0]
        assert (r["media_bytes"], r["media_sha256"], r["n_blocks"]) == (len(media), hashlib.sha256(media).hexdigest(), -(-len(p) // 4096))
        crossings = sum((a > 0) != (b > 0) for a, b in zip(x, x[1:], strict=False))
        assert r["feature"] == f"mean={x.mean():.4f};power={(x * x).mean():.3f};crossings={crossings};levels={len(set((x >> 4).tolist()))}"
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(want[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


# --- SentencePiece


def best_path(run, by_piece, lowest):
    """A plain dynamic program over one line: ids of the best sum of scores, the longest piece first among equals."""
    best = [(0.0, 0)]
    for e in range(1, len(run) + 1):
        found = []
        for a in range(max(0, e - 16), e):
            at = by_piece.get(run[a:e])
            if at or a == e - 1:
                found.append((best[a][0] + (at[0] if at else lowest - 10.0), a))
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    cuts = [len(run)]
    while cuts[-1]:
        cuts.append(best[cuts[-1]][1])
    return [run[a:b] for a, b in zip(cuts[::-1], cuts[-2::-1], strict=False)]


@pytest.fixture(scope="module")
def vocabulary():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    return m


def test_merging_equals_the_library(spark, docs, awkward):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    p = pieces.Pieces()
    both = docs.select("doc_id", "text").union(awkward)
    out = pieces.encode(both, p, keep=["doc_id", "text"], kind="merge")
    got = pieces.decode(out, p).collect()
    assert len(got) == both.count()
    for r in got:
        assert r["ids"] == sp.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")


def test_words_are_cut_by_arrow(docs, monkeypatch):
    """Arrays of texts and words are cut as single ones are, and only few words one by one; ids of arrays decode as single lists do."""
    import pyarrow as pa

    p, rng = pieces.Pieces(), random.Random(3)
    texts = [t for _, t in AWKWARD] + [" ", "  ", "a ", " a", "a  b\n  c \n", "\n\n x.\n", "word.\nNext, (x) ...", "▁ ▁▁x a▁b", "don't. e.g., 3.5% !!", "x" * 31 + ".", "x" * 32, "é" * 31 + ")", "語!"]
    texts += ["".join(rng.choice("ab.,!? \n▁語é)") for _ in range(rng.randrange(60))) for _ in range(500)]
    for some in (texts, [], [None, ""], ["a b"], texts[8:12]):
        words = pieces.words_in(pa.array(some, pa.string()))
        assert words.to_pylist() == [pieces.words_of(t) for t in some]
        assert p.parts_in(words.flatten()).to_pylist() == [p.parts_of(w) for w in words.flatten().to_pylist()]
    ids = [rng.randrange(len(p.raw)) for _ in range(900)]
    ends = [0, 0, 5, 400, 400, 900]
    assert p.decode_in(pa.array(ids, pa.int32()), np.array(ends)) == [p.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    words = pieces.words_in(pa.array([r["text"] for r in docs.select("text").collect()], pa.string())).flatten().unique()
    single, cut = [], p.parts_of
    monkeypatch.setattr(p, "parts_of", lambda w: single.append(w) or cut(w))
    p.parts_in(words)
    assert len(single) < len(words) / 5 and all("\n" in w or len(w) >= pieces.CUT_FROM for w in single)


def test_op2_is_the_best_path(spark, docs, awkward, vocabulary, tmp_path):
    """The registered query's ids are those of a plain dynamic program over whole lines, and no worse than the library's unigram engine's."""
    import sentencepiece

    by_piece = {x.piece: (x.score, i) for i, x in enumerate(vocabulary.pieces) if x.type in (1, 4)}
    lowest = min(v[0] for v in by_piece.values())
    bytes_of = {int(x.piece[1:-1], 16): i for i, x in enumerate(vocabulary.pieces) if x.type == 6}
    coded = lambda part: [by_piece[part][1]] if part in by_piece else [bytes_of[b] for b in part.encode()]
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id % 7 = 0").collect()] + AWKWARD + [(8, "a  b\n  c \n"), (9, " x"), (10, "y" * 150 + "zq" * 90)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"], r["exact"]) for r in pieces.op2_sentencepiece(spark, str(tmp_path)).collect()}
    vocabulary.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.SerializeToString())
    score = lambda parts: sum(by_piece[x][0] if x in by_piece else lowest - 10 for x in parts)
    want = set()
    for i, t in rows:
        parts, line = [], pieces.MARK + (t or "").replace(" ", pieces.MARK) if t else ""
        for k, run in enumerate(line.split("\n")):
            parts += (["\n"] if k else []) + best_path(run, by_piece, lowest)
        ids = [x for part in parts for x in coded(part)]
        want.add((i, hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids), True))
        if t and len(t) < 900:
            assert score(parts) >= score(sp.encode(t, out_type=str)) - 1e-6
    assert got == want
    p = pieces.Pieces()
    clash = pieces.encode(spark.createDataFrame([(1, "a b", [9])], "doc_id long, text string, ids array<int>"), p)
    assert clash.columns == ["doc_id", "text", "ids", "_ids"] and clash.first()["ids"] == [9]
    assert pieces.encoded_stage(clash.drop("_ids")).columns == ["doc_id", "ids", "_ids"]
    assert pieces.encode(spark.createDataFrame([], SCHEMA), p).count() == 0


# --- quality, language, toxicity


def test_quality_orders_grades(spark):
    made = quality.fit_examples([("fine words of a kind here", 2)] * 30 + [("fine words but nasty trash here", 1)] * 30 + [("spam spam spam spam", 0)] * 30, 3)
    assert made.thresholds[0] < made.thresholds[1]
    known = {}
    e = [float(made.tails(*quality.features(t, known)).sum()) for t in ("fine words of a kind", "fine nasty trash words", "spam spam spam")]
    assert e[0] > e[1] > e[2]
    assert np.isfinite(made.tails(*quality.features(None, known))).all()
    assert np.allclose(quality.fit_examples([], 3).tails(*quality.features("x", known)), [2 / 3, 1 / 3])


def test_quality_is_the_stated_model(spark, awkward):
    """Scores of awkward rows equal the cumulative-link formula on features written out by their definition."""
    import math

    rows = [("fine words here", 2), ("fine but trash", 1), ("spam spam 9", 0)] * 9
    model = quality.fit_examples(rows, 3)
    out = quality.score(awkward.withColumnRenamed("doc_id", "keep"), model).collect()
    assert len(out) == len(AWKWARD) and out[0].asDict().keys() == {"keep", "text", "expected_grade", "tail_probability", "_keep"}
    b = lambda f: zlib.crc32(f.encode()) & (2**15 - 1)
    for r in out:
        ws = (r["text"] or "").split()
        n = {w: ws.count(w) for w in set(ws)} if len(ws) < 9 else None
        if n is None:
            continue
        x, norm = {}, math.sqrt(sum((1 + math.log(k)) ** 2 for k in n.values())) or 1.0
        total = max(1, len(ws))
        put = lambda f, v: x.__setitem__(b(f), x.get(b(f), 0.0) + v)
        for w, k in n.items():
            put("w " + w.lower(), (1 + math.log(k)) / norm)
            put("s " + quality.shape_of(w), k / total)
        put("m again", 3 * sum(p == q for p, q in zip(ws, ws[1:], strict=False)) / total)
        put(f"m length {int(math.log2(total))}", 0.5)
        put("m variety", len(n) / total)
        put(f"m variety {int(8 * len(n) / total)} {int(math.log2(total)) // 2}", 0.5)
        put("m bias", 1.0)
        z = sum(model.weights[k] * v for k, v in x.items())
        tails = [1 / (1 + math.exp(-(z - t))) for t in model.thresholds]
        assert math.isclose(r["expected_grade"], sum(tails), abs_tol=1e-9) and math.isclose(r["tail_probability"], tails[0], abs_tol=1e-9) and r["_keep"] == (tails[0] >= 0.5)
    assert quality.score(awkward.limit(0), model).count() == 0


def test_quality_reads_whole_words():
    bins = lambda t: set(quality.features(t, {})[0].tolist())
    assert bins("x" * 32 + "good") != bins("x" * 32 + "trash")
    assert quality._bin("s " + quality.shape_of("a" * 64 + "9.")) in bins("a" * 64 + "9.") - bins("a" * 64)


def test_quality_query(spark):
    got = {r["doc_id"]: r for r in quality.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert len(got) == 1000 and sum(got[r["doc_id"]]["keep"] == (r["quality"] == 1) for r in labels) / len(labels) > 0.9


def test_language(spark, awkward):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in language.op4_language_id(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held and sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.95
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in got)
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    out = language.identify(awkward.withColumnRenamed("doc_id", "score"), model).collect()
    assert {r["score"]: r["lang_pred"] for r in out if r["score"] in (1, 2, 3, 4)} == {1: "und", 2: "und", 3: "und", 4: "und"}
    # the nearest centroid by cosines written out, and letters of no language that was learned
    texts = [spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en' and length(text) > 300").first()["text"], "\u0436\u0434\u0451\u043c \u0437\u0434\u0435\u0441\u044c \u0434\u043e\u043b\u0433\u043e " * 9]
    (lang, score, rejected) = model.classify(texts)
    v = np.zeros(language.BINS)
    np.add.at(v, language.trigram_bins(texts[0]), 1)
    v = np.log1p(v) * model.idf
    cos = model.centroids @ (v / np.linalg.norm(v))
    assert lang[0] == model.labels[int(cos.argmax())] and abs(score[0] - cos.max()) < 1e-5
    assert rejected == [False, True]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = language.fit(empty)
    assert language.identify(empty, none).count() == 0 and language.identify(awkward, none).filter("lang_pred <> 'und'").count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    x = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    index = toxicity.BlockMaxIndex.build([(np.flatnonzero(row), row[row > 0]) for row in x], 16)
    for _ in range(50):
        q = rng.random(40) * (rng.random(40) < 0.15)
        at = np.flatnonzero(q)
        if len(at):
            w = q[at] / np.linalg.norm(q[at])
            ids, sims = index.nearest(at, w, 7)
            full = x[:, at] @ w
            want = sorted(full[full > 0], reverse=True)[:7]
            assert np.allclose(sims, want, atol=1e-6) and np.allclose(full[ids], sims, atol=1e-6)
    ids, sims = toxicity.BlockMaxIndex.build([]).nearest(np.array([1]), np.array([1.0]), 3)
    assert not len(ids) and not len(sims)


def test_toxicity_bins_of_words_and_stems_are_counted_in_one_sort():
    known = toxicity.Bins()
    at, stem = known.of(["walks", "walking", "walkings", "größer"])
    assert stem.tolist() == [1, 2, 3] and at[4] == at[5] != at[6] and at[6] == zlib.crc32("größe".encode(), 1) % toxicity.BINS
    text = "Walking walkings walks WALKING größer " * 3 + "x"
    plain = {}
    for w in text.lower().split():
        for b in [zlib.crc32(w.encode()), *([zlib.crc32(w[: toxicity.STEM].encode(), 1)] if len(w) > toxicity.STEM else [])]:
            plain[b % toxicity.BINS] = plain.get(b % toxicity.BINS, 0) + 1
    bins, n = toxicity.term_counts(text, known)
    assert dict(zip(bins.tolist(), n.tolist(), strict=True)) == plain and bins.tolist() == sorted(plain)
    assert set(toxicity.bins_held(text, known).tolist()) == set(plain)
    assert all(len(x) == 0 for x in toxicity.term_counts(None, known))


def test_toxicity_neighbours_are_brute_force_ones(spark):
    """The query's evidence against cosines of plain dictionaries over all terms, with the model's scale of each term."""
    import math

    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)

    def vector(t):
        tf = {}
        for w in re.findall(r"\w+", (t or "").lower()):
            for b in {zlib.crc32(w.encode()) & (2**20 - 1), *([zlib.crc32(w[:5].encode(), 1) & (2**20 - 1)] if len(w) > 5 else [])}:
                tf[b] = tf.get(b, 0) + 1
        v = {b: (1 + math.log(n)) * float(model.scale[b]) for b, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()} if norm else {}

    examples = [vector(text[i]) for i in model.ids.tolist()]
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, sf).collect()}
    assert set(got) == set(text)
    for i in sorted(text)[::9]:
        v = vector(text[i])
        sims = sorted((sum(x * e.get(b, 0.0) for b, x in v.items()) for e in examples), reverse=True)[:3]
        shown = [float(e.split(":")[2]) for e in got[i]["evidence"].split()]
        assert np.allclose(shown, [x for x in sims if x > 0], atol=2e-3)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_toxicity(spark, awkward):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["sun", "tree", "road", "house", "green", "water", "stone"]) for _ in range(40)) for _ in range(300)]
    rows = [(i, t + (" you idiot" if i % 5 == 0 else ""), int(i % 5 == 0)) for i, t in enumerate(clean)]
    idf = np.full(toxicity.BINS, 2.0)
    model = toxicity.fit_examples(rows, idf)
    score = lambda t: model.score(t, toxicity.Bins(), {})
    assert score("what an idiot you are")[0] >= 0.3 > score("a green tree")[0]
    assert score(None) == (model.blank, "") == score("") == score("?!")
    out = toxicity.score(awkward.withColumnRenamed("doc_id", "score"), model)
    assert out.count() == len(AWKWARD) and out.columns[:3] == ["score", "text", "_score"]
    assert len({r["_score"] for r in out.filter("score = 5").collect()}) == 1
    assert toxicity.fit_examples([], idf).score("x", toxicity.Bins(), {})[0] == 0.0
    assert toxicity.score(awkward.limit(0), model).count() == 0


def test_toxicity_finds_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, sf).collect()}
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p for p, y in held if y == 1) >= 0.6 * sum(y for _, y in held) and sum(p for p, y in held if y == 0) <= 0.05 * len(held)


# --- fingerprints


def plain_signatures(text):
    """Signatures by their definition, one spot after another, hashed as published: XXH64."""
    import xxhash

    words = re.findall(r"\w+", (text or "").lower())
    found = set()
    for k, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[k + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                found.add(" ".join([w, *chain]))
    if not found:
        found = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else {text} if text else set()
    return sorted(xxhash.xxh64_intdigest(x.encode()) for x in found)


def test_spotsigs(spark, tmp_path):
    import base64

    rows = [(i, t) for i, t in AWKWARD if i != 5] + [(5, "a" * 5000)] + [(100 + k, f"the word{k} of a tale about thing{k % 3} and more to say") for k in range(30)]
    rows += [((1 << 60) + k, f"the end{k} of long ids and a tale{k % 5}") for k in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in spotsigs.op6_spotsigs(spark, str(tmp_path)).collect()}
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    shown = lambda s: base64.b64encode(b"".join(x.to_bytes(8, "big") for x in s)).decode()
    like = lambda a, b: float(not a and not b) if not a or not b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        own, edited, after = map(plain_signatures, (t, e, nxt))
        r = got[None if i == -(1 << 63) else i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), shown(own), shown(edited))
        assert abs(r["near_edited"] - like(set(own), set(edited))) < 1e-9 and abs(r["near_next"] - like(set(own), set(after))) < 1e-9
    assert spotsigs.jaccard(np.array([1, 2, 3]), np.array([1]), 0.5) == 0.0
    assert spotsigs.fingerprint(spark.createDataFrame([(1, "the a b")], "fingerprint long, text string")).columns == ["fingerprint", "text", "_fingerprint"]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spotsigs.op6_spotsigs(spark, f"{tmp_path}/none").count() == 0


def test_spotsigs_near_duplicates(spark):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(300)]
    base = [[x for _ in range(40) for x in (rng.choice(["the", "of", "and"]), rng.choice(vocab))] for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "?!")]
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((10 + i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {i: set(plain_signatures(t)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def test_next_document_over_many_buckets(spark):
    """Distinct ids over many buckets, and one id that fills most of them."""
    for rows in ([(3 * i, f"t{i}") for i in range(500)], [(7, f"t{i}") for i in range(400)] + [(i, f"u{i}") for i in range(100)] + [(None, f"n{i}") for i in range(200)]):
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        pending, after = None, {}
        for r in spotsigs.with_next(df, buckets=13).collect():
            if pending is not None and pending["bucket"] == r["bucket"]:
                after[(pending["i"], pending["t"])] = (r["i"], r["t"])
            pending = None if r["ahead"] else r
        assert set(after) == set(rows) == set(after.values())
        at, seen = max((r for r in rows if r[0] is not None), key=lambda r: r[0]), []
        if len({r[0] for r in rows}) < len(rows):
            at = next(r for r in rows if r[0] == 99)
        for _ in rows:
            seen.append(at[0])
            at = after[at]
        falls = sum((b is not None and a is None) or (a is not None and b is not None and b > a) for a, b in zip(seen, seen[1:], strict=False))
        assert falls == 0


# --- WARC


def test_warc(spark, tmp_path):
    html = [None, "", "<p>same</p>" * 50, "<p>same</p>" * 50, "<p>é語</p>", "x" * 200_000, None] + [f"<html><body>page {i % 40} with words</body></html>" for i in range(300)]
    rows = [(100 - i, None if i == 2 else f"http://h/{i}\r\nx", h) for i, h in enumerate(html[:50])] + [(1000 + i, f"http://h/{i}", h) for i, h in enumerate(html[50:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_warc(warc.with_revisits(pages)).persist()
    got = {r["page"]: r for r in warc.read_warc(archives).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        p = (h or "").encode()
        r = got[i]
        own = first[h or ""] == i
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(p), warc.digest_of(p), "response" if own else "revisit", None if own else first[h or ""])
        assert (bytes(r["payload"]) if own else r["payload"]) == (p if own else None)
    warc.export(archives, f"{tmp_path}/out")
    names = sorted((tmp_path / "out").iterdir())
    content = names[0].read_bytes()
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
    at, size, rec = list(warc.records(content))[-1]
    assert warc.parse(rec)[0]["WARC-Type"] in ("response", "revisit") and at + size == len(content)


# --- line dedup


def brute_dedup(rows, gram=25, window=25):
    """Winnowing, extension and deletion by their definitions, with the lines themselves in place of their hashes, but for the order of
    grams in a window, which is that of XXH64 over the lines' hashes."""
    import xxhash

    signed = lambda b: xxhash.xxh64_intdigest(b) - (1 << 63)
    lines = {i: [(k, x.strip(), len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()] for i, t in rows}
    prints = {}
    for i, own in lines.items():
        def reach(a, least, own=own):
            n = 0
            for e in range(a, len(own)):
                n += own[e][2]
                if n >= least:
                    return e + 1
            return None

        order = {}
        for a in range(len(own)):
            if e := reach(a, gram):
                order[a] = signed(np.array([signed(x[1].encode()) for x in own[a:e]], np.int64).tobytes())
        for a in range(len(own)):
            if (e := reach(a, window)) and (inside := [k for k in range(a, e) if k in order]):
                k = min(inside, key=lambda k: (order[k], k))
                prints[(i, k)] = tuple(x[1] for x in own[k : reach(k, gram)])
    first = {}
    for at, g in prints.items():
        first[g] = min(first.get(g, at), at)
    marks = {}
    for i, k in prints:
        marks.setdefault(i, []).append(k)
    gone = {i: set() for i in lines}
    for (i, a), g in prints.items():
        o, b = first[g]
        if (o, b) == (i, a):
            continue
        # each side carries lines from its fingerprint before to the end of the gram of the one after, and no more than two windows on
        def around(j, k):
            ks = sorted(marks[j])
            p = ks.index(k)
            e = len(prints[(j, k)])
            low = max(ks[p - 1] if p else 0, k - gram - window)
            high = ks[p + 1] + len(prints[(j, ks[p + 1])]) if p + 1 < len(ks) else len(lines[j])
            return low, min(high, k + e + 2 * (gram + window))

        (la, ha), (lb, hb) = around(i, a), around(o, b)
        s, e = 0, 0
        while a - s - 1 >= la and b - s - 1 >= lb and lines[i][a - s - 1][1] == lines[o][b - s - 1][1]:
            s += 1
        while a + e < ha and b + e < hb and lines[i][a + e][1] == lines[o][b + e][1]:
            e += 1
        start = max(a - s, b + len(g)) if o == i else a - s
        gone[i] |= {lines[i][k][0] for k in range(start, a + e)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n))
    passage = [line(20), line(30), line(15)]
    rows = []
    for i in range(40):
        own = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            own[1:1] = passage
        rows.append((i, "\n".join(own)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "\n".join(["same line of six words here"] * 30)), (54, "\n".join(passage))]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("doc_id", "clean_text")  # a clashing name
    got = {r["clean_text"]: r["_clean_text"] for r in linededup.dedup_lines(df, id_col="clean_text").collect()}
    assert got == brute_dedup(rows)
    assert sum("\n".join(passage) in (t or "") for t in got.values()) == 1
    assert got[54] == "" and got[50] is None
    kept = {x for t in got.values() if t for x in t.split("\n")}
    assert kept >= {x for _, t in rows if t for x in t.split("\n")}
    nulls = spark.createDataFrame([(None, "\n".join(passage)), (3, "\n".join(passage))], SCHEMA)
    assert {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(nulls).collect()} == {None: 0, 3: 3}
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "\n".join(passage))] * 2, SCHEMA)
    assert linededup.dedup_lines(twice).filter("n_removed > 0").count() == 0


# --- Jaccard join


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, num):
    rng = random.Random(size)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 120))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "one two"), (6, "É x"), (7, "é x"), (8, "a b c d e f"), (9, "A B C  D\te F")]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice([*vocab, f"own{i}"])
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, " ".join(base[0][:25] + [rng.choice(vocab) for _ in range(40)])) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(df, size=size, num=num).collect()}
    assert got == brute_components(rows, size, num, 100)
    kept = setjoin.keep_one(df.withColumnRenamed("text", "body"), size=size, num=num, text="body")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_links_classes_removed_with_a_leader(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    s, q = words("s", 900), words("q", 60)
    # 1 leads and takes 2 out of every group, so 3, which only 2 links to, is alone in what is left; 4 and 5 share 1's other words
    sets = {1: s + q, 2: s + words("p", 30), 3: s + words("t", 60), 4: q + words("r", 900), 5: [*q, *words("r", 900), "more"]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in sets.items()], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in setjoin.jaccard_components(df, size=1, num=90, den=100).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} == {i: c for i, (_, c) in brute_components(list(df.collect()), 1, 90, 100).items()}


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = dict(rows_of(components(links), "v", "c"))
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_jaccard_of_nothing(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


# --- mixing


def test_mixing_keeps_to_its_shares(spark):
    n = {"a": 700, "b": 300, "c": 90, None: 33, "z": 17}
    rows = [(i * 10 + k, s) for k, (s, m) in enumerate(n.items()) for i in range(m)]
    weights = {"a": 5, "b": 3, "c": 2}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string").withColumnRenamed("doc_id", "slot"), weights, id_col="slot", block_rows=4)
    assert got.columns == ["slot", "source", "block", "_slot", "position"]
    rows_out = got.collect()
    assert sorted(r["slot"] for r in rows_out) == sorted(r[0] for r in rows)
    at = {}
    for r in rows_out:
        s = r["source"] if r["source"] in weights else ""
        assert at.setdefault(r["_slot"], (s, r["block"])) == (s, r["block"])
    slots = [at[k] for k in sorted(at)]
    assert sorted(at) == list(range(len(slots)))
    unit = {**weights, "": 1}
    blocks = {"a": 175, "b": 75, "c": 23, "": 13}
    full = min(blocks[s] // unit[s] for s in unit) * sum(unit.values())
    done = dict.fromkeys(unit, 0)
    for t, (s, b) in enumerate(slots, 1):
        assert b == done[s]
        done[s] += 1
        if t <= full:
            assert all(abs(done[x] - unit[x] * t / 11) < 1 for x in unit)


def test_mixing_weights(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(90)], "doc_id long, source string")
    for bad in ({"s0": 0}, {"s0": -1}, {"s0": 1_000_003, "s1": 2}):
        with pytest.raises(ValueError):
            mixing.mix(rows, bad)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mixing.mix(rows, {"s0": 2_000_000, "s1": 1_000_000}, others=1_000_000, block_rows=4)) == key(mixing.mix(rows, {"s0": 2, "s1": 1}, block_rows=4))


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string"), {"a": 1}).count() == 0


def test_mixing_is_native(spark, docs):
    plan = mixing.mix(docs, mixing.target_weights())._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline and SQL


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mix_sources", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = language.keep_identified(docs, language.fit(docs))
    kept = linededup.rewrite_lines(kept)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {i for i, (_, c) in brute_components(rows, 5, 80, 100).items() if i == c}
    got = out.collect()
    assert {r["doc_id"] for r in got} == want and "text" not in out.columns
    p, text = pieces.Pieces(), dict(rows)
    assert all(p.decode(r["ids"]) == text[r["doc_id"]] for r in got)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    prose = [(20 + i, "A first line of words here\nand a second of them " + " ".join(f"w{k}" for k in range(i, i + 30)), "en") for i in range(30)]
    rows = [(i, t, "en") for i, t in AWKWARD] + prose + prose[:3]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'src0' as source", "array(1) as ids", "7L as position", "'x' as rejected").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "ids", "position", "rejected", "_position", "_ids"]
    got = out.collect()
    assert {r["position"] for r in got} == {7} and sorted(r["_position"] for r in got) == list(range(len(got)))
    assert not {r["doc_id"] for r in got} & {1, 2, 3, 4}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_rows_follow_the_mixture(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i, f"some words {i}", f"src{i % 2}") for i in range(200)] + [(7, "some words 7", "src1"), (None, "no id", "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    at = []
    for weights in ({"src0": 3, "src1": 1}, {"src0": 1, "src1": 3}):
        monkeypatch.setattr(mixing, "target_weights", lambda w=weights: w)
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert sorted(r["source"] for r in got) == sorted(r[2] for r in rows)
        want = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights)
        assert sorted((r["position"], str(r["doc_id"])) for r in got) == sorted((r["position"], str(r["doc_id"])) for r in want.collect())
        at.append([r["source"] for r in sorted(got, key=lambda r: r["position"])])
    assert at[0][:64].count("src0") == 48 and at[1][:64].count("src1") == 48


@pytest.mark.parametrize("name", ["op7_warc", "op10_mixing"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from provenant.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(map(repr, rows_of(got, *rel.columns))) == sorted(map(repr, rel.fetchall()))
