"""FLAC columns: lossless encoding and decoding of sample blocks, many frames at a time.

The writer cuts a column of byte payloads into mono 8-bit frames (sample = byte - 128), predicts each with
the better of the fixed predictors of order 0 to 2 and a quantised linear predictor, codes residuals with
Rice codes, and adds a seek point for every frame. The reader checks the header and frame checksums and the MD5 of
all samples, decodes Rice partitions and predictors of any order, and yields PCM blocks with their sample offsets.
Where a stream's seek points leave frames out, they are found by their sync codes and both checksums.
Frames of a batch are decoded in step: one numpy operation handles the same residual of every frame.

Defined cases: null payloads count as empty; a payload is padded with zero bytes to a positive multiple of 64,
so an empty one is 64 zero samples (a constant subframe). A very long payload is many frames, of which IN_STEP are held at once.
A damaged stream raises ValueError, or gives null blocks with on_error="null". Null streams give null blocks. Equal payloads
give equal streams, so repeated rows and ties do too. New columns get underscores before names that the table has.
An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import append_arrow, free_name, spread, stored, table

BLOCK = 4096
ORDER = 4
PRECISION, SHIFT = 10, 7
SAMPLE_RATE = 8000
PAD = 64
#: Frames that are handled in step, and samples of a payload batch.
IN_STEP, BATCH_SAMPLES = 512, 1 << 20
#: Fixed values of the format: predictor coefficients, newest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(width: int, poly: int) -> np.ndarray:
    out, top, mask = np.zeros(256, np.uint32), 1 << (width - 1), (1 << width) - 1
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


_CRC8 = _crc_table(8, 0x07).tolist()
_CRC16 = _crc_table(16, 0x8005).astype(np.uint16)
_CRC16_LIST = _CRC16.tolist()
#: Bytes of a block whose checksum is a sum over its places.
_SPAN = 256


def _place_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte at each place of a block adds to the block's CRC-16, and each CRC-16 after a block of zeros."""
    on = lambda crc: (crc << np.uint16(8)) ^ _CRC16[crc >> np.uint16(8)]
    places, far = [_CRC16], np.arange(1 << 16, dtype=np.uint16)
    for _ in range(_SPAN - 1):
        places.append(on(places[-1]))
    for _ in range(_SPAN):
        far = on(far)
    return np.stack(places[::-1]), far


_AT_PLACE, _FAR = _place_tables()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16_each(parts: list[bytes]) -> np.ndarray:
    """CRC-16 of each byte string; zero bytes put before one leave it as it is, so all end with a block and run in step."""
    blocks = -(-max(map(len, parts), default=0) // _SPAN)
    width = blocks * _SPAN
    rows = np.zeros((len(parts), width), np.uint8)
    for i, p in enumerate(parts):
        rows[i, width - len(p) :] = np.frombuffer(p, np.uint8)
    own = np.zeros(len(parts) * blocks, np.uint16)
    for at, col in zip(_AT_PLACE, np.ascontiguousarray(rows.reshape(-1, _SPAN).T), strict=True):
        own ^= at.take(col)
    crc = np.zeros(len(parts), np.uint16)
    for col in own.reshape(len(parts), blocks).T:
        crc = _FAR[crc] ^ col
    return crc


def _crc16_on(crc: int, data: bytes) -> int:
    """CRC-16 carried on over further bytes."""
    table = _CRC16_LIST
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b]
    return crc


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail: list[int] = []
    room = 0x3F
    while n > room:
        tail.insert(0, 0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([((~room << 1) & 0xFF) | n, *tail])


def _frame_header(n: int, number: int) -> bytes:
    size = bytes([0xC0]) if n == 4096 else bytes([0x70])
    head = b"\xff\xf8" + size + b"\x02" + _coded_number(number) + (b"" if n == 4096 else struct.pack(">H", n - 1))
    return head + bytes([crc8(head)])


# ---------------------------------------------------------------- writing


def _linear_predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of order ORDER for each row, by the Levinson-Durbin recursion on autocorrelations."""
    f = x.astype(np.float32)
    width = f.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : width - lag]) if lag < width else np.zeros(len(f)) for lag in range(ORDER + 1)]).astype(np.float64)
    err = np.maximum(r[0], 1e-9)
    a = np.zeros((ORDER, len(f)))
    for m in range(ORDER):
        k = (r[m + 1] - (a[:m] * r[m:0:-1]).sum(axis=0)) / err
        a[:m] = a[:m] - k * a[:m][::-1]
        a[m] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = 1 << (PRECISION - 1)
    return np.clip(np.rint(a.T * (1 << SHIFT)), -top, top - 1).astype(np.int32)


def _residual(x: np.ndarray, coef: np.ndarray, shift: int) -> np.ndarray:
    """x minus its prediction; coef has a row for each row of x, newest sample first. The first samples predict from zeros."""
    acc = np.zeros_like(x)
    for j in range(coef.shape[1]):
        acc[:, j + 1 :] += coef[:, j : j + 1] * x[:, : -j - 1]
    return x - (acc >> shift)


def _rice_cost(res: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, and for each row the best Rice parameter and its bits."""
    u = ((res << 1) ^ (res >> 31)) * keep
    n = keep.sum(axis=1)
    k0 = np.log2(np.maximum(u.sum(axis=1) / np.maximum(n, 1), 1)).astype(np.int32)
    best_k, best = np.zeros(len(u), np.int32), np.full(len(u), 1 << 60, np.int64)
    for d in (-1, 0, 1):
        k = np.clip(k0 + d, 0, 14)
        bits = (u >> k[:, None]).sum(axis=1) + n * (k + 1)
        best_k, best = np.where(bits < best, k, best_k), np.minimum(bits, best)
    return u, best_k, best


def encode_frames(x: np.ndarray, n: np.ndarray, numbers: list[int]) -> list[bytes]:
    """A frame for each row of int32 samples, of which the first n count."""
    rows, width = x.shape
    t = np.arange(width)
    inside = t < n[:, None]
    x = x * inside
    fixed = [x]  # the predictors of order 0 to 2: each residual is the difference of the one before
    for _ in range(2):
        fixed.append(np.diff(fixed[-1], axis=1, prepend=np.int32(0)))
    cost = np.stack([(np.abs(r) * (inside & (t >= o))).sum(axis=1) for o, r in enumerate(fixed)])
    order = cost.argmin(axis=0)
    res = np.stack(fixed)[order, np.arange(rows)]
    u, k, bits = _rice_cost(res, inside & (t >= order[:, None]))
    coef = _linear_predictors(x)
    lin_u, lin_k, lin_bits = _rice_cost(_residual(x, coef, SHIFT), inside & (t >= ORDER))
    use_lin = (lin_bits + ORDER * (8 + PRECISION) + 9 < bits + order * 8) & (n > 4 * ORDER)
    order = np.where(use_lin, ORDER, order)
    k = np.where(use_lin, lin_k, k).astype(np.int64)
    u = np.where(use_lin[:, None], lin_u, u)
    bits = np.where(use_lin, lin_bits, bits)
    flat = ((x == x[:, :1]) | ~inside).all(axis=1)
    plain = ~flat & (bits + order * 8 + 10 >= n * 8)
    use_lin, rice = use_lin & ~flat & ~plain, ~flat & ~plain
    order = np.where(rice, order, 0)

    # every field of a frame's body is a value with its bits; unary zeros are part of a code's length
    head = 1 + ORDER + 2 + ORDER + 3
    value, size = (np.zeros((rows, head + width), np.int32) for _ in range(2))
    kind = np.where(flat, 0, np.where(plain, 1, np.where(use_lin, 31 + ORDER, 8 + order)))
    value[:, 0], size[:, 0] = kind << 1, 8
    warm = t[:ORDER] < order[:, None]
    value[:, 1 : 1 + ORDER][:, : warm.shape[1]], size[:, 1 : 1 + ORDER][:, : warm.shape[1]] = (x[:, :ORDER] & 255) * warm, 8 * warm
    at = 1 + ORDER
    value[:, at], size[:, at] = (PRECISION - 1) * use_lin, 4 * use_lin
    value[:, at + 1], size[:, at + 1] = SHIFT * use_lin, 5 * use_lin
    value[:, at + 2 : at + 2 + ORDER], size[:, at + 2 : at + 2 + ORDER] = (coef & ((1 << PRECISION) - 1)) * use_lin[:, None], PRECISION * use_lin[:, None]
    at += 2 + ORDER
    size[:, at], size[:, at + 1] = 2 * rice, 4 * rice
    value[:, at + 2], size[:, at + 2] = k * rice, 4 * rice
    coded = inside & (t >= order[:, None]) & rice[:, None]
    kk = k[:, None].astype(np.int32)
    value[:, head:] = np.where(coded, (1 << kk) | (u & ((1 << kk) - 1)), (x & 255) * (plain[:, None] & inside))
    size[:, head:] = np.where(coded, (u >> kk) + 1 + kk, 8 * (plain[:, None] & inside))
    value[:, head], size[:, head] = np.where(flat, x[:, 0] & 255, value[:, head]), np.where(flat, 8, size[:, head])

    ends = np.cumsum(size, axis=1, dtype=np.int64)
    length = (ends[:, -1] + 7) // 8
    start = np.concatenate([[0], np.cumsum(length)])
    # a value of up to 32 bits lies in the word of its last bit and the one before; those of a word don't overlap, so they are summed
    last = (ends + (start[:-1, None] * 8 + 31)).ravel()  # the last bit, one word on
    word = last >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums = np.add.reduceat(value.ravel().astype(np.uint64) << (31 - (last & 31)).astype(np.uint64), first)
    words = np.zeros(int(start[-1]) // 4 + 3, np.uint32)
    words[word[first]] = sums.astype(np.uint32)
    words[word[first] - 1] |= (sums >> np.uint64(32)).astype(np.uint32)
    body = words[1:].astype(">u4").tobytes()
    parts = [_frame_header(int(n[i]), numbers[i]) + body[start[i] : start[i + 1]] for i in range(rows)]
    return [p + struct.pack(">H", c) for p, c in zip(parts, crc16_each(parts).tolist(), strict=True)]


def _stream(samples: bytes, frames: list[bytes]) -> bytes:
    """Marker, STREAMINFO, SEEKTABLE with every frame, then the frames."""
    sizes = [len(f) for f in frames]
    n = len(samples)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + ((SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(samples).digest()
    seek, at = b"", 0
    for i, s in enumerate(sizes):
        seek += struct.pack(">QQH", i * BLOCK, at, min(BLOCK, n - i * BLOCK))
        at += s
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def padded(payload: bytes | None) -> bytes:
    payload = payload or b""
    return payload + bytes(-len(payload) % PAD if payload else PAD)


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of PAD."""
    signed = [(np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8) for p in payloads]
    jobs = sorted(((len(s) - a if len(s) - a < BLOCK else BLOCK, i, a) for i, s in enumerate(signed) for a in range(0, len(s), BLOCK)), reverse=True)
    frames: list[list[bytes]] = [[b""] * -(-len(s) // BLOCK) for s in signed]
    for lo in range(0, len(jobs), IN_STEP):
        part = jobs[lo : lo + IN_STEP]
        x = np.zeros((len(part), part[0][0]), np.int32)
        for row, (n, i, a) in zip(x, part, strict=True):
            row[:n] = signed[i][a : a + n]
        for (_, i, a), f in zip(part, encode_frames(x, np.array([p[0] for p in part]), [p[2] // BLOCK for p in part]), strict=True):
            frames[i][a // BLOCK] = f
    return [_stream(s.tobytes(), f) for s, f in zip(signed, frames, strict=True)]


# ---------------------------------------------------------------- reading


class _Bits:
    """Concatenated byte strings, with the next one-bit of every bit and a 40-bit window at every byte."""

    def __init__(self, parts: list[bytes]):
        data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) * 8
        ones = np.flatnonzero(np.unpackbits(data).view(bool)).astype(np.int32)
        total = len(data) * 8
        self.next_one = np.repeat(np.append(ones, total - 1).astype(np.int32), np.diff(np.concatenate([[-1], ones, [total - 1]])))
        w = data.astype(np.uint64)
        self.window = (w[:-4] << np.uint64(32)) | (w[1:-3] << np.uint64(24)) | (w[2:-2] << np.uint64(16)) | (w[3:-1] << np.uint64(8)) | w[4:]

    def read(self, at: np.ndarray, bits) -> np.ndarray:
        """Unsigned values of up to 32 bits."""
        at = np.minimum(at, len(self.window) * 8 - 40)
        down = 40 - (at & 7) - bits
        return ((self.window[at >> 3] >> down.astype(np.uint64)) & ((np.uint64(1) << np.asarray(bits, np.uint64)) - np.uint64(1))).astype(np.int64)

    def read_signed(self, at: np.ndarray, bits) -> np.ndarray:
        v = self.read(at, bits)
        return v - ((v >> (np.asarray(bits) - 1)) << np.asarray(bits)) * (np.asarray(bits) > 0)


def _subframes(bits: _Bits, pos: np.ndarray, n: np.ndarray, depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the subframe at each position, and the position after it."""
    rows = len(pos)
    first = bits.read(pos, 8)
    if (first & 0x80).any():
        raise ValueError("a subframe starts with a one bit")
    pos = pos + 8
    wasted = np.zeros(rows, np.int64)
    for i in np.flatnonzero(first & 1):
        wasted[i] = int(bits.next_one[pos[i]]) - pos[i] + 1
        pos[i] += wasted[i]
    depth = depth - wasted
    kind = first >> 1
    lin, fix = kind >= 32, (kind >= 8) & (kind <= 12)
    if not (lin | fix | (kind < 2)).all():
        raise ValueError("a reserved subframe type")
    order = np.where(lin, kind - 31, np.where(fix, kind - 8, 0))
    top = int(order.max(initial=0))
    m = n - order  # residuals, or samples where nothing is predicted
    width = int(m.max(initial=0))
    s = np.zeros((top + width, rows), np.int64)
    for j in range(top):
        own = np.flatnonzero(order > j)
        s[top - order[own] + j, own] = bits.read_signed(pos[own] + j * depth[own], depth[own])
    pos = pos + order * depth
    shift = np.zeros(rows, np.int64)
    coef = np.zeros((top, rows), np.int64)
    for i in np.flatnonzero(fix):
        coef[: order[i], i] = FIXED[order[i]]
    if lin.any():
        own = np.flatnonzero(lin)
        precision = bits.read(pos[own], 4) + 1
        shift[own] = bits.read(pos[own] + 4, 5)
        pos[own] += 9
        for j in range(top):
            has = order[own] > j
            at = own[has]
            coef[j, at] = bits.read_signed(pos[at], precision[has])
            pos[at] += precision[has]
    res = np.zeros((width, rows), np.int64)
    for i in np.flatnonzero(kind == 0):
        res[: n[i], i] = bits.read_signed(pos[i : i + 1], depth[i : i + 1])[0]
        pos[i] += depth[i]
    for i in np.flatnonzero(kind == 1):
        res[: n[i], i] = bits.read_signed(pos[i] + np.arange(n[i]) * depth[i], depth[i])
        pos[i] += n[i] * depth[i]
    own = np.flatnonzero(lin | fix)
    if len(own):
        own = own[np.argsort(-m[own], kind="stable")]
        res[:, own], pos[own] = _rice(bits, pos[own], n[own], order[own], width)
    if top and len(own):
        back = np.ascontiguousarray(coef[::-1])  # oldest first, as the samples lie
        terms, acc = np.empty_like(back), np.empty(rows, np.int64)
        for r in range(width):
            np.multiply(back, s[r : top + r], out=terms)
            np.add.reduce(terms, axis=0, out=acc)
            np.right_shift(acc, shift, out=acc)
            np.add(acc, res[r], out=s[top + r])
    else:
        s[top:] = res
    s = np.ascontiguousarray(s.T)
    return [s[i, top - order[i] : top + m[i]] << wasted[i] for i in range(rows)], pos


def _rice(bits: _Bits, pos: np.ndarray, n: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of frames in descending order of their number."""
    rows = len(pos)
    method, split = bits.read(pos, 2), bits.read(pos + 2, 4)
    if (method > 1).any() or ((n >> split << split) != n).any():
        raise ValueError("a reserved residual coding")
    pos = pos + 6
    wide = 4 + method
    escape = (1 << wide) - 1
    m, part = n - order, n >> split
    if rows and not split.any():
        k = bits.read(pos, wide)
        if (k < escape).all():
            return _rice_whole(bits, pos + wide, m, k, width)
    due = np.sort(np.unique(np.concatenate([np.arange(1 << int(p)) * (int(a) >> int(p)) - int(o) for a, p, o in set(zip(n.tolist(), split.tolist(), order.tolist(), strict=True))])))
    due = set(np.maximum(due, 0).tolist())
    k, raw = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
    q, low, ks = np.zeros((width, rows), np.int32), np.zeros((width, rows), np.int64), np.zeros((width, rows), np.int8)
    raws: dict[int, np.ndarray] = {}
    active = np.searchsorted(-m, -np.arange(width), side="left")
    nxt = bits.next_one
    limit = len(nxt) - 1
    for r in range(width):
        a = int(active[r])
        p = pos[:a]
        if r in due:
            at, first = r + order[:a], True
            new = np.flatnonzero((at % part[:a] == 0) | (r == 0))
            while len(new):
                got = bits.read(p[new], wide[new])
                p[new] += wide[new]
                esc = got == escape[new]
                k[new], raw[new] = np.where(esc, 0, got), -1
                if esc.any():
                    at_esc = new[esc]
                    raw[at_esc] = bits.read(p[at_esc], 5)
                    p[at_esc] += 5
                # a first partition that holds warm-up samples only is followed by the next one's parameter
                new = new[(part[new] == order[new]) & (split[new] > 0)] if r == 0 and first else new[:0]
                first = False
        one = nxt[np.minimum(p, limit)].astype(np.int64)
        ks[r, :a] = k[:a]
        if (raw[:a] >= 0).any():
            esc = raw[:a] >= 0
            one = np.where(esc, p - 1, one)
            raws[r] = raw[:a].copy()
            q[r, :a] = np.where(esc, 0, one - p)
            low[r, :a] = one + 1
            pos[:a] = one + 1 + np.where(esc, raw[:a], k[:a])
            continue
        q[r, :a] = one - p
        one += 1
        low[r, :a] = one
        pos[:a] = one + k[:a]
    u = (q.astype(np.int64) << ks) | bits.read(low, ks.astype(np.int64))
    out = (u >> 1) ^ -(u & 1)
    for r, w in raws.items():
        esc = np.flatnonzero(w >= 0)
        out[r, esc] = np.where(w[esc] > 0, bits.read_signed(low[r, esc], np.maximum(w[esc], 1)), 0)
    out[np.arange(width)[:, None] >= m] = 0
    return out, pos


def _rice_whole(bits: _Bits, pos: np.ndarray, m: np.ndarray, k: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of frames of one partition each, in descending order of their number m; pos is past the parameters k."""
    rows = len(pos)
    active = np.searchsorted(-m, -np.arange(width), side="left").tolist()
    first, pos, skip, nxt = pos, pos.copy(), k + 1, bits.next_one
    stop = np.zeros((width, rows), np.int32)  # the one-bit that ends each code's unary part
    a, p = rows, pos
    for r in range(width):
        if active[r] != a:
            a = active[r]
            p, skip = pos[:a], skip[:a]
        np.add(nxt.take(p, mode="clip", out=stop[r, :a]), skip, out=p)
    out = np.empty((width, rows), np.int64)
    step = max(1, (1 << 15) // rows)  # what follows works on as many residuals as stay near
    for lo in range(0, width, step):
        own = stop[lo : lo + step].astype(np.int64)
        began = np.concatenate([first[None] if lo == 0 else stop[lo - 1 : lo] + (k + 1), own[:-1] + (k + 1)])
        u = ((own - began) << k) | bits.read(own + 1, k)
        np.multiply((u >> 1) ^ -(u & 1), np.arange(lo, lo + len(own))[:, None] < m, out=out[lo : lo + step])
    return out, pos


_BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _parse_header(f: bytes, depth: int) -> tuple[int, int, int, int, int, int]:
    """Block size, channels, stereo mode, bits per sample, frame number, bytes of the header."""
    if len(f) < 6 or f[0] != 0xFF or f[1] & 0xFE != 0xF8:
        raise ValueError("no frame sync")
    size, rate, chan, bps = f[2] >> 4, f[2] & 15, f[3] >> 4, f[3] >> 1 & 7
    at, number = 5, f[4]
    if number >= 0xC0:
        more = 8 - (~number & 0xFF).bit_length()
        number &= (1 << (7 - more)) - 1
        for b in f[5 : 4 + more]:
            number = number << 6 | b & 0x3F
        at = 4 + more
    if size in (6, 7):
        n = int.from_bytes(f[at : at + size - 5], "big") + 1
        at += size - 5
    elif size in _BLOCK_SIZES:
        n = _BLOCK_SIZES[size]
    else:
        raise ValueError("a reserved block size")
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if at >= len(f) or crc8(f[:at]) != f[at]:
        raise ValueError("a frame header fails its checksum")
    if chan > 10 or rate == 15 or bps == 3:
        raise ValueError("a reserved value in a frame header")
    return n, 2 if chan >= 8 else chan + 1, chan, _DEPTHS.get(bps, depth), number, at + 1


def decode_frames(frames: list[bytes], depth: int) -> list[np.ndarray]:
    """Samples x channels of each frame; every frame's checksums are verified first."""
    want = [struct.unpack(">H", f[-2:])[0] for f in frames]
    if (crc16_each([f[:-2] for f in frames]) != np.array(want, np.uint16)).any():
        raise ValueError("a frame fails its checksum")
    heads = [_parse_header(f, depth) for f in frames]
    bits = _Bits(frames)
    pos = bits.start[:-1] + np.array([h[5] * 8 for h in heads], np.int64)
    channels: list[list[np.ndarray]] = [[] for _ in frames]
    for c in range(max((h[1] for h in heads), default=0)):
        own = np.array([i for i, h in enumerate(heads) if h[1] > c])
        side = np.array([(heads[i][2], c) in ((8, 1), (9, 0), (10, 1)) for i in own])
        got, pos[own] = _subframes(bits, pos[own], np.array([heads[i][0] for i in own]), np.array([heads[i][3] for i in own]) + side)
        for i, s in zip(own, got, strict=True):
            channels[i].append(s)
    if (pos > bits.start[1:] - 16).any():
        raise ValueError("a frame ends before its last residual")
    out = []
    for h, ch in zip(heads, channels, strict=True):
        if h[2] == 8:
            ch = [ch[0], ch[0] - ch[1]]
        elif h[2] == 9:
            ch = [ch[0] + ch[1], ch[1]]
        elif h[2] == 10:
            mid = (ch[0] << 1) | (ch[1] & 1)
            ch = [(mid + ch[1]) >> 1, (mid - ch[1]) >> 1]
        out.append(np.stack(ch, axis=1))
    return out


class Stream:
    """A parsed stream: depth, channels, samples, md5, seek points (sample, byte from the first frame, samples), where frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC marker")
        self.data, self.seek, at, last = data, [], 4, False
        self.samples = self.depth = self.channels = 0
        self.md5 = b""
        while not last:
            if at + 4 > len(data):
                raise ValueError("the metadata is cut off")
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.channels, self.depth, self.samples, self.md5 = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                self.seek = [p for p in struct.iter_unpack(">QQH", block) if p[0] != (1 << 64) - 1]
            at += 4 + size
        self.first = at

    def frames(self) -> list[tuple[int, int, int]]:
        """(sample offset, byte offset in the data, bytes) of every frame: by seek points, if they cover all samples, else by a scan."""
        if not self.seek or self.seek[0][:2] != (0, 0) or any(a[0] + a[2] != b[0] for a, b in zip(self.seek, self.seek[1:], strict=False)) or self.seek[-1][0] + self.seek[-1][2] != self.samples:
            return self._scanned()
        starts = [self.first + p[1] for p in self.seek] + [len(self.data)]
        return [(p[0], a, b - a) for p, a, b in zip(self.seek, starts, starts[1:], strict=False)]

    def _scanned(self) -> list[tuple[int, int, int]]:
        """Frames by sync codes whose header passes its checksum; a frame ends where its own checksum comes out right before the next one."""
        d = np.frombuffer(self.data, np.uint8)
        sync = np.flatnonzero((d[:-1] == 0xFF) & (d[1:] & 0xFE == 0xF8))
        heads: dict[int, int] = {}
        for p in sync[sync >= self.first].tolist():
            try:
                heads[p] = _parse_header(self.data[p : p + 16], self.depth)[0]
            except ValueError:
                pass
        out, at, sample = [], self.first, 0
        while at < len(self.data):
            if at not in heads:
                raise ValueError("no frame begins where the one before ends")
            # the checksum of a whole frame with its own two bytes is 0
            crc, lo = 0, at
            for end in [*(p for p in heads if p > at), len(self.data)]:
                crc = _crc16_on(crc, self.data[lo:end])
                lo = end
                if crc == 0:
                    break
            else:
                raise ValueError("a frame fails its checksum")
            out.append((sample, at, end - at))
            sample, at = sample + heads[at], end
        return out


def decode_batch(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """PCM blocks (sample offset, byte offset, samples x channels) of each stream; checksums and MD5 are verified."""
    parsed = [Stream(s) for s in streams]
    jobs = sorted(((-size, i, sample, at) for i, p in enumerate(parsed) for sample, at, size in p.frames()))
    blocks: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in streams]
    for lo in range(0, len(jobs), IN_STEP):
        part = jobs[lo : lo + IN_STEP]
        by_depth: dict[int, list] = {}
        for j in part:
            by_depth.setdefault(parsed[j[1]].depth, []).append(j)
        for depth, own in by_depth.items():
            for (_, i, sample, at), pcm in zip(own, decode_frames([streams[i][at : at - size] for size, i, _, at in own], depth), strict=True):
                blocks[i].append((sample, at, pcm))
    for p, b in zip(parsed, blocks, strict=True):
        b.sort(key=lambda x: x[0])
        wide = -(-p.depth // 8)
        if wide in (1, 2, 4) and p.md5 != bytes(16):
            h = hashlib.md5()
            for _, _, pcm in b:
                h.update(np.ascontiguousarray(pcm).astype(f"<i{wide}").tobytes())
            if h.digest() != p.md5:
                raise ValueError("the samples fail the stream's MD5")
    return blocks


def seek_block(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The one block that holds a sample, and its offset; no other frame is read."""
    p = Stream(stream)
    for offset, at, size in reversed(p.frames()):
        if offset <= sample < p.samples:
            return offset, decode_frames([stream[at : at + size]], p.depth)[0]
    raise ValueError("no such sample")


# ---------------------------------------------------------------- columns

BLOCKS = T.ArrayType(T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("n_samples", T.IntegerType()), T.StructField("pcm", T.BinaryType())]))


def _chunks(values: list, weight) -> Iterator[slice]:
    """Slices of about BATCH_SAMPLES in all."""
    lo = total = 0
    for i, v in enumerate(values):
        total += weight(v)
        if total >= BATCH_SAMPLES:
            yield slice(lo, i + 1)
            lo, total = i + 1, 0
    if lo < len(values):
        yield slice(lo, len(values))


def flac_streams(payloads: list) -> list[bytes]:
    """A stream for each payload (bytes, text as UTF-8, or None), padded to a positive multiple of 64 bytes."""
    got = [padded(v.encode("utf-8") if isinstance(v, str) else v) for v in payloads]
    return [s for part in _chunks(got, len) for s in encode_batch(got[part])]


def pcm_blocks(streams: list[bytes | None], on_error: str = "raise") -> list[list[dict] | None]:
    """Verified PCM blocks of each stream, in order of their sample offsets. on_error="null": a damaged stream has none."""
    out: list[list[dict] | None] = [None] * len(streams)
    some = [i for i, s in enumerate(streams) if s is not None]

    def decoded(part: list[int]) -> Iterator[tuple[int, list]]:
        try:
            yield from zip(part, decode_batch([streams[i] for i in part]), strict=True)
        except (ValueError, struct.error, IndexError):
            if on_error != "null":
                raise
            if len(part) > 1:
                for i in part:
                    yield from decoded([i])

    for part in _chunks(some, lambda i: len(streams[i])):
        for i, blocks in decoded(some[part]):
            depth = Stream(streams[i]).depth
            kind = "<i1" if depth <= 8 else "<i2" if depth <= 16 else "<i4"
            out[i] = [{"sample_offset": s, "byte_offset": b, "n_samples": len(pcm), "pcm": np.ascontiguousarray(pcm).astype(kind).tobytes()} for s, b, pcm in blocks]
    return out


def write_flac(df: DataFrame, payload: str, into: str = "flac") -> DataFrame:
    """df with a column of FLAC streams of the payloads (binary or string)."""
    at = df.columns.index(payload)

    def start():
        return lambda batch: [pa.array(flac_streams(batch.column(at).to_pylist()), pa.binary())]

    return append_arrow(df, T.StructType([T.StructField(free_name(df, into), T.BinaryType())]), start)


def read_flac(df: DataFrame, flac: str, into: str = "blocks", on_error: str = "raise") -> DataFrame:
    """df with a column of PCM blocks: offset in samples, offset in bytes of the stream, samples, little-endian PCM."""
    at = df.columns.index(flac)
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))

    def start():
        return lambda batch: [pa.array(pcm_blocks(batch.column(at).to_pylist(), on_error), kind)]

    return append_arrow(df, T.StructType([T.StructField(free_name(df, into), BLOCKS)]), start)


_BACK = bytes(b ^ 0x80 for b in range(256))


def payload_features(pcm: bytes) -> str:
    """Mean and mean square of the samples, zero crossings, and how many of their 16 levels occur."""
    x = np.frombuffer(pcm, np.int8).astype(np.int32)
    up = x > 0
    return f"mean={x.mean():.4f};power={np.mean(x * x):.3f};crossings={int((up[1:] != up[:-1]).sum())};levels={len(np.unique(x >> 4))}"


def stored_payloads(df: DataFrame, payload: str, name: str = "flac") -> DataFrame:
    """df with its payload column written as FLAC into a stored table, in its place n_bytes and media."""
    kept = [c for c in df.columns if c != payload]
    size, media = (free_name(df.drop(payload), c) for c in ("n_bytes", "media"))
    coded = write_flac(df, payload, media)
    return stored(coded.select(*kept, F.octet_length(F.coalesce(F.col(payload), F.lit(""))).cast("long").alias(size), F.col(coded.columns[-1]).alias(media)), name, "zstd")


DIGESTS = T.StructType([T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_blocks", T.IntegerType()))])


def read_digests(df: DataFrame, media: str) -> DataFrame:
    """df with digests and features of the 8-bit payload that each stream decodes to."""
    at = df.columns.index(media)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def start():
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            streams, rows = batch.column(at).to_pylist(), []
            for stream, blocks in zip(streams, pcm_blocks(streams), strict=True):
                pcm = b"".join(b["pcm"] for b in blocks)
                payload = pcm.translate(_BACK)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), payload_features(pcm), len(blocks)))
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return each

    return append_arrow(df, T.StructType([T.StructField(free_name(df, f.name), f.dataType) for f in DIGESTS]), start)


def op1_flac(spark, sf_dir):
    """Contract query: every text is written as FLAC to a stored table, which is read back through its PCM blocks and described."""
    media = stored_payloads(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    return read_digests(media, "media").drop("media")
