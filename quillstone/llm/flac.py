"""Media columns: payloads kept as FLAC streams, and read back as PCM blocks.

Samples are 8-bit, one channel, in frames of BLOCK = 192 samples. The codec works on all frames of a
slice of streams in lockstep: at each step one residual of every frame is read, so the loop runs 192
times for thousands of frames. Frames of other writers that the lockstep reader doesn't know (other
block sizes, several Rice partitions, escapes) go through a plain bit reader, which follows the
format's specification. Both check each header's CRC-8 and each frame's CRC-16.

Streams are written to a table; what they decode to is written as PCM blocks with the number of their
first sample, from which payloads and features are read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, dropped, slices, texts_of, written

BLOCK, RATE, SEEK_FRAMES = 192, 8000, 64
_SHIFT, _PRECISION = 6, 8
#: Predictors of the format's fixed subframes: the weights of the samples before, latest first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_SLICE = 1 << 20
#: Parts in which a table goes through the store.
WAVES = 4


def _table(poly: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c & top else c << 1
        out.append(c & ((1 << bits) - 1))
    return np.array(out, dtype=np.uint16)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc16(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each span, a byte of every span at a time."""
    crc = np.zeros(len(starts), dtype=np.uint16)
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    for i, n in enumerate(left):
        c = crc[:n]
        crc[:n] = _CRC16[(c >> 8) ^ buf[at[:n] + i]] ^ (c << 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write value's `width` low bits at bit positions `at`, highest first."""
    width = np.broadcast_to(np.asarray(width), at.shape)
    value = np.broadcast_to(np.asarray(value), at.shape)
    for j in range(int(width.max(initial=0))):
        some = width > j
        bits[at[some] + j] = (value[some] >> (width[some] - 1 - j)) & 1


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's extended UTF-8: bytes (n x 6) and how many of them count."""
    size = 1 + (n >= 0x80) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    out = np.zeros((len(n), 6), dtype=np.uint8)
    for k in range(1, 7):
        some = size == k
        v = n[some]
        if k == 1:
            out[some, 0] = v
            continue
        out[some, 0] = ((0xFF << (8 - k)) & 0xFF) | (v >> (6 * (k - 1)))
        for j in range(1, k):
            out[some, j] = 0x80 | ((v >> (6 * (k - 1 - j))) & 0x3F)
    return out, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose size must be a positive multiple of BLOCK."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK).astype(np.int64) - 128
    n = len(x)
    number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    # Candidates: fixed predictors of order 0 to 2, and one weight fitted to each frame.
    weight = np.clip(np.rint((x[:, 1:] * x[:, :-1]).sum(1) / np.maximum((x[:, :-1] ** 2).sum(1), 1) * (1 << _SHIFT)), -128, 127).astype(np.int64)
    tries = [x, x[:, 1:] - x[:, :-1], x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2], x[:, 1:] - ((weight[:, None] * x[:, :-1]) >> _SHIFT)]
    orders = np.array([0, 1, 2, 1])
    extra = np.array([0, 0, 0, 9 + _PRECISION])
    cost = np.stack([np.abs(r).sum(1) for r in tries])
    pick = np.argmin(cost, axis=0)
    order = orders[pick]
    res = np.zeros((n, BLOCK), dtype=np.int64)
    for i, r in enumerate(tries):
        res[pick == i, orders[i] :] = r[pick == i]
    live = np.arange(BLOCK) >= order[:, None]
    u = np.where(live, (res << 1) ^ (res >> 63), 0)
    need = np.stack([(u >> k).sum(1) + (BLOCK - order) * (k + 1) + 10**9 * ((u >> k).max(1) > 30) for k in range(11)])
    k = np.argmin(need, axis=0)
    size = 8 + 8 * order + extra[pick] + 10 + np.min(need, axis=0)
    same = (x == x[:, :1]).all(1)
    plain = ~same & (size >= 8 + 8 * BLOCK)
    size = np.where(same, 16, np.where(plain, 8 + 8 * BLOCK, size))
    numbers, width = _numbers(number)
    head = 4 + width + 1
    total = head + (size + 7) // 8 + 2
    at = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()) * 8, dtype=np.uint8)
    h = np.zeros((n, 11), dtype=np.uint8)
    h[:, :4] = (0xFF, 0xF8, 0x10, 0x02)
    h[:, 4:10] = numbers
    crc = np.zeros(n, dtype=np.uint8)
    for j in range(10):
        crc = np.where(j < 4 + width, _CRC8[crc ^ h[:, j]], crc).astype(np.uint8)
    h[np.arange(n), 4 + width] = crc
    for j in range(11):
        some = j < head
        _put(bits, (at[some] + j) * 8, h[some, j].astype(np.int64), 8)
    p = (at + head) * 8
    kind = np.where(same, 0, np.where(plain, 1, np.where(pick == 3, 32 + order - 1, 8 + order)))
    _put(bits, p, kind << 1, 8)
    p = p + 8
    _put(bits, p[same], x[same, 0] & 0xFF, 8)
    if plain.any():
        _put(bits, (p[plain, None] + 8 * np.arange(BLOCK)).ravel(), (x[plain] & 0xFF).ravel(), 8)
    rice = np.flatnonzero(~same & ~plain)
    for j in range(2):
        some = rice[order[rice] > j]
        _put(bits, p[some] + 8 * j, x[some, j] & 0xFF, 8)
    p = p + 8 * order
    lpc = rice[pick[rice] == 3]
    _put(bits, p[lpc], ((_PRECISION - 1) << 5 | _SHIFT) << _PRECISION | (weight[lpc] & 0xFF), 9 + _PRECISION)
    p = p + extra[pick]
    _put(bits, p[rice], k[rice], 10)  # method 0 and partition order 0, then the parameter
    q, kk = u[rice] >> k[rice, None], np.broadcast_to(k[rice, None], (len(rice), BLOCK))
    span = np.where(live[rice], q + 1 + kk, 0)
    to = p[rice, None] + 10 + np.cumsum(span, axis=1) - span
    some = live[rice]
    ones = (to + q)[some]
    bits[ones] = 1
    _put(bits, ones + 1, u[rice][some], kk[some])
    buf = np.packbits(bits)
    crc = _crc16(buf, at, total - 2)
    buf[at + total - 2], buf[at + total - 1] = crc >> 8, crc & 0xFF
    out, lo = [], 0
    for payload, c in zip(payloads, counts, strict=True):
        sizes, first = total[lo : lo + c], at[lo]
        marks = range(0, c, SEEK_FRAMES)
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(at[lo + i] - first), BLOCK) for i in marks)
        md5 = hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + buf[first : first + int(sizes.sum())].tobytes())
        lo += c
    return out


class BadStream(ValueError):
    pass


@dataclass
class Info:
    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    frames: int  # where the first frame starts


def stream_info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise BadStream("no stream marker")
    p, info, seek, last = 4, None, [], False
    while not last:
        if p + 4 > len(data) or p + 4 + int.from_bytes(data[p + 1 : p + 4], "big") > len(data):
            raise BadStream("cut short")
        last, kind, size = bool(data[p] & 0x80), data[p] & 0x7F, int.from_bytes(data[p + 1 : p + 4], "big")
        body = data[p + 4 : p + 4 + size]
        if kind == 0:
            if size < 34:
                raise BadStream("STREAMINFO")
            v = int.from_bytes(body[10:18], "big")
            info = Info(int.from_bytes(body[2:4], "big"), v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & ((1 << 36) - 1), body[18:34], seek, 0)
        elif kind == 3:
            seek += [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, len(body), 18)]
        p += 4 + size
    if info is None:
        raise BadStream("no STREAMINFO")
    info.frames = p
    return info


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.p = data, at * 8

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        lo, hi = self.p >> 3, (self.p + n + 7) >> 3
        if hi > len(self.data):
            raise BadStream("cut short")
        v = int.from_bytes(self.data[lo:hi], "big") >> (hi * 8 - self.p - n)
        self.p += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def read_frame(data: bytes, at: int, info: Info) -> tuple[int, list[int], int]:
    """(first sample's number, samples, next frame's position) of a frame with one channel."""
    b = _Bits(data, at)
    if b.take(15) != 0x7FFC:
        raise BadStream("no sync")
    variable, size, rate, channel, depth = b.take(1), b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    more = next((i for i in range(8) if not lead >> (7 - i) & 1), 8)
    number = lead & (0x7F >> more)
    for _ in range(max(0, more - 1)):
        number = number << 6 | (b.take(8) & 0x3F)
    if size == 1:
        n = 192
    elif 2 <= size <= 5:
        n = 576 << (size - 2)
    elif size in (6, 7):
        n = b.take(8 * (size - 5)) + 1
    else:
        n = 256 << (size - 8)
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    crc = 0
    for x in data[at : b.p >> 3]:
        crc = int(_CRC8[crc ^ x])
    if b.take(8) != crc:
        raise BadStream("header CRC")
    if channel:
        raise BadStream("one channel only")
    if size == 0 or depth == 3 or rate == 15:
        raise BadStream("reserved value")
    width = {0: info.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    b.take(1)
    kind = b.take(6)
    waste = b.unary() + 1 if b.take(1) else 0
    width -= waste
    if kind == 0:
        s = [b.signed(width)] * n
    elif kind == 1:
        s = [b.signed(width) for _ in range(n)]
    else:
        order = kind - 8 if kind < 32 else kind - 31
        if not 0 <= order <= (4 if kind < 32 else 32) or order > n:
            raise BadStream("reserved subframe")
        s = [b.signed(width) for _ in range(order)]
        shift, weights = 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        wide, parts = b.take(2), b.take(4)
        if wide > 1 or n % (1 << parts) or n >> parts < order:
            raise BadStream("partitions")
        for part in range(1 << parts):
            k = b.take(5 if wide else 4)
            escape = k == (31 if wide else 15)
            raw = b.take(5) if escape else 0
            for _ in range((n >> parts) - (0 if part else order)):
                if escape:
                    r = b.signed(raw)
                else:
                    u = b.unary() << k | b.take(k)
                    r = (u >> 1) ^ -(u & 1)
                s.append(r + (sum(w * v for w, v in zip(weights, s[: -order - 1 : -1], strict=True)) >> shift))
    end = (b.p + 7) >> 3
    crc = int(_crc16(np.frombuffer(data, dtype=np.uint8), np.array([at]), np.array([end - at]))[0])
    if crc != int.from_bytes(data[end : end + 2], "big"):
        raise BadStream("frame CRC")
    return number if variable else number * info.block, [v << waste for v in s], end + 2


def _plain(data: bytes) -> np.ndarray:
    """Samples of a whole stream, by the plain reader."""
    info = stream_info(data)
    p, out = info.frames, []
    while p < len(data):
        _, s, p = read_frame(data, p, info)
        out += s
    return np.array(out, dtype=np.int64)


def _frames(data: np.ndarray, info: Info) -> np.ndarray | None:
    """Starts of all frames, from headers whose CRC-8 and running number fit; None if that is not clear."""
    if info.block != BLOCK or info.bits != 8 or info.channels != 1 or info.samples % BLOCK:
        return None
    body = data[info.frames :]
    at = np.flatnonzero((body[:-9] == 0xFF) & (body[1:-8] == 0xF8) & (body[2:-7] == 0x10) & (body[3:-6] == 0x02))
    if not len(at):
        return None
    rows = body[np.minimum(at[:, None] + np.arange(11), len(body) - 1)]
    numbers, width = _numbers(np.arange(info.samples // BLOCK))
    if len(at) != len(numbers):
        return None
    crc = np.zeros(len(at), dtype=np.uint8)
    for j in range(10):
        crc = np.where(j < 4 + width, _CRC8[crc ^ rows[:, j]], crc).astype(np.uint8)
    same = ((rows[:, 4:10] == numbers) | (np.arange(6) >= width[:, None])).all()
    return at + info.frames if same and (rows[np.arange(len(at)), 4 + width] == crc).all() else None


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream. Every frame's checksums and every stream's MD5 are verified; a
    stream that fails a check raises BadStream."""
    infos = [stream_info(s) for s in streams]
    base = np.cumsum([0, *(len(s) for s in streams)])
    buf = np.frombuffer(b"".join(streams) + bytes(16), dtype=np.uint8)
    starts, ends, owner, out = [], [], [], [None] * len(streams)
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        f = _frames(buf[base[i] : base[i + 1]], info)
        if f is None:
            out[i] = _plain(s)
        else:
            starts.append(f + base[i])
            ends.append(np.append(f[1:], len(s)) + base[i])
            owner.append(np.full(len(f), i))
    if starts:
        starts, ends, owner = map(np.concatenate, (starts, ends, owner))
        if (_crc16(buf, starts, ends - starts - 2) != (buf[ends - 2].astype(np.uint16) << 8 | buf[ends - 1])).any():
            raise BadStream("frame CRC")
        samples, known = _lockstep(buf, starts, ends)
        for i in np.unique(owner):
            mine = owner == i
            out[i] = samples[mine].ravel() if known[mine].all() else _plain(streams[i])
    for s, info in zip(out, infos, strict=True):
        if len(s) != info.samples or info.bits == 8 and any(info.md5) and hashlib.md5(s.astype(np.int8).tobytes()).digest() != info.md5:
            raise BadStream("samples")
    return out


def _lockstep(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of frames of BLOCK samples, all frames at once, and for which of them they hold."""
    w64 = np.zeros(len(buf) - 7, dtype=np.uint64)
    for off in range(8):
        some = w64[off::8]
        some[:] = buf[off : off + 8 * len(some)].view(">u8")
    n = len(starts)

    def take(p: np.ndarray, width: int) -> np.ndarray:
        return ((w64[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)

    lead = buf[starts + 4]
    p = (starts + 5 + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC)) * 8
    head = take(p, 8)
    p += 8
    kind, known = head >> 1, (head & 1) == 0
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    known &= (kind <= 1) | fixed | lpc & (order <= 4)
    order = np.where(known, order, 0)
    out = np.zeros((n, BLOCK), dtype=np.int64)
    same = known & (kind == 0)
    out[same] = (take(p[same], 8)[:, None] ^ 0x80) - 0x80
    plain = np.flatnonzero(known & (kind == 1))
    out[plain] = (take((p[plain, None] + 8 * np.arange(BLOCK)).ravel(), 8).reshape(-1, BLOCK) ^ 0x80) - 0x80
    rice = np.flatnonzero(known & (fixed | lpc))
    p, order, kind, lpc = p[rice], order[rice], kind[rice], lpc[rice]
    weights, shift = np.zeros((len(rice), 4), dtype=np.int64), np.zeros(len(rice), dtype=np.int64)
    for j in range(4):
        some = order > j
        out[rice[some], j] = (take(p[some] + 8 * j, 8) ^ 0x80) - 0x80
    p = p + 8 * order
    for o in range(1, 5):
        weights[~lpc & (order == o), :o] = FIXED[o]
    width = np.where(lpc, take(p, 4) + 1, 0)
    shift = np.where(lpc, ((take(p + 4, 5) ^ 16) - 16), 0)
    p = p + 9 * lpc
    for j in range(4):
        some = lpc & (order > j)
        w = width[some]
        weights[some, j] = (take(p[some], 16) >> (16 - w) ^ (1 << (w - 1))) - (1 << (w - 1))
        p = p + np.where(some, width, 0)
    k = take(p, 10)
    good = (k < 15) & (shift >= 0)  # method 0, one partition, no escape
    k, shift = np.where(good, k, 0), np.maximum(shift, 0)
    p = p + 10
    ku = k.astype(np.uint64)
    limit = len(w64) * 8 - 1
    live = BLOCK - int(order.max(initial=0))
    rows = np.arange(len(rice))
    res = np.zeros((len(rice), BLOCK), dtype=np.int64)
    for t in range(BLOCK):
        x = w64[p >> 3] << (p & 7).astype(np.uint64)
        q = 53 - np.frexp((x >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        good &= q + k < 56
        low = (x << (np.minimum(q, 62) + 1).astype(np.uint64)) >> (np.uint64(63) - ku) >> np.uint64(1)
        u = (q << k) | low.astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        if t < live:
            res[rows, order + t] = r
            p = np.minimum(p + q + 1 + k, limit)
        else:
            some = order + t < BLOCK
            res[rows[some], order[some] + t] = r[some]
            p = np.minimum(np.where(some, p + q + 1 + k, p), limit)
    good &= (p + 7) // 8 == ends[rice] - 2
    s = out[rice]
    most = int(order.max(initial=0))
    for i in range(BLOCK):
        guess = np.zeros(len(rice), dtype=np.int64)
        for j in range(min(most, i)):
            guess += weights[:, j] * s[:, i - 1 - j]
        s[:, i] = np.where(i < order, s[:, i], res[:, i] + (guess >> shift))
    out[rice] = s
    known[rice] &= good
    return out, known


def payload(text: bytes) -> bytes:
    """text with bytes 32 up to a positive multiple of BLOCK."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b" ")


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): a FLAC stream for each row of docs.

    Null and empty texts are one frame of spaces. Equal texts give equal streams; null and repeated
    ids are kept as they are. Other columns aren't read; an empty table gives no rows.
    """

    def enc(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts, _SLICE):
                media = encode([payload(t) for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(enc, f"`{id_col}` long, n_bytes long, media binary")


_BLOCKS = "array<struct<sample_offset: long, n_samples: long, pcm: binary>>"


def in_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", frames: int = SEEK_FRAMES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, media_bytes, media_sha256, blocks): one row for each stream, with its blocks of `frames`
    frames as signed 8-bit PCM, each by the number of its first sample.

    A null stream has no blocks and null numbers. A stream of more than 8 bits or one channel, or one
    that fails a check, raises BadStream. Repeated and null ids are kept as they are; an empty table
    gives no rows. Columns to carry are kept; others aren't read.
    """
    step = frames * BLOCK

    def narrow(data: bytes, s: np.ndarray) -> bytes:
        if stream_info(data).bits > 8 or len(s) and (s.min() < -128 or s.max() > 127):
            raise BadStream("more than 8 bits")
        return s.astype(np.int8).tobytes()

    def dec(batches):
        for batch in batches:
            data = batch.column(1).to_pylist()
            for lo, hi in slices([m or b"" for m in data], _SLICE):
                some = data[lo:hi]
                got = iter(decode([m for m in some if m is not None]))
                pcm = [None if m is None else narrow(m, next(got)) for m in some]
                rows = [(o, p[o : o + step]) for p in pcm if p for o in range(0, len(p), step)]
                ends = np.cumsum([0, *(-(-len(p) // step) if p else 0 for p in pcm)]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array([o for o, _ in rows], pa.int64()), pa.array([len(p) for _, p in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["sample_offset", "n_samples", "pcm"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array([None if m is None else len(m) for m in some], pa.int64()),
                        pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in some], pa.string()), pa.ListArray.from_arrays(pa.array(ends), items),
                        *(batch.column(2 + k).slice(lo, hi - lo) for k in range(len(carry))),
                    ],
                    names=[id_col, "media_bytes", "media_sha256", "blocks", *carry],
                )

    more = "".join(f", `{c}` {media.schema[c].dataType.simpleString()}" for c in carry)
    return media.select(F.col(id_col).cast("long").alias(id_col), F.col(media_col), *carry).mapInArrow(dec, f"`{id_col}` long, media_bytes long, media_sha256 string, blocks {_BLOCKS}{more}")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", frames: int = SEEK_FRAMES) -> DataFrame:
    """(id_col, sample_offset, n_samples, pcm): a row for each of in_blocks' blocks."""
    return in_blocks(media, id_col, media_col, frames).select(id_col, F.inline("blocks"))


def read_at(data: bytes, sample: int, n: int) -> np.ndarray:
    """n samples from number `sample` on, decoding from the nearest seek point before it."""
    info = stream_info(data)
    at = max((o for s, o, _ in info.seek if s <= sample), default=0) + info.frames
    out, first = [], None
    while at < len(data) and (first is None or first + len(out) < sample + n):
        number, s, at = read_frame(data, at, info)
        first = number if first is None else first
        out += s
    return np.array(out[sample - (first or 0) :][:n], dtype=np.int64)


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square, peak and sign changes of the samples."""
    x = samples.astype(np.int64)
    turns = int((np.diff(np.signbit(x)) != 0).sum())
    return f"mean={x.sum() / len(x):.4f};rms={float(np.sqrt((x * x).sum() / len(x))):.4f};peak={int(np.abs(x).max())};turns={turns}"


def read_back(blocks: DataFrame, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """What the PCM blocks of in_blocks hold, with the numbers of their streams: id_col, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Blocks must follow each other from sample 0 without a gap. A row without blocks has an empty payload
    and no feature. Repeated and null ids are kept as they are; an empty table gives no rows. Columns to
    carry are kept; others aren't read.
    """

    def read(batches):
        for batch in batches:
            items = batch.column(3)
            at, lists = items.offsets.to_numpy(), items.values
            first, size, pcm = (lists.field(k) for k in range(3))
            first, size, pcm = first.to_numpy(), size.to_numpy(), pcm.to_pylist()
            back = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if (first[lo:hi] != np.cumsum(size[lo:hi]) - size[lo:hi]).any():
                    raise BadStream("blocks don't follow each other")
                back.append(b"".join(pcm[lo:hi]))
            samples = [np.frombuffer(p, dtype=np.int8) for p in back]
            back = [(np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes() for p in back]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(len, back), pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                    batch.column(1), batch.column(2), pa.array([feature(s) if len(s) else None for s in samples], pa.string()),
                    *(batch.column(4 + k) for k in range(len(carry))),
                ],
                names=names,
            )

    schema = f"`{id_col}` long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += "".join(f", `{c}` {blocks.schema[c].dataType.simpleString()}" for c in carry)
    names = [id_col, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *carry]
    return blocks.select(id_col, "media_bytes", "media_sha256", "blocks", *carry).mapInArrow(read, schema)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """in_blocks of to_media of every row, with n_bytes, through written tables: streams are written, read,
    decoded, and their PCM blocks written. Rows go in WAVES by a hash, one after the other, so that the
    streams of one wave at most take up room beside the blocks; all rows are in some wave."""
    blocks = None
    for wave in range(WAVES):
        rows = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(WAVES)) == wave)
        media = written(to_media(rows, id_col, text_col), "zstd")
        own = written(in_blocks(media, id_col, carry=("n_bytes",)), "zstd")
        dropped(media)
        blocks = own if blocks is None else blocks.unionByName(own)
    return blocks


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result is read from the PCM blocks that were written."""
    return read_back(stored(documents(spark, sf_dir)), carry=("n_bytes",))
