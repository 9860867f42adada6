"""What several operators share: a place for written tables, and word views of byte batches.

Words are found and told apart for a whole slice of documents at once, with numpy on the raw UTF-8
bytes. A word is told from others by a 128-bit code: its own bytes if it has 15 or less, else its
BLAKE2b digest.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..session import workspace as shared_dir

#: Bytes of text that one slice holds (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20
#: Words of more bytes than this have a digest for a code.
SHORT_WORD = 15

_MUL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, and a lost
    executor costs no recomputation.

    A table that an operator reads only itself goes with `dropped`; those that a returned DataFrame
    reads stay below tables/<application id>, which is the caller's to delete when its job is done.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back.written_at__ = at
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables made by `written` that nothing reads any more."""
    for df in tables:
        if df is not None:
            spark, at = df.sparkSession, df.written_at__
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A side of a join is broadcast up to this many rows (at most 100 bytes each), and shuffled beyond.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, read from a written table, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def trimmed() -> None:
    """Give back what this process has freed. The C library and Arrow keep such memory else, and Python
    workers live on from one stage to the next with it, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _lut(seps: bytes) -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    lut[list(seps)] = False
    return lut


#: Word bytes for `[^\x20\x09-\x0D]+`, and for runs of ASCII letters, digits and non-ASCII.
SPACED = _lut(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = _lut(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes unchanged."""
    return _LOWER[buf]


class Words:
    """Words of a slice of documents: byte spans, and for each document its first word's number.

    starts, ends: spans in buf. doc: the document of each word. first: word numbers by document,
    with the total at the end.
    """

    def __init__(self, texts: list[bytes], letters: np.ndarray = SPACED, lower: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.buf = lowered(raw) if lower else raw
        self.at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        inside = letters[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate(([0], edge)) if len(inside) and inside[0] else edge
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def codes(self, most: int | None = None) -> np.ndarray:
        """The 128-bit code of each word, or of its first `most` bytes, as two numbers: 2 x words.

        Words of up to 15 bytes are their code, with their length in the last byte; longer ones have
        120 bits of their BLAKE2b digest, and a last byte that no short word has.
        """
        size = self.ends - self.starts if most is None else np.minimum(self.ends - self.starts, most)
        low, high = loaded(self.buf, self.starts, size), np.zeros(len(size), dtype=np.uint64)
        some = np.flatnonzero(size > 8)
        high[some] = loaded(self.buf, self.starts[some] + 8, np.minimum(size[some] - 8, 7))
        high |= size.astype(np.uint64) << np.uint64(56)
        known: dict[bytes, tuple[int, int]] = {}
        for i in np.flatnonzero(size > SHORT_WORD).tolist():
            word = self.buf[self.starts[i] : self.starts[i] + size[i]].tobytes()
            if word not in known:
                x = hashlib.blake2b(word, digest_size=16).digest()
                known[word] = int.from_bytes(x[:8], "little"), int.from_bytes(x[8:15], "little") | 0xFF << 56
            low[i], high[i] = known[word]
        return np.stack((low, high))

    def hashes(self, most: int | None = None) -> np.ndarray:
        """codes with the bits of both numbers spread over both; a bijection."""
        low, high = self.codes(most)
        first = mix(low ^ mix(high, 1))
        return np.stack((first, mix(high ^ first, 1)))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, as they stand, joined by one space."""
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True))


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def loaded(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The `size` bytes (8 at most) from each place on, as one number, the first byte lowest."""
    if len(buf) < 8:
        buf = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    last = len(buf) - 8
    every = np.ndarray((last + 1,), dtype="<u8", buffer=buf, strides=(1,))
    to = np.minimum(at, last)
    out = every[to] >> (8 * (at - to)).astype(np.uint64)
    return out & _KEEP[np.minimum(size, 8)]


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes (2 x n): a place of each distinct code, and for each place its number among those. Exact:
    places that share the first half only are told apart."""
    _, where, inv = np.unique(codes[0], return_index=True, return_inverse=True)
    other = np.flatnonzero(codes[1] != codes[1, where[inv]])
    if len(other):
        more, back = distinct(codes[::-1, other])
        inv[other] = len(where) + back
        where = np.concatenate((where, other[more]))
    return where, inv


def rolling(hashes: np.ndarray, doc: np.ndarray, k: int, which: int = 0, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words (all, or of `at`) at which k words of one document start, and the
    hashes of those windows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    whole = doc[:n] == doc[k - 1 :]
    at = np.flatnonzero(whole) if at is None else at[at < n][whole[at[at < n]]]
    out, q, shift = np.zeros(len(at), dtype=np.uint64), np.uint64(_MUL[which]), np.uint64(31)
    for j in range(k):
        # no polynomial: each step spreads the bits, so that sequences of words don't cancel out
        out ^= hashes[at + j]
        out *= q
        out ^= out >> shift
    return at, mix(out, which)


def mix(x: np.ndarray, which: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(_MUL[which])
    x ^= x >> np.uint64(29)
    x *= np.uint64(_MUL[1 - which])
    x ^= x >> np.uint64(32)
    return x


def texts_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts together hold at most `limit` bytes, one document at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
