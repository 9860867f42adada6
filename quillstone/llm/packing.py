"""Packing: bounded-space online packing of token ids into sequences of at most 2048.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; what
remains goes to the window that it fits best. When none fits and all windows are open, the fullest
is topped up with the front of the piece and emitted, and the rest opens a new window. At the end a
partition's open windows are merged into full ones, and the last tokens are cut into runs of
power-of-two length, so that the leftovers of many partitions merge without padding.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM, SPACED, Words, distinct, documents, slices, texts_of, written
from .token_counts import loaded

SEQUENCE, END, OPEN = 2048, 1, 32
#: Distinct words whose ids a worker remembers at most, and partitions whose leftovers one task merges.
KNOWN_WORDS, PARTITIONS = 1_500_000, 256
_COLS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts as the library gives them, with each distinct word encoded once.

    Holds for vocabularies whose tokens never cross white space and that drop it, as word-end BPE
    does: a text's ids are then its words' ids in a row. The vocabulary must be lower-cased. Known
    words are kept by their 128-bit codes, sorted by one half; a word that shares that half with a
    known one and isn't it is encoded each time.
    """

    def __init__(self, name: str):
        self.tokenizer = loaded(name)
        self._forget()

    def _forget(self) -> None:
        self.codes = np.zeros((2, 0), dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in a row."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return size, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))

    def _learn(self, codes: np.ndarray, words: list[str]) -> None:
        """codes: sorted by the first half, which none of them shares with another or a known one."""
        size, ids = self._ids(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        to = np.searchsorted(self.codes[0], codes[0])
        at, self.used = self.used + np.cumsum(size) - size, self.used + len(ids)
        self.codes = np.insert(self.codes, to, codes, axis=1)
        self.at, self.size = np.insert(self.at, to, at), np.insert(self.size, to, size)

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word would stand, whether its first half is known, and whether it is known itself."""
        if not self.codes.shape[1]:
            return np.zeros(codes.shape[1], dtype=np.int64), *np.zeros((2, codes.shape[1]), dtype=bool)
        j = np.minimum(np.searchsorted(self.codes[0], codes[0]), self.codes.shape[1] - 1)
        half = self.codes[0, j] == codes[0]
        return j, half, half & (self.codes[1, j] == codes[1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Texts of one call should hold a few MB at most."""
        if not texts:
            return []
        # The vocabulary is lower case and splits a final mark from letters or digits before it, so
        # these are taken apart here; texts that may hold a special token's name stay as they are.
        words = Words(texts, SPACED, lower=not any(b"<|" in t for t in texts))
        buf, starts, ends, first = words.buf, words.starts, words.ends, words.first
        tail = _FINAL[buf[ends - 1]] & ALNUM[buf[ends - 2]] & (buf[ends - 2] < 128) & (ends - starts > 1)
        to = np.arange(len(starts)) + np.cumsum(tail) - tail
        words.starts, words.ends = np.repeat(starts, 1 + tail), np.repeat(ends, 1 + tail)
        words.ends[to[tail]] -= 1
        words.starts[to[tail] + 1] = ends[tail] - 1
        first = first + np.concatenate(([0], np.cumsum(tail)))[first]
        where, inv = distinct(codes := words.hashes())
        codes = codes[:, where]
        spell = lambda some: [buf[s:e].tobytes().decode(errors="replace") for s, e in zip(words.starts[where[some]], words.ends[where[some]], strict=True)]
        new = np.flatnonzero(~self._find(codes)[1])
        if self.codes.shape[1] + len(new) > KNOWN_WORDS:
            self._forget()
            new = np.arange(len(where))
        if len(new):
            new = new[np.unique(codes[0, new], return_index=True)[1]]
            self._learn(codes[:, new], spell(new))
        j, _, known = self._find(codes)
        size, at, flat = self.size[j], self.at[j], self.flat
        if not known.all():
            odd = np.flatnonzero(~known)
            size[odd], more = self._ids(spell(odd))
            at[odd] = self.used + np.cumsum(size[odd]) - size[odd]
            flat = np.concatenate((flat[: self.used], more))
        size, at = size[inv], at[inv]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return np.split(ids, total[first[1:-1]])


_FINAL = np.zeros(256, dtype=bool)
_FINAL[list(b".,;:!?")] = True
_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each worker, which keeps its words from task to task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """The open windows of one partition. Rows come out as tuples of the pieces' columns."""

    def __init__(self, part: int, keep_ids: bool):
        self.part, self.keep_ids, self.count = part, keep_ids, 0
        self.open: list[list] = []
        self.fill: list[int] = []

    def _out(self, pieces: list, left: int = 0) -> list[tuple]:
        """pieces (doc, start, ids, doc_tokens) as a sequence of this partition; left: the length of
        a run that is to be merged with other partitions' runs, or 0."""
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), _crc(ids), total, (self.part << 32) + self.count, offset, left, self.part, ids.astype("<u4").tobytes() if self.keep_ids else None))
            offset += len(ids)
        self.count += 1
        return rows

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        total, rows = len(ids), []
        whole = total // SEQUENCE * SEQUENCE
        for s in range(0, whole, SEQUENCE):
            rows += self._out([(doc, s, ids[s : s + SEQUENCE], total)])
        start, rest = whole, ids[whole:]
        if not len(rest):
            return rows
        fits = [(SEQUENCE - f, i) for i, f in enumerate(self.fill) if SEQUENCE - f >= len(rest)]
        if fits:
            self._put(min(fits)[1], (doc, start, rest, total))
        else:
            if len(self.open) == OPEN:
                i = max(range(OPEN), key=lambda k: self.fill[k])
                cut = SEQUENCE - self.fill[i]
                self._put(i, (doc, start, rest[:cut], total))
                start, rest = start + cut, rest[cut:]
            else:
                i = -1
            if len(rest):
                self.open.append([(doc, start, rest, total)])
                self.fill.append(len(rest))
        for i in [i for i, f in enumerate(self.fill) if f == SEQUENCE][::-1]:
            rows += self._out(self.open.pop(i))
            self.fill.pop(i)
        return rows

    def _put(self, i: int, piece: tuple) -> None:
        self.open[i].append(piece)
        self.fill[i] += len(piece[2])

    def end(self) -> list[tuple]:
        rows, total = [], sum(self.fill)
        runs = [SEQUENCE] * (total // SEQUENCE) + [1 << b for b in range(10, -1, -1) if total % SEQUENCE >> b & 1]
        queue = [p for w in self.open for p in w][::-1]
        for run in runs:
            pieces, room = [], run
            while room:
                doc, start, ids, n = queue.pop()
                if len(ids) > room:
                    queue.append((doc, start + room, ids[room:], n))
                    ids = ids[:room]
                pieces.append((doc, start, ids, n))
                room -= len(ids)
            rows += self._out(pieces, 0 if run == SEQUENCE else run)
        return rows


def merged(runs: list[int]) -> list[tuple[int, int]]:
    """(sequence number, offset) of each run of power-of-two length, longest first by contract.

    Descending powers of two fill sequences of 2048 without a gap. What is over is cut into
    sequences of power-of-two length, which need no padding either.
    """
    total = sum(runs)
    ends = [SEQUENCE] * (total // SEQUENCE) + [1 << b for b in range(10, -1, -1) if total % SEQUENCE >> b & 1]
    out, seq, at = [], 0, 0
    for r in runs:
        out.append((seq, at))
        at += r
        if at == ends[seq]:
            seq, at = seq + 1, 0
    return out


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its ids and then END. Null and empty texts are END alone, so every row of docs has
    a piece. ids are little-endian unsigned 32-bit numbers, or null where keep_ids is false. Null and
    repeated ids of documents are kept as they are; each row is packed as a document. Other columns
    aren't read. An empty table gives no rows.
    """

    def place(batches):
        context = TaskContext.get()
        packer, words = Packer(context.partitionId() if context else 0, keep_ids), encoder(name)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 9 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for lo, hi in slices(texts):
                rows = []
                for doc, x in zip(ids[lo:hi], words.encode(texts[lo:hi]), strict=True):
                    rows += packer.add(doc, np.append(x, np.uint32(END)))
                if rows:
                    yield out(rows)
        if rows := packer.end():
            yield out(rows)

    schema = f"{_COLS}, run long, part long, ids binary"
    names = [c.split()[0] for c in schema.split(", ")]
    pieces = written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(place, schema))

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs = sorted({(-r["run"], r["sequence_id"]) for r in rows})
        to = {s: x for (_, s), x in zip(runs, merged([-r for r, _ in runs]), strict=True)}
        base = (1 << 61) + (key[0].as_py() << 32)
        for r in rows:
            seq, at = to[r["sequence_id"]]
            r["sequence_id"], r["offset"] = base + seq, at + r["offset"]
        return pa.Table.from_pylist(rows, schema=table.schema)

    some = [c for c in names if c not in ("run", "part")]
    group = F.floor(F.col("part") / PARTITIONS).cast("long").alias("group")
    left = pieces.where("run > 0").select(*names, group).groupBy("group").applyInArrow(merge, f"{schema}, group long")
    return pieces.where("run = 0").select(*some).unionByName(left.select(*some)).withColumnRenamed("doc_id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), keep_ids=False).drop("ids")
