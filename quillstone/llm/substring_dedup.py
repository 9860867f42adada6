"""Substring dedup with fixed-block anchors.

A window of WINDOW = 13 words holds exactly one of the non-overlapping BLOCK = 7 word blocks of the
document that it is in. So every repeat of a window is found by indexing each document's fixed
blocks and probing that index with every rolling 7-word window. Anchors that are hit are extended
over the 13-word windows around them, which are compared by 128 bits made of their words' 128-bit
codes; overlapping repeats merge into maximal ones.

Documents are dealt into chunks of consecutive ids. A chunk sends each distinct hash once, as a
packed sorted list for each bucket of the hash space, so a passage that a third of all documents
share costs one entry per chunk, and "a smaller id has it" is "a lower chunk has it" plus a look
inside the own chunk. No pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACED, Words, documents, dropped, rolling, slices, texts_of, trimmed, written

WINDOW, BLOCK = 13, 7
#: Text that one chunk holds, and chunks whose entries one bucket of the hash space holds, about.
CHUNK_BYTES, CHUNKS_A_BUCKET = 8 << 20, 3
#: Ranges of ids in which bytes are summed, and partitions that chunks are dealt into at most; beyond,
#: a partition has several chunks, one after the other.
RANGES, MOST_PARTITIONS = 1024, 50_000
_LOW = -(1 << 63)


def _cuts(docs: DataFrame, ids: Column, text_col: str, chunk_bytes: int) -> np.ndarray:
    """The smallest id of each chunk, in order: one number for each chunk_bytes of text.

    The bytes before each id are a sum within its range of ids, and over the ranges before. Ranges
    are RANGES quantiles of the ids, whatever the table's size; a range's rows are an id and a number.
    """
    sizes = written(docs.select(ids.alias("i"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("b")).groupBy("i").agg(F.sum("b").alias("b")))
    some = sizes.agg(F.percentile_approx("i", [k / RANGES for k in range(1, RANGES)], 20 * RANGES).alias("p")).first().p
    bounds = np.unique(np.array(some or [], dtype=np.int64))

    @F.arrow_udf("int")
    def range_of(i: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, i.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    rows = sizes.select("i", "b", range_of("i").alias("r"))
    total = np.zeros(len(bounds) + 1, dtype=np.int64)
    for r in rows.groupBy("r").agg(F.sum("b").alias("b")).collect():
        total[r.r] = r.b
    base = np.cumsum(total) - total

    @F.arrow_udf("long")
    def base_of(r: pa.Array) -> pa.Array:
        return pa.array(base[r.to_numpy(zero_copy_only=False)])

    before = F.sum("b").over(Window.partitionBy("r").orderBy("i")) - F.col("b") + base_of("r")
    cuts = rows.select("i", before.alias("s")).groupBy(F.floor(F.col("s") / chunk_bytes).alias("c")).agg(F.min("i").alias("i")).select("i")
    out = np.sort(cuts.toArrow()["i"].to_numpy())
    dropped(sizes)
    return out


def in_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """docs with chunk__ and id__, dealt by chunk; the number of chunks. Ids of a chunk are larger
    than those of any lower chunk; null counts as the smallest id. A chunk holds about chunk_bytes of
    text, and one document more at most; only rows that repeat one id are never parted."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    cuts = _cuts(docs, ids, text_col, chunk_bytes)
    n = max(1, len(cuts))
    held = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def chunk(i: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(held.value, i.to_numpy(zero_copy_only=False), side="right").astype(np.int32) - np.int32(1))

    return docs.withColumn("id__", ids).withColumn("chunk__", chunk("id__")).repartition(min(n, MOST_PARTITIONS), "chunk__"), n


def _words(table: pa.Table, text_col: str) -> Iterator[tuple[int, Words]]:
    """The words of a chunk's documents, a slice of them after the other, and each slice's first row.
    No window lies over two slices, so only what is compared is held for the whole chunk."""
    texts = texts_of(table[text_col])
    for lo, hi in slices(texts):
        yield lo, Words(texts[lo:hi], SPACED)


def _blocks(w: Words, h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of 7-word windows, keys (the bucket above 32 bits of the hash), and which are fixed blocks."""
    at, x = rolling(h[0], w.doc, BLOCK)
    keys = ((x >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
    return at, keys, (at - w.first[w.doc[at]]) % BLOCK == 0


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct numbers of all parts, which are taken out of the list."""
    keys = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)])
    parts.clear()
    keys.sort()
    return keys[np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]))]


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among sorted numbers."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _packed(keys: np.ndarray) -> bytes:
    """Sorted 32-bit numbers by byte planes: the upper planes are runs, which the shuffle's codec removes."""
    return keys.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed low halves) of sorted distinct 64-bit keys."""
    cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, _packed(keys[cut[b] : cut[b + 1]] & np.uint64(0xFFFFFFFF))


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)


_ROW = (["bucket", "chunk__", "fixed", "keys"], [pa.int32(), pa.int32(), pa.bool_(), pa.binary()])
_ROW_SQL = "bucket int, chunk__ int, fixed boolean, keys binary"


def _wide(pairs: np.ndarray) -> np.ndarray:
    """Rows of two 64-bit numbers as 16-byte items that sort and compare."""
    return np.ascontiguousarray(pairs.astype(">u8")).view("S16").ravel() if len(pairs) else np.zeros(0, dtype="S16")


def _narrow(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="S16")


def repeats(chunks: DataFrame, n: int, text_col: str) -> DataFrame:
    """(bucket, chunk__, fixed, keys): for each chunk, the 128-bit windows that a lower chunk has too."""
    buckets = max(1, n // CHUNKS_A_BUCKET)

    def index_and_probe(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trimmed()
        fixed, every = [], []
        for _, w in _words(table, text_col):
            _, keys, whole = _blocks(w, w.hashes(), buckets)
            fixed.append(keys[whole])
            every.append(keys)
        return _rows([(b, key[0].as_py(), kind, blob) for kind, some in ((True, fixed), (False, every)) for b, blob in _by_bucket(_distinct(some), buckets)], *_ROW)

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trimmed()
        def side(fixed: bool) -> Iterator[tuple[int, np.ndarray]]:
            for i in np.flatnonzero(table["fixed"].to_numpy() == fixed).tolist():
                yield table["chunk__"][i].as_py(), _unpacked(table["keys"][i].as_py())

        index, rows = list(side(True)), []
        uniq = np.unique(np.concatenate([np.zeros(0, np.uint32), *(k for _, k in index)]))
        if not len(uniq):
            return _rows([], *_ROW)
        low, high = np.full(len(uniq), np.iinfo(np.int32).max, np.int32), np.full(len(uniq), -1, np.int32)
        for c, k in index:
            j = np.searchsorted(uniq, k)
            low[j] = np.minimum(low[j], c)
        for c, k in side(False):
            k = k[_within(k, uniq)]
            j = np.searchsorted(uniq, k)
            high[j] = np.maximum(high[j], c)
            rows.append((key[0].as_py(), c, False, _packed(k[low[j] < c])))
        rows += [(key[0].as_py(), c, True, _packed(k[high[np.searchsorted(uniq, k)] > c])) for c, k in index]
        return _rows([r for r in rows if r[3]], *_ROW)

    def extend(key: tuple[pa.Scalar, ...], table: pa.Table, hits: pa.Table) -> pa.Table:
        trimmed()
        if not hits.num_rows or not table.num_rows:
            return _rows([], *_ROW)
        known: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for r in hits.to_pylist():
            known[r["fixed"]].append((np.uint64(r["bucket"]) << np.uint64(32)) | _unpacked(r["keys"]).astype(np.uint64))
        starts, rolled, some = _distinct(known[True]), _distinct(known[False]), []
        for _, w in _words(table, text_col):
            h = w.hashes()
            at, keys, fixed = _blocks(w, h, buckets)
            near = np.zeros(len(w) + 1, dtype=np.int32)
            for q in (at[fixed][_within(keys[fixed], starts)], at[_within(keys, rolled)]):
                np.add.at(near, np.maximum(q - (WINDOW - BLOCK), 0), 1)
                np.add.at(near, q + 1, -1)
            to = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            some.append(np.unique(_wide(np.stack([rolling(h[k], w.doc, WINDOW, k, to)[1] for k in (0, 1)], axis=1))))
        items = np.unique(np.concatenate([*some, _narrow(b"")]))
        home = items.view(np.uint8).reshape(-1, 16)[:, :4].copy().view(np.uint32).ravel() % buckets
        return _rows([(int(b), key[0].as_py(), False, items[home == b].tobytes()) for b in np.unique(home)], *_ROW)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trimmed()
        got = [(_narrow(r["keys"]), r["chunk__"]) for r in table.to_pylist()]
        k, c = np.concatenate([k for k, _ in got]), np.concatenate([np.full(len(k), c, np.int32) for k, c in got])
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        lead = np.concatenate(([True], k[1:] != k[:-1]))
        low = c[lead][np.cumsum(lead) - 1]
        return _rows([(key[0].as_py(), int(x), False, k[(c == x) & (low < x)].tobytes()) for x in np.unique(c[low < c])], *_ROW)

    hits = chunks.groupBy("chunk__").applyInArrow(index_and_probe, _ROW_SQL).groupBy("bucket").applyInArrow(anchors, _ROW_SQL)
    found = chunks.groupBy("chunk__").cogroup(hits.groupBy("chunk__")).applyInArrow(extend, _ROW_SQL)
    return found.groupBy("bucket").applyInArrow(compare, _ROW_SQL)


def _later(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the windows, with 128 bits in a and b, are also in a document with a smaller id here."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.diff(a[order]) != 0
    new[1:] |= np.diff(b[order]) != 0
    starts, own = np.flatnonzero(new), ids[order]
    out = np.zeros(len(order), dtype=bool)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(own, starts), np.diff(starts, append=len(order))) < own
    return out


def _cut(table: pa.Table, text_col: str, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, removed words and kept text of each document of a chunk; known: windows of lower chunks.

    Only windows whose first half is in the chunk twice or known get their second half.
    """
    ids, parts, firsts = table["id__"].to_numpy(), [], []
    for lo, w in _words(table, text_col):
        h = w.hashes()
        firsts.append(rolling(h[0], w.doc, WINDOW)[1])
        w.starts, w.ends, w.doc = (x.astype(np.int32) for x in (w.starts, w.ends, w.doc))
        parts.append((lo, w, h[1].copy()))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    every = np.concatenate(firsts)
    every.sort()
    twice = _distinct([every[1:][every[1:] == every[:-1]]])
    del every
    known = np.sort(known)
    heads = known.view(">u8")[::2].astype(np.uint64)
    places, left, hits = [], [], []
    for (lo, w, h), x in zip(parts, firsts, strict=True):
        some = np.flatnonzero(_within(x, twice) | _within(x, heads))
        at = np.flatnonzero(w.doc[: len(w) - WINDOW + 1] == w.doc[WINDOW - 1 :])[some] if len(x) else some
        a, b = x[some], rolling(h, w.doc, WINDOW, 1, at)[1]
        hit = _within(_wide(np.stack((a, b), axis=1)), known)
        places.append(at.astype(np.int32))
        hits.append(hit)
        left.append((a[~hit], b[~hit], ids[lo + w.doc[at[~hit]]]))
    firsts.clear()
    hit = np.concatenate(hits)
    hit[~hit] = _later(*map(np.concatenate, zip(*left, strict=True)))
    del left
    words, removed, kept, base = [], [], [], 0
    for (_, w, _), at in zip(parts, places, strict=True):
        q = at[hit[base : base + len(at)]]
        base += len(at)
        gone = np.zeros(len(w) + 1, dtype=np.int32)
        np.add.at(gone, q, 1)
        np.add.at(gone, q + WINDOW, -1)
        stay = np.cumsum(gone[:-1]) == 0
        n = len(w.first) - 1
        words.append(np.diff(w.first))
        removed.append(np.bincount(w.doc[~stay], minlength=n))
        starts, ends, doc = w.starts[stay], w.ends[stay], w.doc[stay]
        buf = w.buf.copy()
        buf[ends] = 0x20
        edge = np.zeros(len(buf) + 1, dtype=np.int8)
        edge[starts] += 1
        edge[ends + 1] -= 1
        out = buf[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
        size = np.bincount(doc, weights=ends - starts + 1, minlength=n).astype(np.int64)
        to = np.concatenate(([0], np.cumsum(size)))
        kept += [out[a : max(a, b - 1)] for a, b in zip(to[:-1], to[1:], strict=True)]
    return np.concatenate(words), np.concatenate(removed), kept


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of docs, and n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of 13 words over it also starts in a document with a smaller id. Null
    text has no words; a null id counts as smaller than all others; rows that repeat an id count as
    one document. Fewer than 13 words lose nothing. Columns of docs with one of the new names give
    way; an empty table stays empty.
    """
    new = ("n_words", "n_removed", "kept_text", "chunk__", "id__")
    own = [c for c in docs.columns if c not in new]
    chunks, n = in_chunks(docs.select(*own), id_col, text_col, chunk_bytes)
    schema = docs.select(*own).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        trimmed()
        items = [_narrow(r) for r in known["keys"].to_pylist()] if known.num_rows else []
        words, removed, kept = _cut(table, text_col, np.concatenate([*items, _narrow(b"")]))
        out = table.select(own)
        for name, values in (("n_words", pa.array(words, pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))):
            out = out.append_column(name, values)
        return out

    return chunks.groupBy("chunk__").cogroup(repeats(chunks, n, text_col).groupBy("chunk__")).applyInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, p, array_to_string(words[p : p + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w)),
lows AS (SELECT gram, min(doc_id) AS low FROM g GROUP BY gram),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN lows USING (gram) WHERE low < doc_id),
gone AS (SELECT doc_id, list(q) AS qs FROM hit GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n, list_filter(words, lambda x, i: qs IS NULL OR NOT list_contains(qs, i)) AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
