"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard verification, components.

Two permutations give all signature coordinates: sigma spreads a shingle over a circle of 2**32
places, and coordinate k is the smallest pi(sigma(x) + k), the second permutation read k places
further round. Rows with the same word sequence are folded into their smallest id first. Bands
propose candidates; a link counts only after its Jaccard similarity is computed on full sets.

A band bucket never lists all its pairs. Buckets with the same members count once. Each bucket
links its members to its hub, the member that agrees most with the others. Links that hold make
components; only members that are still apart afterwards meet again, with their full sets. There a
pair is first bounded (the shingles of a document that no other document left at this stage has are in
no intersection), then counted, and one link for each pair of components is kept.

Every link is confirmed on the texts of both documents: words have 128-bit codes that tell them apart,
and shingles 128 bits made of these.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACED, Words, documents, dropped, rolling, slices, small, texts_of, written

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6, at 0.85 2e-8.
COORDS, ROWS = 96, 4
#: Members that one task compares with a hub, and bytes of their texts, about: larger groups are split,
#: the hub's text goes to each.
GROUP, GROUP_BYTES = 256, 64 << 20
#: Signatures of one band bucket that one task holds, about.
PART = 4096
#: Shingles of one bucket whose members are still apart that one task holds, about.
PART_SHINGLES = 2_000_000
_BLOCK = 1 << 12


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 128 bits as 2 x m numbers) of the distinct n-word shingles of a slice, sorted by document
    and first number; a document with 1 to n-1 words has its whole sequence as one shingle."""
    h = words.hashes()
    at, low = rolling(h[0], words.doc, n)
    doc, grams = words.doc[at], np.stack((low, rolling(h[1], words.doc, n, 1)[1]))
    count = np.diff(words.first)
    for k in range(1, n):
        some = np.flatnonzero(count == k)
        if len(some):
            g = [rolling(h[i], words.doc, k, i, words.first[some])[1] ^ np.uint64(k) for i in (0, 1)]
            doc, grams = np.concatenate((doc, some)), np.concatenate((grams, np.stack(g)), axis=1)
    for keys in ((grams[0], doc), (grams[1], grams[0], doc)):
        order = np.lexsort(keys)
        d, g = doc[order], grams[:, order]
        same = (d[1:] == d[:-1]) & (g[0, 1:] == g[0, :-1])
        again = same & (g[1, 1:] == g[1, :-1])
        if (same == again).all():
            break
    new = np.concatenate((np.ones(min(1, len(d)), dtype=bool), ~again))
    return d[new], g[:, new]


def _among(grams: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which of grams are among those of one set, which isn't empty."""
    j = np.minimum(np.searchsorted(one[0], grams[0]), one.shape[1] - 1)
    half = one[0, j] == grams[0]
    out = half & (one[1, j] == grams[1])
    odd = np.flatnonzero(half & ~out)
    if len(odd):
        have = set(zip(*one.tolist(), strict=True))
        out[odd] = [x in have for x in zip(*grams[:, odd].tolist(), strict=True)]
    return out


def signatures(doc: np.ndarray, grams: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x COORDS 32-bit minima; documents without shingles get the largest number."""
    out = np.full((n_docs, COORDS), 0xFFFFFFFF, dtype=np.uint32)
    sigma = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    size = np.bincount(doc, minlength=n_docs)
    cuts, i = np.concatenate(([0], np.cumsum(size))), 0
    while i < n_docs:  # some documents at a time, so that the numbers stay in the cache
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + _BLOCK, side="right")) - 1)
        x = sigma[cuts[i] : cuts[j]]
        has = np.flatnonzero(size[i:j]) + i
        if len(has):
            starts = cuts[has] - cuts[i]
            for k in range(COORDS):
                y = x + np.uint32(k)
                y ^= y >> np.uint32(16)
                y *= np.uint32(0x7FEB352D)
                y ^= y >> np.uint32(15)
                y *= np.uint32(0x846CA68B)
                y ^= y >> np.uint32(16)
                out[has, k] = np.minimum.reduceat(y, starts)
        i = j
    return out


def sketched(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, digest of the word sequence, n_shingles, sig): one row for each row of docs."""

    def sketch(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi], SPACED, lower=True)
                doc, grams = shingles(words, n)
                sig = signatures(doc, grams[0], hi - lo)
                digest = [hashlib.blake2b(words.text(a, b), digest_size=16).digest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(digest, pa.binary()), pa.array(np.bincount(doc, minlength=hi - lo), pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["id", "digest", "n_shingles", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(sketch, "id long, digest binary, n_shingles long, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(band, id): a key for each band of each representative."""

    @F.arrow_udf("array<long>")
    def keys(sig: pa.Array) -> pa.Array:
        m = np.frombuffer(b"".join(sig.to_pylist()), dtype=np.uint32).reshape(-1, COORDS // ROWS, ROWS).astype(np.uint64)
        out = np.zeros(m.shape[:2], dtype=np.uint64)
        for j in range(ROWS):
            out = (out ^ m[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out = (out << np.uint64(5)) ^ np.arange(COORDS // ROWS, dtype=np.uint64)
        return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(out.ravel().view(np.int64)))

    return reps.select(F.explode(keys("sig")).alias("band"), "id")


def _members(bands: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, salt, salts, id, sig) of one bucket of each set of two or more members; and the table of buckets.

    A bucket of more than PART members is dealt by id over `salts`, in the joins too. Of these buckets
    there is one for each PART rows of bands at most; their table is broadcast if it is small.
    """
    sets = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("n > 1")
    buckets = written(sets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / PART).cast("int").alias("salts")))
    rows = bands.join(small(buckets.where("salts > 1")), "band", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    each = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return written(rows.join(each, ["band", "salt"]).join(reps, "id").select("band", "salt", "salts", "id", "sig")), buckets


def _linked(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets have 100 * intersection >= percent * union.

    docs: (id, text, n_bytes); rows that repeat an id have equal texts. b's texts are sent to a's groups,
    which are split where they are large; a's text goes to each part.
    """
    pairs = pairs.join(docs.select(F.col("id").alias("b"), "n_bytes").dropDuplicates(["b"]), "b")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(GROUP) + F.sum("n_bytes") / F.lit(GROUP_BYTES)).alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    hubs = dealt.groupBy("a", "part").agg(F.lit(True).alias("hub")).select(F.col("a").alias("id"), "a", "part", "hub")
    wanted = dealt.select(F.col("b").alias("id"), "a", "part", F.lit(False).alias("hub")).unionByName(hubs)
    rows = docs.join(wanted, "id").select("a", "part", "hub", "id", "text")

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hub = np.flatnonzero(table["hub"].to_numpy())
        texts, ids = texts_of(table["text"].combine_chunks()), table["id"].to_numpy()
        one = shingles(Words([texts[hub[0]]], SPACED, lower=True), n)[1] if len(hub) else np.zeros((2, 0))
        good = []
        if one.shape[1]:
            for lo, hi in slices(texts):
                doc, grams = shingles(Words(texts[lo:hi], SPACED, lower=True), n)
                size = np.bincount(doc, minlength=hi - lo)
                both = np.bincount(doc[_among(grams, one)], minlength=hi - lo)
                good += [lo + i for i in np.flatnonzero((100 * both >= percent * (size + one.shape[1] - both)) & (size > 0))]
        good = [i for i in good if ids[i] != ids[hub[0]]]
        return pa.table({"a": pa.array(np.full(len(good), ids[hub[0]] if good else 0), pa.int64()), "b": pa.array(ids[good], pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(verify, "a long, b long")


def _dealt(members: DataFrame) -> DataFrame:
    """members (band, id, sig) with salt: large buckets are split by id, so that no task holds more than
    about PART signatures of one bucket."""
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / F.lit(PART)).alias("salts"))
    return members.join(sizes, "band").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))


def _sig(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint32).reshape(table.num_rows, COORDS)


def _stars(members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """members (band, salt, id, sig): links (a, b) of each bucket's members to its hub, and the tables that
    these are read from. The parts of a large bucket have hubs of their own, which are members of a
    smaller bucket in the next round."""

    def star(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, sig = table["id"].to_numpy(), _sig(table)
        if len(ids) <= 64:
            agree = (sig[:, None] == sig[None]).sum(axis=(1, 2))
        else:
            s, common = np.sort(sig, axis=0), np.empty(COORDS, dtype=np.uint32)
            for k in range(COORDS):
                edge = np.flatnonzero(np.concatenate(([True], s[1:, k] != s[:-1, k], [True])))
                common[k] = s[edge[np.argmax(np.diff(edge))], k]
            agree = (sig == common).sum(axis=1)
        hub = np.lexsort((ids, -agree))[0]
        of = np.full(len(ids), None, dtype=object)
        of[hub] = sig[hub].tobytes()
        return pa.table({"band": table["band"], "a": pa.array(np.full(len(ids), ids[hub])), "b": pa.array(ids), "sig": pa.array(of, pa.binary())})

    links, tables = None, []
    while True:
        found = written(members.groupBy("band", "salt").applyInArrow(star, "band long, a long, b long, sig binary"))
        tables.append(found)
        pairs = found.where("a <> b").select("a", "b")
        links = pairs if links is None else links.union(pairs)
        hubs = found.where("a = b").select("band", F.col("a").alias("id"), "sig")
        more = hubs.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
        hubs = hubs.join(more, "band", "left_semi")
        if hubs.isEmpty():
            return links.distinct(), tables
        members = _dealt(hubs)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """docs (id, text): (id, size, grams): the number of distinct shingles and their sorted hashes."""

    def sets(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts):
                doc, g = shingles(Words(texts[lo:hi], SPACED, lower=True), n)
                size = np.bincount(doc, minlength=hi - lo)
                at = np.concatenate(([0], np.cumsum(size)))
                grams = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(g[0].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), grams], names=["id", "size", "grams"])

    return docs.select("id", "text").mapInArrow(sets, "id long, size long, grams array<long>")


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """sets with alone, the shingles that no other of them has; without those that have too many of
    these to be linked with any other."""
    single = sets.select("id", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    alone = single.groupBy("id").agg(F.count("*").alias("alone"))
    df = sets.join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return df.where(F.lit(100) * (F.col("size") - F.col("alone")) >= F.lit(percent) * F.col("size"))


class Prefixes:
    """Sets of hashes, indexed by the grams of their prefixes, the rarest first.

    Two sets of similarity percent or more have at least percent of each in common, so they share
    one of the size - ceil(percent of size) + 1 grams that are first in any common order. Only sets
    that share one are compared.
    """

    def __init__(self, flat: np.ndarray, size: np.ndarray, percent: int):
        self.percent, self.size, self.cut = percent, size, np.concatenate(([0], np.cumsum(size)))
        self.grams, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), dtype=np.int64)
        self.rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.number = self.rank[inv]
        doc = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((self.number, doc))
        first = order[np.arange(len(flat)) - self.cut[doc] < self._first(size)[doc]]
        first = first[np.argsort(self.number[first], kind="stable")]
        self.docs, self.at = doc[first], np.searchsorted(self.number[first], np.arange(len(count) + 1))
        self.has = np.zeros(len(count), dtype=np.int64)

    def _first(self, size: np.ndarray) -> np.ndarray:
        return size + 1 + (-self.percent * size) // 100

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of those of a set's grams that some indexed set has, the rarest first."""
        j = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.sort(self.rank[j[self.grams[j] == grams]])

    def candidates(self, known: np.ndarray, size: int) -> np.ndarray:
        """Sets whose prefix meets that of a set of this size. Grams that no indexed set has come first."""
        some = known[: max(0, int(self._first(np.int64(size))) - (size - len(known)))]
        return np.unique(np.concatenate([self.docs[:0], *(self.docs[self.at[g] : self.at[g + 1]] for g in some)]))

    def common(self, known: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """How many of the grams each of docs has."""
        starts = np.concatenate(([0], np.cumsum(self.size[docs])))
        at = np.arange(starts[-1]) + np.repeat(self.cut[docs] - starts[:-1], self.size[docs])
        self.has[known] = 1
        both = np.add.reduceat(self.has[self.number[at]], starts[:-1])
        self.has[known] = 0
        return both


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """members (band, salt, salts, id, comp, size, alone, grams): links between members of a bucket in
    different components, one for each pair of components at least.

    A bucket's members are dealt into parts, and those outside its largest component, which ask, into
    parts of their own. A task holds one part of each kind, whatever the bucket's size.
    """
    few = F.col("comp") != F.col("main")
    parts = lambda shingles: F.greatest(F.lit(1), F.ceil(shingles / F.lit(PART_SHINGLES)))
    size = (
        members.groupBy("band", "salts", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("s")).groupBy("band", "salts")
        .agg(F.max_by(F.struct("comp", "s"), F.struct("n", "comp")).alias("m"), F.sum("s").alias("s"), F.count("*").alias("comps")).where("comps > 1")
        .select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("m.comp").alias("main"), parts(F.col("s")).alias("parts"), parts(F.col("s") - F.col("m.s")).alias("askers"))
    )
    dealt = members.join(size, ["band", "salt"])
    cols = ["band", "part", "asker", "id", "comp", "size", "alone", "grams"]
    deal, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    own = dealt.withColumn("part", deal("parts")).withColumn("asker", every("askers")).select(*cols, F.lit(False).alias("asks"))
    asks = dealt.where(few).withColumn("asker", deal("askers")).withColumn("part", every("parts")).select(*cols, F.lit(True).alias("asks"))

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks, ids, size = (table[c].to_numpy() for c in ("asks", "id", "size"))
        comp, most = table["comp"].to_numpy().copy(), size - table["alone"].to_numpy()
        grams = table["grams"].combine_chunks()
        at, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        own, a, b = np.flatnonzero(~asks), [], []
        if len(own) and asks.any():
            index = Prefixes(np.concatenate([flat[at[i] : at[i + 1]] for i in own]), size[own], percent)
            for i in np.flatnonzero(asks):
                known = index.known(flat[at[i] : at[i + 1]])
                near = index.candidates(known, int(size[i]))
                other = own[near]
                both = np.minimum(most[other], most[i])
                near = near[(comp[other] != comp[i]) & (100 * both >= percent * (size[other] + size[i] - both))]
                if not len(near):
                    continue
                both, other = index.common(known, near), own[near]
                good = other[100 * both >= percent * (size[other] + size[i] - both)]
                found, once = np.unique(comp[good], return_index=True)
                a += [int(ids[i])] * len(found)
                b += ids[good[once]].tolist()
                comp[np.isin(comp, found)] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return own.unionByName(asks).groupBy("band", "part", "asker").applyInArrow(links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over links (a, b), for every id that has a link.

    Each round takes the smallest label among neighbours and then the label of the label, so that
    long chains halve; rounds go on until nothing changes. Labels are written tables.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = old = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("id"), "comp"))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("low"))
        mine = labels.join(near, labels.id == near.a).select("id", F.least("comp", "low").alias("next"), F.col("comp").alias("was"))
        up = labels.select(F.col("id").alias("next"), F.col("comp").alias("top"))
        new = written(mine.join(up, "next", "left").select("id", F.coalesce("top", "next").alias("comp"), "was"))
        labels = new.select("id", "comp")
        dropped(old)
        if new.where("comp <> was").isEmpty():
            dropped(both)
            return labels
        old = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row for each row of docs.

    Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; sets hold
    distinct n-word shingles of the whole text, however long. Rows without words, null texts among them,
    are linked with nothing. Rows with a null id keep null and are linked with nothing. Rows that repeat
    an id are one document: links of any of its texts are links of all. Other columns are not read; an
    empty table gives no rows.
    """
    sketch = written(sketched(docs, id_col, text_col, n))
    if not sketch.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").isEmpty():
        dropped(sketch)
        return _pooled(docs, id_col, text_col, n, percent)
    full = sketch.where("n_shingles > 0 AND id IS NOT NULL")
    firsts = full.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = written(full.groupBy("digest").agg(F.min_by(F.struct("id", "sig"), "id").alias("r")).select("r.id", "r.sig"))
    bands = written(_bands(reps))
    members, buckets = _members(bands, reps)
    dropped(bands, reps)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    texts = written(texts.join(members.select("id").distinct(), "id", "left_semi"))
    stars, tables = _stars(members)
    links = written(_linked(stars, texts, n, percent))
    dropped(*tables, buckets)
    comps = components(links)
    labelled = members.select("band", "salt", "salts", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    ends = labelled.groupBy("band", "salt", "salts").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).groupBy("band", "salts").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mixed = ends.where("lo < hi").select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = written(labelled.join(mixed, ["band", "salt"]).select("band", "salt", "salts", "id", "comp"))
    sets = written(_sets(texts.join(left.select("id").distinct(), "id", "left_semi"), n))
    able = written(_able(sets, percent))
    near = written(_apart(left.join(able, "id"), percent))
    dropped(left, sets, able, members)
    if not near.isEmpty():
        more = written(_linked(near, texts, n, percent))
        comps = components(links.union(more))
        dropped(more)
    dropped(links, near, texts)
    rows = sketch.select("id", "digest", "n_shingles").join(firsts, "digest", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    comp = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("comp", "rep", "id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _pooled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """near_duplicates of a table that repeats an id with different texts: each row is judged under a number
    of its own, and components that an id has in common are one."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    out = written(near_duplicates(rows, "row", "text", n, percent).join(rows.select("row", "id"), "row").select("id", "n_shingles", "component_id"))
    some = out.where("id IS NOT NULL AND n_shingles > 0")
    lows = some.groupBy("id").agg(F.min("component_id").alias("a"))
    tops = components(some.join(lows, "id").select("a", F.col("component_id").alias("b")).where("a <> b").distinct())
    out = written(out.join(tops.select(F.col("id").alias("component_id"), "comp"), "component_id", "left").select("id", "n_shingles", F.coalesce("comp", "component_id").alias("top")))
    names = out.where("id IS NOT NULL AND n_shingles > 0").groupBy("top").agg(F.min("id").alias("low"))
    comp = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("low")).otherwise(F.col("id"))
    return out.join(names, "top", "left").select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=3, percent=85)
