"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows of a hashed table, one for the word and one for its
first bytes (inflected forms share it). Filters of several widths slide over the words, each
filter's largest response over the whole text is kept, and a logistic unit reads those maxima.
Scoring folds table and filters into one lookup table per filter tap, so a text costs gathers and
adds only. Every labelled row that isn't held out is learnt from, four fifths of them by the network
and its counts and one fifth by its thresholds; scoring sees every word of every text.

Training runs on the executors. Labelled rows are dealt over shards of bounded size; in each round a
copy of the network learns from each shard by itself, and the copies' mean begins the next round. One
shard alone is plain training by mini-batches.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM, Words, documents, dropped, slices, small, texts_of, written

#: Bytes of labelled text of a shard on average (a copy learns from at most twice that, or one text).
SHARD_BYTES = 8 << 20
#: Times that the copies are made and averaged, and passes that a copy makes over its rows each time.
ROUNDS, PASSES = 10, 3
#: Steps of a logit at which calibration counts rows.
GRID = 4096
#: Bytes of the hashed prefix.
PREFIX = 5
BUCKETS = 1 << 17
WIDTHS = (1, 2, 3)
_SLICE = 1 << 19
_FIXED = 2.0**52


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out from all learning."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)).cast("int")


def _buckets(words: Words, buckets: int) -> np.ndarray:
    """For each word, its two rows of the hashed table."""
    b = np.uint64(buckets)
    return np.stack([words.hashes()[0] % b, words.hashes(PREFIX)[1] % b]).astype(np.int32)


def _best(resp: np.ndarray, words: Words, width: int, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response by document and filter, and the window's first word; documents with too few
    words for a window get `empty` and -1."""
    n, docs = len(words) - width + 1, len(words.first) - 1
    top, at = np.tile(empty, (docs, 1)), np.full((docs, resp.shape[1]), -1)
    if n <= 0:
        return top, at
    resp = resp[:n].copy()
    resp[words.doc[:n] != words.doc[width - 1 :]] = -np.inf
    has = np.flatnonzero(np.diff(words.first) >= width)
    if len(has):
        starts = words.first[has]
        best = np.maximum.reduceat(resp, starts, axis=0)
        # reduceat runs on to the next start, over words of documents too short for a window, whose responses are -inf
        top[has] = best
        owner = np.repeat(np.arange(len(has)), np.diff(np.append(starts, n)))
        for f in range(resp.shape[1]):
            hit = np.flatnonzero(resp[starts[0] :, f] == best[owner, f]) + starts[0]
            d = owner[hit - starts[0]]
            _, once = np.unique(d, return_index=True)
            at[has[d[once]], f] = hit[once]
    return top, at


@dataclass
class Model:
    """taps[w][k]: a row for each bucket, the part of width w's responses that tap k adds."""

    taps: list[list[np.ndarray]]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias, dtype=np.float64)
        if not self.taps:
            return z
        buckets = len(self.taps[0][0])
        for lo, hi in slices(texts, _SLICE):
            words = Words(texts[lo:hi], ALNUM, lower=True)
            b, feats = _buckets(words, buckets), []
            for taps, shift, width in zip(self.taps, self.shift, WIDTHS, strict=True):
                n = max(0, len(words) - width + 1)
                resp = np.zeros((n, len(shift)), dtype=np.float32)
                for k, tap in enumerate(taps):
                    resp += tap[b[0, k : k + n]]
                    resp += tap[b[1, k : k + n]]
                starts = words.first[:-1]
                has = np.flatnonzero(np.diff(words.first) >= width)
                best = np.zeros((hi - lo, len(shift)), dtype=np.float32)
                if len(has):
                    resp[words.doc[:n] != words.doc[width - 1 :]] = -np.inf
                    best[has] = np.maximum.reduceat(resp, starts[has], axis=0)
                feats.append(np.maximum(best + shift, 0))
            z[lo:hi] += np.concatenate(feats, axis=1) @ self.out
        return z

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, lang, toxic, part, place): every labelled row that isn't held out, as a written table.

    Part 1 of 0-4 is used to calibrate, the others to train; place is a hash that orders the rows.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    known = written(known.where("toxic IN (0, 1)"))
    part, place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)), F.xxhash64("doc_id", "text", F.lit(2))
    rows = written(docs.select("doc_id", "text", "lang").join(small(known), "doc_id").select("text", "lang", "toxic", part.alias("part"), place.alias("place")))
    dropped(known)
    return rows


Batch = tuple[np.ndarray, Words, np.ndarray]


def _batches(texts: list[bytes], toxic: np.ndarray) -> list[Batch]:
    """Labels, words and buckets of each mini-batch."""
    out = []
    for lo, hi in slices(texts, _SLICE):
        words = Words(texts[lo:hi], ALNUM, lower=True)
        out.append((toxic[lo:hi], words, _buckets(words, BUCKETS)))
    return out


def _count(counts: np.ndarray, batches: list[Batch]) -> None:
    """Add to counts, by class and bucket, the documents that hold a word there (each row of the two by itself)."""
    for toxic, words, b in batches:
        for row in b:
            key = np.unique(words.doc.astype(np.int64) * BUCKETS + row)
            np.add.at(counts, (toxic[key // BUCKETS], key % BUCKETS), 1)


@dataclass
class Net:
    """The network in training. dense: filters of each width, their shifts, the logistic unit's weights;
    moments: Adam's two for each of them, after t steps."""

    table: np.ndarray
    seen: np.ndarray
    dense: list[np.ndarray]
    moments: list[tuple[np.ndarray, np.ndarray]]
    bias: float
    t: float

    def vector(self) -> np.ndarray:
        """All numbers but the table's; second moments by their roots."""
        parts = [*self.dense, *(m for m, _ in self.moments), *(np.sqrt(m) for _, m in self.moments)]
        return np.concatenate([np.array([self.bias, self.t]), *(x.ravel().astype(np.float64) for x in parts)])

    def load(self, v: np.ndarray) -> None:
        self.bias, self.t = float(v[0]), float(v[1])
        at = 2
        for k, xs in enumerate((self.dense, [m for m, _ in self.moments], [m for _, m in self.moments])):
            for x in xs:
                x[...] = (v[at : at + x.size] ** (2 if k == 2 else 1)).reshape(x.shape)
                at += x.size

    def model(self) -> Model:
        conv, shift = self.dense[: len(WIDTHS)], self.dense[len(WIDTHS) : -1]
        return Model([[(self.table @ c[k]).astype(np.float32) for k in range(len(c))] for c in conv], shift, self.dense[-1], self.bias, {})


def _start(counts: np.ndarray, n: np.ndarray, filters: int, dims: int, rng: np.random.Generator) -> Net:
    """Rows start from each bucket's log ratio of document counts, shrunk to 0 for rare buckets."""
    prior, a = n[1] / n.sum(), 8.0
    ratio = np.log((counts[1] + a * prior) / (n[1] + a * prior)) - np.log((counts[0] + a * (1 - prior)) / (n[0] + a * (1 - prior)))
    ratio -= np.log(a * prior / (n[1] + a * prior)) - np.log(a * (1 - prior) / (n[0] + a * (1 - prior)))
    seen = counts.sum(axis=0) >= 2
    table = np.where(seen[:, None], rng.normal(0, 0.05, (BUCKETS, dims)), 0).astype(np.float32)
    table[:, 0] = np.where(seen, np.clip(ratio, -4, 4), 0)
    conv = [rng.normal(0, 0.1, (w, dims, filters)).astype(np.float32) for w in WIDTHS]
    for c in conv:
        c[:, 0, :] += 1.0 / len(c)
    dense = [*conv, *(np.full(filters, -1.0, dtype=np.float32) for _ in WIDTHS), np.full(filters * len(WIDTHS), 0.3)]
    return Net(table, seen, dense, [(np.zeros_like(p), np.zeros_like(p)) for p in dense], -2.0, 0)


def _learn(net: Net, batches: list[Batch], n: np.ndarray, epochs: int) -> None:
    """Passes over batches, in place; n holds the rows of each class of the whole job, which weigh alike."""
    table, dense, out = net.table, net.dense, net.dense[-1]
    conv, shift, filters = dense[: len(WIDTHS)], dense[len(WIDTHS) : -1], len(dense[-2])
    weight = 0.5 * n.sum() / n
    for _ in range(epochs):
        for toxic, words, b in batches:
            x = table[b[0]] + table[b[1]]
            feats, where = [], []
            for c, s, w in zip(conv, shift, WIDTHS, strict=True):
                m = max(0, len(words) - w + 1)
                resp = sum(x[k : k + m] @ c[k] for k in range(w)) if m else np.zeros((0, filters), np.float32)
                best, at = _best(resp, words, w, np.zeros(filters, np.float32))
                feats.append(np.maximum(best + s, 0))
                where.append(at)
            h = np.concatenate(feats, axis=1)
            p = 1 / (1 + np.exp(-np.clip(h @ out + net.bias, -30, 30)))
            g = (p - toxic) * weight[toxic] / len(toxic)
            grads = [np.zeros_like(v) for v in dense]
            grads[-1] += h.T @ g + 1e-4 * out
            dh = np.outer(g, out) * (h > 0)
            for i, (c, w) in enumerate(zip(conv, WIDTHS, strict=True)):
                d = dh[:, i * filters : (i + 1) * filters]
                grads[len(WIDTHS) + i] += d.sum(axis=0)
                doc, f = np.nonzero((where[i] >= 0) & (d != 0))
                first, amount = where[i][doc, f], d[doc, f]
                for k in range(w):
                    np.add.at(grads[i][k].T, f, amount[:, None] * x[first + k])
                    step = (0.5 * amount[:, None] * c[k][:, f].T).astype(np.float32)
                    for row in b:
                        hit = row[first + k]
                        np.subtract.at(table, hit, step * net.seen[hit][:, None])
            net.t += 1
            net.bias -= 0.05 * g.sum()
            for p_, gr, (m1, m2) in zip(dense, grads, net.moments, strict=True):
                m1 += 0.1 * (gr - m1)
                m2 += 0.01 * (gr * gr - m2)
                p_ -= (0.02 * (m1 / (1 - 0.9**net.t)) / (np.sqrt(m2 / (1 - 0.99**net.t)) + 1e-8)).astype(p_.dtype)


def _alike(n: np.ndarray) -> Model:
    """A model that scores all texts alike, for labels of one class or none."""
    return Model([], [], np.zeros(0), 20.0 if n[1] else -20.0, {})


def train(texts: list[bytes], toxic: np.ndarray, filters: int = 4, dims: int = 8, epochs: int = 30, seed: int = 7) -> Model:
    """Fit the network to whole texts, here. With one class only, a model that scores all texts alike."""
    rng, n = np.random.default_rng(seed), np.bincount(toxic, minlength=2)
    if not n.all():
        return _alike(n)
    order = rng.permutation(len(texts))
    batches, counts = _batches([texts[i] for i in order], toxic[order]), np.zeros((2, BUCKETS))
    _count(counts, batches)
    net = _start(counts, n, filters, dims, rng)
    _learn(net, batches, n, epochs)
    return net.model()


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts and labels of consecutive rows of one shard, of at most `limit` bytes or one row."""
    texts, toxic, size, shard = [], [], 0, None
    for batch in batches:
        for t, y, s in zip(texts_of(batch["text"]), batch["toxic"].to_pylist(), batch["shard"].to_pylist(), strict=True):
            if texts and (s != shard or size + len(t) > limit):
                yield texts, np.array(toxic, dtype=np.int64)
                texts, toxic, size = [], [], 0
            texts.append(t)
            toxic.append(y)
            size, shard = size + len(t) + 16, s
    if texts:
        yield texts, np.array(toxic, dtype=np.int64)


def _counted(rows: DataFrame, limit: int) -> np.ndarray:
    """Documents by class and bucket, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for texts, toxic in _chunks(batches, limit):
            for lo, hi in slices(texts, _SLICE):
                _count(counts, _batches(texts[lo:hi], toxic[lo:hi]))
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], ["at", "clean", "toxic"])

    t = rows.mapInArrow(count, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, BUCKETS))
    counts[:, t["at"].to_numpy()] = t["clean"].to_numpy(), t["toxic"].to_numpy()
    return counts


def _round(rows: DataFrame, net: Net, n: np.ndarray, limit: int) -> None:
    """Let a copy of net learn from each chunk of rows, and move net to the copies' mean, weighed by their rows.

    A row of the table moves to the mean of the copies that changed it, so that rare words are learnt as
    fast as with one copy. Moves are added as whole numbers, so their order doesn't matter.
    """
    spark, dims = rows.sparkSession, net.table.shape[1]
    held, names = spark.sparkContext.broadcast(net), [f"v{i}" for i in range(dims)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, toxic in _chunks(batches, limit):
            own = copy.deepcopy(held.value)
            _learn(own, _batches(texts, toxic), n, PASSES)
            moved = np.flatnonzero((own.table != held.value.table).any(axis=1))
            dense = own.vector() - held.value.vector()
            dense = np.concatenate((dense, np.zeros(-len(dense) % dims))).reshape(-1, dims)
            move = np.concatenate((own.table[moved].astype(np.float64) - held.value.table[moved], dense))
            at, share = np.concatenate((moved, BUCKETS + np.arange(len(dense)))), len(texts) / n.sum() * _FIXED
            whole = np.rint(move * share).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), round(share))), *(pa.array(v) for v in whole.T.copy())], ["at", "share", *names])

    moves = rows.mapInArrow(learn, f"at long, share long, {', '.join(f'{v} long' for v in names)}")
    t = moves.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("share", *names))).toArrow()
    held.destroy()
    at, mean = t["at"].to_numpy(), np.stack([t[v].to_numpy() / t["share"].to_numpy() for v in names], axis=1)
    words, vector = at < BUCKETS, net.vector()
    net.table[at[words]] += mean[words].astype(np.float32)
    dense = np.zeros((-(-len(vector) // dims), dims))
    dense[at[~words] - BUCKETS] = mean[~words]
    net.load(vector + dense.ravel()[: len(vector)])


def _trained(rows: DataFrame, n: np.ndarray, size: int, filters: int = 4, dims: int = 8, seed: int = 7) -> Model:
    """Fit the network to all rows, of n rows by class and size bytes, on the executors."""
    shards, limit = max(1, -(-size // SHARD_BYTES)), 2 * SHARD_BYTES
    dealt = rows.select("text", "toxic", "place", F.pmod("place", F.lit(shards)).alias("shard"))
    dealt = written(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place"))
    net = _start(_counted(dealt, limit), n, filters, dims, np.random.default_rng(seed))
    for _ in range(ROUNDS):
        _round(dealt, net, n, limit)
    dropped(dealt)
    return net.model()


def _threshold(scores: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap that gives the best F1, from the rows and toxic rows of each score; 0.5 without both classes."""
    if not 0 < toxic.sum() < rows.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    i = int(np.argmax(f1))
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Move the bias so that 0.5 is the best threshold over all rows, and set a threshold for each language
    with 10 toxic rows. Rows are counted by their logit, in steps of 1/GRID."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("long")
    def step(text: pa.Array) -> pa.Array:
        return pa.array(np.rint(np.clip(held.value.logits(texts_of(text)), -100, 100) * GRID).astype(np.int64))

    by = written(rows.select("lang", "toxic", step("text").alias("z")).groupBy("lang", "z").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")))
    held.destroy()
    t = by.groupBy("z").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    middle = _threshold(t["z"].to_numpy() / GRID, t["n"].to_numpy(), t["toxic"].to_numpy())
    model.bias -= middle

    def limit(t: pa.Table) -> pa.Table:
        toxic = t["toxic"].to_numpy()
        own = t["lang"][:1].to_pylist() if toxic.sum() >= 10 else []
        s = 1 / (1 + np.exp(-np.clip(t["z"].to_numpy() / GRID - middle, -30, 30)))
        return pa.table({"lang": pa.array(own, pa.string()), "x": pa.array([_threshold(s, t["n"].to_numpy(), toxic)] * len(own), pa.float64())})

    for r in by.where("lang IS NOT NULL").groupBy("lang").applyInArrow(limit, "lang string, x double").toLocalIterator():
        model.thresholds[r.lang] = min(0.9, max(0.1, r.x))
    dropped(by)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on four parts of all labelled rows, then calibrate on the fifth, or on all where that has fewer
    than 20 toxic rows: the bias so that 0.5 is the best threshold over all languages, and a threshold for
    each language that has 10 toxic rows to calibrate on (others use 0.5). The language chooses a threshold;
    it is no input of the score."""
    rows = labelled(docs, labels)
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    sums = {(r.fifth, r.toxic): (r.n, r.size) for r in rows.groupBy((F.col("part") == 1).alias("fifth"), "toxic").agg(F.count("*").alias("n"), size.alias("size")).collect()}
    n = np.array([sums.get((False, y), (0, 0))[0] for y in (0, 1)])
    if n.all():
        model = _trained(rows.where("part <> 1"), n, sums[False, 0][1] + sums[False, 1][1])
        _calibrate(model, rows.where("part = 1") if sums.get((True, 1), (0, 0))[0] >= 20 else rows)
    else:
        model = _alike(n)
    dropped(rows)
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of docs, and score (0 to 1), rejected (score at or over its language's threshold).

    Null and empty texts get the score of a text without words; every word of a text counts, however
    long it is. Columns of docs named score or rejected give way. Repeated rows are scored alike; an
    empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(held.value.scores(texts_of(text)))

    @F.arrow_udf("double")
    def limits(lang: pa.Array) -> pa.Array:
        return pa.array([held.value.thresholds.get(x, 0.5) for x in lang.to_pylist()], pa.float64())

    own = [c for c in docs.columns if c not in ("score", "rejected")]
    limit = limits(F.col(lang_col)) if model.thresholds else F.lit(0.5)
    return docs.select(*own, scored(F.col(text_col)).alias("score")).withColumn("rejected", F.col("score") >= limit)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected"
    )
