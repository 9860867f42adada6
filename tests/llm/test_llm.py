"""The ten operators against brute force, exact round trips and held-out accuracy, on small fixtures
with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, flac, license_scan, minhash_dedup, packing, sentencepiece_codec, shared, substring_dedup, token_counts, toxicity, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
have_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw) if lower else raw)


def texts():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Straße", "x,y"]
    base = [" ".join(r.choices(vocab, k=n)) for n in (0, 1, 2, 3, 12, 13, 14, 40, 90, 300)]
    out = [None, "", "  \t\n", *base, *base[5:], base[9] + " tail", "UP " + base[8].upper(), base[8].lower()]
    for t in base[7:]:
        w = t.split()
        w[3] = "changed"
        out += [" ".join(w), " ".join(w[10:] + w[:10]), "  ".join(w[:25]) + "\n" + " ".join(w[25:])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t, "en", "s", 0, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def got(df):
    return sorted(map(tuple, df.collect()))


def test_words_and_hashes():
    t = [x.encode() for x in ["", "a", " a  bc\t", "éa b", "x" * 3000 + " y"]]
    w = shared.Words(t)
    assert [w.text(a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [b" ".join(WORD.findall(x)) for x in t]
    h = list(zip(*w.hashes().tolist(), strict=True))
    assert h[0] == h[1] and len(set(h)) == 6


def thue_morse(n):
    """Two texts of n bytes that are equal under every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_codes_tell_words_apart():
    some = ["a", "ab", "ab\x01", "abcdefgh", "abcdefg\x07", "abcdefghi", "x" * 15, "x" * 16, "x" * 17, "x" * 300, *thue_morse(1024), *thue_morse(2048), *(f"{i:015d}" for i in range(3000)), *(f"w{i:020d}" for i in range(3000))]
    w = shared.Words([" ".join(some).encode()])
    assert [w.text(i, i + 1).decode() for i in range(len(w))] == some
    for c in (w.codes(), w.hashes()):
        assert len(set(zip(*c.tolist(), strict=True))) == len(some)
    two = np.array([[1, 1, 2, 1, 2, 1, 1], [5, 6, 5, 5, 7, 6, 8]], dtype=np.uint64)
    where, inv = shared.distinct(two)
    assert (two[:, where][:, inv] == two).all() and len(where) == 5
    h = w.hashes()
    s, t = h[:, [10] * 13], h[:, [11] * 13]
    doc = np.zeros(13, dtype=np.int64)
    assert [shared.rolling(s[i], doc, 13, i)[1][0] != shared.rolling(t[i], doc, 13, i)[1][0] for i in (0, 1)] == [True, True]


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomials_confuse(spark, n):
    s, t = thue_morse(n)
    rows = [(1, " ".join([s] * 13)), (2, " ".join([t] * 13)), (3, " ".join([s, t] * 10)), (4, " ".join([t, s] * 10) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash_dedup.near_duplicates(df, n=3, percent=85)) == brute_near(rows, 3, 85)
    want, first = [], {}
    for i, x in rows:
        w = words(x)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone)))
    assert got(substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed")) == want
    tokenizer, e = pytest.importorskip("tokenizers").Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json")), packing.Encoder("word_bpe_49k.json")
    for x in (s, t, f"{s} {t}", f"{t}. {s},"):
        assert list(e.encode([x.encode()])[0]) == tokenizer.encode(x, add_special_tokens=False).ids


def test_encoder_with_clashing_halves(monkeypatch):
    tokenizer, e = pytest.importorskip("tokenizers").Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json")), packing.Encoder("word_bpe_49k.json")
    plain = shared.Words.hashes
    monkeypatch.setattr(shared.Words, "hashes", lambda w: plain(w) & np.array([[3], [0xFFFFFFFFFFFFFFFF]], dtype=np.uint64))
    for x in ("some words here and there, some words", "others here too and more", "words"):
        assert list(e.encode([x.encode()])[0]) == tokenizer.encode(x, add_special_tokens=False).ids

def test_url_rules_and_regression(spark):
    model = url_filter.train(url_filter.labelled(spark))
    judged = url_filter.filter_urls(url_filter.labelled(spark), model, "label")
    assert judged.where("(score >= 0.5) <> (label = 1)").count() == 0
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/1?x", "https://www.example.com/en/#a", "http://a.b.net/fr/9", "http://x.com", "http://x.com/", "http://notexample.com/en/", "ftp://spam-farm.org/buy?q=/en/", "http://x.net?/es/", "http://É.net/es/é"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    bias, weights = model
    out = {r.page_id: r for r in url_filter.filter_urls(rows, model).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = next(((v, s) for v, s in rules if (host == s.split("/")[0] or host.endswith("." + s.split("/")[0])) and path.startswith("/" + s.split("/", 1)[1])), None)
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[1])
        assert r.verdict == (fit[0] if fit else "block" if r.score >= 0.5 else "allow")
    assert out[9].verdict == "block" and len(weights) == 2048
    assert url_filter.filter_urls(rows.limit(0), model).count() == 0
    assert url_filter.train(url_filter.labelled(spark).limit(0))[0] == 0


def test_dual_fit_is_gradient_descent(spark):
    model = url_filter.train(url_filter.labelled(spark), buckets=64, steps=40)
    host, path = url_filter.host_and_path(F.col("url"))
    rows = url_filter.labelled(spark).select("label", url_filter._grams(host, path, 64).alias("g")).collect()
    x = np.zeros((len(rows), 65))
    for i, r in enumerate(rows):
        np.add.at(x[i], r.g, 1 / np.sqrt(len(r.g)))
        x[i, 64] = 1
    y, w = np.array([r.label for r in rows]), np.zeros(65)
    for _ in range(40):
        w = w * (1 - 2.0 * 0.002) + 2.0 / len(y) * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    assert np.allclose([*model[1], model[0]], w, atol=1e-8)


def test_exact_dedup(docs, empty, monkeypatch):
    rows = pairs(docs)
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    want = sorted((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for small, bits, prefix in ((200_000, 1 << 26, 256), (0, 1 << 26, 256), (0, 1 << 15, 1), (200_000, 1 << 16, 0)):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", small)
        monkeypatch.setattr(exact_dedup, "BITS", bits)
        df = exact_dedup.exact_dedup(docs, prefix=prefix)
        assert got(df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == want
        assert sorted(pairs(exact_dedup.without_copies(docs, prefix=prefix))) == sorted((i, t) for i, t in rows if i == max(by[t or ""]))
    few = exact_dedup._digested(docs, "doc_id", "text", 256).where("sha__ IS NOT NULL").count()
    assert few < len(rows)
    odd = docs.select("*", *(F.lit(None).cast("string").alias(c) for c in ("n_bytes__", "top__", "size__", "ROW__", "bits", "slot", "sha__", "keep__", "id__")))
    assert exact_dedup.exact_dedup(odd).count() == len(rows) and set(odd.columns) <= {*exact_dedup.exact_dedup(odd).columns, "kept"}
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = exact_dedup.exact_dedup(docs.where("doc_id < 15").union(docs.where("doc_id < 15")))
    assert twice.where("group_size < 2").count() == 0


def test_substring_dedup(docs, empty):
    rows = pairs(docs)
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    for size in (8 << 20, 500, 60):
        assert got(substring_dedup.substring_dedup(docs, chunk_bytes=size).select("doc_id", "n_words", "n_removed", "kept_text")) == sorted(want)
    assert sum(x[2] for x in want) > 100
    assert substring_dedup.substring_dedup(empty).count() == 0
    r = random.Random(4)
    uneven = [(k * k, " ".join(r.choices(["u", "v", "w"], k=r.choice([1, 20, 3000])))) for k in range(60)]
    lots = docs.sparkSession.createDataFrame(uneven, "doc_id long, text string").repartition(3)
    chunks, n = substring_dedup.in_chunks(lots, "doc_id", "text", 6000)
    sizes = chunks.groupBy("chunk__").agg(F.sum(F.octet_length("text") + 1).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("chunk__").collect()
    assert len(sizes) == n and max(x.b for x in sizes) <= 12_000 and all(x.hi < y.lo for x, y in zip(sizes, sizes[1:], strict=False))
    odd = docs.sparkSession.createDataFrame([(None, texts()[11]), (1, texts()[11]), (1, texts()[11])], "doc_id long, text string")
    cut = {(r.doc_id, r.n_removed > 0) for r in substring_dedup.substring_dedup(odd).collect()}
    assert cut == {(None, False), (1, True)}


class Steps:
    """Stands for a DataFrame: keeps the functions that run on groups."""

    def __init__(self):
        self.by, self.columns, self.schema = {}, ["doc_id", "text"], self

    def groupBy(self, *_):
        return self

    cogroup = select = add = groupBy

    def applyInArrow(self, f, _):
        self.by[f.__name__] = f
        return self


def test_substring_dedup_holds_little_of_a_chunk(monkeypatch):
    """Each step holds less than 18 times the text of its chunk beside it; a quarter of the
    second chunk's documents repeat some of the first, a quarter some of its own."""
    monkeypatch.setattr(substring_dedup, "in_chunks", lambda df, *_: (df, 2))
    substring_dedup.substring_dedup(steps := Steps())
    r, rows, most, n = random.Random(8), [], {}, 1200
    for k in range(2 * n):
        rows.append(rows[k - n if k % 4 == 1 else k - 1] if k >= n and k % 2 else " ".join(r.choices([f"w{i}" for i in range(5000)], k=1000)))

    def step(name, chunk, *tables):
        tracemalloc.start()
        out = steps.by[name]((pa.scalar(chunk),), *tables)
        most[name] = max(most.get(name, 0), tracemalloc.get_traced_memory()[1] / sum(len(t) for t in rows[:n]))
        tracemalloc.stop()
        return out

    def of(tables, chunk):
        both = pa.concat_tables(tables)
        return both.filter(pc.equal(both["chunk__"], chunk))

    chunks = [pa.table({"doc_id": ids, "text": rows[c * n : c * n + n], "id__": ids, "chunk__": pa.array([c] * n, pa.int32())}) for c in (0, 1) for ids in [pa.array(range(c * n, c * n + n), pa.int64())]]
    hits = step("anchors", 0, pa.concat_tables([step("index_and_probe", c, t) for c, t in enumerate(chunks)]))
    known = step("compare", 0, pa.concat_tables([step("extend", c, t, of([hits], c)) for c, t in enumerate(chunks)]))
    out = [x for c, t in enumerate(chunks) for x in step("cut", c, t, of([known], c))["n_removed"].to_pylist()]
    assert out == [1000 * (k >= n and k % 2) for k in range(2 * n)]
    assert max(most.values()) < 18, list(most.values())


def test_freed_memory_is_given_back():
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10  # noqa: E731, SIM115
    some = [bytes(10_000) for _ in range(10_000)]
    last, full = bytes(10_000), held()
    del some
    shared.trimmed()
    assert held() < full - 70 and last


def brute_near(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets.items())


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, n, percent, monkeypatch):
    assert got(minhash_dedup.near_duplicates(docs, n=n, percent=percent)) == brute_near(pairs(docs), n, percent)
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    r = random.Random(8)
    a, b, c, d = ([f"{k}{r.randrange(10**6)}" for _ in range(60)] for k in "abcd")
    rows = [(5, a), (5, b), (6, [*a, "x"]), (7, [*b, "y"]), (8, c), (9, c), (9, d), (9, []), (12, [*d, "z"]), (13, ["only", "words"]), (None, a), (20, []), (21, d[::-1])]
    for k in range(3):
        r.shuffle(rows)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(k + 1)
        comp = {(x.doc_id, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(df).collect()}
        assert comp == {(5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (9, 8, False), (9, 9, True), (12, 8, False), (13, 13, True), (None, None, True), (20, 20, True), (21, 21, True)}


def test_near_duplicates_in_parts(spark, monkeypatch):
    for name, v in (("PART", 3), ("GROUP", 2), ("PART_SHINGLES", 300), ("GROUP_BYTES", 900)):
        monkeypatch.setattr(minhash_dedup, name, v)
    r = random.Random(2)
    base, rows = [f"b{i}" for i in range(80)], []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(80)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash_dedup.near_duplicates(df, n=3, percent=85)) == brute_near(rows, 3, 85)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.comp) for r in minhash_dedup.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@have_tables
def test_toxicity_held_out(spark):
    at = SF.replace("sf0.001", "sf0.1")
    df = toxicity.op3_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out")
    good, bad = ([r.score for r in df.where(f"toxic = {y}").collect()] for y in (0, 1))
    assert np.mean([[1.0 if b > g else 0.5 if b == g else 0.0 for g in good] for b in bad]) > 0.9


def test_toxicity_edges(docs, empty):
    labels = docs.sparkSession.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, model)
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR rejected").count() == 0
    assert toxicity.score_toxicity(empty, model).count() == 0
    texts_ = [b"good day to all of you", b"you moron go away now", b"a fine text", b"moron it is"] * 20
    m = toxicity.train(texts_, np.array([0, 1, 0, 1] * 20))
    z = m.logits([b"some other good text", b"what a moron", b""])
    assert z[1] > z[0] and np.isfinite(z).all()


def test_toxicity_is_the_plain_forward_pass():
    rng, r = np.random.default_rng(3), random.Random(3)
    buckets, filters = 50, 3
    taps = [[rng.normal(size=(buckets, filters)).astype(np.float32) for _ in range(w)] for w in toxicity.WIDTHS]
    shift, out = [rng.normal(size=filters).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=filters * len(toxicity.WIDTHS))
    model = toxicity.Model(taps, shift, out, 0.25, {})
    vocab = ["Moron", "good", "day", "é", "x9", "superlongwordindeed", "ok"]
    some = ["", "  ", "moron", "Good day", *(" ".join(r.choices(vocab, k=n)) + "!" for n in (1, 2, 3, 4, 17, 400))]

    def rows(word):
        w = shared.Words([word], shared.ALNUM)
        return int(w.hashes()[0][0] % np.uint64(buckets)), int(w.hashes(toxicity.PREFIX)[1][0] % np.uint64(buckets))

    for text, z in zip(some, model.logits([t.encode() for t in some]), strict=True):
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
        ws = [rows(x) for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)]
        feats = []
        for tap, s, width in zip(taps, shift, toxicity.WIDTHS, strict=True):
            for f in range(filters):
                best = max((sum(tap[k][b, f] for k in range(width) for b in ws[p + k]) for p in range(len(ws) - width + 1)), default=0.0)
                feats.append(max(best + s[f], 0.0))
        assert z == pytest.approx(0.25 + float(np.dot(feats, out)), abs=1e-3)


def test_toxicity_learns_from_every_labelled_row(spark):
    """2,000 toxic rows in the order of a hash of their id hold one word, all others another."""
    ids = spark.range(3300).where(toxicity.fold(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id")
    toxic = [(r.id, "moron" if i < 2000 else "zork") for i, r in enumerate(ids.collect())]
    assert len(toxic) > 2500
    rows = [(i, f"a day with {w} in town {i % 7}", 1) for i, w in toxic] + [(i, f"a day with {'rain' if i % 2 else 'sun'} in town {i % 7}", 0) for i in range(4000, 6000)]
    df = spark.createDataFrame([(i, t, "en", y) for i, t, y in rows], "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    moron, zork, rain = model.scores([b"a day with moron in town 3", b"a day with zork in town 3", b"a day with rain in town 3"])
    assert moron >= 0.5 and zork >= 0.5 and rain < 0.5


def test_toxicity_shards(spark, monkeypatch):
    """Counts are those of all rows, one shard is plain training, and many shards don't depend on partitions."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        y = int(r.random() < 0.3)
        rows.append((i, None if i == 5 else "" if i == 6 else " ".join(r.choices(vocab[60 * y :][:140], k=r.randrange(1, 30))), "en" if i % 3 else None, y))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs, labels = df.drop("toxic"), df.select("doc_id", "toxic")
    table = toxicity.labelled(docs, labels).where("part <> 1")
    own = table.orderBy("place").collect()
    texts_, toxic = [(x.text or "").encode() for x in own], np.array([x.toxic for x in own])
    n, counts = np.bincount(toxic), np.zeros((2, toxicity.BUCKETS))
    for t, y in zip(texts_, toxic, strict=True):
        b = toxicity._buckets(shared.Words([t], shared.ALNUM, lower=True), toxicity.BUCKETS)
        for row in b:
            counts[y, np.unique(row)] += 1
    assert (toxicity._counted(table.withColumn("shard", F.lit(0)), 500) == counts).all()
    net = toxicity._start(counts, n, 4, 8, np.random.default_rng(7))
    toxicity._learn(net, toxicity._batches(texts_, toxic), n, toxicity.ROUNDS * toxicity.PASSES)
    size = sum(map(len, texts_))
    assert np.allclose(toxicity._trained(table, n, size).logits(texts_), net.model().logits(texts_), atol=1e-2)
    monkeypatch.setattr(toxicity, "SHARD_BYTES", size // 5)
    first, again = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7), labels.repartition(3))
    z = first.logits(texts_)
    assert (z == again.logits(texts_)).all() and first.thresholds == again.thresholds and set(first.thresholds) == {"en"}
    assert z[toxic == 1].mean() > z[toxic == 0].mean()
    out = toxicity.score_toxicity(docs, first).collect()
    assert all(x.rejected == (x.score >= first.thresholds.get(x.lang, 0.5)) for x in out)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return lambda name: tokenizers.Tokenizer.from_file(token_counts.tokenizer_path(name))


ODD = ["Hello, World!! don't I'LL it's. x.. 5. é. É, ok?!", "<|endoftext|>. foo<|ENDOFTEXT|> A.B.", "a b　 c.\x1c d", "''s. s' 's, 't.", "日本。 ok. ¡Hola!", "x" * 5000 + ". " + "y," * 50, "…., ?! -. İ. ß."]


def test_token_counts(docs, empty, library, tmp_path, monkeypatch):
    t = library("byte_bpe_50k.json")
    more = docs.union(docs.sparkSession.createDataFrame([(200 + i, x, "en", "s", 0, "c") for i, x in enumerate(ODD)], docs.schema))
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in pairs(more))
    cache = str(tmp_path / "cache")
    assert got(token_counts.token_counts(docs, cache)) == [w for w in want if w[0] < 200]
    before = docs.sparkSession.read.parquet(cache).count()
    assert before == len({x or "" for _, x in pairs(docs)})
    assert got(token_counts.token_counts(more, cache)) == want
    assert docs.sparkSession.read.parquet(cache).count() == before + len(ODD)
    assert token_counts.token_counts(empty, cache).count() == 0


def test_encoder_is_the_library(library):
    t, e = library("word_bpe_49k.json"), packing.Encoder("word_bpe_49k.json")
    some = [x or "" for x in texts()] + ODD
    for batch in (some, *[[x] for x in ODD]):
        assert [list(x) for x in e.encode([x.encode() for x in batch])] == [t.encode(x, add_special_tokens=False).ids for x in batch]


def check_packed(rows, docs, ids_of):
    by, seqs, padding = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, x in docs:
        want, at = [*ids_of(x or ""), 1], 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = np.array(want[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(part))
            at += r.length
        assert at == len(want)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
        padding += 0 if at & (at - 1) == 0 else packing.SEQUENCE - at
    return padding


def test_packing(docs, empty, library):
    t = library("word_bpe_49k.json")
    longer = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.repeat(F.concat("text", F.lit(" ")), 40)).otherwise(F.col("text")).alias("text"))
    assert check_packed(packing.pack(longer).collect(), pairs(longer), lambda x: t.encode(x, add_special_tokens=False).ids) == 0
    assert packing.pack(empty).count() == 0


def test_packer_keeps_few_windows():
    p, r = packing.Packer(0, False), random.Random(1)
    rows = []
    for d in range(3000):
        rows += p.add(d, np.arange(r.randrange(1, 5000), dtype=np.uint32))
        assert len(p.open) <= packing.OPEN and max(p.fill, default=0) < packing.SEQUENCE
    assert len(rows + p.end()) > 3000
    runs = sorted((1 << r.randrange(11) for _ in range(200)), reverse=True)
    seqs = collections.defaultdict(int)
    for (s, at), n in zip(packing.merged(runs), runs, strict=True):
        assert seqs[s] == at
        seqs[s] += n
    assert all(n == packing.SEQUENCE or n & (n - 1) == 0 for n in seqs.values())


def test_license_automata(spark, empty):
    a = license_scan.Automaton("licensed under [[the]] {{1-2}} public license")
    ok = lambda s: a.accepts(s.encode().split())
    assert ok("licensed under the gnu public license") and ok("licensed under gnu public license x") and ok("licensed under the new gnu public license")
    assert not ok("licensed under public license") and not ok("licensed under the a b c public license") and not ok("licensed under the gnu public")
    with pytest.raises(ValueError):
        license_scan.Automaton("[[one]] {{1-2}}")
    odd = (("opt", "[[dear]] [[old]] friend [[of]] mine"), ("rep", "{{1-2}} grants you {{0-1}} rights"), ("both", "[[the]] {{0-2}} author waives"))
    some = ["friend mine", "dear friend of mine", "old friend mine now", "friend of yours", "he grants you rights", "grants you rights", "she who grants you all rights", "grants you grants you two rights", "author waives", "the one and author waives", "a author waived"]
    plain = (("opt", r"(^| )(dear )?(old )?friend (of )?mine( |$)"), ("rep", r"(^| )([^ ]+ ){1,2}grants you ([^ ]+ )?rights( |$)"), ("both", r"(^| )(the )?([^ ]+ ){0,2}author waives( |$)"))
    out = license_scan.scan(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), (), odd).collect()
    assert {(r.doc_id, r.labels) for r in out} == {(i, ",".join(sorted(k for k, x in plain if re.search(x, t)))) for i, t in enumerate(some)}
    rows = [(1, None), (2, ""), (3, "Released UNDER the MIT-License. under the mit license"), (4, "Apache License, Version 2.0; CC BY/NC"), (5, "Licensed under the GNU General Public License, version 3"), (6, "under the mit"), (6, "é under é the mit license"), (7, "x " * 30000 + "cc by nc")]
    out = {(r.doc_id, r.n_words): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1, 0].labels == "" and out[1, 0].first_word is None and out[1, 0].score == 0
    r = out[3, 9]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 1, 5, "mit", "mit", 1.0)
    assert out[4, 8].base_labels == "apache-2,cc-by-nc" and out[5, 9].labels == "gpl-3" and out[5, 9].n_base == 0
    assert out[7, 30003].first_word == 30000 and out[6, 6].n_base == 0
    assert license_scan.scan(empty).count() == 0


def test_flac_round_trip(docs, empty):
    rng = np.random.default_rng(1)
    some = [flac.payload(t) for t in [b"", b"a", b"x" * 192, b"hello world " * 40, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes([0, 255] * 300), "é".encode() * 700, b"aaaa" * 47 + b"\xff\x00zz" * 30, b"q" * 192 * 2100 + b"z"]]
    media = flac.encode(some)
    for p, m, s in zip(some, media, flac.decode(media), strict=True):
        assert (s + 128).astype(np.uint8).tobytes() == p and len(p) % 192 == 0
        if len(p) < 10_000:
            assert (flac._plain(m) == s).all()
    last = flac.decode(media[-1:])[0]
    assert (flac.read_at(media[-1], 300_001, 777) == last[300_001:300_778]).all()
    for at in (-20, 90):
        bad = bytearray(media[4])
        bad[at] ^= 4
        with pytest.raises(flac.BadStream):
            flac.decode([bytes(bad)])
    stored = flac.to_media(docs).cache()
    by = {r.n_bytes: r.media for r in stored.collect()}
    back = flac.read_back(flac.in_blocks(stored, frames=2, carry=("n_bytes",)), carry=("n_bytes",)).collect()
    want = []
    for i, t in pairs(docs):
        p = flac.payload((t or "").encode())
        x = [b - 128 for b in p]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        told = f"mean={sum(x) / len(x):.4f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.4f};peak={max(map(abs, x))};turns={turns}"
        m = flac.encode([p])[0]
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), told))
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in back) == sorted(want)
    again = flac.read_back(flac.stored(docs), carry=("n_bytes",))
    assert got(again.select("doc_id", "n_bytes", "payload_sha256")) == sorted((w[0], w[1], w[3]) for w in want) and flac.stored(empty).count() == 0
    blocks = collections.defaultdict(dict)
    for r in flac.pcm_blocks(stored.dropDuplicates(["doc_id"]), frames=2).collect():
        assert r.sample_offset % 384 == 0 and r.n_samples == len(r.pcm) <= 384
        blocks[r.doc_id][r.sample_offset] = r.pcm
    assert {i: sum(map(len, x.values())) for i, x in blocks.items()} == {r.doc_id: r.payload_bytes for r in back}
    assert len(by) > 5 and flac.to_media(empty).count() == 0 and flac.read_back(flac.in_blocks(flac.to_media(empty))).count() == 0
    none = docs.sparkSession.createDataFrame([(1, None)], "doc_id long, media binary")
    assert flac.in_blocks(none).collect()[0].blocks == [] and flac.pcm_blocks(none).count() == 0
    assert flac.read_back(flac.in_blocks(none)).collect()[0].payload_bytes == 0


class Bits:
    """A frame as another writer would put it, bit by bit from the format's specification."""

    def __init__(self):
        self.s = ""

    def put(self, value, width):
        self.s += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.s += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        self.s += "0" * (-len(self.s) % 8)
        return int(self.s, 2).to_bytes(len(self.s) // 8, "big")


def crc(data, poly, bits):
    c = 0
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def foreign(samples, number, weights=None, shift=0, order=0, parts=0, k=2, escape=(), waste=0, wide=False):
    """One frame: a fixed (weights None) or linear predictor, 2**parts partitions, some of them escaped."""
    n, b = len(samples), Bits()
    for v, w in ((0x7FFC, 15), (0, 1), (7, 4), (0, 4), (0, 4), (1, 3), (0, 1), (number, 8), (n - 1, 16)):
        b.put(v, w)
    b.put(crc(b.bytes(), 0x07, 8), 8)
    x = [v >> waste for v in samples]
    b.put(0, 1)
    b.put(8 + order if weights is None else 31 + order, 6)
    b.put(1 if waste else 0, 1)
    if waste:
        b.s += "0" * (waste - 1) + "1"
    for v in x[:order]:
        b.put(v, 8 - waste)
    taps = weights if weights is not None else ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order]
    if weights is not None:
        b.put(11, 4)
        b.put(shift, 5)
        for w in weights:
            b.put(w, 12)
    res = [x[i] - (sum(w * x[i - 1 - j] for j, w in enumerate(taps)) >> shift) for i in range(order, n)]
    b.put(1 if wide else 0, 2)
    b.put(parts, 4)
    at = 0
    for p in range(1 << parts):
        m = (n >> parts) - (0 if p else order)
        some, at = res[at : at + m], at + m
        if p in escape:
            width = max((max(v, -v - 1).bit_length() + 1 for v in some), default=0)
            b.put((1 << (5 if wide else 4)) - 1, 5 if wide else 4)
            b.put(width, 5)
            for v in some:
                b.put(v, width)
        else:
            b.put(k, 5 if wide else 4)
            for v in some:
                b.rice(v, k)
    data = b.bytes()
    return data + crc(data, 0x8005, 16).to_bytes(2, "big")


def stream(frames, samples, block):
    md5 = hashlib.md5(bytes(v & 255 for v in samples)).digest()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + md5
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + b"".join(frames)


@pytest.mark.parametrize("block", [192, 256, 64])
def test_flac_of_another_writer(spark, block):
    r = random.Random(block)
    kinds = [
        {"order": 0, "parts": 2}, {"order": 1, "parts": 3, "k": 0}, {"order": 2, "escape": {0}}, {"order": 3, "parts": 1, "escape": {1}}, {"order": 4, "parts": 2, "wide": True},
        {"order": 2, "weights": [60, -20], "shift": 5}, {"order": 3, "weights": [40, -9, 3], "shift": 5, "parts": 2}, {"order": 4, "weights": [33, 2, -1, -3], "shift": 5, "k": 4},
        {"order": 8, "weights": [30, 1, -2, 3, -4, 5, -6, 7], "shift": 5, "parts": 2, "escape": {0, 3}, "wide": True}, {"order": 1, "waste": 2}, {"order": 2, "weights": [60, -20], "shift": 5, "waste": 1, "parts": 1},
    ]
    samples, frames, v = [], [], 0
    for i, kind in enumerate(kinds):
        own = []
        for _ in range(block):
            v = max(-100, min(100, v + r.randrange(-9, 10)))
            own.append(v >> kind.get("waste", 0) << kind.get("waste", 0))
        samples += own
        frames.append(foreign(own, i, **kind))
    data = stream(frames, samples, block)
    assert flac.decode([data])[0].tolist() == samples
    for at in range(0, len(samples), 77):
        assert flac.read_at(data, at, 50).tolist() == samples[at : at + 50]
    for cut in (3, 6, 20, 41, 60, len(data) - 1):
        with pytest.raises(flac.BadStream):
            flac.decode([data[:cut]])
    for at in r.sample(range(42, len(data)), 40):
        bad = bytearray(data)
        bad[at] ^= 1 << r.randrange(8)
        with pytest.raises(flac.BadStream):
            flac.decode([bytes(bad)])
    df = spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")
    got_pcm = b"".join(x.pcm for x in sorted(flac.pcm_blocks(df, frames=1).collect(), key=lambda x: x.sample_offset))
    assert np.frombuffer(got_pcm, dtype=np.int8).tolist() == samples


def test_sentencepiece(docs, empty):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    some = [x or "" for x in texts()] + ODD + ["  a  b ", "a\n\nb\tc  ", "日本語 ▁x", "𝒳 the   lowering"]
    c = sentencepiece_codec.Codec.load("piece_bpe_32k.model")
    ids = c.encode(some)
    assert ids == sp.encode(some)
    assert [c.decode(x) for x in ids] == [x.replace("▁", " ") for x in some]
    coded = sentencepiece_codec.encode_pieces(docs)
    assert sorted((r.doc_id, r.decoded) for r in sentencepiece_codec.decode_pieces(coded).collect()) == sorted((i, t or "") for i, t in pairs(docs))
    assert sentencepiece_codec.encode_pieces(empty).count() == 0


def test_unigram_viterbi_is_the_best_path():
    pieces = {p: (i, s) for i, (p, s) in enumerate({"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -2.2, "ba": -3.1, "bab": -3.0, "▁ab": -5.0}.items())}
    c = sentencepiece_codec.Codec(pieces, list(range(100, 356)), [p.encode() for p in pieces] + [b""] * 348, "unigram")

    def best(w):
        if not w:
            return 0.0, []
        return max((pieces[w[:k]][1] + s, [pieces[w[:k]][0], *t]) for k in range(1, len(w) + 1) if w[:k] in pieces for s, t in [best(w[k:])])

    for w in ("▁abab", "▁babba", "▁aabb", "▁b"):
        got_ids = c.encode([w[1:]])[0]
        assert sum(s for i in got_ids for j, s in pieces.values() if i == j) == pytest.approx(best(w)[0])


@have_tables
def test_pipeline(spark, library):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = shared.documents(spark, SF)
    kept = shared.written(corpus_pipeline.drop_toxic(spark, docs, SF))
    rows = pairs(kept)
    last = {t: max(i for i, x in rows if x == t) for _, t in rows}
    one = shared.written(corpus_pipeline.drop_copies(spark, kept, SF))
    assert sorted(i for i, _ in pairs(one)) == sorted(last.values())
    two = shared.written(corpus_pipeline.drop_near_copies(spark, one, SF))
    assert sorted(i for i, _ in pairs(two)) == [i for i, _, c, _ in brute_near(pairs(one), 5, 80) if i == c]
    three = shared.written(corpus_pipeline.cut_repeats(spark, two, SF))
    assert three.columns == docs.columns and three.count() == two.count()
    t = library("word_bpe_49k.json")
    assert check_packed(corpus_pipeline.run(spark, SF).collect(), pairs(three), lambda x: t.encode(x, add_special_tokens=False).ids) == 0
