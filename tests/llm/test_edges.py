"""Null ids, null cells, repeated rows, one very long text and clashing columns, for every operator and stage."""

import os

import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, flac, license_scan, minhash_dedup, packing, sentencepiece_codec, substring_dedup, token_counts, toxicity, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAME = " ".join(f"w{i}" for i in range(30))
ROWS = [(None, None), (None, SAME), (7, None), (7, ""), (5, SAME), (5, SAME), (6, SAME + " end"), (9, "ab " * 60000), (10, "y" * 100000)]
CLASH = ("id", "digest", "size", "band", "comp", "n_bytes", "n_tokens", "start", "length", "score", "kept", "group_size", "chunk", "sig", "payload", "version", "piece")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in ("lang", "source", *CLASH)), F.lit(None).cast("long").alias("n_chars")).cache()


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: -1 if x is None else x)


WANT = sorted((i for i, _ in ROWS), key=lambda x: -1 if x is None else x)


def test_urls(spark):
    rows = spark.createDataFrame([(None, None, None), (1, "http://a.net/es/", "p"), (1, "http://a.net/es/", "p"), (2, "http://" + "h" * 50000 + "/x", None)], "page_id long, url string, path string")
    out = url_filter.filter_urls(rows, url_filter.train(url_filter.labelled(spark))).collect()
    assert len(out) == 4 and [r.rule for r in out if r.page_id == 1] == ["net/es/"] * 2
    assert all(r.verdict in ("allow", "block") for r in out)


def test_copies(odd):
    out = exact_dedup.exact_dedup(odd)
    assert ids(out) == WANT
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()}
    assert {(None, 7, 3, False), (7, 7, 3, True), (None, 5, 3, False), (5, 5, 3, True), (9, 9, 1, True)} <= got


def test_near_copies(odd):
    out = minhash_dedup.near_duplicates(odd)
    assert ids(out) == WANT
    got = {(r.doc_id, r.component_id, r.kept) for r in out.collect()}
    assert got == {(None, None, True), (5, 5, True), (6, 5, False), (7, 7, True), (9, 9, True), (10, 10, True)}


def test_passages(odd):
    out = substring_dedup.substring_dedup(odd)
    assert ids(out) == WANT
    got = {(r.doc_id, r.n_words, r.n_removed) for r in out.collect()}
    assert {(None, 30, 0), (None, 0, 0), (5, 30, 30), (6, 31, 30), (9, 60000, 0), (10, 1, 0)} <= got


def test_scores(odd):
    model = toxicity.fit(odd, odd.sparkSession.createDataFrame([(5, 1), (6, 0), (None, 1), (9, None)], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(odd, model)
    assert ids(out) == WANT and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_counts_and_pieces(odd, tmp_path):
    pytest.importorskip("tokenizers")
    out = token_counts.token_counts(odd, str(tmp_path / "cache"))
    assert ids(out) == WANT and out.where("doc_id = 7 AND n_tokens <> 0").count() == 0
    coded = sentencepiece_codec.encode_pieces(odd)
    assert ids(coded) == WANT
    assert sorted(r.decoded for r in sentencepiece_codec.decode_pieces(coded).collect()) == sorted(t or "" for _, t in ROWS)


def test_packed(odd):
    rows = packing.pack(odd).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows if r.start == 0) == [-1 if i is None else i for i in WANT]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_licenses_and_media(odd):
    assert ids(license_scan.scan(odd)) == WANT
    back = flac.read_back(flac.in_blocks(flac.to_media(odd)))
    assert ids(back) == WANT and back.where("payload_bytes % 192 <> 0").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                assert (out.count() > 0) == (docs is odd)
            else:
                assert out.columns == corpus_pipeline.COLUMNS and set(ids(out)) <= set(WANT)


def test_pcm_blocks_refuse_wide_samples(spark):
    good = flac.encode([flac.payload(b"some text")])[0]
    wide = bytearray(good)
    wide[21] |= 0xF0  # STREAMINFO now says 16 bits
    assert flac.stream_info(good).bits == 8 and flac.stream_info(bytes(wide)).bits == 16
    blocks = lambda m: flac.pcm_blocks(spark.createDataFrame([(1, m)], "doc_id long, media binary")).collect()
    assert [bytes(x + 128 & 255 for x in b.pcm).rstrip() for b in blocks(bytearray(good))] == [b"some text"]
    with pytest.raises(Exception, match="more than 8 bits"):
        blocks(wide)
