"""Very long texts: megabytes in one row, with and without white space, twice each, beside short ones."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, licenses, lm, omh, shards, simhash, toxicity, warc
from strandloom.llm.common import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    words = [f"w{r.randrange(20_000)}" for _ in range(250_000)]
    long = " ".join(words)
    return [(0, long), (1, long), (2, "x" * 1_000_000), (3, "x" * 1_000_000), (4, " \n" * 500_000), (5, "short text of its own"), (6, "é " * 300_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_near_duplicates(docs):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found[1] == found[0] == 0 and found[3] == found[2] == 2 and found[5] == 5
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, 2, 4, 5, 6}


def test_scores(docs, spark):
    got = {r.doc_id: r for r in lm.score(docs, spark.createDataFrame([(0,)], "doc_id long")).collect()}
    assert got[0].n_tokens == 250_000 and got[4].n_tokens == 0 and got[0].background_loss == pytest.approx(got[1].background_loss)
    model = toxicity.Model([("w123", False)])
    assert toxicity.score(docs, model).count() == len(got)


def test_licenses(spark):
    text = "lorem " * 200_000 + "MIT License " + "ipsum " * 200_000
    r = licenses.summary(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (400_002, 1, 200_000, "mit")


def test_tokens(docs, rows):
    got = {r.doc_id: r for r in bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert {i: bytes(r.decoded) for i, r in got.items()} == {i: t.encode() for i, t in rows}
    folder = Scratch(docs.sparkSession, "t").path("shards")
    index = shards.write(docs, folder, 3, VOCABULARY, public_tokenizers.PATTERN, length=1024, rows=64)
    assert sum(r.n_tokens for r in index.collect()) == sum(r.n_tokens for r in got.values()) + len(rows)


def test_benchmark_passages(docs, spark, rows):
    words = rows[0][1].split(" ")
    items = spark.createDataFrame([(7, " ".join(words[200_000:200_080])), (8, "x" * 1_000_000), (9, "é " * 40)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(0, 7, 200_000), (1, 7, 200_000), (2, 8, 0), (3, 8, 0), (6, 9, 0)}


def test_order_minhash(spark, rows):
    frame = spark.createDataFrame([(i, t) for i, t in rows if i in (2, 3, 5)] + [(8, " ".join(rows[0][1].split(" ")[:40_000]))], "doc_id long, text string")
    got = {r.doc_id: r for r in omh.edited_fingerprints(frame).collect()}
    assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1.0 and got[8].n_chars > 200_000


def test_archive(spark):
    body = "<p>" + "y" * 4_000_000
    folder = Scratch(spark, "t").path("archive")
    warc.write(spark.createDataFrame([(1, "u", body), (2, "v", body), (3, "w", None)], "page_id long, url string, html string"), folder)
    got = {r.id: r for r in warc.summary(warc.read(spark, folder)).collect()}
    assert got[2].refers_to == 1 and got[2].payload_digest == got[1].payload_digest == hashlib.sha256(body.encode()).hexdigest() and got[3].payload_bytes == 0
    assert spark.read.parquet(f"{folder}/payloads").agg(F.count("*")).first()[0] == 2
