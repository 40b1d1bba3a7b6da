"""Every registered document query: names, types and rows; the pipeline stage by stage against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import bpe, registry, toxicity

SMALL = "/root/testdata/sf0.001"

#: The columns that a query has to return, and of which table it has a row for each row.
CONTRACT = {
    "op1_simhash_near_dedup": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op2_lm_scoring": ("documents", "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"),
    "op3_license_scan": ("documents", "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"),
    "op4_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op5_warc": ("pages", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op6_byte_bpe": ("documents", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "op7_training_shards": (None, "slot bigint, shard int, row int, n_tokens int, doc_ids array<bigint>, sha256 string"),
    "op8_url_filter": ("pages", "page_id bigint, host string, path string, rule string, verdict string, reputation double"),
    "op9_benchmark_decontamination": (None, "doc_id bigint, item_id bigint, first_word bigint, similarity double, distance int"),
    "op10_order_minhash": ("documents", "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"),
}


def test_all_ten_are_registered():
    assert set(registry.queries()) == set(CONTRACT)


@pytest.mark.parametrize("name", CONTRACT)
def test_names_types_and_rows(spark, name):
    table, columns = CONTRACT[name]
    out = registry.queries()[name](spark, SMALL)
    kinds = dict(out.dtypes)
    for column in columns.split(", "):
        n, kind = column.split(" ", 1)
        assert kinds[n] == kind, column
    rows = out.collect()
    if table:
        key = "page_id" if table == "pages" else "doc_id"
        want = spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()
        assert Counter(r[key] for r in rows) == Counter(r[key] for r in want)
        for r in rows:
            for n in ("score", "near_edited", "near_next"):
                assert n not in kinds or name == "op2_lm_scoring" or 0 <= r[n] <= 1
    else:
        assert rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_returns_the_same(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    out = registry.queries()[name](spark, SMALL)
    columns = sorted(out.columns)
    want = con.sql(registry.oracle_sql()[name]).project(", ".join(columns)).fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in out.collect()) == Counter(want)


def shingles(words, k=5):
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    table = {r.doc_id: r.text for r in docs.collect()}
    assert len(table) == docs.count()
    kept = [(None, docs)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1][1], SMALL).cache()
        kept.append((name, out))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for _, df in kept]
    for _, df in kept[:-1]:
        assert df.schema == docs.schema

    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(~toxicity.held_out())
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert ids[1] == {i for i in ids[0] if scores[i] < 0.5}

    sets = {i: set(shingles(re.findall(r"[^\x20\x09-\x0d]+", lower(table[i])))) for i in ids[1]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids[2] == {i for i in sets if root[i] == i}

    items = [re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        every = Counter(shingles(w))
        for item in items:
            if not item or not w:
                continue
            b = Counter(shingles(item))
            n = len(shingles(w[: len(item)]))
            if sum(c for s, c in every.items() if s in b) < 0.8 / 1.8 * (n + b.total()):
                continue  # no window can have enough of the item
            for at in range(max(1, len(w) - len(item) + 1)):
                a = Counter(shingles(w[at : at + len(item)]))
                if (a & b).total() >= 0.8 * (a | b).total():
                    return True
        return False

    assert ids[3] == {i for i in ids[2] if not leaks(table[i])}

    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = kept[4][1].collect()
    assert {r.doc_id for r in last} == ids[3] and len(last) == len(ids[3])
    for r in last:
        assert own.decode_bytes(memoryview(bytes(r.ids)).cast("I").tolist()) == (table[r.doc_id] or "").encode()
        assert memoryview(bytes(r.ids)).cast("I").tolist() == own.encode_ordinary(table[r.doc_id] or "")
        assert r.decoded_sha256 == hashlib.sha256((table[r.doc_id] or "").encode()).hexdigest()


def test_pipeline_of_awkward_rows(spark):
    """Nulls in any column, empty texts, repeated rows, an id of two texts and an empty table go through every stage."""
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, "a text of its own that nobody else has written", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id but words", "en", "s", 5), (4, "twice the same row here", "en", "s", 5), (4, "twice the same row here", "en", "s", 5), (4, "another text under the same id", "en", "s", 5)]
    for given, want in ((rows, {(1, rows[0][1]), (2, None), (None, rows[3][1]), (4, rows[4][1]), (4, rows[6][1])}), ([], set())):
        docs = spark.createDataFrame(given, schema)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMALL).cache()
            if n == 2:
                assert {(r.doc_id, r.text) for r in docs.collect()} == want and docs.count() == len(want)
        assert docs.count() == len(want)
