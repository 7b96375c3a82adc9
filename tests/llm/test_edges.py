"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trailforge.llm import byte_bpe, chat, line_dedup, multiset_hash, packing, pii, secrets, simhash, topk, toxicity

BIG = (1 << 60) + 1
LONG = "a word of text 12 " * 20_000
COPY = "one line of words that is long enough to count as a passage of text " * 5
ROWS = [(1, "Hello there", 1), (2, None, 0), (3, "", 1), (BIG, LONG, None), (5, COPY, 0), (6, COPY, 1), (6, COPY, 1), (None, "no id 4111111111111111", 0)]
SCHEMA = "doc_id bigint, text string, score int, predicted string, fp int, component_id string, n_lines string, seq int, secrets string, held_out int, name string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "c", "n", 2, "s", 0, "m") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


ALL_IDS = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert ids(rows) == ALL_IDS
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == by[3].fp == 0 and by[2].component_id == by[3].component_id == 2
    assert by[6].component_id == 5 and by[BIG].component_id == BIG and by[None].component_id is None
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, BIG, 5, None}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, WORDS).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3)] == [(1, 1)] * 2
    assert sum(r.length for r in rows if r.doc_id == BIG) == next(r.doc_tokens for r in rows if r.doc_id == BIG)
    assert sum(r.start == 0 for r in rows if r.doc_id == 6) == 2
    assert packing.pack(empty, WORDS).count() == 0


def test_byte_bpe(docs, empty):
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert ids(rows) == ALL_IDS
    assert sorted((r.doc_id or 0, bytes(r.data)) for r in rows) == sorted((i or 0, (t or "").encode()) for i, t, _ in ROWS)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pii(docs, empty):
    rows = pii.find_pii(docs).collect()
    assert ids(rows) == ALL_IDS
    by = {r.doc_id: r for r in rows}
    assert by[None].spans == "card:6:22" and by[2].spans == by[3].spans == by[BIG].spans == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[None] == "no id [CARD]" and texts[2] is None and texts[3] == "" and texts[BIG] == LONG
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0


def test_multiset_hash(docs, empty):
    rows = multiset_hash.compare_edits(docs).collect()
    assert ids(rows) == ALL_IDS
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint and by[2].near_next == 1.0
    assert by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0
    assert by[BIG].n_chars == len(LONG)
    assert multiset_hash.compare_edits(empty).count() == 0
    one = multiset_hash.compare_edits(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_line_dedup(docs, empty):
    rows = line_dedup.dedup_lines(docs).collect()
    assert ids(rows) == ALL_IDS
    by = {r.doc_id: r for r in rows}
    assert by[6].text == "" and by[6].n_removed == 1 and by[6].removed_runs == "0-0"
    assert by[5].text == COPY and by[2].text is None and by[3].text == "" and by[2].n_lines == 0
    assert by[BIG].text == LONG
    assert line_dedup.dedup_lines(empty).count() == 0


def test_secrets(docs, empty):
    rows = secrets.scan(docs).collect()
    assert ids(rows) == ALL_IDS and all(r.secrets == [] for r in rows)
    assert secrets.scan(empty).count() == 0
    assert secrets.redact(docs).columns == docs.columns


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (5, None, 0), (5, 0, 2), (BIG, 0, 2), (77, 1, 1)], "doc_id bigint, toxic int, text int")
    rows = toxicity.score(docs, labels).collect()
    assert ids(rows) == ALL_IDS and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    wide = toxicity.with_scores(docs, labels)
    assert set(wide.columns) == set(docs.columns)
    assert toxicity.score(empty, labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.where("false")).collect()} == {0.5}


def test_topk(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1)).withColumn("rank", F.lit("r"))
    got = {}
    for r in topk.top_k(df, k=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 7, 327680), (2, 8, 327680)] or sorted(got[0])[0][1] == 7
    assert 100 not in got
    assert topk.top_k(df.where("false")).count() == 0


def test_chat(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (None, 0, "assistant", "x</turn>\n### \\"), (1, None, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_turns(chat.gather_turns(df)).select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    by = {r.conv_id: r for r in out}
    assert [(t.role, t.text) for t in by[1].t] == [("user", "b"), ("user", "b"), ("", "")]
    assert [(t.role, t.text) for t in by[None].t] == [("assistant", "x</turn>\n### \\")] and by[None].l == "x</turn>\n### \\"
    assert chat.gather_turns(df.where("false")).count() == 0
