"""Near-duplicates by Jaccard similarity against all pairs, and the pipeline's stage on real near copies."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.llm import jaccard
from trailforge.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def _shingles(text):
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(texts):
    """Least id by id, over all pairs."""
    sets = {d: _shingles(t or "") for d, t in texts.items()}
    head = {d: d for d in texts}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                p, q = sorted((find(a), find(b)))
                head[q] = p
    return {d: find(d) for d in ids}


def _edited():
    r = random.Random(4)
    common = " ".join(f"licence{i}" for i in range(40))
    out = {0: "", 1: None, 2: " \n", 3: "one two", 4: "ONE  two"}
    for base in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([8, 30, 120]))]
        for _ in range(8):
            own = list(words)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            out[len(out)] = " ".join(own) + (f"\n{common}" if base % 3 == 0 else "")
    return out


@pytest.mark.parametrize("sampled", [20_000, 1])
def test_every_pair_is_found(spark, monkeypatch, sampled):
    monkeypatch.setattr(jaccard, "SAMPLED", sampled)
    texts = _edited()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == _components(texts)
    assert {r.doc_id for r in jaccard.deduplicate(docs).collect()} == set(got.values())


def test_sketches_never_rule_out_alike_sets(spark):
    r = random.Random(9)
    rows = []
    for _ in range(300):
        n = r.choice([1, 5, 31, 33, 64, 300])
        a = {r.getrandbits(63) for _ in range(n)}
        b = set(list(a)[: r.randint(0, n)]) | {r.getrandbits(63) for _ in range(r.randint(0, n // 3 + 1))}
        if b and max(len(a), len(b)) <= 2 * min(len(a), len(b)):
            rows.append((len(a ^ b), *(jaccard.odd_sketch(np.array(sorted(x), np.int64)).tolist() for x in (a, b))))
    got = spark.createDataFrame(rows, "far int, a array<bigint>, b array<bigint>").select("far", jaccard._differing(F.col("a"), F.col("b")).alias("odd")).collect()
    assert len(got) > 100 and all(x.odd <= x.far and (x.far - x.odd) % 2 == 0 for x in got)


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == set(want.values())


def test_empty(spark):
    assert jaccard.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _jobs(spark, docs):
    sc = spark.sparkContext
    sc.setJobGroup("near", "near-duplicates")
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
        return got, len(sc.statusTracker().getJobIdsForGroup("near"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_few_edges_take_few_jobs_and_give_the_same_components(spark, monkeypatch):
    texts = _edited()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, jobs = _jobs(spark, docs)
    monkeypatch.setattr(jaccard, "FEW", 0)
    by_stars, more = _jobs(spark, docs)
    assert got == by_stars == _components(texts)
    assert jobs * 2 < more


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_chains_and_hubs(spark, few):
    r = random.Random(2)
    ids = [-(1 << 63), (1 << 63) - 1, *(r.getrandbits(63) - (1 << 62) for _ in range(300))]
    r.shuffle(ids)
    edges = [*zip(ids[:100], ids[1:101]), *((ids[101], x) for x in ids[102:200]), (ids[250], ids[250]), (ids[7], ids[3])]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {x.node: x.component for x in connected_components(frame, few=few).collect()}
    assert got == {x: min(part) for part in (ids[:101], ids[101:200]) for x in part}
