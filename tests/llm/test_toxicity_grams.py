"""Toxicity with more grams than are broadcast: the same scores, with none pruned."""

from trailforge.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_scores_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, "x"), (-5, "", None), (-6, "12 34", "y")], docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = lambda df: sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.lang or "", r.held_out, r.predicted, round(r.score, 9)) for r in df.collect()))
    want = rows(toxicity.with_scores(docs, labels))
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 100)
    got = toxicity.with_scores(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "score", "held_out", "predicted"]
    assert rows(got) == want and len({x[-1] for x in want}) > 10


def test_ratios_of_words_by_joins(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    tables = toxicity._tables(toxicity._learned(docs.where("text is not null"), labels.where("toxic is not null")))
    words = sorted({w for r in docs.limit(30).collect() for w in toxicity.words_of(r.text or "")}) + ["zzqqxxyyzz", "\u00e9\u4e2d\U00010400"]
    got = {r.word: r for r in toxicity._word_ratios(spark.createDataFrame([(w,) for w in words], "word string"), *tables).collect()}
    counts = toxicity._arrays(*tables)
    for fold in ("", "0", "1"):
        want = toxicity.Ratio(toxicity._model(counts, fold)).words(words)
        assert all(abs(got[w]["r" + fold] - x) < 1e-9 for w, x in zip(words, want, strict=True))
