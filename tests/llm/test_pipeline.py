"""The pipeline: each stage on its own input, and what is left at the end."""

import corpus_pipeline
from pyspark.sql import functions as F

from trailforge.llm import line_dedup, pii, toxicity

from test_jaccard import _components as all_pairs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        before, after = ({r.doc_id: r.text or "" for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
            assert set(before) - set(after) == bad
        elif name == "line_dedup":
            want = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
            assert all(after[d] == (want[d].text or "") for d in after)
            assert all(want[d].n_removed == want[d].n_lines > 0 for d in set(before) - set(after))
        elif name == "near_dedup":
            assert set(after) == set(all_pairs(before).values())  # 5-word shingles alike by 0.8 or more
        else:
            assert set(after) == set(before) and not any(pii.base_spans(t) for t in after.values())
        assert out.where(F.coalesce(F.length("text"), F.lit(0)) != F.col("n_chars")).count() == 0
        docs = out
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF)
    total = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert total.count() == docs.count() and total.where("n <> all").count() == 0


def test_empty(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
