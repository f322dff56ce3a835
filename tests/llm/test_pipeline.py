from pyspark.sql import functions as F

import corpus_pipeline as P
from pairfold.llm import decontam, neardup, quality, secrets
from pairfold.llm.common import id_remainder


def test_stages_do_what_their_operators_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = docs
    for name, stage in P.STAGES:
        out = P.stored(stage(spark, kept, folder))
        before, after = ids(kept), ids(out)
        assert after <= before and out.count() == len(after), name
        assert out.columns[: len(columns)] == columns
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").where(id_remainder("doc_id", 3) != 1))
            assert after == {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
        elif name == "near-duplicates":
            assert after == {r["class_id"] for r in neardup.near_duplicates(kept).collect()}
        elif name == "benchmark decontamination":
            assert after == ids(decontam.find_matches(kept, spark.read.parquet(f"{folder}/benchmark.parquet")).where("not contaminated"))
        else:
            assert after == before
        if name == "secret scan":
            old = {r["doc_id"]: r["text"] for r in kept.collect()}
            for r in out.collect():
                assert r["text"] == secrets.redact(old[r["doc_id"]], "[SECRET]") and r["n_chars"] == len(r["text"])
        if name != "source mixing":
            assert out.columns == columns
        kept = out
    whole = P.run(spark, folder)
    assert {tuple(r) for r in whole.select("doc_id", "text", "mix_copies").collect()} == {tuple(r) for r in kept.select("doc_id", "text", "mix_copies").collect()}
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs.limit(0).withColumn("n_chars", F.col("n_chars")), folder).count() == 0
