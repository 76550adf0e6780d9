"""The corpus pipeline's stages keep the documents' columns, and their decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert decontaminate.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").count() == 0
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
