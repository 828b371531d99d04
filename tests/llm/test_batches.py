"""The Arrow batches that the pipeline's stages take."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F


def test_stages_take_small_batches(spark):
    """Long texts do not come by thousands into one batch."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 10000).alias("text")).coalesce(1)
    corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count()
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 40e6 and max(r.n for r in sizes) < 8 << 20
