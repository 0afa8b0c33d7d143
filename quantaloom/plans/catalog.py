"""All registered queries, and the flagship one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantaloom.operators import assign, cohesion, metrics
from quantaloom.plans import (  # noqa: F401
    code_queries,
    record_queries,
    text_queries,
    training_queries,
    vector_queries,
)
from quantaloom.plans.base import ORACLE, QUERIES, two_level_codebook, vectors  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual codes of every vector, then collision, coverage, bucket sizes and cohesion per level."""
    coded = assign.encode(vectors(spark, sf_dir), two_level_codebook(spark, sf_dir))
    sims = cohesion.bucket_cosine(coded.select("idx", "embedding", "codes"), levels=2)
    return metrics.summarize(coded.select("codes"), views=(1, 2), cosine=sims)
