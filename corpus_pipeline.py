"""From documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.common import shared_dir, table
from leafmill.llm.lines import line_stage
from leafmill.llm.packing import packing_stage
from leafmill.llm.pii import redact
from leafmill.llm.quality import quality_stage
from leafmill.llm.simhash import one_of_each

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", one_of_each),
    ("PII", redact),
    ("best-fit packing", packing_stage),
]

#: The fingerprint and packing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
