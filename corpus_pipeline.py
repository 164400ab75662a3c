"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

1. quality rules: documents that the base rules or the robust outlier test reject go,
2. n-gram Jaccard join: one document of each group of near-duplicates stays,
3. benchmark decontamination: documents that hold a test item go,
4. personal data: every span found is masked,
5. mixing: documents are sampled towards target weights of source, language and topic.

Every stage returns the columns of its input.  An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontamination, jaccard_join, mixing, pii, quality_rules
from tessella.tables import stored, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontamination", decontamination.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
]

#: The robust estimates and the trained tagger have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
