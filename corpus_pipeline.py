"""A training-data pipeline over `documents`: language ID, exact dedup, near-dedup, mixing, packing.

Each stage is written as Parquet and read again before the next one starts. All but the last return the columns of `documents`.
It belongs to the subpackage waymark.llm and needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import stash, table
from waymark.llm.queries import exact_stage, language_stage, mixing_stage, near_stage, packing_stage

STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained network, the last a tokenizer: SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
