"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it again as the documents of the next stage.
Documents that the quality classifier rejects, repeated texts, near copies, and
documents that the mix doesn't take are gone for the stages after; what remains is
encoded. Repeats in the mix stand on rows of their own.

Null and empty texts are scored like others, are one text for exact dedup and near to
none; where they stay, the mix takes no words of them and they encode to no ids. Rows with a
null id are never labelled, lose to any id among equal texts, and are near to none. Repeated
rows are one after exact dedup; ties go to the largest id there and to the least in near
dedup. Very long texts need memory in proportion to themselves. Further columns, whatever
their names, pass through all stages but the last. Without labels every score is 0.5, so that
no document stays; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import exact_dedup, mixing, near_dedup, piece_tokens, quality
from wayline.llm.shared import shared_folder


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document with their number and digests."""
    return piece_tokens.digests(piece_tokens.stage(spark, docs, sf_dir))


STAGES = [
    ("quality", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("near dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the merge rounds; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
