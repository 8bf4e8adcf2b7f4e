"""A corpus from raw documents to token ids, in five stages.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes each result as Parquet in the folder that
``spark.checkpoint.dir`` names and reads it back as the next stage's documents, so
that a stage never recomputes what stands before it. When a stage is written, its
intermediate tables and what the stage before wrote are deleted.

1. quality: lines that fail a rule go; documents that fail the base rules or lose
   too much text go.
2. line_dedup: lines repeated across documents stay only where they come first. A
   document that loses all its lines stays, with an empty text.
3. near_duplicates: of each group of near duplicates the smallest id stays; rows
   that share an id and a group are all kept or all dropped. Empty texts are linked
   with nothing and stay.
4. decontaminate: documents that overlap a benchmark item go.
5. encode: token ids of every remaining text.

All stages but the last return the columns of ``documents``; where a stage changes
a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import decontam, jaccard, linedup, quality, spiece
from murmura.llm.common import table
from murmura.session import release, remove, scratch_count, scratch_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.deduplicated_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spiece.encode_column(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: SQL can't express the encoding; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    home, before = scratch_dir(spark, "pipeline"), None
    mark = scratch_count()
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        release(spark, mark)
        if before:
            remove(spark, f"{home}/{before}")
        before = name
    return docs
