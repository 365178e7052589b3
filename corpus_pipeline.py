"""A corpus from documents to packed sequences: each stage's decisions take effect on what the next one reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.llm import packing, pii, quality
from shardweave.llm.line_dedup import dedup_lines
from shardweave.llm.similar import row_hash, similar_rows
from shardweave.runtime import settle

THRESHOLD = 0.3


def _with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` as ``docs``, with its column ``text`` as the text and the length put right."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(F.col(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go; the classifier learns from the labelled ones. Null and empty texts are scored like others."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents hold stay in the largest doc_id alone. All documents stay, empty ones too."""
    return _with_text(docs, dedup_lines(docs), "__kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the smallest doc_id stays; decided for each row, so another text under a doc_id that goes stays. Of rows that repeat a doc_id, each text once. Rows without doc_id stay."""
    gone = similar_rows(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("row").alias("__row")).distinct()
    kept = docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (row_hash(docs["text"]) == gone["__row"]), "left_anti")
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id IS NULL"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found gives way to its kind in brackets."""
    return _with_text(docs, pii.mask(docs, "__masked"), "__masked")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near duplicates", near_stage), ("personal data", pii_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda d, stage: settle(stage[1](spark, d, sf_dir), "stage"), STAGES, docs)
