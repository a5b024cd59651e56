"""A corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, then the mix.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept. All but the last return the columns of
documents. run() writes each stage's rows as Parquet to the shared folder and reads them again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, mixing, secrets, toxicity
from logloom.llm.common import free_names, load, shared_folder
from logloom.llm.copies import near_copies


#: Bytes and rows of texts that go to a Python worker at once; Spark's own bounds would hold tens of MB in each of several buffers.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 250


def bounded_batches(spark: SparkSession) -> None:
    """Makes the session send texts to Python workers in small batches, unless it has smaller ones."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) < most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def hashable(docs: DataFrame) -> list[Column]:
    """The columns of docs, those with maps as JSON, which have no hash otherwise."""
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. The model learns from these documents and from labels of rows not held out.

    Null and empty texts get the score of no words, so they stay; long texts are scored whole; rows that repeat are judged alike. An empty table stays empty,
    and without toxic labels all stay. Columns of any name pass through.
    """
    bounded_batches(spark)
    model = toxicity.train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.where(toxicity.score_column(F.col("text"), model) < 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows connected by near copies: five-word shingles, 0.8 or more of them shared.

    It is the row with the smallest doc_id, null being the largest, and of rows that share that, the one whose hash is
    least; equal rows are one. Rows go only because of their group: a doc_id that is null or repeated takes none with it.
    Texts without words are one group; long texts are compared whole; an empty table stays empty; columns of any name pass through.
    """
    bounded_batches(spark)
    (key,), whole = free_names(docs.columns, "head"), hashable(docs)
    row = F.struct(F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole))
    groups = near_copies(docs, row, width=5, similarity=0.8)
    heads = groups.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head")).select(F.col("head.row").alias(key))
    return docs.withColumn(key, row).join(heads, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts have none; long texts are searched whole; rows that repeat are
    judged alike; an empty table, of documents or of items, removes nothing. Columns of any name pass through."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in text replaced by a mark; null and empty texts, repeated rows and other columns stay as they are."""
    bounded_batches(spark)
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with size, source_size, target, taken and drawn, the blocks taken.

    A column of docs that is named like one of these keeps its name; the new one is then written with a trailing _.
    """
    return mixing.mixed_rows(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_filter),
    ("secret scans", secret_redaction),
    ("source mixing", source_mix),
]

#: SQL expresses neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs, folder = load(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
