"""The corpus pipeline: quality rules, toxicity, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; every stage but the
last returns the columns of `documents`. Stages are written as Parquet in the shared folder and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.lineage import cut
from strandgraph.llm import jaccard_join, log_templates, packing, quality, queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough text without their host's boilerplate lines."""
    return _measured(quality.keep(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by a model learnt from the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score_documents(docs.select(COLUMNS), model).filter("score < 0.5").drop("score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates."""
    return _measured(log_templates.drop_recurring(docs, **log_templates.RULE))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents left."""
    return queries.packed(docs)


STAGES = [
    ("quality rules", quality_stage), ("toxicity", toxicity_stage), ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage), ("best-fit packing", packing_stage),
]

#: The toxicity model and the tokenizer cannot be expressed in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
