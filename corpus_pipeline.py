"""A corpus pipeline over the table documents.

Each stage works on all that the one before it kept and returns the columns of documents;
the last returns the packed pieces. Near-duplicates take five words and a similarity of 0.8.

Rows with a null id or text pass every filter (a null text is not toxic, repeats nothing and
holds no benchmark window) and are packed as empty texts. Of rows that repeat an id and its text
one stays; of ties within a group of near-duplicates the smallest id. Very long texts are worked
on whole. Other columns, whatever their names, pass through all stages but the last, which
doesn't read them. Empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm import decontaminate, neardup, packing, repeats, toxicity
from spectrafold.llm.common import materialize, packed, table, unpacked


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Rows with a null id
    stay; of rows that repeat an id and its text, one stays."""
    kept = neardup.near_duplicates(docs, shingle=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    rows = packed(docs, doc_id=F.col("doc_id"), t=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    one = rows.join(kept.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", "t").agg(F.first("row").alias("row"))
    return unpacked(one.select("row").unionAll(rows.filter("doc_id is null").select("row")), docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a document with a smaller id has; n_chars follows the text."""
    got = repeats.remove(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the words that benchmark windows cover."""
    got = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}-{name}")
    return docs
