"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark
decontamination and packing, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, packing, quality, shared, substrings, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_key"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go. Null and empty
    texts have too few words and go; repeated rows stay or go together."""
    judged = quality.quality(docs, [tokens.default_path("piece_bpe_32k.model")])
    rejected = judged.where("NOT kept").select(F.col("key").alias("row_key")).distinct()
    return _keyed(docs).join(rejected, "row_key", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at 0.8 on five-word n-grams the one of smallest
    doc_id stays, once; texts without words are alone and stay."""
    found = jaccard.groups(docs, NEAR_SHINGLE, NEAR_PERCENT)
    gone = found.where("component_id < doc_id").select(F.col("key").alias("row_key")).distinct()
    kept = _keyed(docs).join(gone, "row_key", "left_anti")
    # rows that repeat a doc_id with equal words are one document
    return kept.dropDuplicates(["row_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that stand earlier go; a text that loses words is what is left,
    joined by single blanks, and goes if nothing is left. Other texts stay as they are."""
    cut = substrings.remove_repeats(docs).where("n_removed > 0")
    cut = cut.select(F.col("key").alias("row_key"), F.lit(True).alias("is_cut"), F.col("kept_text")).dropDuplicates(["row_key"])
    rows = _keyed(docs).join(cut, "row_key", "left").where("is_cut IS NULL OR kept_text <> ''")
    text = F.when(F.col("is_cut"), F.col("kept_text")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("is_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("contaminated").select(F.col("key").alias("row_key")).distinct()
    return _keyed(docs).join(gone, "row_key", "left_anti").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of 4096 tokens at the sources' own proportions."""
    return packing.pack(docs, tokens.default_path("word_bpe_49k.json")).withColumnRenamed("n", "length")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: tokenisers and fertility are not expressible in SQL; tests compare with a brute-force version
ORACLE_SQL = None
