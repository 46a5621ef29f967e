"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Null and repeated ids: language identification, line dedup and decontamination judge rows by their text alone; near-dedup keeps one
row of each component, the one with the smallest id (null last); a null text stays null; packing treats each row by itself. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import Scratch
from skarn.llm.crf_langid import predict, train
from skarn.llm.latent_decontam import decontaminate
from skarn.llm.line_runs import dedup_lines
from skarn.llm.packing import pack
from skarn.llm.queries import tokenizer_path
from skarn.llm.set_copies import drop_copies

#: Texts whose best mean posterior is below this are in no known language; texts in two languages reach 0.38 to 0.5 and stay.
LEAST_SCORE = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with extra columns under names that no operator writes, and the way back."""
    names = {c: c if c in ("doc_id", "text", "lang", "source", "n_chars") else f"extra {i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in one of the known languages."""
    plain, back = _plain(docs)
    labelled = predict(plain, train(plain))
    return labelled.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more hold from all of them; every document stays."""
    plain, back = _plain(docs)
    kept = dedup_lines(plain).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    return drop_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also in other words."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 tokens; small sources get more of a window than they have of the corpus."""
    return pack(docs, tokenizer_path(), temper=0.7).select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

#: No SQL: neither the language model, the fingerprints nor the tokens can be computed by it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if len(scratch.paths) > 1:
            scratch.drop(scratch.paths[-2])  # the stage before is read no more
    return docs
