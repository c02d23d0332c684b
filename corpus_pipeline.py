"""A training corpus from raw documents: judged, deduplicated, decontaminated, cleaned of secrets, and mixed.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last returns the draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm.common import cut, keep_last, made
from sigloom.llm.decontaminate import drop_leaks
from sigloom.llm.mixing import mix_sources
from sigloom.llm.ngram_join import keep_one
from sigloom.llm.quality import keep_good
from sigloom.llm.secret_scan import redact


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Each row is judged by its text alone: repeated rows stay or go together, null and empty texts are
    judged as texts of no characters, an empty table stays empty, and all columns pass through."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity 0.8), that of the smallest doc_id, a null one
    last. Repeated rows are copies; null and wordless texts are in no group and all stay; an empty table stays empty; all columns pass through."""
    return keep_one(docs, words=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their doc_id, null or repeated. Null and empty texts stay, an empty table stays
    empty, an empty benchmark drops nothing, and all columns pass through."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and what is linked with them are replaced in the texts, n_chars is brought up to date. Every row stays, repeated ones too; null
    and empty texts and all other columns stay as they are."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draw: documents by pass, in the sources' weights. Repeated rows are drawn as separate documents, a null source is one source,
    null and empty texts cost nothing, and an empty table gives an empty draw."""
    return mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
]

#: The stages learn, hash and walk: SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage wrote on its way goes as soon as the next one's input is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        keep_last(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
