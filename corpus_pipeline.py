"""A training corpus from raw documents, stage by stage.

Each stage works on all rows its predecessor kept; its result is written as
Parquet in the shared folder and read again as the next one's input. All but
the last return the columns of ``documents``; the last returns the packed
pieces. The stages' parameters are those of production use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costlens.llm import decontaminate, jaccard, packing, personal, quality
from costlens.llm.common import default_tokenizer, materialise, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filter_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8 or more) one stays."""
    return jaccard.keep_one(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.filter_documents(docs, read_table(spark, sf_dir, "benchmark"))


def contextual_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return personal.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left is packed into sequences."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("contextual_pii", contextual_pii),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisation and expectation-maximisation are beyond SQL; tests compare the
#: operators with brute-force versions instead.
ORACLE_SQL = None
