"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import decontaminate, edit_join, setsketch, sp_tokenizer, toxicity
from flowlens.llm.queries import SP_MODEL, table, tokenizer
from flowlens.llm.tables import keep
from flowlens.session import tune


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of documents still here, scores below 0.5."""
    return toxicity.drop_toxic(docs, table(tune(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has, give or take two edits; n_chars follows the text."""
    return edit_join.drop_repeated_lines(docs, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return setsketch.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, and whether these agree with the original library and decode to the text."""
    return sp_tokenizer.encode(docs, tokenizer(SP_MODEL)).drop("text")


STAGES = [("toxicity", non_toxic), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", clean_of_benchmark),
          ("sentencepiece", tokenize)]
ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written below the shared folder and read again."""
    docs = table(tune(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
