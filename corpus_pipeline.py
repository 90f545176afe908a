"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: documents that the pattern grammar rejects go;
2. line dedup: lines that repeat earlier ones go; a document that had words and has none
   left goes with them;
3. n-gram Jaccard join: of each class of near copies the first document stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece: the texts are encoded and decoded; the ids are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camwatch.llm.common import drop, written
from camwatch.llm.decontam import decontaminate
from camwatch.llm.line_dedup import dedup_lines
from camwatch.llm.ngram_jaccard import keep_first
from camwatch.llm.toxicity import fit_on, score_texts
from camwatch.llm.unigram import encode_decode

#: Score from which a document is rejected.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is TOXIC or more. Null and empty texts score low and stay, rows with a null id too."""
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model).filter(f"score < {TOXIC}").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines at least 80 % like earlier ones; a document that had words and has none left goes. Null texts and ids stay as they are."""
    emptied = (F.col("n_removed") > 0) & (F.btrim("text", F.lit(" \n")) == "")
    return dedup_lines(docs).filter(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by 80 % of their five-word shingles the one with the smallest id. Texts without words are like nothing; null ids stay."""
    return keep_first(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold 80 % of a benchmark item's five-word shingles (a shorter item's only one). Null texts and ids stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids and whether these decode to the text. A null text has none."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids_out=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: SQL can express neither the grammar nor the encoding; the stages and run() are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; any stage's empty input gives an empty result.

    Each stage's table is deleted once the next one is written, and so is what a stage
    writes on the way. The last stage is one pass over its table and needn't be written.
    """
    docs = before = None
    for _, stage in STAGES[:-1]:
        docs = written(stage, spark, spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs, sf_dir)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
