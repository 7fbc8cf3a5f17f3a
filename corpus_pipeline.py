"""The corpus pipeline: documents to packed training sequences in five stages.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as Parquet
and read again as the docs of the next one. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import common, line_dedup, mixing, ngram_join, packing, toxicity
from graphlake.llm.queries import tokenizer_paths

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic; null text is scored as empty text and stays null."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay (`kept`), and its new number of characters; null text becomes empty."""
    out = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with its smallest doc_id, and one of the rows that repeat this id.

    Documents without words (null or empty text) stay, all of them.
    """
    return ngram_join.one_of_each(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per repetition that the mix takes of it, a partial one with its first words.

    Documents without words (null or empty text) are not taken. A null source is one of its own; rows that repeat a
    doc_id are rows of their own; an empty table gives an empty one.
    """
    return mixing.repeat(mixing.mix(docs, keep=("text", "lang")), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and a piece of one token. Repeated rows are packed as rows of their own; which of several pieces
    of one length goes where is left open. An empty table gives an empty one.
    """
    return packing.pack(packing.tokenize(docs, *tokenizer_paths()), packing.about_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Neither a trained classifier nor a tokenizer can be stated in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark) as path:
        for name, stage in STAGES[:-1]:
            docs = common.written(stage(spark, docs, sf_dir), f"{path}/{name}")
        return common.cut(STAGES[-1][1](spark, docs, sf_dir))
