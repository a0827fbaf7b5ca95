"""A corpus pipeline: quality, repeated lines, near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. Every stage works on all that its predecessor kept. Null texts count as empty, null ids as the largest,
a null source as a source of its own; rows repeated alike share the fate of one. An empty table stays empty. Columns
beyond those of ``documents`` pass through, whatever their names, but for names that begin with ``__kt_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm import line_dedup, mixing, near_dedup, packing, quality
from kinetrace.llm.common import P, drop_stored, stored, tables
from kinetrace.llm.queries import tokenizer_path

#: Ids of documents to drop that are sent to every task, at most (some 20 bytes each); more meet in a shuffle.
MAX_SENT = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, scores at 0.3 or more.

    A document without a word is scored as any other; without a usable label all score 0.5 and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.scored(docs, quality.fit(docs, labels), out=P + "score")
    return out.where(F.col(P + "score") >= quality.CUT).drop(P + "score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of a smaller id has; ``n_chars`` follows the text.

    A document that loses all its lines stays with an empty text, as one with a null text does.
    """
    out = line_dedup.dedup_lines(docs).withColumn("text", F.col(P + "kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id, with all rows of that id.

    Documents without a word, and rows without an id, are in no group and stay.
    """
    with tables(spark) as keep:
        gone = near_dedup.near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias(P + "gone")).distinct()
        gone = stored(gone, "gone")
        keep(gone)
    sent = F.broadcast(gone) if gone.count() <= MAX_SENT else gone
    return docs.join(sent, docs["doc_id"] == gone[P + "gone"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken several times is as many rows, one without words may be taken or not."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens; a text without a word is one token."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither the classifier nor the tokeniser can be said in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with tables(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
