"""A training corpus from `documents`, in five stages of the operators in fleetlog.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`, and any others that they are given, whatever
their names; a row whose id repeats or is null is a row of its own. Between two stages the rows are written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.llm import langid, mixing, path_join, piece_table, suffix_dedup
from fleetlog.llm.common import cut_table, packed, table, unpacked
from fleetlog.llm.queries import fold

MIX_FRACTION = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no learned language claims; the border is chosen on the learning folds, with each language left out in turn."""
    model = langid.fit(docs, F.coalesce(fold() != 2, F.lit(True)), judge=True)
    rest = docs.select("text", packed(docs, "text").alias("rest"))
    kept = langid.annotate(rest, model, judge=True).where("claimed")
    return unpacked(kept, docs.columns, "rest", text=F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once. Rows with a repeated id but different texts are different documents, and so are rows without an id."""
    return path_join.without_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out, with what is left of a split character. A document left without text goes; a null text comes back empty."""
    text = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    cut = F.col("n_removed") > 0
    cleaned = suffix_dedup.remove_repeats(docs, carry=tuple(c for c in docs.columns if c != "text")).withColumn("text", text)
    n_chars = F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("rest")["n_chars"])
    return unpacked(cleaned.where(~cut | (F.col("text") != "")), docs.columns, "rest", text=F.col("text"), n_chars=n_chars)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of MIX_FRACTION of the tokens, domains, languages and sources as even as supply allows; each document once at most."""
    return mixing.draw(docs, fraction=MIX_FRACTION)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document that is left."""
    return piece_table.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can't express the language model or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut_table(docs), sf_dir)
    return docs
