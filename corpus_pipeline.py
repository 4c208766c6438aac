"""A training corpus from documents: toxic ones go, then boilerplate lines, then near
duplicates; what stays is mixed to target weights and packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridwright.llm import linededup, mixing, packing, simhash, toxicity
from gridwright.llm.common import STASHED, stash, sweep


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the machine learns from the labels beside the documents.

    Null and wordless texts stay, repeated rows are judged alike, and without
    labels of both kinds all stay.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many different documents of its source have.

    A null text stays null, a null source is the source '', equal texts of a
    source count once, and a text that loses all its lines stays as an empty one.
    """
    return linededup.drop_boilerplate(docs, "text", "source", copies_once=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    Null and wordless texts are one group; rows are known by id and text; the row
    with the smallest id stays.
    """
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to half as often again.

    A null or wordless text is taken once an epoch, a null source is the source
    '', and a table without a word gives every row once.
    """
    return mixing.mixed(docs, mixing.Mix(max_repeats=1.5))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048 tokens at most, with their ids and their place in a sequence.

    A null or empty text is its end token alone; repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained machine and a tokenizer are no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's result is written and reread, and its scratch tables go.

    Odd rows are treated as the stages say; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = len(STASHED)
        docs = stash(stage(spark, docs, sf_dir), name)
        sweep(spark, made, keep=docs)
    return docs
