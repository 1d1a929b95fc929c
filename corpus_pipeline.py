"""From documents to packed training sequences.

Each stage takes the documents that the one before it kept, with their decisions applied: language identification
rejects texts that no model of a language fits, of each group of near duplicates one document stays, passages that are
found more than once are cut out of the texts, the mix takes each document as often as its source's target asks for, and
packing puts the tokens of what is taken into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import language, mixing, near, packing, repeats
from larder.llm.store import stored

#: Repeated strings of so many bytes are found first; together they must cover so many words. 50 words of prose are longer.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones of the input show; texts without a letter go."""
    return language.in_known_languages(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by 80 % common shingles of five words."""
    return near.deduplicated(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words that are found anywhere else."""
    return repeats.without_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 1.5 times all words, shared by sources at 5, 2, 1, at most twice each."""
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, limit=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Tokenizers and language models are beyond SQL; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage keeps is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
