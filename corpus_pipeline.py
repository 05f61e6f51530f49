"""From raw documents to packed windows, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from quillwing.llm import exact_dedup, langid, packing, simhash, substring_dedup
from quillwing.llm.common import written
from quillwing.llm.queries import documents, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, or whose language the network can't tell."""
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs, largest=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word similarity of 0.8 or more the document with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, shingle=5, least=Fraction(4, 5))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id has are cut; a text that loses none stays as it is. All documents stay."""
    return substring_dedup.remove_repeats(docs, chars_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


#: In this order; each gets what the one before wrote.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", passages),
    ("packing", packed),
]

#: SQL can't express the network, the similar texts' components or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
