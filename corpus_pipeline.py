"""From documents to token ids, in five stages; each is written and read again by the next.

1. language: documents whose language is unknown go.
2. near_duplicates: one document of each group of near copies stays.
3. passages: words of passages that occur before go; what is left empty goes.
4. mixing: documents are taken by source up to the mix's targets, whole and up to three times, and
   sorted by training position.
5. token_ids: byte-level BPE ids of each text, with digests of the ids and of the decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm import byte_bpe, jaccard, language, mixing, passages
from ledgerlink.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digests of op10."""
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.round_trip(docs["text"], path, vocabularies.PATTERN)
    coded = docs.select("doc_id", "lang", "source", both.alias("coded")).select("doc_id", "lang", "source", "coded.ids", "coded.decoded")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("passages", repeated_passages),
    ("mixing", mixed_sources),
    ("token_ids", token_ids),
]

#: SQL can express neither the language model nor the tokenizer; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every one but the last is written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
