"""A corpus pipeline out of the corpus operators: language, near duplicates, benchmark passages, source mix, token ids.

Each stage takes the rows that its predecessor kept, judges all of them and returns the columns of documents, the last one the
index of the token files. The benchmark comes from sf_dir, everything else from the documents at hand.

Defined results: a null or empty text, or one without letters, has no language and goes in the first stage, whatever its other columns
are; null lang, source and n_chars are values like others (null is a source of its own); very long texts are judged whole; of rows
that repeat a doc_id one stays, of a group of near duplicates the one with the smallest doc_id, and a row without doc_id stays, as it has no
group; ties of sizes and equal rows are interchangeable, so that reruns agree; empty tables give no rows; extra columns are carried
through all stages but the last, whatever their names. The mix repeats a document as often as words of it are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import decontaminate, langid, mixing, near_dedup, token_store
from vertexloom.llm.common import packed, table, unpacked, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those that language ID rejects go."""
    judged = langid.identified(packed(docs, "text"), langid.fit(docs))
    return judged.where("not rejected").select(*unpacked(docs.columns, ("text",)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return near_dedup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each time that words of a document are taken."""
    return mixing.mixed_documents(docs, held=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 of every row."""
    return token_store.report(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the language models, the draws of the mix or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, as the stages' own input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
