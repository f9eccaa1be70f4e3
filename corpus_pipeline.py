"""From raw documents to packed sequences: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact, langid, mixing, packing, simhash_wide
from tessella.llm.common import crc_mod, free_name, new_path, scratch, table, written

#: A document stays if a language is found with at least this posterior.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those whose language stays unsure.

    Equal texts stay or go together. An empty table stays empty; all columns pass through, whatever their names.
    """
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    lang, score = free_name(docs, "__lang_pred"), free_name(docs, "__lang_score")
    sure = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= SURE)
    return langid.annotate(docs, model, lang_out=lang, score_out=score).where(sure).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts (null ones count as empty); see ``exact.drop_copies`` for the odd cases."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, by SimHash: word shingles of five words, similarity 0.8 or more.

    Null ids stay; an empty table stays empty; see ``simhash_wide.drop_near_copies``.
    """
    return simhash_wide.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target asks; a repeated document is a repeated row.

    A null source is a source; texts without words are not taken; an empty table stays empty; see ``mixing.mix``.
    """
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences: one row per piece (a null text has one, the end id). An empty table gives none.

    Less memory for each worker than by default, as earlier stages' heap is still there.
    """
    return packing.pack(docs, memo=60_000, at_once=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", copies),
    ("simhash_dedup", near_copies),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Hashes and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables go when its own rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
    return docs
