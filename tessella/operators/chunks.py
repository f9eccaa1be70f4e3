"""Long texts in chunks of paragraphs, with offsets into the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.segment import Language, check_options, segment

_BREAK = r"(?:\r?\n){2,}"


def chunks(df: DataFrame, text_col: str = "text", paragraphs: int = 1000) -> DataFrame:
    """One row per chunk: adds ``chunk``, ``chunk_start``, ``chunk_text`` and ``delim`` (of a chunk that a break closed).

    Each ``paragraphs``-th break closes a chunk and belongs to it. Blank texts have no chunk. The chunks of a text are
    found inside its row and then exploded, so no shuffle is needed.
    """
    if paragraphs < 1:
        raise ValueError("chunk_paragraphs must be at least 1")
    text = F.when(~F.rlike(F.col(text_col), F.lit(r"(?U)^[\s\x1c-\x1f]*\z")), F.col(text_col))
    df = df.withColumn("__t", text)
    df = df.withColumn("__p", F.split("__t", _BREAK, -1)).withColumn("__d", F.regexp_extract_all("__t", F.lit(_BREAK), F.lit(0)))
    n = F.size("__p")
    piece = lambda i: F.concat(F.get(F.col("__p"), i), F.coalesce(F.get(F.col("__d"), i), F.lit("")))
    last = lambda c: F.least((c + 1) * paragraphs, n) - 1
    made = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / paragraphs).cast("int")), lambda c: F.struct(
        F.array_join(F.transform(F.sequence(c * paragraphs, last(c)), piece), "").alias("text"),
        F.when((c + 1) * paragraphs < n, F.get(F.col("__d"), last(c))).when((c + 1) * paragraphs == n, F.get(F.col("__d"), last(c))).alias("delim")))
    df = df.withColumn("__c", F.when(F.col("__t").isNotNull(), F.filter(made, lambda x: F.length(x["text"]) > 0)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate("__c", zero, lambda a, x: F.struct((a["at"] + F.length(x["text"])).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    df = df.withColumn("__c", F.zip_with("__c", starts, lambda x, at: F.struct(x["text"].alias("text"), at.alias("at"), x["delim"].alias("delim"))))
    df = df.select("*", F.posexplode_outer("__c").alias("chunk", "__x")).where(F.col("chunk").isNotNull())
    return df.select("*", F.col("__x.at").alias("chunk_start"), F.col("__x.text").alias("chunk_text"), F.col("__x.delim").alias("delim")).drop("__t", "__p", "__d", "__c", "__x")


def segment_chunks(df: DataFrame, text_col: str = "text", language: Language = "en", clean: bool = False, doc_type: str = "", char_span: bool = False, paragraphs: int = 1000, out: str = "sentences") -> DataFrame:
    """``segment`` chunk by chunk; offsets are into the whole text, ``clean_start`` and ``clean_end`` into the chunk's.

    The last record of a chunk that a paragraph break closed carries that break.
    """
    check_options(language, clean, doc_type)
    df = segment(chunks(df, text_col, paragraphs).drop(text_col), "chunk_text", language, clean, doc_type, char_span, out)
    if char_span:
        size = F.size(out)

        def placed(x, i):
            delim = F.when(i == size - 1, F.coalesce("delim", F.lit(""))).otherwise(F.lit(""))
            return F.struct(x["sent"].alias("sent"), (x["start"] + F.col("chunk_start")).alias("start"), (x["end"] + F.col("chunk_start")).alias("end"), x["clean_start"].alias("clean_start"), x["clean_end"].alias("clean_end"), x["raw_slice"].alias("raw_slice"), delim.alias("trailing_delim"))

        df = df.withColumn(out, F.transform(out, placed))
    return df.drop("delim", "chunk_text")
