"""Documents to sentences: the whole pipeline as one narrow chain of projections."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import FLAGS, Steps, gateway
from tessella.functions.languages import Profile, profile
from tessella.functions.sentinels import ELLIPSIS_SPACE, END, unmask
from tessella.operators import cleaning, masking, offsets
from tessella.operators.lists import mask_lists
from tessella.operators.splitting import split

Language = str | Profile | None
_BLANK = r"(?U)^[\s\x1c-\x1f]*\z"


def check_options(language: Language, clean: bool, doc_type: str) -> Profile | None:
    """Errors come when the plan is built, not when it runs."""
    if doc_type == "pdf" and not clean:
        raise ValueError("doc_type='pdf' requires `clean=True`: joining PDF lines is a part of cleaning")
    return profile(language)


def disambiguate(df: DataFrame, col: str, language: Language = None) -> DataFrame:
    """Adds ``__masked`` (same length as the text) and ``__spans`` (trimmed sentences of the masked text)."""
    p = profile(language)
    df = masking.flags(df, col).withColumn("__masked", F.col(col))
    df = mask_lists(df, "__masked")
    df = masking.mask_abbreviations(df, "__masked", p)
    df = masking.mask_rest(df, "__masked", p)
    return split(df.drop(*masking.FLAG_COLUMNS), "__masked", p)


def segment(df: DataFrame, text_col: str = "text", language: Language = "en", clean: bool = False, doc_type: str = "", char_span: bool = False, out: str = "sentences") -> DataFrame:
    """Adds the array ``out``: sentences, or with ``char_span`` their records with offsets into the raw text.

    Null and blank texts have an empty array. A record's ``sent`` runs on over the white space after it.
    """
    return _chain(gateway(), text_col, check_options(language, clean, doc_type), clean, doc_type, char_span, out).on(df)


@lru_cache(maxsize=128)
def _chain(jvm: int, text_col: str, p: Profile | None, clean: bool, doc_type: str, char_span: bool, out: str) -> Steps:
    """All projections of one set of options."""
    text = F.when(~F.rlike(F.col(text_col), F.lit(_BLANK)), F.col(text_col))
    df = Steps().withColumn("__text", text)
    if clean and char_span:
        df = offsets.clean_with_map(df, "__text", "__target", p, doc_type)
    else:
        df = df.withColumn("__target", F.col("__text"))
        if clean:
            df = cleaning.clean(df, "__target", p, doc_type)
    df = disambiguate(df.withColumn("__target", F.when(~F.rlike("__target", F.lit(_BLANK)), F.col("__target"))), "__target", p)
    if char_span:
        df = _records(df, clean).withColumnRenamed("__records", out)
    else:
        df = df.withColumn(out, F.transform("__spans", lambda s: unmask(s["sent"])))
    return df.drop("__text", "__target", "__masked", "__spans", "__map")


def _records(df: DataFrame, mapped: bool) -> DataFrame:
    blank = FLAGS + rf"^[\s\x1c-\x1f{ELLIPSIS_SPACE}{END}]+"
    after = lambda i: F.coalesce(F.get(F.col("__spans"), i + 1)["start"], F.length("__target"))

    def reach(s, i):
        gap = F.substring(F.col("__target"), s["end"] + 1, after(i) - s["end"])
        return F.struct(s["start"].alias("a"), (s["end"] + F.length(F.regexp_extract(gap, blank, 0))).alias("b"))

    df = df.withColumn("__reach", F.transform("__spans", reach))
    raw = (lambda k: offsets.to_raw(F.col("__map"), k)) if mapped else (lambda k: k)
    df = df.withColumn("__raw", F.transform("__reach", lambda s: F.struct(raw(s["a"]).alias("a"), F.greatest(raw(s["a"]), raw(s["b"])).alias("b"))))

    def record(s, r):
        return F.struct(
            F.translate(unmask(F.substring(F.col("__target"), s["a"] + 1, s["b"] - s["a"])), "\r", "\n").alias("sent"),
            r["a"].alias("start"),
            r["b"].alias("end"),
            s["a"].alias("clean_start"),
            s["b"].alias("clean_end"),
            F.substring(F.col("__text"), r["a"] + 1, r["b"] - r["a"]).alias("raw_slice"),
            F.lit("").alias("trailing_delim"),
        )

    return df.withColumn("__records", F.zip_with("__reach", "__raw", record)).drop("__reach", "__raw")


def by_language(df: DataFrame, lang_col: str, languages: list[str], otherwise: Language = None, **options) -> DataFrame:
    """``segment`` with each row's own language. One branch per language: the filter is pushed into the scan."""
    known = F.col(lang_col).isin(languages)
    parts = [segment(df.where(F.col(lang_col) == code), language=code, **options) for code in languages]
    parts.append(segment(df.where(~F.coalesce(known, F.lit(False))), language=otherwise, **options))
    return reduce(DataFrame.unionByName, parts)


def sentences(df: DataFrame, *keep: str, array: str = "sentences") -> DataFrame:
    """One row per sentence: the kept columns, ``sent_id`` from 0, and ``sent`` or the record's fields.

    The outer form and a filter above it: of the plain form Spark infers a filter on the array, which it would push down
    through every stage, writing each stage's expression into it.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias("sent_id", "sent")).where(F.col("sent_id").isNotNull())
    if out.schema["sent"].dataType.typeName() == "struct":
        return out.withColumnRenamed("sent", "__r").select(*keep, "sent_id", "__r.*")
    return out
