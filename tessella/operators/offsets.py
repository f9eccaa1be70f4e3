"""Offset maps: from places in cleaned text back to places in the raw text.

A map is ``struct<keys: array<struct<key, delta>>, raw_length, clean_length>``. A place adds the delta of the last key at
or before it (none: 0), within the raw length. Each cleaning rule composes its own edits with the map so far.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import flagged, let
from tessella.functions.languages import Profile
from tessella.operators.cleaning import Edit, edits

_KEYS = "array<struct<key:int,delta:int>>"


def _delta(keys: Column, at: Column) -> Column:
    """As-of lookup: the delta of the largest key that is not beyond ``at``."""
    return F.coalesce(F.array_max(F.filter(keys, lambda k: k["key"] <= at))["delta"], F.lit(0))


def _raw(keys: Column, length: Column, at: Column) -> Column:
    return F.least(at + _delta(keys, at), length)


def identity(length: Column) -> Column:
    return F.struct(F.array().cast(_KEYS).alias("keys"), length.alias("raw_length"), length.alias("clean_length"))


def to_raw(offset_map: Column, at: Column) -> Column:
    return _raw(offset_map["keys"], offset_map["raw_length"], at)


def span_to_raw(offset_map: Column, start: Column, end: Column) -> Column:
    a = to_raw(offset_map, start)
    return F.struct(a.alias("start"), F.greatest(a, to_raw(offset_map, end)).alias("end"))


def _follow(df: DataFrame, text: str, edit: Edit) -> DataFrame:
    """One rule over the text and its keys ``__keys``; rows without a match pass unchanged."""
    p = flagged(edit.pattern)
    c = F.col(text)
    there = F.rlike(c, F.lit(p)) if edit.has is None else c.contains(edit.has) & F.rlike(c, F.lit(p))
    df = df.withColumn("__m", F.when(there, F.regexp_extract_all(c, F.lit(p), F.lit(0))))
    df = df.withColumn("__g", F.when(F.col("__m").isNotNull(), F.split(c, p, -1)))
    df = df.withColumn("__r", F.transform("__m", edit.of))
    sizes = F.zip_with(F.zip_with("__g", "__m", lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), "__r", lambda x, r: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.length(r).alias("r")))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("o"), F.array().cast("array<struct<s:int,e:int,o:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s, o = acc["i"] + x["g"], acc["o"] + x["g"] + x["r"]
        return F.struct((s + x["m"]).alias("i"), o.alias("o"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["m"]).alias("e"), o.alias("o")))).alias("out"))

    df = df.withColumn("__e", F.when(F.col("__m").isNotNull(), F.aggregate(F.filter(sizes, lambda x: x["m"].isNotNull()), zero, step, lambda acc: acc["out"])))
    old, ends, length = F.col("__keys"), F.col("__e"), F.col("__raw_length")
    # a key inside a replaced range goes, one outside moves with the text before it
    outside = F.filter(old, lambda k: ~F.exists(ends, lambda x: (k["key"] > x["s"]) & (k["key"] <= x["e"])))

    def moved(k: Column) -> Column:
        before = F.array_max(F.filter(ends, lambda x: x["e"] < k["key"]))
        now = k["key"] + F.coalesce(before["o"] - before["e"], F.lit(0))
        return F.struct(now.alias("key"), F.lit(0).alias("turn"), (_raw(old, length, k["key"]) - now).alias("delta"))

    new = F.transform(ends, lambda x: F.struct(x["o"].alias("key"), F.lit(1).alias("turn"), (_raw(old, length, x["e"]) - x["o"]).alias("delta")))
    df = df.withColumn("__n", F.when(ends.isNotNull(), F.array_sort(F.concat(F.transform(outside, moved), new))))
    # of equal keys the last counts; a key that changes nothing goes
    last = lambda x, i: ~F.coalesce(F.get(F.col("__n"), i + 1)["key"] == x["key"], F.lit(False))
    df = df.withColumn("__n", F.filter("__n", last))
    news = lambda x, i: (i == 0) | ~F.coalesce(F.get(F.col("__n"), i - 1)["delta"] == x["delta"], F.lit(False))
    kept = F.transform(F.filter("__n", news), lambda x: F.struct(x["key"].alias("key"), x["delta"].alias("delta")))
    joined = F.array_join(F.zip_with("__g", "__r", lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    done = F.col("__m").isNotNull()
    df = df.withColumns({"__keys": F.when(done, kept).otherwise(old), text: F.when(done, joined).otherwise(c)})
    return df.drop("__m", "__g", "__r", "__e", "__n")


def clean_with_map(df: DataFrame, text_col: str, out: str, profile: Profile | None = None, doc_type: str = "", custom: Iterable[tuple[str, str]] = (), map_col: str = "__map") -> DataFrame:
    """Adds the cleaned text and its offset map. Null text: both null."""
    df = df.withColumns({out: F.col(text_col), "__keys": F.array().cast(_KEYS), "__raw_length": F.length(text_col)})
    for edit in edits(profile, doc_type, custom):
        df = _follow(df, out, edit)
    made = F.struct(F.col("__keys").alias("keys"), F.col("__raw_length").alias("raw_length"), F.length(out).alias("clean_length"))
    return df.withColumn(map_col, F.when(F.col(out).isNotNull(), made)).drop("__keys", "__raw_length")


def places(offset_map: Column, at: Column) -> Column:
    """Raw places of an array of cleaned places."""
    return let(offset_map, lambda m: F.transform(at, lambda k: to_raw(m, k)))
