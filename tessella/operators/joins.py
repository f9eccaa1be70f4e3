"""Relational forms of what the text stages do inside a row: as-of lookups, lexicon joins, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], slices: Column | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its group whose ``on`` is not later.

    One union and one window: both sides are sorted once by group and place, and no range join pairs them up. Without an
    earlier row the columns are null. Of right rows at the same place the one with the greatest values counts.

    ``slices`` is made of ``on`` alone and never falls as ``on`` grows, such as its day. A group is then sorted slice by
    slice, in as many tasks, so one key may hold a third of all rows; a slice starts with the last right row before it,
    found by one aggregation, combined before its shuffle. The rows are the same.
    """
    marked = lambda df, cols, turn: df.select(*by, on, F.lit(turn).alias("__turn"), *cols)
    rest = [c for c in left.columns if c not in (*by, on)]
    right_rows = marked(right, [*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], F.struct(*take).alias("__r")], 0)
    left_rows = marked(left, [*rest, F.lit(None).cast(right.select(F.struct(*take).alias("r")).schema["r"].dataType).alias("__r")], 1)
    both, parts = right_rows.unionByName(left_rows), list(by)
    if slices is not None:
        both, parts = both.withColumn("__slice", slices), [*by, "__slice"]
        last = F.max(F.when(F.col("__turn") == 0, F.struct(F.col(on).alias("at"), "__r")))
        before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*parts).agg(last.alias("__x")).withColumn("__x", F.max("__x").over(before)).where("__x IS NOT NULL")
        carried = carried.select(*parts, F.col("__x.at").alias(on), F.lit(0).alias("__turn"), F.col("__x.__r").alias("__r"))
        both = both.unionByName(carried, allowMissingColumns=True)
    order = Window.partitionBy(*parts).orderBy(on, "__turn", "__r").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.last("__r", ignorenulls=True).over(order))
    return both.where("__turn = 1").select(*left.columns, *[F.col("__last")[c].alias(c) for c in take])


def in_lexicon(tokens: DataFrame, word: str, lexicon: DataFrame, entry: str, keep: bool = True, most: int = 100_000) -> DataFrame:
    """Rows whose lower-cased word is (``keep``) or is not an entry: a semi or anti join.

    The word list is counted, and broadcast if it has at most ``most`` entries; a larger one joins by a shuffle.
    """
    words = lexicon.select(F.col(entry).alias("__entry")).distinct()
    words = F.broadcast(words) if words.limit(most + 1).count() <= most else words
    return tokens.join(words, F.lower(word) == F.col("__entry"), "left_semi" if keep else "left_anti")


def islands(rows: DataFrame, by: list[str], order: str, opens: Column, start: str, end: str) -> DataFrame:
    """Merges each row that opens nothing into the row before it; a group's first row always opens."""
    w = Window.partitionBy(*by).orderBy(order)
    flag = F.when(opens | (F.row_number().over(w) == 1), 1).otherwise(0)
    numbered = rows.withColumn("__open", flag).withColumn("__island", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, F.col("__island").cast("int").alias("island")).agg(F.min(start).alias(start), F.max(end).alias(end))
