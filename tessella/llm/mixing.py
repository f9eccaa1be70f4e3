"""Mixing sources to target weights by nested hash-threshold histograms; DataFrame operations only.

Each source has a budget of words. Its documents fall into size classes (powers of two), each with its share of the
budget. A class takes documents below a threshold of a hash of the id: sums by hash bucket show the bucket where the
budget ends, and only that bucket is opened into finer ones, ten bits at a time, until it holds one hash. So nothing is
sorted, and a source of any size costs a histogram. Documents at the ends of the classes' budgets, one a class, share
what is left over, the larger ones first, and a second round among the documents that still fit uses up most of the rest;
so what a source misses does not grow with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import if_small, n_words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
_BITS, _STEP = 60, 10


def _key(source: Column) -> Column:
    """Sources as strings that sort by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """Per row: id, source key, size, size class (-1: no words), hash of 60 bits; ``more``: further columns."""
    size = n_words(F.col(text_col).cast("string"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col)), 64 - _BITS)
    out = docs.select(*more, F.col(id_col).cast("long").alias("__id"), _key(F.col(source_col)).alias("__key"), size.alias("__size"), h.alias("__h"))
    return out.withColumn("__cls", F.when(F.col("__size") > 0, F.length(F.bin("__size")) - 1).otherwise(-1))


def _ranked(totals: DataFrame) -> DataFrame:
    """Adds the place of each key in the order of all, without bringing all keys to one task."""
    ranged = written(totals.repartitionByRange("__key").withColumn("__part", F.spark_partition_id()), "mix-sources")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", before)  # one row per range
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy("__key")) - 1
    return ranged.join(parts, "__part").withColumn("__rank", place).drop("__part", "__n", "__before")


def cells(rows: DataFrame) -> DataFrame:
    """The first histogram: per key, class and bucket of the first bits ``__b`` its words ``__s`` and its ends ``__lo, __hi``.

    Small, as all tables here that come of it: they are written, since a written table is read in few tasks and its size
    is known, where a checkpoint keeps a task for each partition, full or empty.
    """
    return written(_sums(rows.withColumn("__b", F.shiftrightunsigned("__h", _BITS - _STEP)), "__key", "__cls", "__b"), "mix-cells")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("__size").alias("__s"), F.min("__h").alias("__lo"), F.max("__h").alias("__hi"))


def targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source key of ``cells``: ``__total`` words, ``__target`` words."""
    totals = histogram.groupBy("__key").agg(F.sum("__s").alias("__total"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    sources = written(_ranked(totals).select("__key", "__total", weight.alias("__w"), (F.col("__total") * most).alias("__cap")), "mix-weights")
    want = share * (sources.agg(F.sum("__total")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level only rises, and each round fills a source or is the last
        capped = F.col("__cap") <= F.lit(level) * F.col("__w")
        n, used, free = sources.agg(F.coalesce(F.sum(capped.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(capped, F.col("__total"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("__w"))), F.lit(0.0))).first()
        if n == full or not free:
            break
        level, full = (want - most * used) / free, n
    return sources.select("__key", "__total", F.least(F.col("__cap"), F.lit(level) * F.col("__w")).alias("__target"))


def fill(rows: DataFrame, histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """Chooses rows, of which ``histogram`` has the ``cells``, for the ``__budget`` words of each key, at most once each.

    Returns per key and class the hash below which rows are taken and the hash (null: none) at the end of the class's
    budget that is taken too: ``__thr, __also``; and the words that are left over for the key: ``__left``.
    """
    rows, histogram = rows.where("__cls >= 0"), histogram.where("__cls >= 0")
    budgets = budgets.select("__key", "__budget")
    classes = histogram.groupBy("__key", "__cls").agg(F.sum("__s").alias("__class_total"))
    totals = histogram.groupBy("__key").agg(F.sum("__s").alias("__all"))
    share = F.least(F.lit(1.0), F.col("__budget") / F.col("__all")) * F.col("__class_total")
    state = classes.join(totals, "__key").join(budgets, "__key").select("__key", "__cls", share.alias("__share"), F.lit(0).cast("long").alias("__below"))
    sums = histogram.join(state, ["__key", "__cls"])
    fixed, depth = None, 0
    mine = Window.partitionBy("__key", "__cls")
    while True:
        depth += _STEP
        if depth > _STEP:  # rows of the buckets that the last round left open: their prefix is part of the join's key
            held = rows.withColumn("__pre", F.shiftrightunsigned("__h", _BITS - depth + _STEP)).join(state, ["__key", "__cls", "__pre"])
            sums = _sums(held.withColumn("__b", F.shiftrightunsigned("__h", _BITS - depth)), "__key", "__cls", "__b", "__share", "__below")
        sums = sums.withColumn("__upto", F.col("__below") + F.sum("__s").over(mine.orderBy("__b")))
        end = F.min(F.when(F.col("__upto") > F.col("__share"), F.col("__b")))
        found = (
            sums.withColumn("__end", end.over(mine))
            .where("__b = __end or __end is null")
            .groupBy("__key", "__cls", "__share", "__end")
            .agg(F.max(F.when(F.col("__end").isNull(), F.col("__upto")).otherwise(F.col("__upto") - F.col("__s"))).alias("__below"), F.max("__s").alias("__s"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        )
        found = written(found, "mix-found")
        done = found.where("__end is null or __lo = __hi").select(
            "__key", "__cls", "__below", F.when(F.col("__end").isNull(), F.lit(1 << _BITS)).otherwise(F.shiftleft("__end", _BITS - depth)).alias("__thr"),
            F.when(F.col("__end").isNotNull(), F.col("__lo")).alias("__unit_h"), F.when(F.col("__end").isNotNull(), F.col("__s")).alias("__unit"))
        fixed = done if fixed is None else fixed.unionByName(done)
        state = found.where("__end is not null and __lo != __hi").select("__key", "__cls", "__share", F.col("__end").alias("__pre"), "__below")
        if depth >= _BITS or not state.limit(1).count():
            break
    # what stands at the ends: at most one hash a class, so at most 63 a key are gathered; the larger ones choose first
    ends = fixed.groupBy("__key").agg(F.sum("__below").alias("__sum"), F.sort_array(F.collect_list(F.when(F.col("__unit").isNotNull(), F.struct("__unit", "__cls"))), asc=False).alias("__ends"))
    ends = ends.join(budgets, "__key").withColumn("__left", F.col("__budget") - F.col("__sum"))
    start = F.struct(F.col("__left").alias("left"), F.array().cast("array<int>").alias("took"))
    step = lambda s, x: F.when(x["__unit"] <= s["left"], F.struct((s["left"] - x["__unit"]).alias("left"), F.concat(s["took"], F.array(x["__cls"].cast("int"))).alias("took"))).otherwise(s)
    took = ends.select("__key", F.aggregate("__ends", start, step).alias("__t")).select("__key", F.col("__t.took").alias("__took"), F.col("__t.left").alias("__left"))
    also = F.when(F.array_contains("__took", F.col("__cls").cast("int")), F.col("__unit_h")).alias("__also")
    return written(fixed.join(took, "__key").select("__key", "__cls", "__thr", also, "__left"), "mix-filled")


def _once(thr: str, also: str) -> Column:
    return F.coalesce(F.col("__h") < F.col(thr), F.lit(False)) | F.coalesce(F.col("__h") == F.col(also), F.lit(False))


def _copies() -> Column:
    once = _once("__thr", "__also") | ((F.col("__size") <= F.coalesce("__left", F.lit(0.0))) & _once("__thr2", "__also2"))
    return (F.col("__whole") + F.when(once, F.lit(1)).otherwise(F.lit(0))).cast("int")


def decisions(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source key and size class all that a row needs to know how often it is taken; a few rows a source.

    Words that the first round leaves over go to a second one, among documents that fit and were not yet taken.
    """
    histogram = cells(rows)
    wanted = targets(histogram, weights, share, most)
    whole = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(0).cast("long")
    wanted = written(wanted.withColumn("__whole", whole).withColumn("__budget", F.col("__target") - F.col("__whole") * F.col("__total")), "mix-wanted")
    first = fill(rows, histogram, wanted)
    left = first.groupBy("__key").agg(F.first("__left").alias("__left"))
    rest = rows.join(first, ["__key", "__cls"]).where(~_once("__thr", "__also") & (F.col("__size") <= F.col("__left"))).select(*rows.columns)
    second = fill(rest, cells(rest), left.withColumnRenamed("__left", "__budget"))
    second = second.select("__key", "__cls", F.col("__thr").alias("__thr2"), F.col("__also").alias("__also2"))
    known = histogram.select("__key", "__cls").distinct().join(wanted.drop("__budget"), "__key")
    first = first.drop("__left")
    return written(known.join(first, ["__key", "__cls"], "left").join(left, "__key", "left").join(second, ["__key", "__cls"], "left"), "mix-decided")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A document is taken whole, 0 to ``most`` times; taken counts its words once for each time. Documents without words
    (null text too) are taken 0 times. A null source is a source of its own, last in order. Repeated and null ids share a
    hash, so at the end of a budget they go or stay together. An empty table gives no rows.
    """
    rows = written(_rows(docs, id_col, source_col, text_col), "mix-rows")
    placed = rows.join(if_small(decisions(rows, weights, share, most)), ["__key", "__cls"])
    return placed.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__total").cast("long").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * _copies()).cast("long").alias("taken"), _copies().alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns whatever their names, each as often as it is taken (see ``mix``).

    Documents without words (null and empty texts) are not in the mix. An empty table gives no rows.
    """
    rows = written(_rows(docs, id_col, source_col, text_col), "mix-rows")
    full = _rows(docs, id_col, source_col, text_col, F.struct(*docs.columns).alias("__row"))
    placed = full.join(if_small(decisions(rows, weights, share, most)), ["__key", "__cls"]).withColumn("__times", F.when(F.col("__size") > 0, _copies()).otherwise(0))
    return placed.where("__times > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__each")).select("__row.*")
