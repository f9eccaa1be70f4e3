"""SimHash near-dedup by multi-index hashing.

Two fingerprints of 64 bits within ``r`` bits of each other are within floor(r/2) bits in the upper half or within
ceil(r/2) - 1 in the lower half. So each half is a table of keys; a fingerprint visits the keys of a small Hamming ball
around its own half, and a complete comparison verifies what it meets. Of the two ends of a pair only that with the
smaller key walks to the other. Identical fingerprints are one row from the start.

A key that more than ``crowd`` fingerprints share is not compared all against all. There the other half must agree in all
but ``r`` of eight blocks, so its members meet again under each choice of agreeing blocks, where at most a constant number
of distinct fingerprints can share a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, checkpointed, free_name, if_small, release_memory, written
from tessella.llm.components import components

SEED = 42
_SLICE = 200_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; unsigned. No words: zero."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    one = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        part = found[at : at + _SLICE + words - 1] if n > 1 else found
        hashes = [one(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(words)))] if n > 1 else [one(b" ".join(part), SEED)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])
        release_memory()

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "doc_id long, fp long")


def _ball(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(32), n)]


def _halves(prints: DataFrame) -> DataFrame:
    """``seg, part, other, fp``: both halves of each fingerprint, the upper one as segment 0."""
    up, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    pair = lambda seg, part, other: F.struct(F.lit(seg).alias("seg"), part.alias("part"), other.alias("other"))
    return prints.select("fp", F.explode(F.array(pair(0, up, low), pair(1, low, up))).alias("h")).select("fp", "h.*")


def links(prints: DataFrame, radius: int, crowd: int = 256) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints of the column ``fp`` (distinct already) at 1 to ``radius`` differing bits."""
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1, 2 or 3")
    key = F.shiftleft(F.col("seg").cast("long"), 32).bitwiseOR(F.col("part"))
    halves = _halves(prints)
    shelf = halves.select("fp", "other", key.alias("key"))
    masks = [_ball(radius // 2), _ball(max(0, -(-radius // 2) - 1))]

    def steps(masks: list[int]) -> Column:
        # the identity, and masks whose topmost bit the key lacks: the walk goes up only
        return F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("part").bitwiseXOR(m) >= F.col("part"))

    walks = halves.select("fp", "other", "seg", "part", F.explode(F.when(F.col("seg") == 0, steps(masks[0])).otherwise(steps(masks[1]))).alias("mask"))
    walks = walks.select("fp", "other", "mask", F.shiftleft(F.col("seg").cast("long"), 32).bitwiseOR(F.col("part").bitwiseXOR(F.col("mask"))).alias("key"))
    crowded = checkpointed(shelf.groupBy("key").count().where(F.col("count") > crowd).select("key"))

    def meet(walks: DataFrame, shelf: DataFrame, keys: list[str]) -> DataFrame:
        w, s = walks.alias("w"), shelf.alias("s")
        apart = F.bit_count(F.col("w.fp").bitwiseXOR(F.col("s.fp")))
        on = (apart <= radius) & ((F.col("w.mask") != 0) | (F.col("w.fp") < F.col("s.fp")))
        for k in keys:
            on = (F.col(f"w.{k}") == F.col(f"s.{k}")) & on
        return w.join(s, on).select(F.least("w.fp", "s.fp").alias("a"), F.greatest("w.fp", "s.fp").alias("b"))

    if not crowded.limit(1).count():
        return meet(walks, shelf, ["key"]).distinct()
    agree = [sum(0xF << (4 * i) for i in blocks) for blocks in combinations(range(8), 8 - radius)]
    again = F.explode(F.array(*[F.lit(m).cast("long") for m in agree]))

    def finer(rows: DataFrame) -> DataFrame:
        rows = rows.join(crowded, "key", "left_semi").select("*", again.alias("blocks"))
        return rows.withColumn("rest", F.col("other").bitwiseAND(F.col("blocks")))

    thin = meet(walks.join(crowded, "key", "left_anti"), shelf.join(crowded, "key", "left_anti"), ["key"])
    dense = meet(finer(walks), finer(shelf), ["key", "blocks", "rest"])
    return thin.unionByName(dense).distinct()


def near_groups(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest id reachable, itself included).

    Texts without words (null ones too) have the fingerprint zero and link like any others. A null id gets a row but is
    never a component's smallest id unless all are null. Repeated ids stand in one row each and may be in two
    components only if their texts are. An empty table gives no rows. Only the two named columns are read.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius), "a", "b")
    tied = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tied = written(tied, "simhash-tied")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tied.join(least.withColumnRenamed("root", "__root"), F.col("root") == F.col("__root")).select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that another document of their component stands for: its smallest id stays.

    Rows with a null id stay, as no other can be told from them; of repeated ids all rows stay or go. Other columns pass
    through, whatever their names. An empty table stays empty.
    """
    gone_id = free_name(docs, "gone_id")
    gone = written(near_groups(docs, radius, words, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "simhash-gone")
    return docs.join(if_small(gone), F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
