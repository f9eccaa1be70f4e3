"""Exact dedup: counting quotient filters find texts that may repeat, and grouping by the bytes themselves verifies them.

A fingerprint of 64 bits has a quotient (its upper bits, which name a block of the filter) and a remainder. A filter keeps
per block the sorted remainders with a count each. Every partition builds its own, the blocks are shuffled, and filters
merge without loss by merging their sorted remainders. Only rows whose fingerprint counts above one go on to byte
verification: grouping by the normalised text, which Spark compares byte by byte and combines in each task first, so
a group of copies crosses the network once per task, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import free_name, if_small, without_blanks, written

#: Fingerprints of a block that a merge holds at once, as an aim.
_BLOCK = 50_000
_KEEP = "cast({n} as decimal(38,0)) * 20000000000000000000BD + (9223372036854775807BD - cast({id} as decimal(38,0)))"


class QuotientFilter:
    """Counts of 64-bit fingerprints: per quotient of ``q`` bits, the sorted remainders."""

    def __init__(self, q: int):
        self.q = q
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _merge(remainders: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(remainders, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts)
        return distinct, total

    def add(self, prints: np.ndarray) -> None:
        prints = np.sort(np.asarray(prints).astype(np.int64).view(np.uint64))
        if not len(prints):
            return
        rest = np.uint64(64 - self.q)
        quotients = (prints >> rest).astype(np.int64) if self.q else np.zeros(len(prints), np.int64)
        low = prints & np.uint64((1 << (64 - self.q)) - 1)
        cuts = np.flatnonzero(np.diff(quotients)) + 1
        for at, part in zip([0, *cuts.tolist()], np.split(low, cuts)):
            self.add_block(int(quotients[at]), part, np.ones(len(part), np.int64))

    def add_block(self, quotient: int, remainders: np.ndarray, counts: np.ndarray) -> None:
        if quotient in self.blocks:
            r, c = self.blocks[quotient]
            remainders, counts = np.concatenate([r, remainders]), np.concatenate([c, counts])
        self.blocks[quotient] = self._merge(remainders, counts)

    def repeated(self, quotient: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (signed) of a block that count above one, and their counts."""
        r, c = self.blocks[quotient]
        full = r[c > 1] | np.uint64((quotient << (64 - self.q)) & ((1 << 64) - 1))
        return full.view(np.int64), c[c > 1]


def repeated_fingerprints(prints: DataFrame, col: str) -> DataFrame:
    """Values of the 64-bit column that more than one row has, with their numbers of rows: ``fp, n``."""
    q = max(0, min(40, (prints.count() // _BLOCK).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, waiting, many = QuotientFilter(q), [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False))
            many += len(waiting[-1])
            if many > 500_000:
                mine.add(np.concatenate(waiting))
                waiting, many = [], 0
        if waiting:
            mine.add(np.concatenate(waiting))
        for quotient, (r, c) in mine.blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([quotient], pa.int64()), pa.array([r.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["quotient", "remainders", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive sorted by quotient, so one is open at a time."""
        mine = QuotientFilter(q)

        def out() -> Iterator[pa.RecordBatch]:
            for quotient in list(mine.blocks):
                prints, n = mine.repeated(quotient)
                del mine.blocks[quotient]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(n, pa.int64())], ["fp", "n"])

        for batch in batches:
            for quotient, r, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if quotient not in mine.blocks:
                    yield from out()
                mine.add_block(quotient, np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64))
        yield from out()

    filters = prints.select(col).mapInArrow(build, "quotient long, remainders binary, counts binary")
    return filters.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts (null: empty) are equal if identical without ASCII white space. The row with the most code points, then the
    smallest id, stays; a null id comes after all others. Of repeated rows with the same id and equal texts, one has
    ``kept``, and all count. An empty table gives no rows. Only the two named columns are read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = without_blanks(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("n"), norm.alias("norm"))
    slim = written(rows.select("doc_id", "n", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha")), "exact-rows")
    repeated = written(repeated_fingerprints(slim, "fp"), "exact-repeated")
    # a null id ranks after 2^63 - 1, the last long
    rank = F.expr(_KEEP.format(n="n", id="coalesce(cast(doc_id as decimal(38,0)), 9223372036854775808BD)"))
    classes = (
        rows.withColumn("fp", F.xxhash64("norm"))
        .join(repeated.select("fp"), "fp", "left_semi")
        .withColumn("rank", rank.cast("decimal(38,0)"))
        .groupBy("fp", "norm")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("m"))
        .select("fp", F.sha2("norm", 256).alias("sha"), F.expr("9223372036854775807BD - pmod(rank + 1, 20000000000000000000BD) + 1").alias("keep"), "m")
    )
    classes = written(classes.where("m > 1").select("fp", "sha", F.when(F.col("keep") <= F.lit(9223372036854775807), F.col("keep").cast("long")).alias("keep_id"), F.col("m").cast("long").alias("m")), "exact-classes")
    if classes.groupBy("fp", "sha").count().where("count > 1").limit(1).count():
        raise ValueError("two texts share a fingerprint and a SHA-256")
    out = slim.join(classes, ["fp", "sha"], "left")
    # the same id again within a class: the first of them stays
    copies = out.where(F.col("m").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = copies.groupBy("sha").count().where("count > 1").limit(1).count()
    kept = F.col("m").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if again:
        of_class = Window.partitionBy("sha", "doc_id").orderBy("n")
        out = out.withColumn("first", F.row_number().over(of_class) == 1)
        kept = F.col("m").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first"))
    return out.select("doc_id", F.when(F.col("m").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("m", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one stays.

    Null texts count as empty ones; null ids are ids like others. Any other columns pass through, whatever their names. An
    empty table stays empty.
    """
    groups = written(exact_groups(docs, id_col, text_col), "exact-groups")
    pairs = lambda rows, k, v: rows.select(F.col("doc_id").alias(k), F.col("text_sha256").alias(v)).distinct()
    own, key, gone_id, gone_key = (free_name(docs, x) for x in ("own_id", "own_key", "gone_id", "gone_key"))
    gone, stays = pairs(groups.where("not kept"), gone_id, gone_key), pairs(groups.where("kept"), "stays_id", "stays_key")
    same = F.col(gone_id).eqNullSafe(F.col("stays_id")) & (F.col(gone_key) == F.col("stays_key"))
    # an id and text that both go and stay are repeated rows, of which one is kept
    alone = if_small(written(gone.join(stays, same, "left_anti"), "exact-gone"))
    twice = if_small(written(gone.join(stays, same, "left_semi"), "exact-twice"))
    named = docs.withColumns({own: F.col(id_col).cast("long"), key: F.sha2(without_blanks(F.col(text_col).cast("string")), 256)})
    on = F.col(own).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    left = named.join(alone, on, "left_anti")
    if twice.limit(1).count():
        left = left.join(twice, on, "left_anti").unionByName(left.join(twice, on, "left_semi").dropDuplicates([own, key]))
    return left.drop(own, key)
