"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``PREFIX`` nearest pivots in order. The index is written once: rows are dealt to blocks
by a hash, and each block holds its vectors and, as inverted files, one list per pivot of (row, place). A query visits the
lists of its own ``VISITS`` nearest pivots only, adds up what they contribute to the footrule distance of the two orders, and
measures the best ranked rows exactly. Blocks follow from the rows alone, so no layout of the input changes an answer.
Queries go in groups of bounded size against all blocks, so neither queries nor rows ever meet in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, sample_by_hash, written

#: Vectors that serve as pivots, about: the bound of the sample that the index is fitted on.
PIVOTS = 1024
#: Pivots that a row is posted under, and lists that a query visits.
PREFIX, VISITS = 128, 64
#: A query measures this share of the rows exactly, and ``LEAST`` rows more over the whole table.
RERANK, LEAST = 0.04, 200
#: Rows of a block, about; more than ``_MOST`` (equal rows that a hash cannot part) are cut into several.
ROWS, _MOST = 8_192, 16_384
_FILE = 8  # blocks of a file, if there are enough files for all cores
_QUERIES = 8_192
_EMPTY = "query_id long, rank int, vec_id long, score double"
_INDEX = "block long, slot int, id long, v array<double>, rows binary, places binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows that take part: an id, a vector that is not null, empty or zero, without null or non-finite parts."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first (ties: smaller pivot)."""
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def post(order: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The inverted files of a block: per pivot its rows (ascending) and the place that each gives it."""
    flat, prefix = order.ravel(), order.shape[1]
    by = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[by], np.arange(n_pivots + 1))
    rows, places = (by // prefix).astype(np.int16), (by % prefix).astype(np.int16)
    return [(rows[a:b], places[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def footrule(lists: list[tuple[np.ndarray, np.ndarray]], n_rows: int, order: np.ndarray, prefix: int) -> np.ndarray:
    """Distance of a query's order to each row's, over the pivots of ``order``; a pivot that a row lacks has the place
    ``prefix``. Pivots of the row alone count as if all others were such; with a whole order it is the footrule distance."""
    out = np.full(n_rows, prefix * (prefix + 1), np.int32)
    for place, pivot in enumerate(order.tolist()):
        rows, theirs = lists[pivot]
        # a pivot of the row alone costs prefix - place, of the query alone too; of both, the difference
        out[rows] += np.abs(theirs - place) - (prefix - theirs) - (prefix - place)
    return out


def nearest(ids: np.ndarray, x: np.ndarray, lists: list, q: np.ndarray, order: np.ndarray, prefix: int, most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of the ``most`` rows that rank best; rows are in order of their ids, so ties go to the smaller id."""
    if most < len(ids):
        rank = footrule(lists, len(ids), order, prefix).astype(np.int64) * len(ids) + np.arange(len(ids))
        at = np.sort(np.argpartition(rank, most)[:most])
    else:
        at = np.arange(len(ids))
    d = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
    best = np.argsort(d, kind="stable")[:k]
    return ids[at[best]], d[best]


def _write_index(rows: DataFrame, n: int, pivots: np.ndarray, prefix: int) -> DataFrame:
    """A block's vectors in slots from 0, in order of their ids, then its lists in slots from -1 down (pivot -1 - slot)."""
    blocks = -(-n // ROWS)
    files = max(-(-blocks // _FILE), min(blocks, rows.sparkSession.sparkContext.defaultParallelism))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.binary(), pa.binary()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(part: int) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            ids = t.column(1).to_numpy()
            x = t.column(2).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            by = np.lexsort((*x.T[::-1], ids))
            ids, x = ids[by], x[by]
            lists = post(orders(x, shared.value, prefix), len(shared.value))
            block = t.column(0)[0].as_py() << 20 | part
            for at in range(0, len(ids), 512):
                m = len(ids[at : at + 512])
                blank = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([block] * m, kinds[0]), pa.array(np.arange(at, at + m), kinds[1]), pa.array(ids[at : at + m]), pa.array(list(x[at : at + m]), kinds[3]), blank, blank], names)
            m = len(lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * m, kinds[0]), pa.array(-1 - np.arange(m), kinds[1]), pa.nulls(m, kinds[2]), pa.nulls(m, kinds[3]), pa.array([r.tobytes() for r, _ in lists], kinds[4]), pa.array([p.tobytes() for _, p in lists], kinds[5])], names
            )

        now, part, many = None, 0, 0
        for batch in batches:
            column = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for a, b in zip(cuts, cuts[1:]):
                if held and (column[a] != now or many + b - a > _MOST):
                    yield from out(part)
                    part, held[:], many = part + 1 if column[a] == now else 0, [], 0
                if b > a:
                    now, many = column[a], many + b - a
                    held.append(batch.slice(a, b - a))
        if held:
            yield from out(part)

    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), "id", "v")
    dealt = dealt.repartitionById(files, (F.col("block") % files).cast("int")).sortWithinPartitions("block")
    return written(bounded_batches(dealt).mapInArrow(build, _INDEX), "ann-index")


def _visits(index: DataFrame, asked: tuple, n_pivots: int, prefix: int, share: float, k: int) -> DataFrame:
    """The ``k`` best of each task for each of a group of queries."""
    wanted = index.sparkSession.sparkContext.broadcast(asked)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, order = wanted.value
        best_id, best_d = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
        held: list[pa.RecordBatch] = []

        def measure() -> None:
            nonlocal best_id, best_d
            t = pa.Table.from_batches(held)
            slot = t.column("slot").to_numpy()
            rows = np.flatnonzero(slot >= 0)
            rows = rows[np.argsort(slot[rows])]
            ids = t.column("id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            x = t.column("v").take(pa.array(rows)).combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
            lists: list = [None] * n_pivots
            for at in np.flatnonzero(slot < 0).tolist():
                lists[-1 - slot[at]] = tuple(np.frombuffer(t.column(c)[at].as_py(), np.int16) for c in ("rows", "places"))
            most = max(k, int(np.ceil(share * len(ids))))
            new_id, new_d = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
            for i in range(len(q)):
                a, d = nearest(ids, x, lists, q[i], order[i], prefix, most, k)
                new_id[i, : len(a)], new_d[i, : len(d)] = a, d
            both_id, both_d = np.concatenate([best_id, new_id], axis=1), np.concatenate([best_d, new_d], axis=1)
            top = np.lexsort((both_id, both_d), axis=1)[:, :k]
            best_id, best_d = np.take_along_axis(both_id, top, 1), np.take_along_axis(both_d, top, 1)

        now = None
        for batch in batches:
            column = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and column[a] != now:
                        measure()
                        held = []
                    now = column[a]
                    held.append(batch.slice(a, b - a))
        if held:
            measure()
        i, j = np.nonzero(np.isfinite(best_d))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best_id[i, j]), pa.array(best_d[i, j])], ["q", "vec_id", "score"])

    return bounded_batches(index).mapInArrow(visit, "q long, vec_id long, score double")


def _search(rows: DataFrame, queries: Column, k: int, pivots: int, prefix: int, visits: int, rerank: float, least: int) -> DataFrame | None:
    """``search`` among vectors of one dimension."""
    n = rows.count()
    chosen = sample_by_hash(rows, "v", pivots).select("v").distinct().orderBy(F.xxhash64("v"), "v").toArrow()
    points = np.array((chosen if chosen.num_rows else rows.limit(1).select("v").toArrow()).column("v").to_pylist(), float)
    prefix = min(prefix, len(points))
    index = _write_index(rows, n, points, prefix)
    asked = rows.where(queries).select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).alias("h"))
    groups, found = max(1, -(-asked.count() // (_QUERIES // 2))), None
    for group in range(groups):
        some = asked.where(F.col("h") % groups == group).orderBy("id", "v").toArrow()  # about 4,096 queries
        if not some.num_rows:
            continue
        q = np.array(some.column("v").to_pylist(), float)
        # one more than asked for, as a query meets its own row
        part = written(_visits(index, (q, orders(q, points, min(visits, prefix))), len(points), prefix, min(1.0, rerank + least / n), k + 1), "ann-found")
        ids = rows.sparkSession.createDataFrame(pa.table({"q": pa.array(np.arange(len(q))), "query_id": some.column("id")}))
        part = part.join(F.broadcast(ids), "q").withColumn("group", F.lit(group))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return None
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    first = Window.partitionBy("group", "q").orderBy("score", F.when(mine, 0).otherwise(1), "vec_id")
    best = Window.partitionBy("group", "q").orderBy("score", "vec_id")
    # of the rows with the query's id and vector one is its own
    others = found.withColumn("at", F.row_number().over(first)).where(~(mine & (F.col("at") == 1)))
    place = others.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return place.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, visits: int = VISITS, rerank: float = RERANK, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row that ``queries`` (over ``id``) picks.

    Every usable row (see ``usable``) is indexed and is a candidate, but for the query's own. Rows that repeat an id are
    rows of their own: each is a candidate, and a repeated query id has a list of answers for each of its rows. Vectors of
    different dimensions have no distance; each dimension has an index of its own. Ties go to the smaller vec_id. Pivots
    are a sample by hash of the vectors. A null id or vector takes no part; an empty table, or one without usable vectors,
    gives no rows. Only the two named columns are read.
    """
    rows = written(usable(vectors, id_col, vec_col), "ann-rows")
    sizes = [r.d for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    out = vectors.sparkSession.createDataFrame([], _EMPTY)
    for d in sizes:
        part = _search(rows.where(F.size("v") == d), queries, k, pivots, prefix, visits, rerank, least)
        out = out if part is None else out.unionByName(part)
    return out
