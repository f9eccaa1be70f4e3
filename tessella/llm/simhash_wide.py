"""SimHash near-dedup at a similarity of word shingles: wide fingerprints, multi-index hashing, and the sets decide.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. At 0.8 a bit of a
SimHash differs with probability 0.15, which is some 10 of 64 bits: too many for the two halves of ``simhash``. So here a
fingerprint has 512 bits, of which ``SEGMENTS`` segments of ``WIDTH`` bits each have a table of keys. A fingerprint visits
in each table the small Hamming ball of the ``2^FLIPS`` keys that flip some of the segment's least certain bits: those whose
sum over the shingles is closest to a tie, which are the bits that near copies differ in. What it meets is compared by a
sample of 64 bits first, then by the complete distance, then by the sets themselves, so nothing below 0.8 is linked.

The ball is a part of all keys at that distance, so a pair can be missed; README has the measured share. ``WIDTH`` keeps
strangers apart: a fingerprint meets about n * SEGMENTS * 2^FLIPS / 2^WIDTH of n others. It is a constant, so that every
size behaves alike; 24 bits serve to some 10^8 sets, beyond that it has to be raised, and ``WORDS_OF_64`` with it.

Equal sets are one node from the start. Keys that more than ``CROWD`` nodes share are taken first: their members are compared
with one of them, the centre, twice; then only with members of the key whose component differs, where the members of the
key's largest component do not meet each other. So a large group of copies costs its size, not its square.

Texts that share a passage are alike below 0.8 in any number, and no component tells them apart. For them a set has an odd
sketch (Mitzenmacher, Pagh, Pham 2014): ``PARITIES`` bits, each the parity of the set's hashes in a bucket. A hash that only
one of two sets has flips one bit, so the bits that differ are at most the hashes that do, of which similar sets have at most
a ninth of both sizes: the test loses no pair. In crowded keys it is a part of the join, elsewhere it comes before the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, free_name, if_small, release_memory, written
from tessella.llm.components import components

WORDS = 5
#: Similarity of near copies, as a fraction.
LEAST = (4, 5)
WORDS_OF_64, WIDTH, SEGMENTS, FLIPS = 8, 24, 21, 3
#: Differing bits that end a comparison: of the sample of 64, and of all SEGMENTS * WIDTH. At similarity 0.8 the expected
#: numbers are 9.7 and 76, with deviations of 2.9 and 8.1.
HEAD_FAR, FAR = 22, 112
#: Other keys give at most so many pairs a visit, unfiltered: in proportion to the input.
CROWD = 3
#: Segments whose tables are met at once: what is shuffled for them stands on disk together.
TURN = 7
PARITIES = 256
SEED = 42
_STARS = 2
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 2**63, (2, WORDS_OF_64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SUM = 255  # rows that a byte can add up
_NODE = "fp long, size int, head long, keys array<int>, low array<int>, odd array<long>"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text's word shingles as sorted hashes; a shorter text is one shingle, a text without words has none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh64_intdigest
    parts = zip(*(found[i:] for i in range(words))) if len(found) > words else [found]
    return np.unique(np.array([one(b" ".join(s), SEED) for s in parts], np.uint64))


def lean(hashes: np.ndarray) -> np.ndarray:
    """Per bit of the fingerprint: shingles that set it, less those that do not."""
    ones = np.zeros(WORDS_OF_64 * 64, np.int64)
    for at in range(0, len(hashes), _SUM * 16):
        x = hashes[at : at + _SUM * 16, None] * _TIMES[0]
        x = (x ^ (x >> np.uint64(32))) * _TIMES[1]
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for part in range(0, len(bits), _SUM):
            ones += np.add.reduce(bits[part : part + _SUM], axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a set that is not empty: the sample of 64 bits, each segment's bits, and masks of each segment's least certain ones."""
    leaning = lean(hashes)
    head = int(np.packbits(leaning[7::8][:64] > 0, bitorder="little").view("<i8")[0])
    parts = leaning[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
    place = np.int32(1) << np.arange(WIDTH, dtype=np.int32)
    low = np.argsort(np.abs(parts), axis=1, kind="stable")[:, :FLIPS]
    return head, (parts > 0).astype(np.int32) @ place, place[low].ravel()


def parities(hashes: np.ndarray) -> list[int]:
    """The odd sketch: per bucket of hashes, whether it holds an odd number; as words of 64 bits."""
    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _digest(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text")))


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id and node: ``fp`` stands for the set (0: empty, without keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            prints, sizes, heads, keys, low, odd = [], [], [], [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py())
                head, key, mask = sketch(hashes) if len(hashes) else (0, [], [])
                for column, value in zip((prints, sizes, heads, keys, low, odd), (_digest(hashes), len(hashes), head, key, mask, parities(hashes))):
                    column.append(value)
            columns = [batch.column(0), _signed(prints), pa.array(sizes, pa.int32()), pa.array(heads, pa.int64()), pa.array(keys, ints), pa.array(low, ints), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "size", "head", "keys", "low", "odd"])
        release_memory()

    return _slim(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {_NODE}")


def _sets(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """``fp, hashes`` of the nodes, made again from the texts of their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([_signed([_digest(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "hashes"])
        release_memory()

    ids = written(nodes.select(F.col("least").alias("__least")).distinct(), "wide-ids")
    rows = _slim(docs, id_col, text_col)
    made = rows.join(if_small(ids), F.col("doc_id").eqNullSafe(F.col("__least")), "left_semi").mapInArrow(run, "fp long, hashes array<long>")
    # an id that stands in several rows brings the sets of all of them
    return written(made.join(if_small(nodes.select("fp")), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes")), "wide-sets")


def _shelf(nodes: DataFrame, first: int = 0, many: int = SEGMENTS) -> DataFrame:
    """``key, fp, root, head``: each node under its own keys, or those of ``many`` segments from ``first``; ``m1..``: the
    masks of the key's least certain bits."""
    rows = nodes.select("fp", "root", "head", "low", F.posexplode(F.slice("keys", first + 1, many)).alias("at", "part")).withColumn("seg", F.col("at") + first)
    masks = [F.get("low", F.col("seg") * FLIPS + i).alias(f"m{i}") for i in range(FLIPS)]
    return rows.select(F.shiftleft("seg", WIDTH).bitwiseOR(F.col("part")).alias("key"), "fp", "root", "head", *masks)


def _walks(shelf: DataFrame) -> DataFrame:
    """``key, fp, root, head``: each node under all keys of its balls."""

    def flipped(bits: tuple[int, ...]) -> Column:
        key = F.col("key")
        for i in bits:
            key = key.bitwiseXOR(F.col(f"m{i}"))
        return key

    ball = [flipped(bits) for n in range(FLIPS + 1) for bits in combinations(range(FLIPS), n)]
    return shelf.select(F.explode(F.array(*ball)).alias("key"), "fp", "root", "head")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _near(one: str, other: str) -> Column:
    return F.bit_count(F.col(one).bitwiseXOR(F.col(other))) <= HEAD_FAR


def _may(n: Column, m: Column, one: Column, other: Column) -> Column:
    """Whether sets of these sizes and odd sketches may be similar enough; true of all that are."""
    up, down = LEAST
    apart = reduce(Column.__add__, [F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(PARITIES // 64)])
    return (F.least(n, m) * down >= F.greatest(n, m) * up) & (apart * (up + down) <= (n + m) * (down - up))


def _meet(walks: DataFrame, shelf: DataFrame, crowded: bool = False) -> DataFrame:
    """Pairs under a key whose components differ and whose samples are near; in crowded keys only those that may be alike."""
    w, s = walks.alias("w"), shelf.alias("s")
    on = (F.col("w.key") == F.col("s.key")) & (F.col("w.root") != F.col("s.root")) & _near("w.head", "s.head")
    if crowded:
        on &= _may(F.col("w.size"), F.col("s.size"), F.col("w.odd"), F.col("s.odd"))
    return w.join(s, on).select(*_pair("w.fp", "s.fp"))


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sizes and odd sketches allow the similarity and whose complete distance is small."""
    one = nodes.select(F.col("fp").alias("a"), F.col("size").alias("n"), F.col("keys").alias("x"), F.col("odd").alias("o"))
    other = nodes.select(F.col("fp").alias("b"), F.col("size").alias("m"), F.col("keys").alias("y"), F.col("odd").alias("p"))
    both = pairs.distinct().join(one, "a").join(other, "b").where(_may(F.col("n"), F.col("m"), F.col("o"), F.col("p")))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return both.where(apart <= FAR).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose sets are similar enough."""
    up, down = LEAST
    one = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x"))
    other = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(other, "b")
    # shared / (n + m - shared) >= up / down
    return both.where(F.size(F.array_intersect("x", "y")) * (up + down) >= (F.size("x") + F.size("y")) * up).select("a", "b")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = written(components(links, "a", "b"), "wide-roots").withColumnRenamed("root", "__root")
    return nodes.drop("root").join(if_small(roots), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("__root", "fp")).drop("node", "__root")


def _star_links(nodes: DataFrame, crowded: DataFrame, decide) -> DataFrame:
    """Links of crowded keys' members with their keys' centres; a second turn takes other centres and open components."""
    held = written(_shelf(nodes).join(if_small(crowded), "key", "left_semi").select("key", "fp", "head"), "wide-crowds")
    found = None
    for turn in range(_STARS):
        members = held.withColumn("root", F.col("fp")) if found is None else _rooted(held, found)
        members = members.withColumn("__k", F.col("key").bitwiseXOR(F.lit(1)))
        centre = F.min(F.struct(F.xxhash64(F.lit(turn), "fp").alias("h"), F.col("fp").alias("c"), F.col("root").alias("r"), F.col("head").alias("t")))
        hubs = written(members.groupBy("key").agg(centre.alias("x")).select(F.col("key").bitwiseXOR(F.lit(1)).alias("__k"), "x.c", "x.r", "x.t"), "wide-hubs")
        met = members.join(if_small(hubs), "__k").where((F.col("root") != F.col("r")) & _near("head", "t"))
        some = decide(met.select(*_pair("fp", "c")))
        found = some if found is None else found.unionByName(some)
    return found


def _in_turns(nodes: DataFrame, meet: Callable[[DataFrame], list[DataFrame]]) -> DataFrame:
    """The pairs of all segments; ``meet`` gives those of some segments' shelf. Pairs are few beside the keys that are
    shuffled for them, so they are written after each turn and each join, and the shuffle goes."""
    met = [written(pairs, "wide-met") for at in range(0, SEGMENTS, TURN) for pairs in meet(_shelf(nodes, at, TURN))]
    return reduce(DataFrame.unionByName, met)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, fp (of the set), component_id (smallest id reachable, itself included).

    Texts without words (null ones too) are copies of each other. A null id gets a row but is never a component's smallest
    id unless all are null. Repeated rows are copies; rows with equal ids and different texts are told apart. An empty table
    gives no rows. Only the two named columns are read. ``crowd`` changes the way, not the result.
    """
    sketches = written(_sketches(docs, id_col, text_col), "wide-sketches")
    rest = [F.first(c).alias(c) for c in ("size", "head", "keys", "low", "odd")]
    nodes = written(sketches.groupBy("fp").agg(F.min("doc_id").alias("least"), *rest).withColumn("root", F.col("fp")), "wide-nodes")

    def decide(pairs: DataFrame) -> DataFrame:
        close = written(_close(pairs, nodes), "wide-close")
        ends = close.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        ends = written(nodes.select("fp", "least").join(if_small(written(ends, "wide-ends")), "fp", "left_semi"), "wide-wanted")
        return written(_alike(close, _sets(docs, id_col, text_col, ends)), "wide-links")

    crowded = written(_shelf(nodes).groupBy("key").count().where(F.col("count") > crowd).select("key"), "wide-crowded")
    if not crowded.limit(1).count():
        found = decide(_in_turns(nodes, lambda shelf: [_meet(_walks(shelf), shelf)]))
    else:
        crowded = if_small(crowded)
        stars = _star_links(nodes, crowded, decide)
        now = written(_rooted(nodes, stars), "wide-named")
        # in a crowded key the largest component's members meet the others only
        sizes = _shelf(now).join(crowded, "key", "left_semi").groupBy("key", "root").count()
        top = if_small(written(sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("top")), "wide-top"))
        dense = lambda rows: rows.join(top, "key").join(now.select("fp", "size", "odd"), "fp")

        def meet(shelf: DataFrame) -> list[DataFrame]:
            walks, shelf = _walks(shelf), shelf.select("key", "fp", "root", "head")
            big, w, s = F.col("root") == F.col("top"), dense(walks), dense(shelf)
            sparse = _meet(walks.join(crowded, "key", "left_anti"), shelf.join(crowded, "key", "left_anti"))
            return [sparse, _meet(w.where(~big).drop("top"), s.drop("top"), True), _meet(w.where(big).drop("top"), s.where(~big).drop("top"), True)]

        found = stars.unionByName(decide(_in_turns(now, meet)))
    roots = components(found, "a", "b")
    tied = nodes.select("fp", "least").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tied = written(tied, "wide-tied")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tied.join(least.withColumnRenamed("root", "__root"), F.col("root") == F.col("__root")).select("fp", "component_id")
    return sketches.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that another document of their component stands for: its smallest id stays.

    Rows with a null id stay, as no other can be told from them; of repeated ids all rows stay or go. Other columns pass
    through, whatever their names. An empty table stays empty.
    """
    gone_id = free_name(docs, "gone_id")
    gone = written(near_groups(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "wide-gone")
    return docs.join(if_small(gone), F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
