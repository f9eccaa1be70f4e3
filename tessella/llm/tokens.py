"""Token ids: a memoising encoder, shard files of raw ids, and a minimal perfect hash index over document keys.

Shard file::

    magic  TSID0001
    ids    little-endian unsigned, 2 bytes each if the vocabulary fits, else 4; documents one after another
    index  numpy arrays (see ``_index``), one after another
    tail   int64 x 2: where the index starts, bytes of one id; magic

A key's place is found in constant time: the manifest's key ranges name its shard; there its hash walks the levels of the
minimal perfect hash (a key that met no other in a level's bit field has its slot there, as the rank of its bit), the slot's
stored fingerprint tells most strangers from members and its stored key the rest, and the slot names the document's first
row and number of rows. Rows keep offsets into the payload.
"""

from __future__ import annotations

import io
import os
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, new_path, release_memory, written

MAGIC = b"TSID0001"
END_ID = 0
_READ_BLOCK = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A unit that the pre-tokenizer surely cuts in three: a newline, Latin letters, plain punctuation.
_SIMPLE = "^(?P<lead>\n?)(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<tail>[.,;:!?|#$%&*()]*)$"
#: Entries of each of the memo's generations, and bytes of text that are encoded at once, about.
MEMO, AT_ONCE = 250_000, 4 << 20


class Encoder:
    """Ids of texts, equal to the library's on each whole text.

    The byte-level pre-tokenizer always cuts between a non-space and a single space or newline that a non-space follows.
    So texts are cut there, and the distinct units of a batch are encoded once. Simple units are cut further: their
    letters, with the space before them, and their punctuation; new ones go to the library in one call. Other units go
    there whole, and texts with other white space at a cut go there as they are. An index array puts all together.

    The memo has two generations of at most ``memo`` entries: a full one becomes the old one, whose entries come back
    when they are asked for.
    """

    def __init__(self, path: str, memo: int = MEMO, at_once: int = AT_ONCE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self.vocab = self._tok.get_vocab_size(with_added_tokens=True)
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most, self._at_once = memo, at_once
        newline = self._tok.encode("\n", add_special_tokens=False).ids
        self._newline_id, self._newline = newline[0], np.array(newline, "<u4").tobytes()
        self._apart = len(newline) == 1 and self._tok.encode("a\n b\nc", add_special_tokens=False).ids.count(newline[0]) == 2

    def _raw(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tok.encode_batch_fast(units, add_special_tokens=False)] if units else []

    def _ids(self, units: list[str], lines: bool) -> list[bytes]:
        """Ids of distinct units; ``lines``: none holds a newline, so new ones take one call, a newline between them."""
        if len(self._memo) > self._most:
            self._old, self._memo = self._memo, {}
        memo, old = self._memo, self._old
        missing = [u for u in units if u not in memo]
        new = [u for u in missing if u not in old]
        if len(new) < len(missing):
            memo.update((u, old[u]) for u in missing if u in old)
        if new and lines and self._apart:
            ids = np.array(self._tok.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self._newline_id), len(ids))
            if len(ends) != len(new):
                raise ValueError("this tokenizer does not keep lines apart")
            flat = ids.tobytes()
            memo.update((u, flat[a:b]) for u, a, b in zip(new, (4 * np.append(0, ends[:-1] + 1)).tolist(), (4 * ends).tolist()))
        else:
            memo.update(zip(new, self._raw(new)))
        return list(map(memo.__getitem__, units))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's place: the ids of text i are from places[i] to places[i + 1]."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        at, coded = at - at[0], cut.flatten().dictionary_encode()
        seq, starts, many = coded.indices.to_numpy(), at[:-1], np.diff(at)
        later = np.ones(len(seq), bool)
        later[starts] = False  # the first word has no space before it, and is encoded by itself
        used = np.zeros(len(coded.dictionary), bool)
        used[seq[later]] = True
        words = coded.dictionary.filter(pa.array(used))
        # simple words: lead, core and tail; of others the whole is the core
        found = pc.extract_regex(words, _SIMPLE)
        lead, core, tail = (pc.struct_field(found, i) for i in range(3))
        simple = pc.fill_null(pc.not_equal(core, ""), False)
        plain = simple.to_numpy(zero_copy_only=False)
        led = pc.fill_null(pc.equal(lead, "\n"), False)
        spaced = pc.binary_join_element_wise(pc.if_else(pc.and_(simple, led), "", " "), pc.if_else(simple, core, ""), "").dictionary_encode()
        ends = pc.if_else(simple, tail, "").dictionary_encode()
        others = words.filter(pc.invert(simple)).to_pylist()
        bad = np.array([not (w := x.removeprefix("\n")) or w[0].isspace() or w[-1].isspace() for x in others], bool)
        table = [b"", self._newline]

        def listed(names: list[str], empty: str) -> np.ndarray:
            """Puts the ids of names into the table, and says where each is; ``empty`` has none."""
            place, skip = np.arange(len(table), len(table) + len(names)), names.index(empty) if empty in names else -1
            if skip >= 0:
                place[skip], place[skip + 1 :] = 0, place[skip + 1 :] - 1
            table.extend(self._ids(names[:skip] + names[skip + 1 :] if skip >= 0 else names, True))
            return place

        where, tails = listed(spaced.dictionary.to_pylist(), " "), listed(ends.dictionary.to_pylist(), "")
        # three slots a word: newline, letters (or whole), punctuation
        slots = np.zeros((len(coded.dictionary), 3), np.int32)
        rows = np.flatnonzero(used)
        slots[rows, 0] = (led.to_numpy(zero_copy_only=False) & plain).astype(np.int64)
        slots[rows, 1] = where[spaced.indices.to_numpy()]
        slots[rows, 2] = tails[ends.indices.to_numpy()]
        whole = [x if x[:1] == "\n" else " " + x for x, b in zip(others, bad.tolist()) if not b]
        odd_words = rows[~plain]
        slots[odd_words[~bad], 1] = len(table) + np.arange(len(whole))
        table += self._ids(whole, False)
        flawed = np.zeros(len(coded.dictionary), bool)
        flawed[odd_words[bad]] = True
        odd = np.add.reduceat((flawed[seq] & later).astype(np.int64), starts) > 0
        opening = coded.dictionary.take(coded.indices.take(pa.array(starts))).to_pylist()
        odd |= np.array([bool(w) and w[-1].isspace() for w in opening])
        rare = odd.tolist()
        known = list(dict.fromkeys(w for w, o in zip(opening, rare) if w and not o))
        known = dict(zip(known, self._ids(known, False)))
        ahead = len(table)
        table += [b"" if o else known.get(w, b"") for w, o in zip(opening, rare)]
        odd_rows = np.flatnonzero(odd).tolist()
        for row, raw in zip(odd_rows, self._raw([texts[r].as_py() for r in odd_rows])):
            table[ahead + row] = raw
        order = slots[seq]
        order[starts] = 0
        order[starts, 1] = ahead + np.arange(len(starts))
        order[np.repeat(odd, many) & later] = 0  # an odd text is one unit, in its first place
        order = order.ravel()
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[order]
        upto = np.cumsum(lengths)
        pick = np.repeat(begin[order] - (upto - lengths), lengths) + np.arange(int(upto[-1]))
        flat = np.frombuffer(b"".join(table), "<u4")[pick]
        return flat, np.concatenate([[0], upto])[3 * at]

    def blocks(self, batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """Batches of (key, text, ..) in slices of bounded size: the rows, all their ids one after another (the end id after
        each text's), and each text's place among them."""

        def slices() -> Iterator[list[pa.RecordBatch]]:
            held, size = [], 0
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                row = 0
                for at, n in enumerate(sizes.tolist()):
                    if size and size + n > self._at_once:
                        held.append(batch.slice(row, at - row))
                        yield held
                        held, size, row = [], 0, at
                    size += n
                held.append(batch.slice(row))
            yield held

        for held in slices():
            held = pa.Table.from_batches([b for b in held if b.num_rows]) if any(b.num_rows for b in held) else None
            if held is None:
                continue
            flat, place = self.batch(held.column(1).combine_chunks())
            n = held.num_rows
            ended = np.full(len(flat) + n, end_id, "<u4")
            ended[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(place))] = flat
            yield held, ended, place + np.arange(n + 1)
        release_memory()

    def documents(self, batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """Keys and ids of batches of (key, text), the end id appended to each; encoded in slices of bounded size."""
        for held, flat, place in self.blocks(batches, end_id):
            place = place.tolist()
            for key, a, b in zip(held.column(0).to_pylist(), place, place[1:]):
                yield key, flat[a:b]

    def __call__(self, text: str | None) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, memo: int = MEMO, at_once: int = AT_ONCE) -> Encoder:
    """This process's encoder, kept between tasks."""
    return Encoder(path, memo, at_once)


# ---------------------------------------------------------------- minimal perfect hash


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalising hash of int64 keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct int64 keys to 0..n-1, by cascaded bit fields with ranks (about 4 bits a key)."""

    def __init__(self, fields: list[np.ndarray]):
        self.fields = fields
        self._ranks = [np.concatenate([[0], np.cumsum(f, dtype=np.int64)]) for f in fields]
        self._starts = np.cumsum([0] + [int(f.sum()) for f in fields])

    @staticmethod
    def build(keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        fields, left = [], np.asarray(keys, np.int64)
        while len(left):
            size = max(8, int(gamma * len(left)))
            at = (_mix(left, len(fields)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(alone)
            left = left[~alone[at]]
            if len(fields) > 200:
                raise ValueError("the keys are not distinct")
        return PerfectHash(fields)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 if no level knows it. A stranger may get a slot: compare fingerprints."""
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, field in enumerate(self.fields):
            if not len(todo):
                break
            at = (_mix(keys[todo], level) % np.uint64(len(field))).astype(np.int64)
            hit = field[at]
            out[todo[hit]] = self._starts[level] + self._ranks[level][at[hit]]
            todo = todo[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _index(keys: np.ndarray, nulls: int, offsets: np.ndarray) -> list[np.ndarray]:
    """keys: sorted ids of the rows after the first ``nulls`` rows (whose id is null); offsets: in ids, one more than rows."""
    distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    own, prints, row, many = (np.zeros(len(distinct), t) for t in (np.int64, np.uint32, np.int64, np.int64))
    own[slot], prints[slot], row[slot], many[slot] = distinct, fingerprints(distinct), first + nulls, rows
    bits = [np.packbits(f) for f in mph.fields]
    sizes = np.array([len(f) for f in mph.fields], np.int64)
    return [np.array([nulls], np.int64), own, prints, row, many, offsets.astype(np.int64), sizes, *bits]


class Shard:
    """Keyed access to one shard file, from a file object that can seek."""

    def __init__(self, file):
        self._f = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 24)
        tail = file.read(24)
        if tail[16:] != MAGIC:
            raise ValueError("not a shard of token ids")
        at, self._width = np.frombuffer(tail[:16], "<i8").tolist()
        file.seek(at)
        buf = io.BytesIO(file.read(end - 24 - at))
        nulls, self.keys, self._prints, self._row, self._many, self.offsets, sizes = (np.load(buf) for _ in range(7))
        self.nulls = int(nulls[0])
        self._mph = PerfectHash([np.unpackbits(np.load(buf), count=int(n)).astype(bool) for n in sizes])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows if the shard does not hold it."""
        keys = np.asarray(keys, np.int64)
        slot = self._mph.slots(keys)
        known = slot >= 0
        known[known] = self._prints[slot[known]] == fingerprints(keys[known])
        known[known] = self.keys[slot[known]] == keys[known]  # a stranger may share a fingerprint
        slot = np.where(known, slot, 0)
        if not len(self._row):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return self._row[slot], np.where(known, self._many[slot], 0)

    def ids(self, row: int, until: int | None = None) -> np.ndarray:
        """Ids of the rows from ``row`` up to ``until`` (one row, if left out), end ids included."""
        a, b = self.offsets[row], self.offsets[row + 1 if until is None else until]
        self._f.seek(len(MAGIC) + int(a) * self._width)
        return np.frombuffer(self._f.read(int(b - a) * self._width), f"<u{self._width}")


# ---------------------------------------------------------------- jobs

_MANIFEST = "shard int, path string, n_rows long, n_tokens long, nulls long, first long, last long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of text of a shard, as an aim: small tables make smaller shards, at least one a core, down to the lesser size.
SHARD_BYTES, LEAST_BYTES = 64 << 20, 4 << 20
#: Rows of a shard, about, that the sample of its key ranges holds.
_SAMPLE = 32
_HEAD = 64
_LOW = -(2**63)


def _bounds(rows: DataFrame, n: int, many: int) -> list[tuple[int, str, int]]:
    """Where shards 1 to n - 1 begin, as (id, first characters of the text, salt), from about ``_SAMPLE`` rows a shard."""
    if n < 2:
        return []
    steps = 1 << 30
    some = rows.where(F.pmod("__salt", F.lit(steps)) < int(steps * min(1.0, n * _SAMPLE / many))).select("__id", "__head", "__salt").toArrow()
    found = sorted(zip((_LOW if x is None else x for x in some.column(0).to_pylist()), (x or "" for x in some.column(1).to_pylist()), some.column(2).to_pylist()))
    return [found[len(found) * i // n] for i in range(1, n)] if found else []


def _shard_of(bounds: list[tuple[int, str, int]], ids: np.ndarray, rest: Callable[[int], tuple[str, int]]) -> np.ndarray:
    """Each row's shard. Only rows with a bound's own id need the rest of their key."""
    starts = np.array([b[0] for b in bounds], np.int64)
    low, high = np.searchsorted(starts, ids, "left"), np.searchsorted(starts, ids, "right")
    out = low.astype(np.int32)
    for i in np.flatnonzero(high > low).tolist():
        out[i] = bisect_right(bounds, (int(ids[i]), *rest(i)), int(low[i]), int(high[i]))
    return out


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all texts as shards in ascending order of ``id_col`` (nulls first); returns the manifest.

    Texts are encoded where they are read; only ids are shuffled, to shards whose key ranges come from a sample of the rows.
    One task writes one shard, under a name of its own attempt: a lost task's retry never meets its remains, and the
    manifest (a written table) names only files of tasks that ended. Null texts are empty: just the end id. Rows with
    equal ids stand together, in order of the first characters of their texts; many of them are dealt over several shards.
    An empty table makes no shard. A null id counts as the smallest long.
    """
    path = tokenizer or default_tokenizer()
    width = 2 if encoder(path).vocab <= 1 << 16 else 4
    text = F.col(text_col).cast("string")
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"), F.xxhash64(F.monotonically_increasing_id()).alias("__salt"), F.substring(text, 1, _HEAD).alias("__head"))
    many, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    n = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), -(-size // SHARD_BYTES))
    bounds = _bounds(rows, n, max(1, many))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, flat, place in encoder(path).blocks(batches, end_id):
            keys, heads, salts = held.column(0).combine_chunks(), held.column(3).combine_chunks(), held.column(2)
            ids = pc.fill_null(keys, _LOW).to_numpy(zero_copy_only=False)
            shard = _shard_of(bounds, ids, lambda i: (heads[i].as_py() or "", salts[i].as_py()))  # noqa: B023
            payload = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer((place * width).astype(np.int64)), pa.py_buffer(flat.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([pa.array(shard), keys, heads, payload.cast(pa.binary())], ["shard", "id", "head", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        out, keys, lengths, name = None, [], [], ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                out = store.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                out.write(MAGIC)
            keys.append(batch.column(0))
            lengths.append(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) // width)
            out.write(b"".join(batch.column(1).to_pylist()))
        if out is None:
            return
        all_keys = pa.chunked_array(keys).combine_chunks()
        nulls, ids = all_keys.null_count, all_keys.drop_null().to_numpy()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        buf = io.BytesIO()
        for part in _index(ids, nulls, offsets):
            np.save(buf, part)
        out.write(buf.getvalue())
        out.write(np.array([len(MAGIC) + int(offsets[-1]) * width, width], "<i8").tobytes() + MAGIC)
        out.close()
        ends = [int(ids[0]), int(ids[-1])] if len(ids) else [None, None]
        row = [TaskContext.get().partitionId(), f"{folder}/{name}", len(all_keys), int(offsets[-1]), nulls, *ends]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [x.split()[0] for x in _MANIFEST.split(", ")])

    coded = rows.select("__id", "__text", "__salt", "__head").mapInArrow(encode, "shard int, id long, head string, ids binary")
    dealt = coded.repartitionById(n, "shard").sortWithinPartitions("id", "head", "ids").select("id", "ids")
    return written(dealt.mapInArrow(write, _MANIFEST), "manifest")


def read_documents(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of the keys (column ``doc_id``; each key once, null too), read from the shards: doc_id, start,
    n_tokens, ids_crc32. A key without documents has no row, one that repeats has a row for each.

    The manifest has one row per shard; its key ranges are the directory that sends each key to its shards.
    """
    shards = manifest.orderBy("shard").toArrow().to_pydict()
    if not shards["path"]:
        return manifest.sparkSession.createDataFrame([], _ROWS)
    base = np.cumsum([0, *shards["n_tokens"]]).tolist()
    ranged = [i for i, x in enumerate(shards["first"]) if x is not None]
    first, last = (np.array([shards[c][i] for i in ranged], np.int64) for c in ("first", "last"))
    with_nulls = [i for i, x in enumerate(shards["nulls"]) if x]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy()
            low, high = np.searchsorted(last, ids, "left"), np.searchsorted(first, ids, "right")
            many = np.maximum(high - low, 0)  # none, if the key falls between two shards
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ranged, np.int32)[at]), pa.array(np.repeat(ids, many))], ["shard", "doc_id"])
            if batch.column(0).null_count:
                yield pa.RecordBatch.from_arrays([pa.array(with_nulls, pa.int32()), pa.nulls(len(with_nulls), pa.int64())], ["shard", "doc_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            column = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and column[a] != now:
                        yield from _rows_of(shards["path"][now], base[now], pa.chunked_array(held))
                        held = []
                    now = int(column[a])
                    held.append(batch.column(1).slice(a, b - a))
        if held:
            yield from _rows_of(shards["path"][now], base[now], pa.chunked_array(held))

    spark = manifest.sparkSession
    n = min(len(shards["path"]), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    routed = keys.select("doc_id").mapInArrow(route, "shard int, doc_id long")
    return routed.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard", "doc_id").mapInArrow(read, _ROWS)


def _rows_of(path: str, base: int, keys: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """Documents of keys that one shard may hold; neighbours are read in one go, up to a bound."""
    from pyarrow import fs

    store, file = fs.FileSystem.from_uri(path)
    with store.open_input_file(file) as f:
        shard = Shard(f)
        ids = keys.drop_null().to_numpy()
        first, many = shard.find(ids)
        rows = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        owner, known = np.repeat(ids, many), np.ones(len(rows), bool)
        if keys.null_count:
            rows = np.concatenate([rows, np.arange(shard.nulls)])
            owner, known = np.concatenate([owner, np.zeros(shard.nulls, np.int64)]), np.concatenate([known, np.zeros(shard.nulls, bool)])
        by = np.argsort(rows)
        rows, owner, known = rows[by], owner[by], known[by]
        runs = [0, *(np.flatnonzero(np.diff(rows) != 1) + 1).tolist(), len(rows)]
        for a, end in zip(runs, runs[1:]):
            while a < end:
                here = int(rows[a])
                until = max(here + 1, int(np.searchsorted(shard.offsets, shard.offsets[here] + _READ_BLOCK // 4, "right")) - 1)
                b = min(end, a + until - here)
                at = shard.offsets[here : here + b - a + 1]
                wide, cut = shard.ids(here, here + b - a).astype("<u4"), at - at[0]
                crc = [zlib.crc32(wide[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(owner[a:b], pa.int64(), mask=~known[a:b]), pa.array(at[:-1] + base, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                a = b


def token_index(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids (null text: empty; end id appended) in ``doc_id`` order, and looks each document up by key.

    Null ids come first and are read by place; rows that repeat an id share one slot of the index. An empty table gives
    no rows. Only the id and text columns are read, so further columns cannot clash. Very long texts are one row each.
    """
    folder = folder or new_path(docs.sparkSession, "token-ids")
    manifest = write_shards(docs, folder, id_col, text_col, tokenizer)
    return read_documents(manifest, docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct())
