"""Token shards, the perfect hash and packing: exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, tokens

SCHEMA = "doc_id long, text string, lang string, start long, n_tokens long"
ROWS = [(5, "Hello  world"), (3, None), (-2, ""), (9, "a b\nc"), (9, "a b\nc"), (9, "zz"), (None, "null id"), (None, None), (2**62, "x " * 3_000), (11, "é☃ <|endoftext|> y\t\tz")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


def table(spark, rows=ROWS):
    return spark.createDataFrame([(k, t, "en", 1, 1) for k, t in rows], SCHEMA).repartition(3)


def plain(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


ALPHABET = [" ", "  ", "\n", "\n\n", "a", "b.", "é", "\x1c", "'s", "<|endoftext|>", "1", "\t", "日", "!", "\u3000", "\x85", "Z", "|", "#.", "-", "The", "\u00a0", "\r\n"]


def test_encoder_equals_the_library(library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(8_000)] + [None, "", " ", "\n"]
    encode = tokens.Encoder(tokens.default_tokenizer(), memo=50)
    for at in range(0, len(texts), 1_000):
        part = texts[at : at + 1_000]
        flat, place = encode.batch(pa.array(part, pa.string()))
        for text, a, b in zip(part, place, place[1:]):
            assert flat[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_slices_keep_order(library):
    texts = ["some words here", None, "x" * 200, "", "end"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t], pa.string())], ["k", "t"]) for i, t in enumerate(texts)]
    got = list(tokens.Encoder(tokens.default_tokenizer(), at_once=20).documents(iter(batches), 0))
    assert [k for k, _ in got] == list(range(5)) and all(v.tolist() == plain(library, t).tolist() for (_, v), t in zip(got, texts))
    assert list(tokens.Encoder(tokens.default_tokenizer()).documents(iter([]), 0)) == []


def test_token_index(spark, library):
    got = tokens.token_index(table(spark)).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (key, text) in zip(got, order, strict=True):
        ids = plain(library, text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_lookup_by_key(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "LEAST_BYTES", 1)
    rows = [(i % 40, f"text {i}") for i in range(400)] + [(7, "hot")] * 900 + [(None, f"n {i}") for i in range(300)]
    manifest = tokens.write_shards(table(spark, rows), f"file://{tmp_path}/shards")
    listed = manifest.orderBy("shard").collect()
    assert len(listed) > 2 and max(r.n_rows for r in listed) < 900  # a repeated id is dealt over shards
    assert sum(r.first is not None and r.first <= 7 <= r.last for r in listed) > 1
    wanted = spark.createDataFrame([(k,) for k in (0, 7, 39, 40, -5, None)], "doc_id long")
    got = tokens.read_documents(manifest, wanted).collect()
    texts = [t for k, t in rows if k in (0, 7, 39, None)]
    crc = lambda t: zlib.crc32(plain(library, t).tobytes())
    assert sorted((repr(r.doc_id), r.ids_crc32) for r in got) == sorted((repr(k), crc(t)) for k, t in rows if k in (0, 7, 39, None))
    assert len({r.start for r in got}) == len(texts)
    assert {r.doc_id for r in got} == {0, 7, 39, None}


def test_strangers_are_not_found(spark, tmp_path):
    """Keys that get a member's slot and fingerprint are told apart by the key."""
    path = tmp_path / "one.tok"
    keys = np.arange(0, 3_000, 3)
    prints = tokens.fingerprints
    try:
        tokens.fingerprints = lambda k: np.zeros(len(k), np.uint32)
        index = tokens._index(keys, 0, np.arange(len(keys) + 1))
        with open(path, "wb") as f:
            f.write(tokens.MAGIC + np.arange(len(keys), dtype="<u2").tobytes())
            at = f.tell()
            for part in index:
                np.save(f, part)
            f.write(np.array([at, 2], "<i8").tobytes() + tokens.MAGIC)
        with open(path, "rb") as f:
            first, many = tokens.Shard(f).find(np.arange(3_000))
    finally:
        tokens.fingerprints = prints
    assert np.flatnonzero(many).tolist() == keys.tolist() and first[many > 0].tolist() == list(range(1_000))


def test_token_index_empty(spark):
    assert tokens.token_index(table(spark).where("false")).count() == 0


def test_shards_by_key(spark, library, tmp_path):
    manifest = tokens.write_shards(table(spark), f"file://{tmp_path}/shards").collect()
    texts: dict = {}
    for key, text in ROWS:
        texts.setdefault(key, []).append(text)
    found = {}
    for row in manifest:
        with open(row.path.removeprefix("file://"), "rb") as f:
            shard = tokens.Shard(f)
            wanted = np.array([k for k in texts if k is not None] + [1, 2, 7, -9, 123456789], np.int64)
            first, many = shard.find(wanted)
            for key, a, n in zip(wanted.tolist(), first.tolist(), many.tolist()):
                if n:
                    assert key in texts
                    found[key] = sorted(shard.ids(a + i).tolist() for i in range(n))
    assert found == {k: sorted(plain(library, t).tolist() for t in v) for k, v in texts.items() if k is not None}


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash(keys):
    array = np.array(sorted(keys), np.int64)
    assert sorted(tokens.PerfectHash.build(array).slots(array).tolist()) == list(range(len(array)))


def test_perfect_hash_needs_distinct_keys():
    with pytest.raises(ValueError, match="not distinct"):
        tokens.PerfectHash.build(np.array([1, 1]))


@pytest.mark.parametrize("n", [1, 2, 3, 511, 512, 513, 700, 1023, 1024, 1025, 9_999])
def test_cuts(n):
    out = packing.cuts(n)
    assert sum(out) == n and all(0 < x <= 1024 for x in out) and len(out) <= n // 1024 + 3


def check_pieces(rows, ids_of):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append(r)
    for key, ids in ids_of.items():
        at = 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[key], key=lambda r: r[1]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, sum(map(len, ids_of.values()))


@pytest.mark.parametrize("seed", [0, 1])
def test_packer(seed):
    rng = np.random.default_rng(seed)
    ids = {i: rng.integers(0, 50_000, int(n)).astype("<u4") for i, n in enumerate(rng.choice([1, 2, 3, 17, 100, 341, 600, 1024, 3_000], 500))}
    packer = packing.Packer(7 << 36)
    for key, v in ids.items():
        packer.add(key, v)
        assert all(len(waiting) < k for k, waiting in packer._open.items())
    packer.finish()
    padding, total = check_pieces(packer.rows, ids)
    assert padding < 0.01 * total and min(r[5] for r in packer.rows) == 7 << 36


def test_pack(spark, library):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    got = [tuple(r) for r in packing.pack(table(spark, rows)).collect()]
    padding, total = check_pieces(got, {i: plain(library, t) for i, t in rows})
    assert padding < 0.01 * total
    assert packing.pack(table(spark).where("false")).count() == 0
    assert packing.pack(table(spark)).where("doc_id is null").count() >= 2
