"""Exact dedup, SimHash groups and components against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import exact, simhash
from tessella.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, norm string, sha string, keep_id long"
BASE = " ".join(f"word{i}" for i in range(300))
TEXTS = {
    1: "Hello  world", 2: "Hello world", 3: "Helloworld\n", 4: "hello world", 5: None, 6: "", 7: " \t\n\x0b\f\r", 8: "Ünïcödé ☃", 9: "Ünïcödé\u2003☃",
    10: BASE, 11: BASE + " ", 12: BASE.replace("word150", "other"), 13: "a b", 14: "A B", 15: "x " * 50_000, 16: "x " * 50_001, 17: "a b c d", 18: None,
}


def docs(spark, texts=TEXTS, extra=()):
    rows = [(k, t, "en", "s", 0, 7, "n", "h", 9) for k, t in [*texts.items(), *extra]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), k))
    out = []
    for k, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (x[0], x[1] is None, x[1] or 0))[1]
        out.append((k, keep, len(g), k == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(spark):
    got = exact.exact_groups(docs(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(list(TEXTS.items()))


def test_exact_null_and_repeated_ids(spark):
    extra = [(None, "solo"), (None, "Hello world"), (20, "twin"), (20, "twin"), (20, "other text")]
    got = exact.exact_groups(docs(spark, extra=extra)).collect()
    assert len(got) == len(TEXTS) + 5
    twins = [r for r in got if r.doc_id == 20 and r.group_size == 2]
    assert sorted(r.kept for r in twins) == [False, True]
    assert [r.kept for r in got if r.doc_id == 20 and r.group_size == 1] == [True]
    assert sorted((r.keep_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, True), (1, False)]
    left = exact.drop_copies(docs(spark, extra=extra))
    assert left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in [*TEXTS.items(), *extra]})


def test_exact_empty(spark):
    none = docs(spark).where("false")
    assert exact.exact_groups(none).count() == 0 and exact.drop_copies(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-2, 2)), max_size=4), st.integers(0, 12))
def test_quotient_filters_merge(parts, q):
    whole = exact.QuotientFilter(q)
    for part in parts:
        one = exact.QuotientFilter(q)
        one.add(np.array(part, np.int64))
        for quotient, (r, c) in one.blocks.items():
            whole.add_block(quotient, r, c)
    got = {int(p): int(n) for k in whole.blocks for p, n in zip(*whole.repeated(k))}
    flat = [x for part in parts for x in part]
    assert got == {x: flat.count(x) for x in flat if flat.count(x) > 1}


def brute_print(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("n", [3, 5])
def test_fingerprints(n):
    for text in [t for t in TEXTS.values() if len(t or "") < 5_000] + ["ÀB c", "a\u00a0b c d"]:
        assert simhash.fingerprint(text, n) == brute_print(text, n)
    long = "p q r s " * 120_000
    assert simhash.fingerprint(long, n) == simhash.fingerprint("p q r s " * 120_000, n) != 0


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("a b c", 42)


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("crowd", [256, 2])
def test_links(spark, radius, crowd):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64).tolist()
    prints = set(base)
    for b in base:
        for _ in range(14):
            prints.add(b ^ sum({1 << int(x) for x in rng.integers(0, 64, rng.integers(1, 6))}))
    prints |= {0, 1, 3, 2**63, 2**32, 2**64 - 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, crowd).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert got == expected and expected


def test_near_groups(spark):
    prints = {k: brute_print(t, 3) for k, t in TEXTS.items() if k not in (15, 16)}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.near_groups(docs(spark, {k: TEXTS[k] for k in prints})).collect()
    assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in got} == {k: (prints[k], want[k]) for k in prints}
    left = simhash.drop_near_copies(docs(spark, {k: TEXTS[k] for k in prints}))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_near_groups_edges(spark):
    assert simhash.near_groups(docs(spark).where("false")).count() == 0
    got = simhash.near_groups(docs(spark, {3: "a b c"}, extra=[(None, "a b c"), (3, "a b c"), (None, "zz")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (3, 3)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (-5, 200), (200, -5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[103] == got[101] == 100 and got[200] == -5
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
