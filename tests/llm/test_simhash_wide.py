"""Near copies by wide fingerprints against all pairs of plain shingle sets, and the pipeline's stage."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from tessella.llm import simhash_wide as wide
from test_dedup import brute_components


def plain(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def planted():
    """Groups of texts with some words replaced: similarities on both sides of 0.8, chains, a large group, odd rows."""
    rng, texts = random.Random(7), {}
    for group in range(40):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.randrange(60, 500))]
        for copy in range(40 if group == 0 else 4):
            words = list(base)
            for _ in range(0 if not copy else max(1, int(len(base) * rng.choice((0.005, 0.01, 0.02, 0.03, 0.05))))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
    return texts | {1_000: None, 1_001: " ", 1_002: "A b", 1_003: "a B\n", 1_004: "a b c", 1_005: texts[9].upper()}


def finer(got, want):
    """Whether no component of ``got`` reaches over two of ``want``."""
    return all(len({want[k] for k in got if got[k] == c}) == 1 for c in set(got.values()))


@pytest.fixture(scope="module")
def texts():
    return planted()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0, 9) for k, t in texts.items()], "doc_id long, text string, lang string, source string, fp long, gone_id int").repartition(3)


def test_stage_drops_copies_of_similarity_0_8(spark, texts, docs):
    sets = {k: plain(t) for k, t in texts.items()}
    want = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    got = {r.doc_id: r.component_id for r in wide.near_groups(docs).collect()}
    assert set(got) == set(want) and finer(got, want)
    # of the copies that all pairs find, at most one in a hundred may be missed
    assert len(want) - len(set(got.values())) >= 0.99 * (len(want) - len(set(want.values())))
    kept = cp.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs.columns


def test_crowded_keys_give_the_same(docs):
    answers = [sorted(map(tuple, wide.near_groups(docs, crowd=n).collect())) for n in (2, 10**6)]
    assert answers[0] == answers[1]


def test_bits_lean_as_their_shingles_do():
    hashes = wide.shingles(" ".join(f"w{i}" for i in range(5_000)))
    parts = sum(wide.lean(h) for h in np.array_split(hashes, 7))
    assert (wide.lean(hashes) == parts).all() and abs(parts).max() < 6 * len(hashes) ** 0.5
    head, keys, low = wide.sketch(hashes)
    leaning = wide.lean(hashes)
    for seg in range(wide.SEGMENTS):
        part = leaning[seg * wide.WIDTH : (seg + 1) * wide.WIDTH]
        assert keys[seg] == sum(1 << i for i, x in enumerate(part) if x > 0)
        flips = sorted(range(wide.WIDTH), key=lambda i: (abs(part[i]), i))[: wide.FLIPS]
        assert low[seg * wide.FLIPS : (seg + 1) * wide.FLIPS].tolist() == [1 << i for i in flips]
    assert head & (2**64 - 1) == sum(1 << i for i, x in enumerate(leaning[7::8]) if x > 0)


def test_edge_of_similarity(spark):
    base = [f"w{i}" for i in range(94)]  # 90 shingles; one more word changes none of them
    docs = {0: base, 1: base + [f"x{i}" for i in range(22)], 2: base + [f"y{i}" for i in range(23)], 3: [*base[:50], "z", *base[51:]]}
    sets = {k: plain(" ".join(w)) for k, w in docs.items()}
    want = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in wide.near_groups(rows).collect()} == want == {0: 0, 1: 0, 2: 2, 3: 0}


def test_empty_null_long_and_repeated_ids(spark):
    long = " ".join(f"w{i % 7_919}x{i % 13}" for i in range(300_000))
    rows = spark.createDataFrame([(3, "a b c"), (None, "a b c"), (3, "a b c"), (None, "zz"), (8, long), (9, long + " end"), (9, "q")], "doc_id long, text string")
    got = wide.near_groups(rows).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (3, 3), (8, 8), (9, 8), (9, 9)]
    assert wide.drop_near_copies(rows).count() == 5  # of a repeated id all rows go
    assert wide.near_groups(rows.where("false")).count() == 0


def test_odd_sketches_lose_no_similar_pair(spark):
    rng, rows, want = random.Random(3), [], []
    for i in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.choice((1, 5, 40, 150, 900)))]
        other = base[rng.randrange(len(base) // 3 + 1) :] + [rng.getrandbits(64) for _ in range(rng.randrange(len(base) // 3 + 1))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        rows.append((i, len(a), len(b), wide.parities(a), wide.parities(b)))
        want.append(alike(set(a.tolist()), set(b.tolist())))
    df = spark.createDataFrame(rows, "i int, n int, m int, x array<long>, y array<long>")
    may = {r.i for r in df.where(wide._may(*(df[c] for c in "nmxy"))).collect()}
    similar = {i for i, yes in enumerate(want) if yes}
    assert similar <= may and 50 < len(similar) and len(may) < 300
    assert wide.parities(np.array([3, 3 + 256, 64], np.uint64)) == [0, 1, 0, 0]


def test_texts_that_share_a_passage_are_not_paired_up(spark):
    """Similarity of about 0.7 among all of a cloud: none is linked, and few pairs get as far as the sets."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(124)]
    texts = {i: " ".join([*passage, *(f"w{rng.randrange(10**9)}" for _ in range(26))]) for i in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in wide.near_groups(rows).collect()} == set(texts)
