"""The classifier and the language identifier: held-out accuracy, and the odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, quality
from tessella.llm.common import crc_mod, sample_by_hash

WORDS = {"en": "the of and to in is that was for it with".split(), "de": "der die und das ist nicht ein mit für auf".split(), "xx": "zq qz zzq qqz zqz".split()}


def text(rng, words, n):
    return " ".join(rng.choice(words, n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        lang = list(WORDS)[i % 3]
        good = i % 4 != 0
        body = text(rng, WORDS[lang], int(rng.integers(5, 60)))
        rows.append((i, body if good else body.replace(" ", "*** ").upper(), lang, "s", 0, 1.0, 5, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, quality int").repartition(3)


ODD = [(901, None), (902, ""), (903, " \n"), (904, "123 !!"), (905, "x" * 300_000), (905, "the of"), (None, "the of and to")]


def odd(spark):
    return spark.createDataFrame([(k, t, None, None) for k, t in ODD], "doc_id long, text string, lang string, source string")


def test_language(spark, corpus):
    model = langid.fit(corpus, crc_mod(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in langid.identify(corpus, model).collect()}
    held = [r for r in corpus.where(crc_mod(F.col("doc_id"), 4) == 2).collect()]
    assert len(held) > 50 and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    rest = langid.identify(odd(spark), model).collect()
    assert len(rest) == len(ODD) and all(0 <= r.score <= 1 for r in rest)
    assert {r.doc_id: r.lang_pred for r in rest if r.doc_id in (901, 902, 903, 904)} == dict.fromkeys((901, 902, 903, 904), "und")
    assert langid.identify(corpus.where("false"), model).count() == 0
    same = langid.fit(corpus.repartition(5), crc_mod(F.col("doc_id"), 4) != 2)
    assert same.languages == model.languages and np.allclose(same.logs, model.logs)


def test_language_without_labels(spark):
    model = langid.fit(odd(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd(spark), model).collect()} == {"und"}


def test_blocks_lose_no_ngram(monkeypatch):
    body = "abc déf ghijklmnop qrstu vw"
    whole = sorted(np.concatenate(list(langid.buckets(body))).tolist())
    for size in (1, 2, 3, 5, 9):
        monkeypatch.setattr(langid, "_BLOCK", size)
        assert sorted(np.concatenate(list(langid.buckets(body))).tolist()) == whole


def test_scores_are_the_plain_product():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], np.log([0.5, 0.5]), np.log(rng.random((langid.BUCKETS, 2))))
    for body in ("hello", "hello there " * 900):
        total = model.prior + sum(model.logs[b] for part in langid.buckets(body) for b in part)
        assert model.score(body)[0] == "ab"[int(np.argmax(total))]


def test_batches_are_the_plain_product():
    """Labels and posteriors of a batch, whatever stands beside a text in it."""
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], np.log([0.5, 0.3, 0.2]), np.log(rng.random((langid.BUCKETS, 3)) + 0.5))
    texts = ["ab", "x", None, "Hello There", "", "123", "İstanbul ß", "zz" * 70, "q", "\ud800a", "y " * 400, "end"]
    for room in (1, 60, 10**6):
        langid._GATHER, kept = room * langid.N * 3, langid._GATHER
        got = model.scores(texts)
        langid._GATHER = kept
        for body, (label, p) in zip(texts, got):
            if not body or not any(c.isalpha() for c in body):
                assert (label, p) == ("und", 0.0)
                continue
            total = model.prior + sum(model.logs[b] for part in langid.buckets(body) for b in part)
            odds = np.exp(total - total.max())
            assert label == "abc"[int(np.argmax(total))] and abs(p - odds.max() / odds.sum()) < 1e-9


def test_clashing_names_are_an_error(spark, corpus):
    model = langid.Model(["a"], np.zeros(1), np.zeros((langid.BUCKETS, 1)))
    with pytest.raises(ValueError, match="already"):
        langid.annotate(corpus, model, lang_out="lang")


def plain_tree(g, h, leaves, reg, least):
    """Leaf values by trying every cut of every part."""
    parts = [list(range(len(g)))]
    gain = lambda p: sum(g[i] for i in p) ** 2 / (sum(h[i] for i in p) + reg)
    while len(parts) < leaves:
        best = (1e-9, None)
        for p in parts:
            for at in range(1, len(p)):
                a, b = p[:at], p[at:]
                if sum(h[i] for i in a) >= least and sum(h[i] for i in b) >= least and gain(a) + gain(b) - gain(p) > best[0]:
                    best = (gain(a) + gain(b) - gain(p), (p, a, b))
        if best[1] is None:
            break
        p, a, b = best[1]
        parts = [x for x in parts if x is not p] + [a, b]
    out = [0.0] * len(g)
    for p in parts:
        for i in p:
            out[i] = sum(g[j] for j in p) / (sum(h[j] for j in p) + reg)
    return out


def test_tables_are_those_of_plain_boosting():
    rng = np.random.default_rng(8)
    x = rng.random((300, 3))
    y = (x[:, 0] + 0.3 * rng.random(300) > 0.6).astype(int)
    model = quality.train(x, y, n_bins=6, rounds=5, pairs=0, pair_rounds=0)
    margin = [model.base] * 300
    bins = [[sum(v >= e for e in model.edges[j]) for v in x[:, j]] for j in range(3)]
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    for _ in range(5):
        for j in range(3):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for i in range(300):
                p = 1 / (1 + np.exp(-margin[i]))
                g[bins[j][i]] += y[i] - p
                h[bins[j][i]] += p * (1 - p)
            step = [0.1 * v for v in plain_tree(g, h, 3, 1.0, 2.0)]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
            margin = [m + step[b] for m, b in zip(margin, bins[j])]
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.array(margin))))


def test_pair_scores_are_sums_of_entries():
    rng = np.random.default_rng(9)
    x = rng.random((500, 4))
    model = quality.train(x, ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.4)).astype(int), n_bins=8, rounds=3, pairs=2, pair_rounds=4)
    for row, got in zip(x[:50], model.score(x[:50])):
        b = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.base + sum(t[i] for t, i in zip(model.tables, b))
        total += sum(t[model.coarse[i][b[i]]][model.coarse[j][b[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_labels_that_repeat_an_id(spark, corpus):
    labels = corpus.select("doc_id", "quality")
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(0, None)] * 50, "doc_id long, quality int"))
    one, two = (quality.fit(corpus, x, F.lit(True), sample=10_000) for x in (labels, again))
    assert np.allclose(one.score(np.eye(len(quality.FEATURES))), two.score(np.eye(len(quality.FEATURES))))


def test_quality(spark, corpus):
    labels = corpus.select("doc_id", "quality")
    model = quality.fit(corpus, labels, crc_mod(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in quality.score(corpus, model).collect()}
    held = corpus.where(crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert len(held) > 50 and np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.97
    rest = quality.score(odd(spark), model).collect()
    assert len(rest) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rest)
    again = quality.fit(corpus.repartition(7), labels.repartition(2), crc_mod(F.col("doc_id"), 5) != 0)
    assert np.allclose(again.score(np.eye(len(quality.FEATURES))), model.score(np.eye(len(quality.FEATURES))))


def test_quality_without_contrast(spark, corpus):
    empty = quality.fit(corpus, corpus.select("doc_id", "quality").where("false"), F.lit(True))
    one = quality.fit(corpus, corpus.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    assert len({r.score for r in quality.score(corpus, empty).collect()}) == 1
    assert all(r.score > 0.9 for r in quality.score(corpus, one).collect())


def test_pairs_are_learned():
    rng = np.random.default_rng(2)
    x = rng.random((4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.train(x[:3_000], y[:3_000], pairs=3)
    assert np.mean((model.score(x[3_000:]) > 0.5) == y[3_000:]) > 0.95


def test_features_of_any_text():
    for body in (None, "", "\ud800", "a" * 1_000_000, "\n\n", "١٢٣", "\x00"):
        row = quality.features(body)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()


def test_sample_is_bounded_and_stable(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    a = sample_by_hash(ids, "k", 1_000)
    assert 800 < a.count() < 1_200 and a.exceptAll(sample_by_hash(ids.repartition(9), "k", 1_000)).count() == 0
    assert sample_by_hash(ids, "k", 20_000).count() == 20_000
