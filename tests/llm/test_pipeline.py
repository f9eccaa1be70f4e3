"""The pipeline: each stage against a plain version on a small corpus, and the registered queries."""

import re

import __spark_entry__ as entry
import corpus_pipeline as cp
from test_simhash_wide import alike, plain

from tessella.llm import packing, queries, tokens
from tessella.llm.langid import UNKNOWN

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, path):
    english = "the cat and the dog of the house was in that place with it".split()
    german = "der hund und die katze ist nicht das haus mit einem garten für".split()
    rows = []
    for i in range(120):
        words = english if i % 2 else german
        body = " ".join(words[(i * k + k * k) % len(words)] + str(i) * (k % 5 == 0) for k in range(30 + i))
        rows.append((i, body, "en" if i % 2 else "de", f"s{i % 4}" if i % 9 else None, len(body)))
    rows += [(200, rows[5][1], "en", "s1", 0), (201, rows[5][1] + "\n ", "en", "s1", 0), (202, "12 34 !!", None, "s0", 0), (203, None, "en", "s0", 0), (204, rows[8][1].upper(), "de", None, 0), (205, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    for name, stage in cp.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id for r in docs.collect()}
        if name == "language":
            assert after == {r[0] for r in rows} - {202, 203, 205}
        elif name == "exact_dedup":
            assert {r.doc_id for r in before} - after == {5, 200} and 201 in after
        elif name == "simhash_dedup":
            sets = {r.doc_id: plain(r.text) for r in before}
            assert 204 not in after and 8 in after
            for gone in {r.doc_id for r in before} - after:
                assert any(k < gone and alike(v, sets[gone]) for k, v in sets.items() if k != gone)
            kept = sorted(after)
            assert not any(alike(sets[a], sets[b]) for a in kept for b in kept if a < b)
        else:
            size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before)
            mixed = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect())
            assert abs(mixed - 1.5 * size) < 0.02 * size
    encode = tokens.Encoder(tokens.default_tokenizer())
    pieces = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == sum(len(encode(r.text)) // 4 + 1 for r in docs.collect())
    assert max(p.offset + p.length for p in pieces) <= packing.CAPACITY


ODD = "doc_id long, text string, lang string, source string, n_chars long, `__lang_pred` string, gone_id int, own_key string, `__row` int, `__key` int"


def test_stages_take_empty_tables_and_odd_rows(spark):
    """No rows; nulls everywhere, a very long text, repeated rows, and columns of the names that stages use themselves."""
    long = "the cat and the dog " * 60_000
    rows = [(1, "the cat and the dog", "en", "s", 1), (1, "the cat and the dog", "en", "s", 1), (None, "the dog and the cat", "en", None, 1), (2, long, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "der hund", "de", "s", 2)]
    docs = spark.createDataFrame([(*r, "own", 7, "k", 8, 9) for r in rows], ODD).repartition(2)
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.where("false"), "")
        got = stage(spark, docs, "")
        assert empty.count() == 0 and got.count()
        if name != "packing":
            assert got.columns == docs.columns and {tuple(r)[5:] for r in got.collect()} == {("own", 7, "k", 8, 9)}


def test_run_is_the_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    out = cp.run(spark, str(tmp_path))
    assert out.count() and cp.ORACLE_SQL is None and UNKNOWN == "und"


def test_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(names) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
