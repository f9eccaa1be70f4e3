"""Source mixing against a plain computation of targets, and how near the mix comes."""

import re

import numpy as np
import pytest

from tessella.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target double, copies int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1.0, 1) for i, t, s in rows], SCHEMA).repartition(3)


def plain_targets(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(keys)}
    left, free, out = 1.5 * sum(sizes.values()), set(keys), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def rows(seed, n=400, sources=("b", "a", None, "é", "Z", "")):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(rng.choice([0, 1, 2, 5, 40, 300], p=[0.05, 0.2, 0.2, 0.25, 0.2, 0.1]))
        hot = rng.random() < 0.4
        out.append((i, None if k == 0 and i % 2 else " \n".join(["w"] * k), sources[0] if hot else sources[int(rng.integers(0, len(sources)))]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    data = rows(seed)
    got = {r.doc_id: r for r in mixing.mix(table(spark, data)).collect()}
    assert len(got) == len(data)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    total: dict = {}
    for i, _, s in data:
        total[s] = total.get(s, 0) + size[i]
    want, taken = plain_targets(total), dict.fromkeys(total, 0)
    for i, _, s in data:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s], (s, taken[s], want[s])  # a few dozen documents a source
    again = {r.doc_id: r.taken for r in mixing.mix(table(spark, data).repartition(5)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mixed_documents(spark):
    data = rows(3, 200)
    df = table(spark, data)
    taken = {r.doc_id: r.copies * (r.size > 0) for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    seen: dict = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in taken.items() if n}


def test_edges(spark):
    assert mixing.mix(table(spark, []).where("false")).count() == 0
    assert mixing.mixed_documents(table(spark, [(1, "a", "s")]).where("false")).count() == 0
    blank = mixing.mix(table(spark, [(1, None, "s"), (2, " ", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2
    same = mixing.mix(table(spark, [(7, "a b", "s")] * 4 + [(None, "a b", "s")] * 3 + [(8, "c", "t")])).collect()
    assert len(same) == 8 and all(r.taken <= 2 * r.size for r in same)


def test_word_counts(spark):
    from tessella.llm.common import n_words

    texts = [None, "", " ", "a", " a b ", "a\u00a0b\tc", "x\ny\r\nz\x0bq\fw", "é☃ 日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.fixture
def dealt_out(spark):
    """A session that keeps 64 partitions after each shuffle, however few rows there are."""
    kept = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_cost_few_tasks(dealt_out):
    """What the mix decides fits a few rows a source; the tasks that make it are the driver's memory and event log."""
    sc, made = dealt_out.sparkContext, mixing._rows(table(dealt_out, rows(1)), "doc_id", "source", "text").cache()
    made.count()
    sc.setJobGroup("decide", "")
    decided = mixing.decisions(made, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("decide") for s in status.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    made.unpersist()
    assert decided.rdd.getNumPartitions() < 64 and tasks < 2500
