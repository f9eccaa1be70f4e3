"""Permutation search, URL filters and WARC archives."""

import base64
import gzip
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import ann, urls, warc


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0, 0.5) for i, r in enumerate(x)] + [(k, v, 1, 0.5) for k, v in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double").repartition(3)


def test_search_recall_and_scores(spark):
    x = np.random.default_rng(0).normal(size=(3_000, 32)).astype(np.float32).astype(float)
    got = ann.search(vectors(spark, x), F.col("id") % 50 == 0).collect()
    hit = 0
    for q in range(0, 3_000, 50):
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11)) and q not in {r.vec_id for r in rows}
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(r.score == d[r.vec_id] for r in rows)
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        d[q] = np.inf
        hit += len({r.vec_id for r in rows} & set(np.lexsort((np.arange(3_000), d))[:10].tolist()))
    assert hit / 600 > 0.9


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (600, []), (700, [None, 1.0])]
    x = np.array([[1, 1]] * 6 + [[2, 2]] * 3)
    got = ann.search(vectors(spark, x, [*bad, (0, [1.0, 1.0])]), F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()
    # the id 0 stands in two equal rows: each asks, and each finds the other
    assert sorted((r.query_id, r.vec_id) for r in got) == sorted([(0, i) for i in range(9)] * 2)
    assert [r.vec_id for r in got if r.rank <= 6] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and got[-1].rank == 9
    none = ann.search(vectors(spark, x).where("false"), F.lit(True))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_footrule_is_the_plain_sum():
    rng = np.random.default_rng(1)
    k, pivots = 5, 12
    order = np.array([rng.permutation(pivots)[:k] for _ in range(40)])
    query = rng.permutation(pivots)[:k]
    place = lambda o, p: o.tolist().index(p) if p in o.tolist() else k
    want = [sum(abs(place(o, p) - place(query, p)) for p in range(pivots)) for o in order]
    lists = ann.post(order, pivots)
    assert ann.footrule(lists, 40, query, k).tolist() == want
    # a query that visits two lists ranks by those alone
    part = [k * (k + 1) + sum(abs(place(o, p) - i) - (k - place(o, p)) - (k - i) for i, p in enumerate(query[:2]) if p in o) for o in order]
    assert ann.footrule(lists, 40, query[:2], k).tolist() == part


def test_search_does_not_depend_on_the_layout(spark):
    x = np.random.default_rng(3).normal(size=(2_500, 16)).astype(np.float32).astype(float)
    x[700:900] = x[0]  # equal vectors
    df = vectors(spark, x, [(7, x[9].tolist()), (7, x[9].tolist()), (100, [1.0, 2.0]), (200, [1.0, 2.5])])
    answers = [sorted(map(tuple, ann.search(df.repartition(n), F.col("id") % 100 == 0, pivots=64, prefix=16, visits=8, rerank=0.02, least=40).collect())) for n in (1, 17)]
    assert answers[0] == answers[1]
    assert {(q, v) for q, _, v, s in answers[0] if s == 0.5} == {(100, 200), (200, 100)}  # another dimension, another index
    mine = [(q, v) for q, _, v, _ in answers[0] if q == v]
    assert not mine


URLS = {
    1: "https://WWW.Example.com/en/1?x#y", 2: "http://example.com/en/77", 3: "http://a.net/de/8", 4: "http://example.net/de/81", 5: "http://shop.org/es/",
    6: "http://shop.org/fr/", 7: None, 8: "no scheme", 9: "x://y", 10: "http://com/en/", 11: "http://notcom/en/", 12: "a://b://c/d", 13: "http://H.net?q=/de/", 14: "http://good.net/x", 15: "http://farm.info/x",
}


def plain_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def pages(spark, html=None):
    rows = [(i, u, (html or {}).get(i), "r", "h") for i, u in URLS.items()]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, host string").repartition(3)


def test_url_rules(spark):
    got = {r.page_id: r for r in urls.judge(pages(spark)).collect()}
    assert len(got) == len(URLS)
    for i, u in URLS.items():
        host, path = plain_url(u)
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name)
        if rule:
            assert got[i].verdict == rule.verdict
    assert got[6].verdict == "block" and got[14].verdict == "allow" and got[7].verdict == got[8].verdict == "allow"
    assert urls.judge(pages(spark).where("false")).count() == 0


def plain_spread(links, seeds, damping=0.85, rounds=200):
    total = sum(seeds.values())
    hosts = sorted({h for a, b, _ in links for h in (a, b)} | set(seeds))
    s = {h: seeds.get(h, 0) / total for h in hosts}
    out = {h: sum(n for a, _, n in links if a == h) for h in hosts}
    r = dict(s)
    for _ in range(rounds):
        m = dict.fromkeys(hosts, 0.0)
        for a, b, n in links:
            m[b] += r[a] * n / out[a]
        held = sum(m.values())
        r = {h: damping * m[h] + (1 - damping * held) * s[h] for h in hosts}
    return {h: v * total for h, v in r.items()}


def test_spread(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "a", 1), ("c", "e", 1)]
    seeds = {"a": 3, "d": 1}
    got = urls.spread(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, weight long"), rounds=60, close=1e-9)
    want = plain_spread(links, seeds)
    assert {r.host: round(r["rank"], 6) for r in got.collect()} == {h: round(v, 6) for h, v in want.items() if v}


def test_distrust_runs_against_links(spark):
    farm = '<a href="http://shop.org/es/1">x</a> <a class=b href=//shop.org/q>y</a>'
    got = {r.page_id: r for r in urls.judge(pages(spark, {15: farm, 3: "<a href='https://GOOD.net/x'>z</a>"})).collect()}
    assert got[15].verdict == "block" and got[15].distrust > 0 and got[14].trust > 0 and got[14].verdict == "allow"


HTML = {1: "<p>x</p>", 2: "<p>x</p>", 3: None, 4: "", 5: "é☃", 6: "y" * 200_000, 7: "<p>x</p>", 9: "WARC/1.1\r\n\r\n"}


def web(spark, extra=()):
    rows = [(i, f"http://h/{i}\r\n é", h, "t") for i, h in HTML.items()] + [(i, None, h, "t") for i, h in extra]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def test_warc_round_trip(spark):
    got = {r.page_id: r for r in warc.round_trip(web(spark)).collect()}
    first: dict = {}
    for i, h in sorted(HTML.items()):
        first.setdefault(h or "", i)
    for i, h in HTML.items():
        body = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))


def test_warc_edges(spark, tmp_path):
    assert warc.round_trip(web(spark).where("false")).count() == 0
    got = warc.round_trip(web(spark, [(None, "<p>x</p>"), (None, "q"), (1, "<p>x</p>")])).collect()
    assert len(got) == len(HTML) + 3 and sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]
    assert [r.record_type for r in got if r.page_id == 1] == ["response", "response"]
    small = warc.round_trip(web(spark), least=9).collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 9)
    index = warc.write_archives(web(spark), f"file://{tmp_path}/w")
    back = warc.read_records(index, F.col("page_id").isin(5, 2), payloads=True).collect()
    assert {r.page_id: r.payload for r in back} == {5: "é☃".encode(), 2: None}
    for r in index.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_spans():
    places = [(0, 10), (10, 5), (100_000, 10), (100_020, 5), (9_000_000, 9_000_000), (18_000_001, 1)]
    out = warc.spans(places, gap=50, most=1_000_000)
    assert [(a, b) for a, b, _ in out] == [(0, 15), (100_000, 100_025), (9_000_000, 18_000_000), (18_000_001, 18_000_002)]
    assert sorted(i for _, _, held in out for i in held) == list(range(6))
