"""Trust spreads until it has settled, however long the chain of links."""

import pytest

from tessella.llm import urls


def chain(spark, n):
    links = [(f"h{i}", f"h{i + 1}", 1) for i in range(n)]
    return spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame([("h0", 2)], "host string, weight long")


def test_far_hosts_are_reached(spark):
    got = {r.host: r["rank"] for r in urls.spread(*chain(spark, 36), close=2e-3).collect()}
    assert len(got) == 37 and got["h36"] == pytest.approx(got["h0"] * 0.85**36, rel=0.02)


def test_unsettled_ranks_are_an_error(spark):
    with pytest.raises(RuntimeError):
        urls.spread(*chain(spark, 5), rounds=2)
