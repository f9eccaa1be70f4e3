"""The driver contract: names, oracles, and each query against its SQL on the small tables."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.FLAGSHIP in entry.queries()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "sent_id", "sent"] and df.limit(1).count()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    cols = sorted(ours.columns)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    theirs = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(names) == cols
    rows = lambda data: sorted(repr([_plain(r[c]) for c in cols]) for r in data)
    assert rows(ours.collect()) == rows(theirs)


CHANGES = ("clean_inline", "clean_quotes", "toc_leaders", "consecutive_chars", "nospace_sentences", "mask_possessive", "mask_initials", "mask_prepositive", "mask_standard_abbr", "mask_ellipsis", "mask_common", "numbered_list_validity", "alpha_list_validity", "roman_list_validity")


@pytest.mark.parametrize("name", CHANGES)
def test_probes_change_their_texts(spark, name):
    from pyspark.sql import functions as F

    from tessella.plans.probes import PROBES

    probe = next(p for p in PROBES if p.name == name)
    before = spark.read.parquet(f"{SF}/{probe.table}.parquet").select(probe.key, F.expr(probe.text).alias("before"))
    changed = before.join(catalogue.QUERIES[name](spark, SF), probe.key).where("before != result").count()
    assert changed > before.count() // 4
