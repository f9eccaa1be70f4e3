"""Connected components of a link table, by alternating stars; no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def _least(links: DataFrame) -> DataFrame:
    """``u, m``: each first end's smallest second end, or itself. Keys are recoded so that the join that follows deals
    both of its sides anew, which lets Spark split a hub's links over tasks."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(1)).alias("k"), F.least("u", "m").alias("m"))


def _joined(links: DataFrame) -> DataFrame:
    return links.withColumn("k", F.col("u").bitwiseXOR(F.lit(1))).join(_least(links), "k").drop("k")


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, root`` for each end of a link; root is the smallest node reachable. Links of a node to itself are ignored."""
    now = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v").distinct()
    now, seen = written(now, "links"), None
    for _ in range(rounds):
        # larger neighbours move to the smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # smaller neighbours, and the node, do
        small = _joined(large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        now = written(small, "links")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
