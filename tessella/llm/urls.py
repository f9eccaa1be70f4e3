"""URL filters: rules by host and path first, then trust and distrust spread over the host graph; DataFrames only.

Hosts of allowed pages are trusted seeds, hosts of blocked pages are distrusted ones, each weighing by its pages. Trust is
a personalised PageRank along links, distrust one against them. A host without a fitting rule is blocked if its distrust
outweighs its trust by ``ratio``; without evidence it is allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule that fits (of equals the first given), or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, n``: links between different hosts that the pages hold."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1))
    pairs = pages.select(host(F.col(url_col)).alias("src"), F.explode(found).alias("to")).select("src", F.translate("to", _UPPER, _LOWER).alias("dst"))
    return pairs.where("src != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 120, close: float = 1e-6) -> DataFrame:
    """Personalised PageRank, scaled to the seeds' sum: ``host, rank``. links: src, dst, n; seeds: host, weight.

    What a host without links holds goes back to the seeds. The plan of a round is cut by a checkpoint; a seed's share
    and a host's rank meet by joins on the host, so nothing here grows on the driver. Rounds go on until less than ``close``
    of the mass moves (at most 90 by default, as a round leaves 0.85 of what moved); if that isn't reached, it is an error.
    """
    seeds = checkpointed(seeds.where("weight > 0"))
    total = seeds.agg(F.sum("weight")).first()[0]
    links = checkpointed(links)
    if not total or not links.limit(1).count():
        return seeds.select("host", F.col("weight").cast("double").alias("rank"))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    edges = checkpointed(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")))
    share = seeds.select("host", (F.col("weight") / total).alias("s"))
    ranks = share.select("host", F.col("s").alias("r"))
    for _ in range(rounds):
        moved = edges.join(ranks, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("p") * F.col("r")).alias("m"))
        held = moved.agg(F.coalesce(F.sum("m"), F.lit(0.0))).first()[0]
        back = 1 - damping * held  # teleports, and what had nowhere to go
        now = moved.select(F.col("dst").alias("host"), (F.col("m") * damping).alias("r")).unionByName(share.select("host", (F.col("s") * back).alias("r"))).groupBy("host").agg(F.sum("r").alias("r"))
        now = checkpointed(now)
        old = ranks.select(F.col("host").alias("__host"), F.col("r").alias("__r"))
        gap = now.join(old, F.col("host") == F.col("__host"), "full").agg(F.sum(F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("__r", F.lit(0.0))))).first()[0]
        ranks = now
        if gap < close:
            break
    else:
        raise RuntimeError(f"spread did not settle in {rounds} rounds")
    return ranks.select("host", (F.col("r") * total).alias("rank"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows are judged
    alike, each counts as a page. An empty table gives no rows; only the named columns are read.
    """
    url = F.col(url_col).cast("string")
    named = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    named = written(named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "url-pages")
    blocked = [r.name for r in rules if r.verdict == "block"]
    by_rule = F.when(F.col("rule").isin(blocked), F.lit("block")).when(F.col("rule").isNotNull(), F.lit("allow"))
    marked = named.withColumn("said", by_rule)
    seeds = checkpointed(marked.where("host != '' and said is not null").groupBy("host").agg(F.sum((F.col("said") == "allow").cast("long")).alias("good"), F.sum((F.col("said") == "block").cast("long")).alias("bad")))
    links = checkpointed(host_links(pages, url_col, html_col))
    trust = spread(links, seeds.select("host", F.col("good").alias("weight")))
    distrust = spread(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds.select("host", F.col("bad").alias("weight")))
    scores = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    scores = checkpointed(scores.groupBy(F.col("host").alias("__host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    out = marked.join(scores, F.col("host") == F.col("__host"), "left").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > F.col("trust") * ratio, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
