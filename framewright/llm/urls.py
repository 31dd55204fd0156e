"""URL filter: host and path rules, then trust and distrust propagated over the host graph.

Hosts of allowed pages seed a personalised PageRank along the edges, hosts of blocked pages one along
the reversed edges. A page that no rule fits gets its host's verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import spread_join, stored

#: The rules of the query; (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def folded(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = folded(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, "^([^/?#]*)", 1)) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def linked_hosts(html: Column) -> Column:
    """Hosts (A-Z lower-cased) of the page's links with a host of their own, ``scheme://host`` or ``//host``; null html has none."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), F.lit(1))
    return F.transform(found, folded)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of ``pages(host, links)``: links between hosts, and each host with its parent domain, both ways.

    Relative links stay on their host and make no edge.
    """
    out = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> '' and src <> dst")
    out = out.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    named = pages.select("host").distinct().union(out.select(F.col("dst"))).distinct().where("host like '%.%'")
    labels = F.split("host", r"\.")
    chain = named.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda i: F.concat_ws(".", F.slice(labels, i + 1, F.size(labels))))).alias("child")).distinct()
    up = chain.select(F.col("child").alias("src"), F.expr("substring(child, instr(child, '.') + 1)").alias("dst")).where("dst like '%.%'")
    both = up.union(up.select(F.col("dst"), F.col("src"))).withColumn("weight", F.lit(1.0))
    return out.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def settled(edges: pa.Table, hosts: pa.Table, damping: float, tolerance: float) -> pa.Table:
    """Ranks of one block's ``hosts(kind, host, inflow, last)``, whose ``edges(kind, src, dst, share)`` inside the block are followed until they change nothing more.

    ``inflow`` is what restarts and other blocks bring; ``last`` is handed on.
    """
    kind = hosts["kind"].to_pylist()
    at = {key: i for i, key in enumerate(zip(kind, hosts["host"].to_pylist(), strict=True))}
    src, dst = ([at[key] for key in zip(edges["kind"].to_pylist(), edges[c].to_pylist(), strict=True)] for c in ("src", "dst"))
    src, dst, share = np.array(src, "i8"), np.array(dst, "i8"), edges["share"].to_numpy() * damping
    inflow = hosts["inflow"].to_numpy()
    rank, change = inflow, 1.0
    while change >= tolerance and len(src):
        following = inflow + np.bincount(dst, weights=rank[src] * share, minlength=len(inflow))
        rank, change = following, float(np.abs(following - rank).sum())
    return pa.table({"kind": kind, "host": hosts["host"], "rank": rank, "last": hosts["last"]})


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-12, block_edges: int = 200_000, share: int = 10_000) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank, run until a round changes the ranks by less than ``tolerance`` in all.

    ``seeds(host, trust, distrust)`` hold shares that sum to one each. Trust follows the edges, distrust
    the reversed ones; both run in one pass with a kind column. A host without edges keeps its
    restart share only. Hosts are dealt by hash to blocks of about ``block_edges`` edges. A round gathers what flows
    into each block from others, and follows the edges inside it until they add nothing; where all edges lie in
    one block, one round is all. A round's change is at most ``damping`` times the last one's, so the rounds end, and
    what is left out is less than damping / (1 - damping) times the tolerance. The tables' size is that of the
    host graph; each round's ranks are stored. The edges of a hub are dealt to parts of about ``share`` edges by
    their other end.
    """
    kinds = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("weight")))
    total = stored(kinds.groupBy("kind", "src").agg(F.sum("weight").alias("total"), F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts")), "host-totals")
    flow = spread_join(kinds, total, ["kind", "src"], ["dst"]).select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "dst", (F.col("weight") / F.col("total")).alias("share"))
    flow = stored(flow, "host-flow")
    parts = total.select("kind", F.col("src").alias("host"), "parts")
    seed = stored(seeds.selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)").where("seed > 0"), "host-seeds")
    blocks = max(1, -(-(flow.count() + seed.count()) // block_edges))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    inside = flow.where(block("src") == block("dst")).select("kind", "src", "dst", "share", block("src").alias("block"))
    outside = flow.where(block("src") != block("dst"))
    still = flow.select("kind", F.explode(F.array("src", "dst")).alias("host")).distinct().select("kind", "host", F.lit(0.0).alias("inflow"), F.lit(0.0).alias("last"))
    base = stored(seed.select("kind", "host", F.col("seed") * (1 - damping), F.lit(0.0)).union(still).toDF("kind", "host", "inflow", "last"), "host-restarts")
    rank = seed.select("kind", "host", F.col("seed").alias("rank"))
    while True:
        sent = rank.join(parts, ["kind", "host"]).select("kind", F.col("host").alias("src"), "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        passed = sent.join(outside, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("inflow"), F.lit(0.0).alias("last"))
        known = base.union(passed).union(rank.select("kind", "host", F.lit(0.0), F.col("rank"))).groupBy("kind", "host").agg(F.sum("inflow").alias("inflow"), F.sum("last").alias("last")).withColumn("block", block("host"))
        ranks = inside.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda e, h: settled(e, h, damping, tolerance), "kind string, host string, rank double, last double")
        ranks = stored(ranks, "host-rank")
        rank = ranks.drop("last")
        if blocks == 1 or (ranks.agg(F.sum(F.abs(F.col("rank") - F.col("last")))).first()[0] or 0.0) < tolerance:
            break
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(one("trust"), one("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust_share) of ``pages(page_id, url, html)``.

    Without a fitting rule a page is blocked if its host's share of distrust, distrust / (trust +
    distrust), is above ``threshold``; a host that neither rank reaches, and a share that ties with the
    threshold, is allowed. A null or empty html links to nothing; a null url, or one without ``://``, has an
    empty host that neither rank reaches. Every row is judged, also repeated ones and those with a null page_id,
    and repeated rows count as often as they stand. An empty table has no rows.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(linked_hosts(F.col("html")), F.array().cast("array<string>")).alias("links"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = stored(read.withColumn("fit", fit).select("page_id", "host", "path", "fit.rule", "fit.verdict", "links"), "ruled-pages")
    named = ruled.drop("links")
    counts = named.where("verdict is not null").groupBy("host").agg(F.sum((F.col("verdict") == "allow").cast("double")).alias("allowed"), F.sum((F.col("verdict") == "block").cast("double")).alias("blocked"))
    counts = stored(counts, "host-counts")
    allowed, blocked = (max(x or 0.0, 1.0) for x in counts.agg(F.sum("allowed"), F.sum("blocked")).first())  # two numbers
    seeds = counts.select("host", (F.col("allowed") / allowed).alias("trust"), (F.col("blocked") / blocked).alias("distrust"))
    ranks = propagate(stored(host_edges(ruled.select("host", "links")), "host-edges"), seeds)
    share = F.expr("coalesce(distrust / nullif(trust + distrust, 0), 0D)")
    hosts = named.select("host").distinct().join(ranks, "host", "left").select("host", F.round(share, 9).alias("distrust_share"))
    judged = spread_join(named, hosts, ["host"], ["page_id", "path"])
    verdict = F.coalesce("verdict", F.when(F.col("distrust_share") > threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("distrust_share", F.lit(0.0)).alias("distrust_share"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page by the rules and, where none fits, by its host's propagated trust."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
