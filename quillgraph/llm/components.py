"""Connected components of links, by alternating large-star and small-star rounds.

Each round writes its edges to the shared folder, so lineage stays short and a lost
executor costs one round; a round is one job, which also tells whether it changed an
edge.  Neighbour minima are partial aggregates, so a hub costs one row a task before
the shuffle.

Defined results: links of a node to itself, links with a null end and repeated links
add nothing; the order of a link's ends does not count; nodes of equal neighbourhoods
are told apart by their ids only; no link gives no row; other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import observed, sized


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each larger neighbour of a node points at the least node of its neighbourhood, the node included."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = sized(both.join(sized(least, rows), "u"), rows)
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node and its smaller neighbours point at the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sized(down.groupBy("u").agg(F.min("v").alias("m")), rows)
    joined = sized(down.join(least, "u"), rows)
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return sized(out.where("u != v").distinct(), rows)


def components(links: DataFrame, rows: int) -> DataFrame:
    """(node, component) of every node of the about ``rows`` links (u, v); the component is its least node."""
    edges, before = links.where("u != v").select("u", "v"), None
    while True:
        told = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))}
        edges, now = observed(small_star(large_star(edges, rows), rows), "links", told)
        # a round that changes no edge has made stars of all components
        if now == before:
            break
        before, rows = now, max(1, now["n"])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        sized(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), rows)
    )
