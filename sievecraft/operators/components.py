"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialise


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and its neighbours. A hot u is pre-aggregated and its join can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), "_m")
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least_neighbour(edges)
    return down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected graph: one row (node, component) per node that has an edge to another node.

    ``component`` is the least node of the component. Nulls, self loops, both directions and repeated edges are
    allowed and add nothing; an empty edge table gives an empty result. Nothing is collected: a round is two
    aggregations and joins and one table in the shared folder, whose size and hash are observed while it is written.
    Rounds end when a round changes nothing, after a number of them that grows with the logarithm of the nodes.
    """
    a, b = F.col(src), F.col(dst)
    down = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, seen = _written(down.distinct(), "edges")
    while seen[0]:
        step, state = _written(_small_star(_large_star(now).distinct()).where("u != v").distinct(), "star")
        discard(now)
        now, settled, seen = step, state == seen, state
        if settled:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and hash, which tell whether two rounds are equal."""
    seen = Observation()
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])
