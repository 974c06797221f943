"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. Each pattern offers its words once at cost 0, again at
cost 1, and so on up to ``epochs`` times (convex repetition costs); sources demand their targets. Where a source
overlaps with no other, the cheapest flow has a closed form, the lesser of its demand and of all its repetitions, and is
computed as a column, however many sources there are. The patterns of overlapping sources are solved together on the
driver; their number is checked. Each pattern then takes whole epochs, and the rest by a seeded order of its documents,
cut by a histogram of hash prefixes: no pattern is ever sorted in one task.

Weights go to sources in the order of their code points, by a sort over ranges, and targets come from a few aggregations
over the table of sources. A pattern's decisions are joined to its documents by broadcast if it holds more than one in
``HOT`` of all rows, as there are fewer than ``HOT`` of those, and by its hash else.

Nulls: a null text has size 0, a null source is a source of its own, ranked last; without sources a document is never
taken. Repeated rows of an id share a rank and a fate, as do rows with a null id; they are added up before they meet in
one task. Documents of size 0 are taken 0 times. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialise
from .common import count_words

WEIGHTS = (5.0, 2.0, 1.0)
#: Patterns of overlapping sources that the driver may hold; more raise an error, as merging them would change the mix.
MAX_PATTERNS = 200_000
#: Patterns that may be broadcast.
HOT = 10_000
#: Sources that one range of their order holds, about.
RANGE = 1_000_000
#: Documents around a pattern's cut that are looked at one by one.
CUT_ROWS = 256
_BITS = 60
_DIGIT = 4


@dataclass
class Mix:
    #: id, size, sources (sorted, array<string>), source_sizes and targets (of these), taken
    rows: DataFrame
    #: source, source_size, target
    sources: DataFrame


def weighted(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The table of distinct sources with a weight each: in turn, by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = -(-sources.count() // RANGE)
    dealt = sources.repartitionByRange(max(1, parts), *order)
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "mix-order")
    first, starts = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        starts.append((r["part"], first))
        first += r["count"]
    start = sources.sparkSession.createDataFrame(starts, "part int, first long")
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int"))
    out = materialise(dealt.join(F.broadcast(start), "part").select("source", "source_size", weight.alias("weight")), "mix-weights")
    discard(dealt)
    return out


def targets(sources: DataFrame, total: int, epochs: int = 3) -> DataFrame:
    """Share ``total`` by weight; what lies beyond ``epochs`` times a source's size is shared again among the others.

    sources: source, source_size, weight. A source once full stays so, as the share of a unit of weight only rises.
    """
    cap = F.col("source_size") * epochs
    unit, n_full = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(unit) > cap
        r = sources.agg(F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, True)).alias("n")).first()
        if r["n"] <= n_full or not r["weight"]:
            break
        unit, n_full = (total - (r["cap"] or 0)) / r["weight"], r["n"]
    share = F.col("weight") * F.lit(unit)
    return sources.select("source", "source_size", F.when(share > cap, cap.cast("double")).otherwise(share).alias("target"))


def flow(patterns: list[tuple[tuple, int]], demand: dict[str | None, float], epochs: int = 3) -> list[int]:
    """Words that each pattern gives. patterns: (sources, words).

    Costs are convex in a pattern's repetitions and the same for all patterns, so the cheapest flow comes from raising
    every pattern's capacity epoch by epoch and augmenting to a maximum each time (greedy on a polymatroid).
    """
    index = {s: k for k, s in enumerate(demand)}
    need = [round(x) for x in demand.values()]
    links = [[index[s] for s in own] for own, _ in patterns]
    users: list[list[int]] = [[] for _ in need]
    for p, own in enumerate(links):
        for s in own:
            users[s].append(p)
    sent = [dict.fromkeys(own, 0) for own in links]
    given = [0] * len(patterns)
    for epoch in range(1, epochs + 1):
        room = [epoch * size - given[p] for p, (_, size) in enumerate(patterns)]
        for p, own in enumerate(links):  # straight routes first
            for s in own:
                x = min(room[p], need[s])
                sent[p][s] += x
                given[p] += x
                room[p] -= x
                need[s] -= x
        for p in range(len(patterns)):
            while room[p] > 0 and any(need):
                before: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                queue, end = deque([("p", p)]), None
                while queue and end is None:
                    kind, k = node = queue.popleft()
                    for nxt in [("s", s) for s in links[k]] if kind == "p" else [("p", q) for q in users[k] if sent[q][k] > 0]:
                        if nxt in before:
                            continue
                        before[nxt] = node
                        if nxt[0] == "s" and need[nxt[1]] > 0:
                            end = nxt
                            break
                        queue.append(nxt)
                if end is None:
                    break
                path = [end]
                while (prev := before[path[-1]]) is not None:
                    path.append(prev)
                path.reverse()
                x = min([room[p], need[end[1]], *(sent[path[k + 1][1]][path[k][1]] for k in range(1, len(path) - 1, 2))])
                for k in range(0, len(path) - 1, 2):
                    sent[path[k][1]][path[k + 1][1]] += x
                    if k + 2 < len(path):
                        sent[path[k + 2][1]][path[k + 1][1]] -= x
                room[p] -= x
                given[p] += x
                need[end[1]] -= x
    return given


def _fill(ranks: pd.DataFrame) -> pd.DataFrame:
    """Around the cut: in seeded order, take what still fits; the nearer of stopping short and one more document."""
    ranks = ranks[ranks["size"] > 0].sort_values("rank")
    left, taken, over = 0 if ranks.empty else int(ranks["rest"].iloc[0]), [], []
    for rank, size in zip(ranks["rank"].tolist(), ranks["size"].tolist(), strict=True):
        if size <= left:
            left -= size
            taken.append(rank)
        else:
            over.append((size, rank))
    if over and (least := min(over))[0] - left < left:
        taken.append(least[1])
    return pd.DataFrame({"key": ranks["key"].iloc[:1], "ranks": [taken][: len(ranks)]})


def _beside(rows: DataFrame, plan: DataFrame, hot: DataFrame, cold: bool) -> DataFrame:
    """Rows with what ``plan`` says of their pattern. hot: keys of patterns that hold many rows; cold: are there others?"""
    if not cold:
        return rows.join(F.broadcast(plan), "key")
    many, few = plan.join(F.broadcast(hot), "key", "left_semi"), plan.join(F.broadcast(hot), "key", "left_anti")
    return rows.join(F.broadcast(many), "key").unionByName(rows.join(F.broadcast(hot), "key", "left_anti").join(few, "key"))


def _given(found: DataFrame, sources: DataFrame, epochs: int) -> DataFrame:
    """Patterns with their sources' sizes and targets, and the words that they give."""
    links = found.select("key", F.posexplode("sources").alias("at", "name")).join(sources, F.col("name").eqNullSafe(F.col("source")))
    own = links.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "source_size", "target"))).alias("own"))
    plan = found.join(own, "key", "left").select("key", "size", "n", "sources", F.col("own.source_size").alias("source_sizes"), F.col("own.target").alias("targets"))
    alone = F.least(F.col("size") * epochs, F.bround(F.get("targets", F.lit(0))).cast("long"))
    plan = plan.withColumn("given", F.coalesce(F.when(F.size("sources") == 1, alone), F.lit(0)))
    several = found.where(F.size("sources") > 1)
    if several.isEmpty():
        return plan
    shared = several.select(F.explode("sources").alias("name")).distinct()
    single = found.where(F.size("sources") == 1).join(shared, F.get("sources", F.lit(0)).eqNullSafe(F.col("name")), "left_semi")
    tangled = several.unionByName(single).select("key", "sources", "size").limit(MAX_PATTERNS + 1).collect()
    if len(tangled) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of overlapping sources: merge sources before mixing")
    tangled.sort(key=lambda p: p["key"])
    names = sources.join(F.broadcast(shared), F.col("source").eqNullSafe(F.col("name")), "left_semi").collect()
    demand = {r["source"]: r["target"] for r in sorted(names, key=lambda r: (r["source"] is None, r["source"] or ""))}
    given = flow([(tuple(p["sources"]), p["size"]) for p in tangled], demand, epochs)
    solved = found.sparkSession.createDataFrame([(p["key"], x) for p, x in zip(tangled, given, strict=True)], "key string, solved long")
    return plan.join(solved, "key", "left").withColumn("given", F.coalesce("solved", "given")).drop("solved")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sources: Column | None = None, weights: tuple[float, ...] = WEIGHTS, epochs: int = 3, seed: int = 17) -> Mix:
    """Mix documents to the sources' target shares. ``sources``: array of the sources a document belongs to."""
    if min(weights) <= 0:
        raise ValueError("weights are positive")
    own = F.array(F.col("source")) if sources is None else F.coalesce(sources, F.array().cast("array<string>"))
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << _BITS))
    rows = docs.select(F.col(id_col).alias("id"), count_words(F.col(text)).alias("size"), F.to_json(F.sort_array(F.array_distinct(own))).alias("key"), order.alias("rank"))
    rows = materialise(rows, "mix-sizes")
    found = materialise(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first(F.from_json("key", "array<string>")).alias("sources")), "mix-patterns")
    whole = found.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("patterns")).first()
    cold = whole["patterns"] > HOT
    hot = found.where(F.col("n") * HOT > whole["n"]).select("key")

    sizes = weighted(found.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    table = targets(sizes, whole["size"], epochs)
    words = F.when(F.col("size") > 0, F.col("size"))
    plan = _given(found, table, epochs).select(
        "key", "n", "sources", "source_sizes", "targets", F.coalesce(F.expr("given div nullif(size, 0)"), F.lit(0)).alias("base"), F.coalesce(F.col("given") % words, F.lit(0)).alias("rest")
    )
    plan = materialise(plan, "mix-plan")
    cuts = _cut(rows, plan.select("key", "n", "rest"), hot, cold)
    ended = materialise(plan.select("key", "sources", "source_sizes", "targets", "base").join(cuts, "key", "left"), "mix-decided")
    discard(cuts)
    discard(plan)

    extra = F.coalesce((F.col("rank") < F.col("low")) | F.array_contains("ranks", F.col("rank")), F.lit(False)).cast("int")
    taken = (F.col("size") * (F.col("base") + extra)).alias("taken")
    return Mix(_beside(rows, ended, hot, cold).select(F.col("id").alias(id_col), "size", "sources", "source_sizes", "targets", taken), table)


def _cut(rows: DataFrame, plan: DataFrame, hot: DataFrame, cold: bool) -> DataFrame:
    """key, low, ranks: of a pattern with a rest, documents ranked below ``low`` are taken once more, and those of ``ranks``.

    Each pattern's cut is narrowed, digit by digit, to a range of ranks with few documents. A pass is one aggregation.
    """
    width = _BITS
    plan = materialise(plan.where("rest > 0").select("key", "n", "rest", F.lit(0).cast("long").alias("low"), F.lit(1 << _BITS).alias("high")), "mix-cut")
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    while width and not (wide := plan.where(F.col("n") > CUT_ROWS)).isEmpty():
        width -= _DIGIT
        digit = F.shiftright(F.col("rank") - F.col("low"), width).alias("digit")
        seen = _beside(rows, wide.select("key", "low", "high"), hot, cold).where(inside).groupBy("key", digit).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        before = F.sum("size").over(Window.partitionBy("key").orderBy("digit")) - F.col("size")
        at = seen.withColumn("before", before).join(wide.select("key", "rest", "low"), "key").where("before <= rest and rest < before + size")
        low = F.col("low") + F.shiftleft("digit", width)
        narrow = at.select("key", "n", (F.col("rest") - F.col("before")).alias("rest"), low.alias("low"), (low + F.lit(1 << width)).alias("high"))
        last, plan = plan, materialise(plan.where(F.col("n") <= CUT_ROWS).unionByName(narrow), "mix-cut")
        discard(last)
    near = _beside(rows, plan.select("key", "low", "high", "rest"), hot, cold).where(inside).groupBy("key", "rank").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    ranks = near.groupBy("key").applyInPandas(_fill, "key string, ranks array<long>")
    out = materialise(plan.select("key", "low").join(ranks, "key", "left"), "mix-cuts")
    discard(plan)
    return out
