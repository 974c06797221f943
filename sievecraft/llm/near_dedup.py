"""MinHash near-dedup by an inverted join over signature coordinates, confirmed on full shingle sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and a signature of ``COORDINATES`` minima.
   Texts with equal sets form a class, which is one vertex with one signature from here on.
2. Each class is posted under its (coordinate, value) pairs. Two sets over the threshold collide in ``least_matches``
   pairs or more but for a chance of ``MISS`` (binomial), so pairs that nothing shares are skipped, a class with fewer
   shared pairs is dropped, and of the others only the prefix, the rarest (shared - least_matches + 1) pairs, is
   posted: any two that collide often enough meet in both prefixes.
3. A posting list isn't expanded into pairs. Its most central member is compared with the others first, and the links
   found are merged into components. Lists within one component are skipped; what is left compares members of
   different components only: by pairs in short lists, by pairs of blocks in long ones, where a matrix product
   counts all intersections and only links that join components come out.
4. Each row gets its class's component. Classes of many rows are joined by broadcast, so no copy is hot.

A pair is linked if 100 * intersection >= percent * union of the full sets. The result has each document's component
(least id that links reach). Sets so small that one shingle more or less breaks the threshold can only be
linked to an equal set.

Nulls: a null text, or one without words, has the empty set and is linked to nothing. A row with a null id is linked by
its text; a component without any id has a null component_id. Rows that repeat an id and text are one document; an id
with several texts has a row for each and is linked by all of them. Texts with fewer words than a shingle are one
shingle. Very long texts are whole. Columns other than id and text are only passed on. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.lineage import discard, materialise
from .common import WORD, small_batches, utf8

COORDINATES = 64
#: Chance that a pair right at the threshold collides too seldom to be found.
MISS = 1e-6
#: Posting lists up to this many members are compared by pairs.
SHORT = 24
#: Members and shingles that one block holds at most, about.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1_000_000
#: Classes whose rows are joined by broadcast at most, and the rows that such a class has at least.
HOT, LEAST_HOT = 50_000, 256
#: Rank of rows without an id: after all others.
_LAST = (1 << 63) - 1

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_matches(percent: int) -> int:
    """The most collisions that a pair at the threshold misses with a chance of ``MISS`` at most."""
    p, total = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        total += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if total > MISS:
            return max(1, t)
    return COORDINATES


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


class Shingler:
    """Distinct shingle hashes of UTF-8 text, sorted."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: bytes) -> np.ndarray:
        own = text.lower().split()
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in own:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((known[w] for w in own), dtype=np.uint64, count=len(own))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = self.words(text) if text else np.zeros(0, dtype=np.uint64)
        if not len(words):
            return words
        width = min(self.width, len(words))
        out = _mix(words[: len(words) - width + 1] + np.uint64(width))
        for k in range(1, width):
            out = _mix(out + words[k : len(words) - width + 1 + k])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value under each of ``COORDINATES`` permutations, each mixed with its coordinate."""
    out = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(shingles), 4096):
        part = (shingles[start : start + 4096, None] ^ _SEEDS) * _A
        part ^= part >> np.uint64(32)
        part *= _B
        np.minimum(out, part.min(0), out=out)
    return _mix(out + _SEEDS)


def _signer(width: int):
    @F.pandas_udf("n_shingles long, digest binary, signature array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for part in parts:
            rows = []
            for text in part:
                own = shingler(text)
                rows.append((len(own), xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None, signature(own).view(np.int64) if len(own) else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "signature"])

    return run


def _shingle_sets(width: int):
    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(width)
        for part in parts:
            yield part.map(lambda text: shingler(text).tobytes())

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """Pairs with their sets -> linked pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [_linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch.loc[good, ["a", "b"]]

    return run


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirm candidate pairs (a, b): sizes, enough colliding coordinates, then the full sets."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a"), F.col("signature").alias("sig_a"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b"), F.col("signature").alias("sig_b"))
    both = pairs.join(left, "a").join(right, "b").where(_size_fits(F.length("set_a"), F.length("set_b"), percent))
    hits = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(hits >= least_matches(percent)).select("a", "b", "set_a", "set_b").mapInPandas(_confirm(percent), "a long, b long")


def _block_links(percent: int):
    """Members of two blocks of a posting list -> links that join their components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("key").sort_values("key", kind="stable")
        ids = rows["key"].to_numpy(np.int64)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(s) for s in sets])
        _, label = np.unique(rows["component"].to_numpy(np.int64), return_inverse=True)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = times[column] > 1
        rank = np.cumsum(times > 1) - 1
        column, owner = rank[column[shared]], owner[shared]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        width = int(column[-1]) + 1 if len(column) else 0
        for start in range(0, width, 4096):
            a, b = np.searchsorted(column, [start, start + 4096])
            part = np.zeros((len(sets), min(4096, width - start)), dtype=np.float32)
            part[owner[a:b], column[a:b] - start] = 1
            both += part @ part.T
        union = sizes[:, None] + sizes[None, :] - both
        good = np.triu((100 * both >= percent * union) & (label[:, None] != label[None, :]), 1)
        i, j = np.nonzero(good)
        n = label.max() + 1
        _, first = np.unique(label[i] * n + label[j], return_index=True)  # one link between two components will do
        parent = list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for k in first:
            x, y = root(label[i[k]]), root(label[j[k]])
            if x != y:
                parent[x] = y
                out.append((ids[i[k]], ids[j[k]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _prefixes(reps: DataFrame, matches: int) -> DataFrame:
    """(token, key, shared): the rarest shared pairs of each representative that can have a partner."""
    tokens = reps.select("key", F.explode("signature").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    found = tokens.join(shared, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    found = found.where(F.size("own") >= matches).withColumn("shared", F.size("own"))
    return found.select("key", "shared", F.explode(F.slice("own", F.lit(1), F.col("shared") - matches + 1)).alias("t")).select(F.col("t.token").alias("token"), "key", "shared")


def _components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(key, component) of every vertex."""
    found = connected_components(links, "a", "b")
    return vertices.join(found, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("component"))


def _pairs_in_blocks(long_: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, low, high, key, component, shingles): members of long lists, dealt to the pairs of blocks that may join components.

    A component with half a block of members or more has blocks of its own, the others share mixed ones (owner -1).
    Two blocks are compared unless both are one component's, and only mixed blocks are compared with themselves, so a
    list of one large component and a few strays costs a copy of each member per block of strays.
    """
    part = long_.groupBy("token", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    own = (2 * F.col("n") >= BLOCK_ROWS) | (2 * F.col("size") >= BLOCK_SHINGLES)
    part = materialise(part.withColumn("owner", F.when(own, F.col("component")).otherwise(-1)), "dedup-parts")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    pools = part.groupBy("token", "owner").agg(blocks.alias("blocks"))
    name = F.xxhash64("owner", "turn").alias("block")
    every = pools.select("token", "owner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("turn")).select("token", "owner", name)
    every = materialise(every, "dedup-blocks")
    x = every.select("token", F.col("owner").alias("o"), F.col("block").alias("low"))
    y = every.select("token", F.col("owner").alias("p"), F.col("block").alias("high"))
    pairs = x.join(y, "token").where("low < high and (o != p or o = -1) or low = high and o = -1")
    pairs = pairs.select("token", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    member = long_.join(part.select("token", "component", "owner"), ["token", "component"]).join(pools, ["token", "owner"])
    member = member.withColumn("turn", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("token", "key", "component", name)
    return member.join(pairs, ["token", "block"]).select("token", "low", "high", "key", "component").join(sets.select("key", "shingles"), "key")


def _spread(rows: DataFrame, named: DataFrame, on: str, total: int) -> DataFrame:
    """Join rows with the columns of ``named``, which has a row per value of ``on`` and the number ``n`` of its rows.

    Values of many rows are broadcast: they are ``HOT`` at most, as each has more than a share of ``total`` by it. The
    others are joined by shuffle. Rows where ``on`` is null meet nowhere and get nulls.
    """
    bound = total // HOT + LEAST_HOT
    hot, cold = named.where(F.col("n") > bound).drop("n"), named.where(F.col("n") <= bound).drop("n")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in hot.dtypes if c != on]
    alone, full = rows.where(F.col(on).isNull()).select("*", *none), rows.where(F.col(on).isNotNull())
    cold_rows = full.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return alone.unionByName(full.join(F.broadcast(hot), on)).unionByName(cold_rows)


def _all_links(source: DataFrame, classes: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (key) and confirmed links (a, b) between classes; enough of them to connect what is connected."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    reps = classes.where(F.col("size") >= least)
    posted = materialise(_prefixes(reps, least_matches(percent)), "dedup-postings")
    vertices = posted.select("key").distinct()
    wanted = reps.join(vertices, "key", "left_semi").select("key", "at.*", "signature")
    texts = source.groupBy("rank", "hash").agg(F.first("text").alias("text"))  # a hot row is one before the shuffle
    sets = texts.join(wanted, ["rank", "hash"]).select("key", "signature", _shingle_sets(width)("text").alias("shingles"))
    sets = materialise(sets, "dedup-sets")

    # The most central member of a list has most shared pairs.
    centre = posted.groupBy("token").agg(F.min(F.struct((-F.col("shared")).alias("s"), F.col("key").alias("a"))).alias("c"), F.count("*").alias("n")).where("n > 1")
    star = posted.join(centre.select("token", "c.a"), "token").where(F.col("key") != F.col("a"))
    star = star.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
    first = materialise(_links(star, sets, percent), "dedup-links")
    state = materialise(_components(vertices, first), "dedup-state")

    listed = posted.join(state, "key")
    lists = listed.groupBy("token").agg(F.count("*").alias("listed"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = listed.join(lists.where("low < high").select("token", "listed"), "token").join(classes.select("key", "size"), "key")
    open_ = materialise(open_.select("token", "key", "component", "listed", "size"), "dedup-open")
    brief, long_ = open_.where(F.col("listed") <= SHORT), open_.where(F.col("listed") > SHORT)

    x = brief.select("token", F.col("key").alias("a"), F.col("size").alias("n_a"), F.col("component").alias("c_a"))
    y = brief.select("token", F.col("key").alias("b"), F.col("size").alias("n_b"), F.col("component").alias("c_b"))
    pairs = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _size_fits(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()
    links = first.union(_links(pairs, sets, percent))
    if not long_.isEmpty():
        links = links.union(_pairs_in_blocks(long_, sets).groupBy("token", "low", "high").applyInPandas(_block_links(percent), "a long, b long"))
    links = materialise(links, "dedup-all-links")
    vertices = materialise(vertices, "dedup-vertices")
    for done in (posted, sets, first, state, open_):
        discard(done)
    return vertices, links


def _judged(docs: DataFrame, percent: int, width: int, id_col: str, text: str) -> DataFrame:
    """A row per document: id, rank, hash, n_shingles, digest, class_id, component_id, win (rank and hash of the component's first row)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    own, words = F.col(id_col).cast("long"), utf8(F.col(text))
    source = docs.select(own.alias("id"), F.coalesce(own, F.lit(_LAST)).alias("rank"), F.xxhash64(words).alias("hash"), words.alias("text"))
    signed = materialise(source.select("id", "rank", "hash", _signer(width)("text").alias("s")).select("id", "rank", "hash", "s.*"), "dedup-signatures")
    # A vertex per distinct set, named by a number: an id may stand for several texts, or be null.
    at = F.min(F.struct("rank", "hash")).alias("at")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"), at, F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    classes = materialise(classes.withColumn("key", F.monotonically_increasing_id()), "dedup-classes")

    vertices, links = _all_links(source, classes, percent, width)
    found = classes.select("key", "digest", "class_id", "at", "n").join(_components(vertices, links), "key", "left")
    found = materialise(found.withColumn("component", F.coalesce("component", "key")).drop("key"), "dedup-components")
    # Texts of one id are one document: their components are one.
    several = signed.where("id is not null and digest is not null").groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x != y").select("id")
    several = materialise(several, "dedup-several")
    if not several.isEmpty():
        both = signed.join(several, "id").select("id", "digest").distinct().join(found.select("digest", "component"), "digest").select("id", "component").distinct()
        joined = connected_components(both.join(both.groupBy("id").agg(F.min("component").alias("a")), "id"), "a", "component")
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        found = materialise(found.join(joined, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to"), "dedup-joined")
    whole = materialise(found.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min("at").alias("win"), F.count("*").alias("n")), "dedup-whole")
    named = _spread(found.select("component", "digest", "class_id", F.col("n").alias("rows")), whole, "component", found.count())
    named = materialise(named.select("digest", "class_id", "component_id", "win", F.col("rows").alias("n")), "dedup-names")
    for done in (classes, vertices, links, found, several, whole):
        discard(done)
    return _spread(signed.drop("signature"), named, "digest", signed.count())


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, class_id (least id with an equal set), component_id, kept."""
    rows = _judged(docs, percent, width, id_col, text)
    alone = F.col("digest").isNull()
    first = F.col("component_id").isNull() & (F.col("hash") == F.col("win.hash"))
    kept = F.when(alone, True).when(F.col("id").isNull(), first).otherwise(F.col("id") == F.col("component_id"))
    named = [F.when(alone, F.col("id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")]
    return rows.select(F.col("id").alias(id_col), "n_shingles", *named, kept.alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns it came with: the least text hash of its least id, once.

    A component without any id keeps the row of least text hash. Rows without words are kept as they are.
    """
    rows = materialise(_judged(docs, percent, width, id_col, text).select("rank", "hash", "digest", "win"), "dedup-verdicts")
    gone = rows.where("digest is not null and (rank != win.rank or hash != win.hash)").select("rank", "hash").distinct()
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("rank"), F.xxhash64(utf8(F.col(text))).alias("hash"))
    kept = own.join(gone, ["rank", "hash"], "left_anti")
    again = materialise(rows.where("digest is not null and rank = win.rank and hash = win.hash").groupBy("rank", "hash").agg(F.count("*").alias("n")).where("n > 1"), "dedup-again")
    if not again.isEmpty():  # repeated rows are one before the shuffle, however many
        full = F.col("row")[text].rlike(WORD)
        once = kept.where(full).groupBy("rank", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.where(~F.coalesce(full, F.lit(False))).select("row").unionByName(once.select("row"))
    return kept.select("row.*")
