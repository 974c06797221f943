"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A window is 13 consecutive
words of an item; a shorter item is one window. The automaton, over words as pairs of signs, reads each document once, and hits
are mapped back to offsets of the original text. The documents are never shuffled.

Nulls: a null text has no words, so it is never contaminated; items with a null id or without words are left out.
Rows of one item id count as one item. Repeated documents are judged one by one, texts of any length whole. Columns of
the input are passed on; one of the output's name is replaced. An empty benchmark hits nothing, an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import materialise
from .common import free_name, small_batches, utf8

WIDTH = 13
#: Benchmark words that one automaton holds, with up to 26 nodes each (some 50 bytes a node, 270 MB in all); a larger
#: benchmark is dealt to several, which read the documents in turn.
BLOCK_WORDS = 200_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[int, tuple] = {}

_SPANS = "array<struct<item:string,start:int,end:int>>"
SCHEMA = f"n_words long, n_hit long, items array<string>, spans {_SPANS}"


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of UTF-8 bytes."""
    return text.translate(_TABLE).split() if text else []


class Windows:
    """An Aho-Corasick automaton over words, each of which is two signs: its number's quotient and remainder by the root of
    the vocabulary's size. A node of the automaton looks a sign up among its children one by one, so few signs make it
    fast, and a window of 13 words has 26 nodes, however long the words are. Other words are one sign that no window has."""

    OTHER = "\0"

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import ahocorasick

        texts = [(item, words(text)) for item, text in items]
        known = list(dict.fromkeys(w for _, own in texts for w in own))
        base = math.isqrt(len(known)) + 1
        self.sign = {w: chr(256 + k // base) + chr(256 + base + k % base) for k, w in enumerate(known)}
        found: dict[str, list[str]] = {}
        for item, own in texts:
            signs = "".join([self.sign[w] for w in own])
            for k in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(signs[2 * k : 2 * (k + width)], []).append(item)
        self.owners = [list(dict.fromkeys(x)) for x in found.values()]
        self.lengths = [len(x) // 2 for x in found]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, x in enumerate(found):
            self.auto.add_word(x, k)
        if found:
            self.auto.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray | None, set[str], list[tuple[int, int, int]]]:
        """Words, a mask of hit words, items hit, and (window, first word, last word) of each occurrence."""
        own = words(text)
        if not self.owners or not own:
            return len(own), None, set(), []
        get, other = self.sign.get, self.OTHER
        signs = [get(w, other) for w in own]
        hits = list(self.auto.iter("".join(signs)))
        if not hits:
            return len(own), None, set(), []
        ends = np.cumsum([len(x) for x in signs]) - 1
        mask, items, at = np.zeros(len(own), dtype=bool), set(), []
        for end, k in hits:
            last = int(np.searchsorted(ends, end))
            first = last - self.lengths[k] + 1
            mask[first : last + 1] = True
            items.update(self.owners[k])
            at.append((k, first, last))
        return len(own), mask, items, at


def _spans(text: bytes, owners: list[list[str]], at: list[tuple[int, int, int]]) -> list[dict]:
    """Merged occurrences of each item, as code-point offsets of the original text."""
    offsets = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    by: dict[str, list[tuple[int, int]]] = {}
    for k, first, last in sorted(at, key=lambda x: x[1]):
        for item in owners[k]:
            own = by.setdefault(item, [])
            if own and first <= own[-1][1] + 1:
                own[-1] = (own[-1][0], max(last, own[-1][1]))
            else:
                own.append((first, last))
    return [{"item": i, "start": offsets[a][0], "end": offsets[b][1]} for i in sorted(by) for a, b in by[i]]


def _scanner(shared, key: int, width: int):
    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Windows(shared.value, width)
        built = _BUILT[key]
        for part in parts:
            rows = []
            for text in part:
                n, mask, items, at = built.scan(text)
                rows.append((n, 0 if mask is None else int(mask.sum()), sorted(items), _spans(text, built.owners, at) if at else []))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> tuple[int, Callable[[int], list[tuple[str, bytes]]]]:
    """How many blocks the benchmark, a stated query set, has, and how to fetch one; the driver holds one at a time."""
    own = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    total = own.agg(F.sum(F.size(F.split("t", r"[^0-9A-Za-z\x80-\x{10FFFF}]+")))).first()[0] or 0
    n = 1 + total // block_words
    return n, lambda k: [(r.i, r.t.encode()) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "t").collect()]


def add_hits(docs: DataFrame, benchmark: DataFrame, out: str = "hits", id_col: str = "item_id", text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Append ``out``, a struct of n_words, n_hit, items (sorted ids as strings) and spans.

    Beyond ``block_words`` the benchmark is read in blocks: the documents are numbered in one table in the shared folder,
    each block reads it once and leaves a table of row numbers and hits only, so that a worker holds one automaton at a
    time. Hits of all blocks are merged by their spans and joined back by row number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n, fetch = _blocks(benchmark, id_col, text, block_words)
    scan = lambda k: _scanner(spark.sparkContext.broadcast(fetch(k)), uuid.uuid4().int, width)
    if n == 1:
        return docs.withColumn(out, scan(0)(utf8(F.col(text))))
    numbered = materialise(docs.drop(out).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "decontaminate-rows")
    found = None
    for k in range(n):
        part = numbered.select("at", scan(k)(utf8(F.col("row")[text])).alias("h")).where(F.size("h.items") > 0).select("at", "h.items", "h.spans")
        part = materialise(part, "decontaminate-block")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("at").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    none = F.array().cast("array<string>")
    rows = numbered.join(merged, "at", "left")
    counts = _words_within(F.col("row")[text], F.col("spans"))
    hits = F.struct(counts["n_words"].alias("n_words"), counts["n_hit"].alias("n_hit"), F.array_sort(F.array_distinct(F.coalesce("items", none))).alias("items"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return rows.select("row.*", hits.alias(out))


@F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())]))
def _words_within(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Words, and words that lie within any span."""
    counts = []
    for text, own in zip(texts, spans, strict=True):
        at = np.array([m.span() for m in _WORD.finditer(text or "")], dtype=np.int64).reshape(-1, 2)
        hit = np.zeros(len(at) + 1, dtype=np.int64)
        for s in own if own is not None else ():
            a, b = np.searchsorted(at[:, 0], s["start"]), np.searchsorted(at[:, 1], s["end"], side="right")
            hit[a] += 1
            hit[b] -= 1
        counts.append((len(at), int((np.cumsum(hit)[:-1] > 0).sum())))
    return pd.DataFrame(counts, columns=["n_words", "n_hit"], dtype="int64")


def contaminated(hits: Column) -> Column:
    """A document is contaminated if a twentieth of its words or more are hit."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents that aren't contaminated, with the columns they came with."""
    own = free_name(docs, "contamination")
    return add_hits(docs, benchmark, own, text=text).where(~contaminated(F.col(own))).drop(own)
