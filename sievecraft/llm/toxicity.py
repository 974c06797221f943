"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a lexicon (words and word stems that toxic training texts hold and others don't, by
log-odds), closeness of lexicon words to the second person, capitals, punctuation, and obfuscation (words that mix
letters with digits or signs, and lexicon words found once these are read as letters). Fitting takes at most
``max_rows`` labelled rows, those with the least hash of their id. The lexicon of a fold is learnt from the other
folds, so that the trees and the calibration see features as new texts have them; scoring uses the whole lexicon.

Nulls: a null text counts as an empty one and gets the score of a text without words; rows with a null label or id
aren't learnt from; an id with several labels is toxic if one says so, one with several texts is learnt from the least. Repeated rows are scored one by one. Without
labels every score is 0, without documents the result is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from .boosting import Boosted, fit, isotonic
from .common import free_name, small_batches

#: Bound of the labelled sample that the model is fitted on.
MAX_ROWS = 24_000
#: Share of the toxic rows that must hold an entry.
SUPPORT = 0.003
FOLDS = 3
THRESHOLD = 0.3
STEMS = (4, 5, 6, 7)
NEAR = 6

# General English insults, and second persons of four languages.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumb", "fool", "loser", "losers", "scum", "trash", "garbage", "filth", "filthy", "vermin", "worthless", "pathetic",
    "disgusting", "clown", "clowns", "jerk", "coward", "pig", "rat", "bastard", "bitch", "asshole", "shit", "crap", "damn", "fuck", "fucking", "hate", "kill", "die", "ugly",
)
YOU = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "ti", "tus", "usted", "ustedes", "vous", "votre", "vos", "toi", "ton", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "sie")
LOOKALIKES = str.maketrans("013457@$!|€*", "oieastasilea")

NAMES = (
    "strong_hits", "strong_density", "strong_distinct", "weak_hits", "weak_density", "stem_hits", "stem_density", "best_odds", "odds_density", "insult_hits", "insult_density",
    "hidden_hits", "near_you", "you_density", "capital_share", "shouted_share", "bang_rate", "mark_rate", "odd_rate", "words",
)

_TOKEN = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
_PLAIN = re.compile(r"[^\W\d_]+")


@dataclass
class Lexicon:
    """Log-odds of words, and of word stems (first 4 to 7 letters)."""

    words: dict[str, float]
    stems: dict[str, float]

    def odds(self, word: str) -> tuple[float, float]:
        return self.words.get(word, 0.0), max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    scores: np.ndarray
    chances: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), self.scores, self.chances), 0.0, 1.0)


class Describer:
    """Features of texts. What a token means is worked out once and remembered, as most tokens come again."""

    #: Codes of tokens: a word of no interest, no word at all; larger ones name a row of ``known``.
    PLAIN, NONE = 0, 1

    def __init__(self, lexicon: Lexicon, remember: int = 400_000):
        self.lexicon, self.remember = lexicon, remember
        self.codes: dict[str, int] = {}
        self.known: list[tuple | None] = [None, None]

    def _meaning(self, raw: str) -> int:
        found = _TOKEN.search(raw)
        if not found:
            return self.NONE
        token = found[0]
        low = token.lower()
        whole = low.isalpha()
        word, root = self.lexicon.odds(low if whole else "".join(_PLAIN.findall(low)))
        odd = hidden = False
        if not whole:
            some = any(map(str.isalpha, low))
            odd = some and any(map(str.isdigit, low))
            if some and max(word, root) <= 0 and any(not c.isalpha() for c in low[1:-1]):
                read = "".join(_PLAIN.findall(low.translate(LOOKALIKES)))
                shown = max(self.lexicon.odds(read))
                hidden = shown > 0 or read in _INSULTS
                word, root = (shown, 0.0) if hidden else (word, root)
        insult, you, shouted = low in _INSULTS, low in _YOU, len(token) > 2 and token.isupper()
        if not (word > 0 or root > 0 or odd or hidden or insult or you or shouted):
            return self.PLAIN
        strong = not hidden and (word >= 3 or (word > 0 and root >= 3))
        stem = not hidden and root >= 3
        weak = not hidden and not strong and word > 0
        self.known.append((low, max(word, root), strong, weak, stem, hidden, insult, you, shouted, odd))
        return len(self.known) - 1

    def _codes(self, tokens: list[str]) -> list[int]:
        get = self.codes.get
        out = [get(t, -1) for t in tokens]
        if -1 in out:
            if len(self.codes) > self.remember:
                self.codes.clear()
                self.known = [None, None]
            for t in tokens:
                if t not in self.codes:
                    self.codes[t] = self._meaning(t)
            out = [self.codes[t] for t in tokens]
        return out

    def __call__(self, text: str) -> list[float]:
        """One row of NAMES."""
        codes = self._codes(text.split())
        n_words = len(codes) - codes.count(self.NONE)
        n = max(1, n_words)
        found = [(at, self.known[c]) for at, c in enumerate(codes) if c > self.NONE]
        sums = [sum(x[k] for _, x in found) for k in range(2, 10)]
        strong, weak, stem, hidden, insult, yous, shouted, odd = sums
        best, total = max((x[1] for _, x in found), default=0.0), sum(x[1] for _, x in found)
        hits = [at for at, x in found if x[2] or x[4] or x[5] or x[6]]
        seen = {x[0] for _, x in found if x[2] or x[4]}
        near = 0
        if hits and yous:
            spots = np.array([at for at, x in found if x[7]])
            at = np.searchsorted(spots, hits)
            left, right = spots[np.maximum(at - 1, 0)], spots[np.minimum(at, len(spots) - 1)]
            near = int((np.minimum(np.abs(left - hits), np.abs(right - hits)) <= NEAR).sum())
        chars = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        small = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letters = int((((chars | 32) - np.uint32(97)) < 26).sum()) + int((chars >= 0xC0).sum())
        capitals = int((chars != small).sum()) if len(chars) == len(small) else sum(map(str.isupper, text))
        marks = sum(text.count(c) for c in "#*$%&|<>@~^")
        size = max(1, len(text))
        return [
            strong, 100 * strong / n, len(seen), weak, 100 * weak / n, stem, 100 * stem / n, best, 100 * total / n, insult, 100 * insult / n,
            hidden, near, 100 * yous / n, capitals / max(1, letters), shouted / n, 100 * (text.count("!") + text.count("?")) / size, 100 * marks / size, 100 * odd / n, math.log1p(n_words),
        ]


_INSULTS, _YOU = frozenset(INSULTS), frozenset(YOU)


def units(text: str) -> set[str]:
    """What a lexicon entry can be: words (``=word``) and stems."""
    out = set()
    for word in set(_PLAIN.findall(text.lower())):
        out.add("=" + word)
        out.update(word[:k] for k in STEMS if len(word) > k)
    return out


def _counter(known: frozenset | None):
    """Rows that hold each unit, by fold and label: per batch for any unit, per task for a bounded set of known ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
                own = units(text)
                counts.update((u, fold, toxic) for u in (own if known is None else own & known))
            if known is None:
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["unit", "fold", "toxic", "n"])
                counts.clear()
        if counts:
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["unit", "fold", "toxic", "n"])

    return count


def _unit_counts(rows: DataFrame, toxic: int) -> pd.DataFrame:
    """(unit, fold, n, toxic) of the units that enough toxic rows hold, over all sampled rows. A row counts once per unit, so the units of
    one in ``1 / SUPPORT`` toxic rows are at most that many times what one row holds, whatever the size of the corpus."""
    schema = "unit string, fold int, toxic int, n long"
    bad = rows.where("toxic = 1").mapInPandas(_counter(None), schema).groupBy("unit").agg(F.sum("n").alias("n"))
    found = bad.where(F.col("n") >= max(2.0, SUPPORT * toxic)).select("unit").collect()
    known = frozenset(r["unit"] for r in found)
    counts = rows.mapInPandas(_counter(known), schema).groupBy("unit", "fold", "toxic").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["unit", "fold", "toxic"], kind="stable")
    counts["bad"] = counts["n"] * counts["toxic"]
    return counts.groupby(["unit", "fold"], as_index=False).agg(n=("n", "sum"), toxic=("bad", "sum"))


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(id, text, toxic, fold) of at most ``max_rows`` labelled documents. The id list is that long at most, so it is broadcast."""
    order = F.xxhash64(F.col(id_col))
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(allowed).groupBy(id_col).agg(F.max(label).cast("int").alias("toxic"))
    own = own.orderBy(order, id_col).limit(max_rows).withColumn("fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(FOLDS)).cast("int"))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialise(texts.join(F.broadcast(own), id_col).groupBy(F.col(id_col).alias("id"), "toxic", "fold").agg(F.min("text").alias("text")).select("id", "text", "toxic", "fold"), "toxicity-sample")


def _lexicon(counts: pd.DataFrame, totals: dict[int, tuple[int, int]], without: int | None) -> Lexicon:
    """Entries with log-odds of 1.5 or more, from all folds but one."""
    n = sum(a for f, (a, _) in totals.items() if f != without)
    toxic = sum(b for f, (_, b) in totals.items() if f != without)
    if not toxic or toxic == n:
        return Lexicon({}, {})
    own = counts[counts["fold"] != without].groupby("unit")[["n", "toxic"]].sum()
    own = own[own["toxic"] >= max(2.0, SUPPORT * toxic)]
    bad, good = own["toxic"], own["n"] - own["toxic"]
    odds = np.log((bad + 0.1) / (toxic + 0.2)) - np.log((good + 0.5) / (n - toxic + 1.0))
    found = odds[odds >= 1.5].sort_values(ascending=False, kind="stable").items()
    words, stems = {}, {}
    for unit, value in found:
        (words if unit[0] == "=" else stems)[unit.removeprefix("=")] = float(value)
    return Lexicon(words, stems)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows for which ``allowed`` (a condition on the label table's id) holds."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, allowed, id_col, text, label, max_rows)
    totals = {r["fold"]: (r["n"], r["t"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    if not totals:
        return Model(Lexicon({}, {}), Boosted(0.0), np.array([0.0]), np.array([0.0]))
    counts = _unit_counts(rows, sum(t for _, t in totals.values()))
    lexicons = {f: _lexicon(counts, totals, f) for f in range(FOLDS)}
    whole = _lexicon(counts, totals, None)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {f: Describer(x) for f, x in shared.value.items()}
        for batch in batches:
            x = [of[f](t) for t, f in zip(batch["text"], batch["fold"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "fold": batch["fold"], "x": x})

    kind = dict(rows.dtypes)["id"]
    described = rows.mapInPandas(describe, f"id {kind}, toxic int, fold int, x array<double>").toPandas().sort_values("id", kind="stable")
    x, y, fold = np.array(described["x"].tolist(), dtype=float), described["toxic"].to_numpy(float), described["fold"].to_numpy()
    out = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            out[fold == f] = fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(whole, fit(x, y), *isotonic(out, y))


def add_score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """Append ``out``, the calibrated chance that the text is toxic. Documents aren't shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        describe = Describer(own.lexicon)
        for part in parts:
            yield pd.Series(own.score(np.array([describe(t or "") for t in part], dtype=float).reshape(len(part), len(NAMES))))

    return docs.withColumn(out, run(F.col(text)))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Documents that score under the threshold, with the columns they came with."""
    own = free_name(docs, "toxicity")
    return add_score(docs, model, own, text).where(F.col(own) < threshold).drop(own)
