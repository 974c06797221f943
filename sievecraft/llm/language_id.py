"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (of all lengths up to ``MAX_N``, hashed to ``BUCKETS``
buckets) that both hold, divided by the root of the product of what each holds: the blended-spectrum presence kernel.
Landmark texts give a Nyström map, one-versus-rest kernel ridge regression fits a weight per landmark and language.
As k(x, Z) is a presence row times the landmarks' presence matrix, scoring a batch is one sparse-by-dense product
with that matrix already multiplied by the weights.

Fitting takes at most ``max_rows`` rows, those with the least hash of their id, of at most ``MAX_FIT_CHARS``
characters. Nulls: a text that is null or has no letter is ``und`` with score 0; rows with a null language or id
aren't learnt from. If nothing can be learnt, all texts are ``und``. Repeated rows are judged one by one; whole texts
are read, in blocks of characters. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from .common import small_batches

MAX_N = 4
BUCKETS = 1 << 18
MAX_ROWS = 3_000
MAX_FIT_CHARS = 20_000
#: Landmark texts, or as many as give each language some.
LANDMARKS, LEAST_LANDMARKS = 240, 4
RIDGE = 1e-2
BLOCK_CHARS = 1 << 16
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    #: BUCKETS x languages: the landmarks' presence matrix times their weights
    weights: np.ndarray
    bias: np.ndarray


def presence(text: str) -> np.ndarray:
    """Sorted buckets of a text's n-grams; letters in lower case, anything else as one space."""
    codes = np.frombuffer(f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    flags = np.zeros(BUCKETS, dtype=bool)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for start in range(0, len(codes), BLOCK_CHARS):
        part = codes[start : start + BLOCK_CHARS + MAX_N - 1]
        key = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, MAX_N + 1):
            if len(part) < n:
                break
            key = key[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            flags[(mixed >> shift).astype(np.int64)] = True
    return np.flatnonzero(flags)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def score_batch(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores: the softmax of the margins."""
    rows = [presence(t) if t and model.languages and has_letter(t) else None for t in texts]
    known = [k for k, r in enumerate(rows) if r is not None]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if known:
        sizes = np.array([len(rows[k]) for k in known])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sums = np.add.reduceat(model.weights[np.concatenate([rows[k] for k in known])], starts, axis=0, dtype=np.float64)
        margin = sums / np.sqrt(sizes)[:, None] + model.bias
        p = np.exp(6 * (margin - margin.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        for k, best, chance in zip(known, p.argmax(1), p.max(1), strict=True):
            names[k], scores[k] = model.languages[best], float(chance)
    return names, scores


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression. Landmarks are dealt to the languages in turn, in the rows' order."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0))
    by = {x: [k for k, own in enumerate(langs) if own == x] for x in languages}
    chosen = [k for turn in range(max(map(len, by.values()))) for x in languages for k in by[x][turn : turn + 1]][: max(landmarks, LEAST_LANDMARKS * len(languages))]
    index = np.concatenate([rows[k] for k in chosen])
    owner = np.repeat(np.arange(len(chosen)), [len(rows[k]) for k in chosen])
    matrix = np.zeros((BUCKETS, len(chosen)), dtype=np.float32)  # presence of the landmarks, each of unit length
    matrix[index, owner] = 1 / np.sqrt(np.array([len(rows[k]) for k in chosen], dtype=np.float32))[owner]
    kernel = np.stack([matrix[r].sum(0, dtype=np.float64) / np.sqrt(len(r)) for r in rows])
    value, vector = np.linalg.eigh(kernel[chosen])
    good = value > 1e-6 * value.max()
    to = vector[:, good] / np.sqrt(value[good])
    phi = kernel @ to
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = len(langs) / (len(languages) * np.array([len(by[x]) for x in langs]))  # languages count alike
    mean_x, mean_y = np.average(phi, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    centred = (phi - mean_x) * weight[:, None]
    beta = np.linalg.solve(centred.T @ (phi - mean_x) + ridge * len(rows) * np.eye(phi.shape[1]) / 10, centred.T @ (y - mean_y))
    return Model(languages, (matrix @ (to @ beta).astype(np.float32)), mean_y - mean_x @ beta)


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Fit on documents with a language for which ``allowed`` holds; the sample is bounded in rows and characters."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.where(allowed).where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).rlike(r"\p{L}"))
    own = own.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.length("text") <= MAX_FIT_CHARS)
    # The rows of least hash: a cut that the row count puts near the bound, then the bound itself.
    n = own.select("id").count()
    share = min(1.0, 1.2 * max_rows / max(1, n))
    near = own.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = materialise(near.orderBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)), "id", "lang").limit(max_rows), "language-sample")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "x": [presence(t).astype(np.int32).tobytes() for t in b["text"]]})

    found = rows.mapInPandas(describe, f"id {dict(rows.dtypes)['id']}, lang string, x binary").toPandas().sort_values(["id", "lang"], kind="stable")
    order = pd.util.hash_pandas_object(found["id"], index=False).to_numpy().argsort(kind="stable")
    return fit([np.frombuffer(found["x"].iloc[k], dtype=np.int32) for k in order], [found["lang"].iloc[k] for k in order])


def add_language(docs: DataFrame, model: Model, out: str = "language", text: str = "text") -> DataFrame:
    """Append ``out``, a struct of lang and score. Documents aren't shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lang, score = score_batch(shared.value, list(part))
            yield pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn(out, run(F.col(text)))
