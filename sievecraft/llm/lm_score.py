"""Language-model scores by stupid backoff, computed relationally over the corpus itself.

    S(w | v) = c(v w) / c(v)         if the bigram occurs in other documents,
               backoff * c(w) / N    else, if the word does,
               backoff**2 / N        else

All counts leave the scored document out, so no document vouches for itself: c(v w), c(v), c(w) and N are those of the
other documents, and a word that nobody else uses gets the lowest probability there is. N is 1 at least. A text's first
word follows a start mark, which is counted like a word but isn't one of N. Words are lower-cased (A-Z) runs without
ASCII white space, told apart by a 64-bit hash. No word is left out, and nothing that grows with the corpus is held by
the driver or broadcast.

Documents are packed into chunks once. Twice, a chunk asks and is answered: for the corpus's counts of its distinct
words, then for those of its distinct bigrams. Requests are dealt to buckets by hash; a bucket sums what all chunks hold
and returns the sums to each. A chunk then scores its documents by itself. A word or bigram occurs once in a chunk's
request, however common it is, so that no bucket is hot; a bigram with a word that only this chunk holds isn't asked
for. Rows hold packed arrays. Rows whose id is repeated are in chunks of their own, which ask by id: the answer leaves
out what the id holds in other chunks.

Nulls: a null or empty text has 0 words, log_score 0 and a null mean. Rows that share an id are one document. A null
id is an id. Ids are integers. Texts of any length are whole; one longer than a chunk is a chunk. Input columns other
than id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialise
from .common import small_batches, utf8

BACKOFF = 0.4
#: Words or bigrams that one group of rows holds, about.
BUCKET = 1_000_000
#: Bytes of text and documents that a chunk holds, about.
CHUNK_BYTES, CHUNK_DOCS = 2_500_000, 1 << 16
#: Rows of chunks in an Arrow batch, and chunks that a task of the last steps reads, about.
CHUNK_ROWS, TASK_CHUNKS = 4, 8
_NULL_ID = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands before a text's first word; no word is empty.
_START = b""
_START_HASH = np.uint64(xxhash.xxh3_64_intdigest(_START))
_CHUNK = "chunk long, again boolean, ids binary, lengths binary, words binary, index binary"
_REQUEST = "bucket long, chunk long, keys binary, counts binary, ids binary"
_REPLY = "chunk long, bucket long, counts binary, total long"


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _pack(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes by plane, so that planes of zeros compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), 8)


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, 8)).view(np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(_pack(values, 4), asbytes=True)


def _unsqueeze(data: bytes, n: int) -> np.ndarray:
    return _unpack(pa.Codec("zstd").decompress(data, decompressed_size=4 * n, asbytes=True), 4)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """By the upper bits, so that buckets are ranges of sorted keys."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _chunk_row(turn: int, again: bool, ids: list[int], texts: list[bytes | None]) -> tuple:
    """Hashes of the distinct words in order of appearance, and each token's place among them; a start mark before each text."""
    at: dict[bytes, int] = {}
    tokens = [[_START, *w] if (w := _words(t)) else [] for t in texts]
    lengths = np.array([len(x) for x in tokens], dtype=np.int64)
    index = np.fromiter((at.setdefault(w, len(at)) for x in tokens for w in x), dtype=np.int64, count=int(lengths.sum()))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in at], dtype=np.uint64)
    chunk = (TaskContext.get().partitionId() << 32) | turn
    return chunk, again, _pack(np.array(ids, dtype=np.int64), 8), _pack(lengths, 4), hashes.tobytes(), _squeeze(index)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    turn, held = 0, {False: ([], [], []), True: ([], [], [])}
    out = lambda again: pd.DataFrame([_chunk_row(turn, again, *held[again][:2])], columns=["chunk", "again", "ids", "lengths", "words", "index"])
    for batch in batches:
        for i, text, again in zip(batch["id"], batch["text"], batch["again"], strict=True):
            ids, texts, sizes = held[bool(again)]
            ids.append(i)
            texts.append(text)
            sizes.append(len(text or b"") + (sizes[-1] if sizes else 0))
            if sizes[-1] >= CHUNK_BYTES or len(ids) == CHUNK_DOCS:
                yield out(bool(again))
                turn += 1
                held[bool(again)] = ([], [], [])
    for again in held:
        if held[again][0]:
            yield out(again)
            turn += 1


class _Counted:
    """Occurrences of a chunk's tokens: sorted distinct ``keys``, each token's place ``at`` among them, and by document
    (key, document) ``pairs`` with their ``times`` and each token's place ``of`` among the pairs."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, own: _Chunk, doc: np.ndarray):
        self.keys, self.at, self.own, self.n_ids = keys, at, own, max(1, len(own.ids))
        self.pairs, self.first, self.of, self.times = np.unique(at * self.n_ids + doc, return_index=True, return_inverse=True, return_counts=True)
        self.ask = np.ones(len(keys), dtype=bool)

    @property
    def key_of(self) -> np.ndarray:
        return self.pairs // self.n_ids

    def in_chunk(self) -> np.ndarray:
        """How often the chunk holds each key."""
        return np.bincount(self.key_of, weights=self.times, minlength=len(self.keys)).astype(np.int64)

    def request(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sorted keys, their counts and, where ids are repeated, their ids."""
        if self.own.again:
            return self.keys[self.key_of], self.times, self.own.ids[self.pairs % self.n_ids]
        return self.keys[self.ask], self.in_chunk()[self.ask], None

    def elsewhere(self, answers: np.ndarray) -> np.ndarray:
        """Per pair, how often other documents hold the key."""
        if self.own.again:
            return answers - self.times
        sums = self.in_chunk()
        sums[self.ask] = answers
        return sums[self.key_of] - self.times


class _Chunk:
    """A chunk's documents: ``index`` has the place of each token in ``hashes``, ``doc`` that of its document in ``ids``."""

    def __init__(self, row):
        self.chunk, self.again, lengths = int(row.chunk), bool(row.again), _unpack(row.lengths, 4)
        self.ids, at = np.unique(_unpack(row.ids, 8), return_inverse=True)
        self.hashes = np.frombuffer(row.words, dtype=np.uint64)
        self.index = _unsqueeze(row.index, int(lengths.sum()))
        self.doc = np.repeat(at, lengths)
        #: Tokens that are words; the one before a word is its predecessor or a start mark.
        self.word = np.flatnonzero(self.hashes[self.index] != _START_HASH)

    def words(self) -> _Counted:
        order = np.argsort(self.hashes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return _Counted(self.hashes[order], rank[self.index], self, self.doc)

    def bigrams(self, words: _Counted, answers: np.ndarray) -> _Counted:
        """Bigrams of the tokens ``word``. One with a word that no other chunk holds is this chunk's alone."""
        hashes = self.hashes[self.index]
        keys, first, at = np.unique(hashes[self.word - 1] * _MIX + hashes[self.word], return_index=True, return_inverse=True)
        out = _Counted(keys, at, self, self.doc[self.word])
        if not self.again:
            shared = (answers > words.in_chunk())[words.at]
            where = self.word[first]
            out.ask = shared[where] & shared[where - 1]
        return out


def _requests(chunk: int, n: int, keys: np.ndarray, times: np.ndarray, ids: np.ndarray | None = None) -> pd.DataFrame:
    """A row for each bucket that sorted keys are in."""
    bucket = _bucket(keys, n)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else [0]
    rows = [(int(bucket[a]), chunk, _pack_sorted(keys[a:b]), _pack(times[a:b], 4), None if ids is None else _pack(ids[a:b], 8)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "counts", "ids"])


def _asker(n: int, words: bool):
    """Requests for the counts of each chunk's distinct words, or else bigrams."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = _Chunk(row)
                asked = own.words()
                yield _requests(own.chunk, n, *(asked if words else own.bigrams(asked, _unpack(row.counts, 8))).request())

    return ask


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of all chunks' counts to each chunk. The first row has the bucket's total, start marks left out."""
    rows = rows.reset_index(drop=True)
    keys = [_unpack_sorted(x) for x in rows["keys"]]
    edges = np.cumsum([len(x) for x in keys])[:-1]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.concatenate([_unpack(x, 4) for x in rows["counts"]])
    sums = np.bincount(at, weights=times, minlength=len(own)).astype(np.int64)
    answers = sums[at]
    if (again := rows["ids"].notna().to_numpy()).any():
        asked = np.repeat(again, [len(x) for x in keys])
        ids = np.concatenate([_unpack(x, 8) for x in rows["ids"][again]])
        mine = pd.DataFrame({"key": at[asked], "id": ids, "n": times[asked]})
        answers[asked] -= (mine.groupby(["key", "id"])["n"].transform("sum") - mine["n"]).to_numpy()
    out = pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "counts": [zlib.compress(_pack(x, 8), 1) for x in np.split(answers, edges)]})
    return out.assign(total=np.where(np.arange(len(rows)) == 0, sums[own != _START_HASH].sum(), 0))


def _answers(replies: pd.DataFrame) -> np.ndarray:
    """Counts in the order of a chunk's request."""
    return np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(zlib.decompress(x), 8) for x in replies.sort_values("bucket")["counts"])])


def _resolve(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """The chunk with its words' counts."""
    return rows.assign(counts=[_pack(_answers(replies), 8)])


def _scorer(backoff: float):
    def score(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """A row per document of a chunk; the logarithm of N is left out of the words that back off."""
        row = next(rows.itertuples(index=False))
        own, answers = _Chunk(row), _unpack(row.counts, 8)
        words = own.words()
        bigrams = own.bigrams(words, answers)
        n_word = words.elsewhere(answers)[words.of]
        n_both = bigrams.elsewhere(_answers(replies))
        at = own.word[bigrams.first]
        doc, before, word, seen = own.doc[at], n_word[at - 1], n_word[at], n_both > 0
        backed = np.where(word > 0, backoff * np.maximum(word, 1), backoff**2)
        log = np.log(np.where(seen, np.maximum(n_both, 1) / np.maximum(before, 1), backed))
        n, hit, sums = (np.bincount(doc, weights=x, minlength=len(own.ids)) for x in (bigrams.times, bigrams.times * seen, bigrams.times * log))
        return pd.DataFrame({"id": own.ids, "n_words": n.astype(np.int64), "n_seen": hit.astype(np.int64), "log_score": sums})

    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", backoff: float = BACKOFF, bucket: int = BUCKET) -> DataFrame:
    """One row per id: id, n_words, n_seen (words by their bigram), log_score (natural log, summed), mean_log_score."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), utf8(F.col(text)).alias("text"))
    ids = materialise(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lm-ids")
    repeated = ids.select("id", F.lit(True).alias("again"))
    if repeated.isEmpty():
        rows = rows.withColumn("again", F.lit(False))
    else:
        rows = rows.join(repeated, "id", "left").select("id", "text", F.coalesce("again", F.lit(False)).alias("again"))
    chunks = materialise(rows.mapInPandas(_chunks, _CHUNK), "lm-chunks")
    discard(ids)
    small_batches(spark, CHUNK_ROWS)
    size = chunks.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, -(-size["n"] // TASK_CHUNKS))
    # Numbers of partitions follow from the measured size, so that a task's share stays the same at any scale.
    n = max(1, -(-size["bytes"] // 8 // bucket))
    asked = chunks.mapInPandas(_asker(n, True), _REQUEST).repartition(n, "bucket")
    replies = materialise(asked.groupBy("bucket").applyInPandas(_answer, _REPLY), "lm-words")
    total = replies.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    by_chunk = lambda x: x.repartition(tasks, "chunk").groupBy("chunk")
    known = materialise(by_chunk(chunks).cogroup(by_chunk(replies)).applyInPandas(_resolve, _CHUNK + ", counts binary"), "lm-known")
    discard(chunks)
    discard(replies)
    n = max(1, -(-total // bucket))
    asked = known.mapInPandas(_asker(n, False), _REQUEST).repartition(n, "bucket")
    replies = materialise(asked.groupBy("bucket").applyInPandas(_answer, _REPLY), "lm-bigrams")
    small_batches(spark)
    parts = by_chunk(known).cogroup(by_chunk(replies)).applyInPandas(_scorer(backoff), "id long, n_words long, n_seen long, log_score double")
    whole = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_seen", "log_score")])
    others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    whole = whole.withColumn("log_score", F.col("log_score") - (F.col("n_words") - F.col("n_seen")) * F.log(others.cast("double")))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score")
    return whole.select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias(id_col), "n_words", "n_seen", "log_score", mean)
