"""Language identification by multinomial naive Bayes over hashed character n-grams.

The n-grams are 1, 2 and 3 successive code points of the lower-cased text, hashed to BUCKETS. The
executors count them over all rows that may be learnt from and add the counts up; the matrix of
log-probabilities (BUCKETS by languages, 4 bytes each) is broadcast, and texts are scored in blocks by numpy.
At most MAX_LANGUAGES languages are accepted, which bounds the matrix.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches
from .textblock import U, blocks

BITS = 16
BUCKETS = 1 << BITS
#: 512 languages take 128 MB.
MAX_LANGUAGES = 512
#: Added to each count.
SMOOTHING = 0.5
WIDTH = 8192
#: Languages whose counts a task holds (of 512 KB each) before it sends them on; a block may add its own.
HELD = 64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below 0x10000: its lower case, and whether it is a letter."""
    lower = np.arange(0x10000, dtype=np.uint32)
    letter = np.zeros(0x10000, bool)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
    return lower, letter


def code_points(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, row offsets in them, and which are letters."""
    lower, letter = _tables()
    first = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    points = np.frombuffer(part.tobytes().decode("utf-8").encode(f"utf-32-{sys.byteorder[0]}e"), np.uint32)
    small = points < 0x10000
    at = np.where(small, points, 0)
    is_letter = letter[at] & small
    if not small.all():
        beyond = np.unique(points[~small])
        is_letter |= np.isin(points, beyond[[chr(x).isalpha() for x in beyond.tolist()]])
    return np.where(small, lower[at], points), first[offsets], is_letter


def grams(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The bucket of the n-gram that starts at each code point, for n = 1, 2, 3; n. N-grams across rows are included."""
    wide = points.astype(np.uint64)
    key = wide
    for n in (1, 2, 3):
        if n > 1:
            key = key[:-1] << U(21) | wide[n - 1 :]
        h = (key + U(n << 57)) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
        yield (h * U(0xBF58476D1CE4E5B9) >> U(64 - BITS)).astype(np.int64), n


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability matrix, from all rows (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j, part, offsets in blocks(batch.column(0)):
                points, ends, _ = code_points(part, offsets)
                names, number = np.unique(lang[i:j].astype(str), return_inverse=True)
                of = np.repeat(number, np.diff(ends))
                row = np.repeat(np.arange(j - i), np.diff(ends))
                keys = []
                for bucket, n in grams(points, ends):
                    same = row[: len(bucket)] == row[n - 1 :] if n > 1 else slice(None)
                    keys.append((of[: len(bucket)] * BUCKETS + bucket)[same])
                key, times = np.unique(np.concatenate(keys), return_counts=True)
                edge = np.searchsorted(key, np.arange(len(names) + 1) * BUCKETS)
                for k, name in enumerate(names.tolist()):
                    if name not in tables:
                        tables[name] = np.zeros(BUCKETS, np.int64)
                    tables[name][key[edge[k] : edge[k + 1]] - k * BUCKETS] += times[edge[k] : edge[k + 1]]
                if len(tables) > HELD:
                    yield from sent(tables)
                    tables = {}
        yield from sent(tables)

    def sent(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, table in tables.items():
            yield _batch(name, range(BUCKETS // WIDTH), [table[c * WIDTH : (c + 1) * WIDTH] for c in range(BUCKETS // WIDTH)])

    def _batch(name: str, chunks: range | list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(parts), pa.string()), "chunk": pa.array(chunks, pa.int32()), "part": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, chunk, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums[name, chunk] = sums.get((name, chunk), 0) + np.frombuffer(part, np.int64)
        for (name, chunk), x in sums.items():
            yield _batch(name, [chunk], [x])

    kind = "lang string, chunk int, part binary"
    tables: dict[str, np.ndarray] = {}
    some = rows.select("text", "lang").mapInArrow(count, kind).repartition("lang", "chunk").mapInArrow(add, kind)
    for row in some.toLocalIterator():
        if row.lang not in tables:
            tables[row.lang] = np.zeros(BUCKETS)
            if len(tables) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        tables[row.lang][row.chunk * WIDTH : (row.chunk + 1) * WIDTH] += np.frombuffer(row.part, np.int64)
    names = sorted(tables)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    count_ = np.stack([tables[x] for x in names], axis=1) + SMOOTHING
    return names, np.log(count_ / count_.sum(0)).astype(np.float32)


def predict_language(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang_pred and score (posterior probability of lang_pred) of every row of docs.

    Learns from the rows for which `learnable` (over columns of docs) holds and lang is not null. Each language is as
    likely as another beforehand. A text that is null or has no letter, and any text if nothing
    could be learnt, is `und` with score 0. Of languages equally likely, the first by code point is taken. Repeated
    rows get a row each; other columns are left aside, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shared = spark.sparkContext.broadcast(learn(known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for i, j, part, offsets in blocks(batch.column(1)):
                if not names:
                    break
                points, ends, letter = code_points(part, offsets)
                lettered = np.diff(np.concatenate([[0], np.cumsum(letter)])[ends]) > 0
                total = np.zeros((j - i, len(names)))
                row = np.repeat(np.arange(j - i), np.diff(ends))
                for bucket, n in grams(points, ends):
                    own = row[: len(bucket)]
                    if n > 1:
                        same = own == row[n - 1 :]
                        bucket, own = bucket[same], own[same]
                    for k in range(len(names)):
                        total[:, k] += np.bincount(own, matrix[bucket, k], j - i)
                top = total.argmax(1)
                odds = np.exp(total - total.max(1, keepdims=True))
                best[i:j] = np.where(lettered, top, -1)
                score[i:j] = np.where(lettered, 1 / odds.sum(1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und" if k < 0 else names[k] for k in best.tolist()], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
