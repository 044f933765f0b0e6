"""Toxicity by a factorisation machine over hashed terms.

Terms are the lower-cased words of a text and their first 4 and 5 bytes (endings change, stems stay), hashed to BUCKETS. The machine gives a text
sum(w_i) + sum over pairs <v_i, v_j> over its distinct terms, so two terms together (an insult and a mention of a group)
can weigh more, or less, than each alone. No term is chosen by its label: every bucket that stands in at least
MIN_SHARE of the sampled rows has a weight and factors, as a term may only tell beside another.
It is fitted in one task on at most MAX_SAMPLE labelled rows, chosen by a hash of the id, one text a row; the model is of a
fixed size (BUCKETS by 1 + FACTORS floats at most) and is broadcast. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, checkpoint
from .textblock import ALNUM, LOWER, U, blocks, prefix_hash, span_hash, words

BITS = 18
BUCKETS = 1 << BITS
#: Share of the sampled rows in which a term must stand (and 3 rows at least): of one seen in fewer little can be told.
MIN_SHARE = 0.001
#: Most labelled rows that the machine is fitted on.
MAX_SAMPLE = 16_000
#: Size of the pairwise factors; passes over the sample at most, and steps before which the fit doesn't stop.
FACTORS, EPOCHS, LEAST_STEPS = 4, 60, 600
#: Passes without a better loss on the rows left out, after which it stops.
PATIENCE = 3


def term_sets(column: pa.Array, number: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row; the numbers (number[bucket] >= 0) of the distinct terms of these rows, and their rows, ascending."""
    top = max(int(number.max(initial=-1)) + 1, 1)
    for i, j, part, offsets in blocks(column):
        low = LOWER[part]
        start, end, per_row = words(low, offsets, ALNUM)
        sums, rows = prefix_hash(low), np.repeat(np.arange(j - i), np.diff(per_row))
        keys = []
        for size in (0, 4, 5):
            some = end - start > size
            stop = start[some] + size if size else end
            n = number[(span_hash(sums, start[some], stop) >> U(64 - BITS)).astype(np.int64)]
            on = n >= 0
            keys.append(rows[some][on] * top + n[on])
        key = np.unique(np.concatenate(keys))
        yield i, j, key % top, key // top


@dataclass
class Machine:
    """number: the term of each bucket, or -1; bias, weight and factor: the model."""

    number: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, term: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """term, row: the distinct terms of each row, rows ascending."""
        out = np.full(n_rows, self.bias)
        if len(term):
            out += np.bincount(row, self.weight[term], n_rows)
            for f in range(self.factor.shape[1]):
                v = self.factor[term, f]
                out += 0.5 * (np.bincount(row, v, n_rows) ** 2 - np.bincount(row, v * v, n_rows))
        return out


class _Rows:
    """Rows of terms, one behind another from start[row] on, of which any can be taken out."""

    def __init__(self, term: np.ndarray, start: np.ndarray):
        self.term, self.start = term, start

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.start[chosen + 1] - self.start[chosen]
        r = np.repeat(np.arange(len(chosen)), count)
        return self.term[np.repeat(self.start[chosen] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(r))], r


def fit(term: np.ndarray, start: np.ndarray, label: np.ndarray, n_terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss with an L2 penalty, by Adam over batches; the terms of row i are term[start[i] : start[i + 1]]. Bias, weights, factors.

    A tenth of the rows is left out, and the parameters of the least loss on it are taken.
    """
    rng = np.random.default_rng(seed)
    n = len(label)
    p = (label.sum() + 0.5) / (n + 1)
    # factors by factor, so that each is read in one stretch
    params = [np.array([np.log(p / (1 - p))]), np.zeros(n_terms), rng.normal(0, 0.3 / np.sqrt(1 + len(term) / n), (FACTORS, n_terms))]
    first = [np.zeros_like(x) for x in params]
    second = [np.zeros_like(x) for x in params]
    rows = _Rows(term, start)
    order = rng.permutation(n)
    aside, train = order[: n // 10], order[n // 10 :]
    size = max(32, min(512, n // 16))
    step, best, since = 0, (np.inf, [x.copy() for x in params]), 0

    def forward(chosen: np.ndarray) -> tuple:
        t, r = rows.take(chosen)
        bias, weight, factor = params
        total = np.stack([np.bincount(r, v[t], len(chosen)) for v in factor])
        z = bias[0] + 0.5 * (total**2).sum(0) + np.bincount(r, (weight - 0.5 * (factor**2).sum(0))[t], len(chosen))
        return t, r, total, np.clip(z, -30, 30)

    for epoch in range(EPOCHS if n_terms else 0):
        rng.shuffle(train)
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.002
        for lo in range(0, len(train), size):
            chosen = train[lo : lo + size]
            t, r, total, z = forward(chosen)
            g = (1 / (1 + np.exp(-z)) - label[chosen]) / len(chosen)
            gw = np.bincount(t, g[r], n_terms)
            gv = np.stack([np.bincount(t, x[r], n_terms) for x in total * g]) - params[2] * gw
            grads = [np.array([g.sum()]), gw + 1e-5 * params[1], gv + 1e-5 * params[2]]
            step += 1
            for x, grad, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
        z, y = (forward(aside)[-1], label[aside]) if len(aside) else (np.zeros(0), np.zeros(0))
        loss = float(np.logaddexp(0, np.where(y > 0, -z, z)).mean()) if len(aside) else -epoch
        if loss < best[0]:
            best, since = (loss, [x.copy() for x in params]), 0
        else:
            since += 1
        if since >= PATIENCE and step >= LEAST_STEPS:
            break
    bias, weight, factor = best[1]
    return float(bias[0]), weight, np.ascontiguousarray(factor.T)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learnable: Column, max_sample: int = MAX_SAMPLE) -> Machine:
    """The machine, from the rows of labels for whose id `learnable` (over column id_col) holds.

    Labels that are null or neither 0 nor 1 teach nothing; of an id's several labels each counts once, and of its several
    texts the least. Without labelled rows of both kinds the machine has no terms, and scores all texts alike.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(learnable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    some = checkpoint(known.orderBy(F.xxhash64("id"), "id", "label").limit(max_sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one row of each sampled label, whatever rows the id has
    rows = texts.join(F.broadcast(some), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    every = np.arange(BUCKETS)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, term, row in term_sets(batch.column(0), every):
                ends = np.searchsorted(row, np.arange(j - i + 1))
                found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([found, batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)], names=["terms", "label", "id"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row, the machine. The sample is of a fixed size, so it meets in this one task and not on the driver."""
        some = list(batches)
        if some:
            machine = trained(pa.Table.from_batches(some))
            parts = {"number": machine.number.tobytes(), "weight": machine.weight.tobytes(), "factor": machine.factor.tobytes()}
            yield pa.RecordBatch.from_pydict({"bias": pa.array([machine.bias]), **{k: pa.array([v], pa.binary()) for k, v in parts.items()}})

    picked = rows.select("text", "label", F.xxhash64("id").alias("id")).mapInArrow(pick, "terms array<int>, label int, id long")
    row = picked.repartition(1).mapInArrow(train, "bias double, number binary, weight binary, factor binary").first()
    if row is None:
        return Machine(np.full(BUCKETS, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    return Machine(np.frombuffer(row.number, np.int32), row.bias, np.frombuffer(row.weight), np.frombuffer(row.factor).reshape(-1, FACTORS))


def trained(sample: pa.Table) -> Machine:
    """The machine of a sample: terms (distinct buckets of a row), label and id."""
    # in the order of ids, whatever order the rows came in
    sample = sample.sort_by([("id", "ascending"), ("label", "ascending")])
    label, lists = sample["label"].to_numpy().astype(float), sample["terms"].combine_chunks()
    number = np.full(BUCKETS, -1, np.int32)
    if len(np.unique(label)) < 2:
        p = (label.sum() + 0.5) / (len(label) + 1)
        return Machine(number, float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
    term, start = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    kept = np.flatnonzero(np.bincount(term, minlength=BUCKETS) >= max(3, MIN_SHARE * len(label)))
    number[kept] = np.arange(len(kept))
    term = number[term]
    start = np.concatenate([[0], np.cumsum(term >= 0)])[start - start[0]]
    return Machine(number, *fit(term[term >= 0], start, label, len(kept)))


def score_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (by default the id) of every row of docs, and score: 0 to 1, higher the likelier toxic.

    Null and empty texts have no terms and get the score of the bias. Repeated rows get a row each, and
    equal texts equal scores. Columns of docs that are not asked for are left aside, whatever their names; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, learnable))
    keep = [id_col] if keep is None else keep
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    schema = ", ".join([*(f"k{i} {t.dataType.simpleString()}" for i, t in enumerate(rows.schema[:-1])), "score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, term, row in term_sets(batch.column(batch.num_columns - 1), machine.number):
                out[i:j] = 1 / (1 + np.exp(-np.clip(machine.logits(term, row, j - i), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "score"])

    found = rows.mapInArrow(score, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")
