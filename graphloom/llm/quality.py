"""Quality classifier of supervised subword embeddings.

Each word, word pair and character n-gram inside a word is hashed to a learned vector; a text is
the average of its vectors, and a softmax layer on top gives the class.  Training is plain
stochastic gradient descent in numpy on a bounded sample of labelled texts.  As the output
layer is linear, the score of a text is the average of one number for each hashed vector,
so scoring is a table lookup in one narrow pass over whole texts.

Null and empty texts have no vectors and get the prior of the output layer.  Long texts are
scored whole, one at a time.  Repeated rows get equal scores.  Input columns named ``score`` or
``predicted`` are replaced, all others stay.  Without both labels in the sample every score is the share of label 1
(0.5 without any label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import below, sampled_texts

BUCKETS, DIM, ORDERS = 1 << 16, 16, (3, 4)
#: Labelled rows used for training at most (expected; chosen by a hash of the id).
SAMPLE_ROWS = 6000


def hashed(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, bounds)``: the vectors of each text's words and n-grams, document by document.

    Word pairs count too; a word that repeats one of the three before it gives a mark that
    all words share.  A character n-gram is ``n`` bytes of a word together with the blank on either side, never across blanks.
    """
    starts, ends, first = K.words(data, offsets)
    ids = [(K.span_hashes(data, starts, ends) % np.uint64(buckets)).astype(np.int32)]
    place = [starts]
    word, doc = K.span_hashes(data, starts, ends), K.doc_of(first)
    for lag in (1, 2, 3):
        if len(word) <= lag:
            continue
        same = word[lag:] == word[:-lag]
        pair = K.ngram_hashes(word, 2) if lag == 1 else np.zeros(len(same), np.uint64)
        pair = np.where(same, np.uint64(lag), pair)  # a word that comes again is one mark, whichever word it is
        at = np.flatnonzero((doc[lag:] == doc[:-lag]) & (same | (lag == 1)))
        ids.append((pair[at] % np.uint64(buckets)).astype(np.int32))
        place.append(starts[lag:][at])
    blank = ~K.NOT_SPACE[data]
    clean = np.where(blank, np.uint8(32), data).astype(np.uint32)
    for n in ORDERS:
        if len(data) < n:
            continue
        size = len(data) - n + 1
        value = np.full(size, n, np.uint32)
        for k in range(n):
            value *= np.uint32(0x01000193)
            value ^= clean[k : k + size]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        value ^= value >> np.uint32(13)
        bad = np.zeros(size, bool)
        for k in range(1, n - 1):
            bad |= blank[k : k + size]
        edge = offsets[1:-1]
        for k in range(1, n):  # windows over the end of a document
            cut = edge - k
            bad[cut[(cut >= 0) & (cut < size)]] = True
        at = np.flatnonzero(~bad)
        ids.append((value[at] % np.uint32(buckets)).astype(np.int32))
        place.append(at)
    where = np.concatenate(place)
    doc = np.searchsorted(offsets, where, "right") - 1
    order = np.argsort(doc, kind="stable")
    return np.concatenate(ids)[order], np.searchsorted(doc[order], np.arange(len(offsets)))


@dataclass
class Model:
    """One number for each hashed vector, and the prior: the log-odds of label 1 is their mean plus the prior."""

    table: np.ndarray
    prior: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, bounds = hashed(data, offsets, len(self.table))
        total = np.concatenate([[0.0], np.cumsum(self.table[ids], dtype=np.float64)])
        n = np.diff(bounds)
        return 1 / (1 + np.exp(-(np.diff(total[bounds]) / np.maximum(n, 1) + self.prior)))


def train(texts: list[str], labels: np.ndarray, *, epochs: int = 8, rate: float = 20.0, dim: int = DIM, buckets: int = BUCKETS, seed: int = 11) -> Model:
    """Stochastic gradient descent over single texts with a falling rate; deterministic."""
    labels = np.asarray(labels, int)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(buckets, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.log(np.maximum(np.bincount(labels, minlength=2), 1) / len(labels)).astype(np.float32)
    bags = []
    data, offsets = K.flat(pa.array(texts, pa.large_string()))
    for i, j in K.slices(offsets):
        ids, bounds = hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            unique, count = np.unique(ids[a:b], return_counts=True)
            bags.append((unique, (count / max(b - a, 1)).astype(np.float32)))
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for d in rng.permutation(len(bags)):
            ids, weight = bags[d]
            mean = weight @ vectors[ids]
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[d]] -= 1
            now = rate * (1 - step / steps)
            step += 1
            back = p @ out
            out -= 0.05 * now * np.outer(p, mean)
            bias -= 0.001 * now * p
            vectors[ids] -= now * weight[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def train_on(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on about ``sample_rows`` ids of ``docs`` that have a label 0 or 1, and on ``SAMPLE_BYTES`` of whole texts at most."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.xxhash64("key", F.lit(8)) < below(sample_rows / n))
    some = docs.select(F.col(key).alias("key"), F.col("text").alias("text")).join(F.broadcast(known), "key")  # about sample_rows pairs of numbers
    rows = sampled_texts(some, "key", "label")
    return train([t or "" for t in rows["text"]], rows["label"].to_numpy())


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (the probability of label 1) and ``predicted``; one narrow pass."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one float for each bucket
    where = keep.index(text)

    def run(batches):
        for batch in batches:
            data, offsets = K.flat(batch.column(where))
            for i, j in K.slices(offsets):
                part = batch.slice(i, j - i)
                score = sent.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])
        K.release()

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double, predicted int"]))
