"""Language identification by a linear-chain conditional random field over words.

Every word (a run of letters of the lower-cased text) gets a label.  Its features are its
prefixes and suffixes, the byte 2- and 3-grams inside it (word ends included), and which
language's learned lexicon it stands in.  Learned transitions tie neighbouring words, so
a foreign word does not break its sentence while a switched passage is followed.  Weights
are trained with the exact gradient from forward-backward sums.  A text's language is the
label with the largest mean marginal, which is also its score.

Forward and backward sums run over all texts of a batch at once.  Long chains are cut into
blocks whose transfer matrices are multiplied first, so the number of steps does not grow
with the longest text, and the result is still exact.

Null texts and texts without a letter are ``und`` with score 0.  Input columns that bear the
name of a result are replaced, all others stay.  Repeated rows get equal results; long texts are
labelled whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import below, sampled_texts

BUCKETS = 1 << 16
BLOCK_WORDS = 512
#: Text that is labelled at a time.
GROUP_BYTES = 6 << 20
#: Labelled rows used for training at most (expected), and words of a language's lexicon.
SAMPLE_ROWS, LEXICON = 1600, 4000
#: Rows that a language has in the sample at least, if there are so many; languages a model may have.
LEAST_ROWS, MAX_LABELS = 40, 1000
#: Lengths of the byte n-grams.
ORDERS = (2, 3)
LETTERS = K.byte_table((97, 122), (0x80, 0xFF))


def _gram(clean: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all byte n-grams."""
    size = max(len(clean) - n + 1, 0)
    value = np.full(size, 7 * n, np.uint32)
    for k in range(n):
        value = (value ^ clean[k : k + size]) * np.uint32(0x01000193)
    return value


def _slot(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint32(16))
    value = value * np.uint32(0x7FEB352D)
    return ((value ^ (value >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)


class Words:
    """Words of some texts, and their features as hashed slots."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = np.insert(data, offsets[1:-1], 32)  # a word's features do not depend on the text before or after its own
        offsets = offsets + np.minimum(np.arange(len(offsets)), max(len(offsets) - 2, 0))
        clean = np.where(LETTERS[data], data, np.uint8(32))
        self.clean = np.concatenate([[32], clean, [32, 32, 32]]).astype(np.uint8)  # every word has a blank on both sides
        self.starts, self.ends, self.first = K.words(data, offsets, LETTERS)
        self.hashes = K.span_hashes(data, self.starts, self.ends)

    def distinct(self) -> tuple[Words, np.ndarray]:
        """One of each different word (by its bytes) with a blank between them, and which of these every word is."""
        ids = K.exact_ids(self.clean[1:], self.starts, self.ends, self.hashes)
        one = np.full(int(ids.max(initial=-1)) + 1, -1)
        one[ids] = np.arange(len(ids))
        at = one[one >= 0]
        size = self.ends[at] - self.starts[at]
        out = object.__new__(Words)
        out.ends = np.cumsum(size + 1) - 1
        out.starts, out.hashes, out.first = out.ends - size, self.hashes[at], np.array([0, len(at)])
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out.clean = np.full(int((size + 1).sum()) + 4, 32, np.uint8)
        out.clean[np.repeat(out.starts + 1, size) + step] = self.clean[np.repeat(self.starts[at] + 1, size) + step]
        return out, (np.cumsum(one >= 0) - 1)[ids]

    def blocks(self, limit: int = K.BLOCK):
        """Ranges of words that span about ``limit`` bytes, so that work arrays stay small."""
        i, n = 0, len(self.starts)
        while i < n:
            j = max(int(np.searchsorted(self.ends, self.starts[i] + limit, "right")), i + 1)
            yield i, j
            i = j

    def grams(self, i: int, j: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the byte n-grams around words ``i:j``, and where each word's begin and end.

        Byte ``p`` of the text is ``clean[p + 1]``; a word's n-grams run from the blank on its left to
        the blank on its right.
        """
        low = int(self.starts[i])
        part = self.clean[low : int(self.ends[j - 1]) + 1 + order].astype(np.uint32)
        begin = self.starts[i:j] - low
        return _slot(_gram(part, order)), begin, begin + np.maximum(self.ends[i:j] - self.starts[i:j] + 3 - order, 1)

    def affixes(self, i: int, j: int):
        """Slots of the prefixes and suffixes of one to four bytes; -1 where a word is shorter."""
        starts, ends = self.starts[i:j], self.ends[i:j]
        for order in (1, 2, 3, 4):
            ok = ends - starts >= order
            for salt, at in ((0x51ED270B, starts + 1), (0x6C8E9CF5, ends - order + 1)):
                value = np.full(len(at), 7 * order, np.uint32)
                for k in range(order):
                    value = (value ^ self.clean[np.where(ok, at + k, 0)].astype(np.uint32)) * np.uint32(0x01000193)
                yield np.where(ok, _slot(value ^ np.uint32(salt)), -1)

    def pairs(self, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ``(word, slot)`` pairs; ``lexicon`` gives each word's slot or -1."""
        word, slot = [], []
        for i, j in self.blocks():
            index = np.arange(i, j)
            for order in ORDERS:
                grams, a, b = self.grams(i, j, order)
                n = b - a
                word.append(np.repeat(index, n))
                slot.append(grams[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            for column in (*self.affixes(i, j), lexicon[i:j]):
                ok = column >= 0
                word.append(index[ok])
                slot.append(column[ok])
        return (np.concatenate(word), np.concatenate(slot)) if word else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Tagger:
    labels: list[str]
    weights: np.ndarray  # slots by labels; the last rows are the lexicons
    moves: np.ndarray  # labels by labels
    lexicon: np.ndarray  # sorted word hashes
    lexicon_slot: np.ndarray

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, self.lexicon_slot[at], -1)

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of each word for each label; they follow from its bytes alone, so equal words are worked out once."""
        w, which = w.distinct()
        out = np.zeros((len(w.starts), len(self.labels)), np.float32)
        padded = np.concatenate([self.weights, np.zeros((1, len(self.labels)), np.float32)])  # slot -1
        lexicon = self.lookup(w.hashes)
        for i, j in w.blocks():
            for order in ORDERS:
                grams, a, b = w.grams(i, j, order)
                total = np.zeros((len(grams) + 1, len(self.labels)), np.float64)
                np.cumsum(self.weights[grams], axis=0, out=total[1:])
                out[i:j] += total[b] - total[a]
            for column in (*w.affixes(i, j), lexicon[i:j]):
                out[i:j] += padded[column]
        return out[which]

    def chain(self, emissions: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Marginals of each word, and if asked the expected count of each transition."""
        return forward_backward(emissions, first, self.moves, pairs)


def forward_backward(emissions: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False, block: int = BLOCK_WORDS):
    """Exact marginals of all chains ``first[i]:first[i + 1]``; a chain begins with a uniform label before its first word."""
    n, k = emissions.shape
    T = np.exp(moves - moves.max()).astype(np.float32)
    em = np.exp(emissions - emissions.max(1, keepdims=True)) if n else emissions
    em = np.maximum(em, np.float32(1e-12))
    lengths = np.diff(first)
    per = -(-lengths // block)
    doc = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][doc] + nth * block
    size = np.minimum(lengths[doc] - nth * block, block)
    enter = np.full((len(doc), k), 1 / k, np.float32)
    leave = np.ones((len(doc), k), np.float32)

    def active(order):
        """For each step the number of blocks (sorted by size) that still have a word."""
        s = size[order]
        return [int(np.searchsorted(-s, -t, "left")) for t in range(int(s[0]) if len(s) else 0)]

    many = np.flatnonzero(per[doc] > 1) if len(doc) else np.zeros(0, int)
    if len(many):
        order = many[np.argsort(-size[many], kind="stable")]
        M = np.tile(np.eye(k, dtype=np.float32), (len(order), 1, 1))
        for t, m in enumerate(active(order)):
            x = (M[:m] @ T) * em[begin[order[:m]] + t][:, None, :]
            M[:m] = x / x.max((1, 2), keepdims=True)
        matrix = np.empty_like(M)
        back = np.empty(len(doc), int)
        back[order] = np.arange(len(order))
        matrix = M
        top = int(per.max())
        for j in range(1, top):  # one step for each block of the longest chain, all chains at once
            at = many[nth[many] == j]
            x = np.einsum("bi,bij->bj", enter[at - 1], matrix[back[at - 1]])
            enter[at] = x / x.sum(1, keepdims=True)
        for j in range(top - 1, 0, -1):
            at = many[nth[many] == j]
            x = np.einsum("bij,bj->bi", matrix[back[at]], leave[at])
            leave[at - 1] = x / x.sum(1, keepdims=True)
    order = np.argsort(-size, kind="stable")
    counts = active(order)
    alpha = np.empty((n, k), np.float32)
    now = enter[order]
    for t, m in enumerate(counts):
        at = begin[order[:m]] + t
        x = (now[:m] @ T) * em[at]
        x /= x.sum(1, keepdims=True)
        now[:m] = x
        alpha[at] = x
    gamma = np.empty((n, k), np.float32)
    beta = leave[order]
    total = np.zeros((k, k))
    for t in range(len(counts) - 1, -1, -1):
        m = counts[t]
        at = begin[order[:m]] + t
        x = alpha[at] * beta[:m]
        gamma[at] = x / x.sum(1, keepdims=True)
        right = em[at] * beta[:m]
        if pairs:
            left = enter[order[:m]] if t == 0 else alpha[at - 1]
            both = left[:, :, None] * T[None] * right[:, None, :]
            total += (both / both.sum((1, 2), keepdims=True)).sum(0)
        x = right @ T.T
        beta[:m] = x / x.sum(1, keepdims=True)
    return (gamma, total) if pairs else gamma


def train(texts: list[str], langs: list[str], *, epochs: int = 3, batch: int = 32, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Tagger:
    """Stochastic gradient ascent (scaled by past gradients) on the likelihood of the labels; deterministic."""
    labels = sorted(set(langs))
    k = len(labels)
    y = np.array([labels.index(x) for x in langs], int)
    slots = BUCKETS + k
    column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    groups = []
    data, offsets = K.flat(column)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    words = []
    seen: list[dict[int, int]] = [{} for _ in labels]
    for i in range(0, len(order), batch):
        at = order[i : i + batch]
        data, offsets = K.flat(column.take(pa.array(at)))
        w = Words(data, offsets)
        words.append((w, y[at]))
        word_label = np.repeat(y[at], np.diff(w.first))
        for c in range(k):
            values, count = np.unique(w.hashes[word_label == c], return_counts=True)
            for v, n in zip(values.tolist(), count.tolist(), strict=True):
                seen[c][v] = seen[c].get(v, 0) + n
    lexicon: dict[int, int] = {}
    for c in range(k):
        own = sorted(((n, v) for v, n in seen[c].items() if n >= 3 and all(n >= 4 * seen[o].get(v, 0) for o in range(k) if o != c)), reverse=True)
        for _, v in own[:LEXICON]:
            lexicon[v] = BUCKETS + c
    keys = np.array(sorted(lexicon), np.uint64)
    tagger = Tagger(labels, np.zeros((slots, k), np.float32), np.zeros((k, k), np.float32), keys, np.array([lexicon[int(v)] for v in keys], np.int64))
    if k < 2:
        return tagger
    past, past_moves = np.full((slots, k), 1e-2), np.full((k, k), 1.0)
    for w, target in words:
        groups.append((w, target, *w.pairs(tagger.lookup(w.hashes))))
    for _ in range(epochs):
        for w, target, word, slot in groups:
            if not len(w.starts):
                continue
            emit = tagger.emissions(w)
            gamma, expected = tagger.chain(emit, w.first, pairs=True)
            word_label = np.repeat(target, np.diff(w.first))
            gap = -gamma
            gap[np.arange(len(gap)), word_label] += 1
            scale = 1 / len(gap)
            for c in range(k):
                g = np.bincount(slot, gap[word, c], slots) * scale - decay * scale * tagger.weights[:, c]
                past[:, c] += g * g
                tagger.weights[:, c] += (rate * g / np.sqrt(past[:, c])).astype(np.float32)
            inner = np.bincount(target, np.maximum(np.diff(w.first) - 1, 0), k)
            entry = np.bincount(target, np.diff(w.first) > 0, k)
            g = (np.diag(inner) + entry[None, :] / k - expected) * scale - decay * tagger.moves
            past_moves += g * g
            tagger.moves += (rate * g / np.sqrt(past_moves)).astype(np.float32)
    return tagger


def train_on(docs: DataFrame, *, key: str = "doc_id", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS) -> Tagger:
    """Train on about ``sample_rows`` rows with an id, a text and a language, and ``LEAST_ROWS`` of each language that has so many.

    A language of a small share is so learned too.  Texts come whole, ``SAMPLE_BYTES`` at most.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("key"), F.col("text").alias("text"), F.col(lang).alias("label"))
    counts = known.groupBy("label").count().limit(MAX_LABELS + 1).collect()  # one row for each language
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    if not counts:
        return train([], [])
    n = sum(r["count"] for r in counts)
    cuts = [(r.label, below(min(1.0, max(sample_rows / n, least_rows / r["count"])))) for r in counts]
    cut = docs.sparkSession.createDataFrame(cuts, "label string, cut long")
    some = known.join(F.broadcast(cut), "label").where(F.xxhash64("key", F.lit(10)) <= F.col("cut")).select("key", "label", "text")
    rows = sampled_texts(some, "key", "label")
    return train(rows["text"].tolist(), rows["label"].tolist())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identified(docs: DataFrame, tagger: Tagger, text: str = "text", with_words: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``score``; ``with_words`` also adds the label of each word.  One narrow pass."""
    made = ["lang_pred", "score", *["word_langs"] * with_words]
    keep = [c for c in docs.columns if c not in made]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = docs.sparkSession.sparkContext.broadcast(tagger)  # a fixed number of weights
    where = keep.index(text)

    def run(batches):
        model = sent.value
        k = len(model.labels)
        for batch in batches:
            column = pc.utf8_lower(pc.fill_null(batch.column(where).cast(pa.large_string()), ""))
            data, offsets = K.flat(column)
            for i, j in K.slices(offsets, GROUP_BYTES):
                emit, hashes, bounds = [], [], [np.zeros(1, np.int64)]
                for a, b in K.slices(offsets[i : j + 1], K.SLICE):
                    a, b = a + i, b + i
                    w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    emit.append(model.emissions(w))
                    bounds.append(w.first[1:] + bounds[-1][-1])
                first = np.concatenate(bounds)
                emissions = np.concatenate(emit)
                part = batch.slice(i, j - i)
                n = np.diff(first)
                pred: list[str] = ["und"] * (j - i)
                score = np.zeros(j - i)
                labels_of = [[] for _ in range(j - i)]
                if k and len(emissions):
                    gamma = model.chain(emissions, first)
                    total = np.concatenate([np.zeros((1, k)), np.cumsum(gamma, axis=0, dtype=np.float64)])
                    share = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)[:, None]
                    best = share.argmax(1)
                    ascii_letter = np.concatenate([[0], np.cumsum(K.byte_table((97, 122))[data[offsets[i] : offsets[j]]], dtype=np.int64)])
                    sure = np.diff(ascii_letter[offsets[i : j + 1] - offsets[i]]) > 0
                    top = gamma.argmax(1) if with_words else None
                    for d in np.flatnonzero(n > 0).tolist():
                        if sure[d] or has_letter(column[i + d].as_py()):
                            pred[d], score[d] = model.labels[best[d]], min(1.0, float(share[d, best[d]]))
                            if with_words:
                                labels_of[d] = [model.labels[x] for x in top[first[d] : first[d + 1]]]
                arrays = [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if with_words:
                    arrays.append(pa.array(labels_of, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])
        K.release()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double", *["word_langs array<string>"] * with_words])
    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)
