"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  Of the
``window - gram + 1`` grams in each window of ``window`` words the one of smallest hash is
kept.  Equal windows keep equal grams, so joining the kept grams of documents with those of
the benchmark finds every shared span of ``window`` words.  Hits are extended to the
windows around the shared gram and compared word by word, so a hash cannot decide.

Items of fewer words are one window of that length each; for each such length all grams of
just that length are joined in the same way.

The benchmark is taken in blocks of about ``max_block_bytes`` of text (in practice one); a
block's sorted arrays are made once, sent to the workers and meet the documents in a narrow
pass.  With more blocks each pass is written to the shared folder and its index dropped before
the next, so one index lives at a time and memory does not grow with the benchmark; the
documents are then read once for each block.  No shuffle.

Null texts have no words.  Items without words are ignored; items whose id is null mark
words as hit but are not listed.  Equal ids are one item.  Repeated rows each get their own
result, long texts are searched whole, and further columns may bear any name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import stage

WINDOW, GRAM = 8, 4
MAX_BLOCK_BYTES = 16 << 20


def kept_grams(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window of words the smallest hash of its grams."""
    grams = K.ngram_hashes(hashes, gram)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = grams[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(out, grams[i : i + n], out=out)
    return out


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    return sorted_set[np.minimum(at, len(sorted_set) - 1)] == values


class WindowTable:
    """The different windows of one length: sorted keys, where each stands, and its items."""

    def __init__(self, text: bytes, begin: np.ndarray, end: np.ndarray, item: np.ndarray):
        view = memoryview(text)
        keys = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)
        data = np.frombuffer(text, np.uint8)
        same = K.exact_ids(data, begin, end)
        order = np.lexsort((item, same, keys))
        keys, same, item, begin, end = keys[order], same[order], item[order], begin[order], end[order]
        again = np.zeros(len(order), bool)
        again[1:] = (same[1:] == same[:-1]) & (item[1:] == item[:-1])
        keys, same, item, begin, end = keys[~again], same[~again], item[~again], begin[~again], end[~again]
        new = np.ones(len(keys), bool)
        new[1:] = same[1:] != same[:-1]
        self.keys, self.begin, self.size = keys[new], begin[new], (end - begin)[new].astype(np.int32)
        self.posting = np.append(np.flatnonzero(new), len(keys))
        self.item = item.astype(np.int32)

    def items(self, text: bytes, window: bytes) -> np.ndarray | None:
        """The items that hold a window, by its bytes; none if it is not there."""
        key = np.uint64(xxhash.xxh3_64_intdigest(window))
        i = int(np.searchsorted(self.keys, key))
        while i < len(self.keys) and self.keys[i] == key:
            a = int(self.begin[i])
            if text[a : a + int(self.size[i])] == window:
                return self.item[self.posting[i] : self.posting[i + 1]]
            i += 1
        return None


class BenchmarkIndex:
    """The kept grams and the windows of some items, all in sorted arrays (about seven bytes a byte of text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)} | {None: -1}
        data, offsets = K.flat(pa.array([t for _, t in items], pa.large_string()))
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, K.ALNUM)
        hashes, doc = K.span_hashes(data, starts, ends), K.doc_of(first)
        raw = data.tobytes()
        self.text = b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = ends - starts
        begin = np.cumsum(size + 1) - size - 1
        owner = np.array([number[i] for i, _ in items], np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(first), window)
        self.windows: dict[int, WindowTable] = {}
        self.kept: dict[int, np.ndarray] = {}
        for n in sorted(set(count[count > 0].tolist())):
            at = np.flatnonzero((doc[: len(doc) - n + 1] == doc[n - 1 :]) & (count[doc[: len(doc) - n + 1]] == n))
            self.windows[n] = WindowTable(self.text, begin[at], begin[at + n - 1] + size[at + n - 1], owner[at])
            values = kept_grams(hashes, window, gram) if n == window else K.ngram_hashes(hashes, n)
            self.kept[n] = np.unique(values[at])

    def nbytes(self) -> int:
        tables = [x for t in self.windows.values() for x in (t.keys, t.begin, t.size, t.posting, t.item)]
        return len(self.text) + sum(x.nbytes for x in [*tables, *self.kept.values()])

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """``(first word of each document, hit mask over all words, items of each document)``."""
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, K.ALNUM)
        hashes, doc = K.span_hashes(data, starts, ends), K.doc_of(first)
        hit = np.zeros(len(doc), bool)
        items: dict[int, set] = defaultdict(set)
        for n, kept in self.kept.items():
            values = kept_grams(hashes, n, self.gram) if n == self.window else K.ngram_hashes(hashes, n)
            if not len(values):
                continue
            new = np.ones(len(values), bool)  # neighbouring windows mostly keep the same gram: ask once
            new[1:] = values[1:] != values[:-1]
            at = _member(values[new], kept)
            found = np.flatnonzero(at[np.cumsum(new) - 1] & (doc[: len(values)] == doc[n - 1 :]))
            good = []
            for i in found.tolist():
                window = b" ".join([data[starts[j] : ends[j]].tobytes() for j in range(i, i + n)])
                known = self.windows[n].items(self.text, window)
                if known is not None:
                    good.append(i)
                    items[int(doc[i])].update(known.tolist())
            hit |= K.cover(len(doc), np.array(good, np.int64), n)
        return first, hit, {d: {self.names[x] for x in xs if x >= 0} for d, xs in items.items()}


def _without(text: str, cuts: list[dict]) -> str:
    """The text without the words of some spans and the blanks after them."""
    raw = text.encode()
    data = K.LOWER[np.frombuffer(raw, np.uint8)]
    starts, _, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
    out, at = [], 0
    for s in cuts:
        out.append(raw[at : starts[s["begin"]]])
        at = int(starts[s["end"]]) if s["end"] < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    gram: int = GRAM,
    max_block_bytes: int = MAX_BLOCK_BYTES,
    cut: bool = False,
    shortest_cut: int | None = None,
) -> DataFrame:
    """Adds ``n_words, n_hit, hit_spans, item_ids`` to the rows of ``docs`` (replacing columns of these names).

    ``hit_spans`` are ``[begin, end)`` in words; ``item_ids`` are strings in string order.
    ``cut`` also takes hit spans out of the text, with the blank after them, if they have
    ``shortest_cut`` words or more (a window by default): ordinary text holds very short items by chance.
    """
    spark = docs.sparkSession
    shortest = window if shortest_cut is None else shortest_cut
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col("text").alias("body")).where("body is not null")
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-int(size) // max_block_bytes))
    made = ["n_words", "n_hit", "hit_spans", "item_ids"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    keep = [c for c in docs.columns if c not in made]
    added = "n_words long, n_hit long, hit_spans array<struct<begin:int,end:int>>, item_ids array<string>"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), added])
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    where = keep.index(text)
    out = docs.select(*[f"`{c}`" for c in keep])
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == k)
        # One block is indexed here and sent once to each worker, which keeps it for all its tasks.
        sent = spark.sparkContext.broadcast(BenchmarkIndex([tuple(r) for r in part.collect()], window, gram))

        def run(batches, sent=sent, k=k):
            index = sent.value
            for batch in batches:
                data, offsets = K.flat(batch.column(where))
                for i, j in K.slices(offsets):
                    sub = batch.slice(i, j - i)
                    first, hit, items = index.find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    before = (sub.column(len(keep) + 2).to_pylist(), sub.column(len(keep) + 3).to_pylist()) if k else None
                    n_hit, all_spans, all_items = [], [], []
                    for d in range(j - i):
                        mask = hit[first[d] : first[d + 1]]
                        ids = set(items.get(d, ()))
                        if before:
                            for s in before[0][d]:
                                mask[s["begin"] : s["end"]] = True
                            ids |= set(before[1][d])
                        a, b = K.runs(mask) if mask.any() else ((), ())
                        n_hit.append(int(mask.sum()))
                        all_spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                        all_items.append(sorted(ids))
                    columns = list(sub.columns[: len(keep)])
                    if cut and k == blocks - 1 and any(all_spans):
                        texts = columns[where].to_pylist()
                        for d, found in enumerate(all_spans):
                            if long := [s for s in found if s["end"] - s["begin"] >= shortest]:
                                texts[d] = _without(texts[d], long)
                        columns[where] = pa.array(texts, pa.string())
                    columns += [pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64())]
                    columns += [pa.array(all_spans, spans), pa.array(all_items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])
            K.release()

        out = out.mapInArrow(run, schema)
        if k < blocks - 1:  # one block's index lives at a time
            out = stage(out, f"leaks-{k}")
            sent.destroy()
    return out
