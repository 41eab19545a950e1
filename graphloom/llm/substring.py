"""Exact removal of repeated passages with a log-structured fingerprint index.

A window is ``window`` consecutive words of one document.  Its fingerprint is the smallest
hash of the ``gram``-word grams inside it, so equal windows have equal fingerprints, and
neighbouring windows mostly share one: the index holds about one entry in seven words.

* **Append.**  The fingerprints of a batch become one sorted immutable run, cut by hash into
  buckets, with the chunk (a hash of id and text) each came from.
* **Merge-join.**  Bucket by bucket the new run is merged with the runs of all earlier
  batches; what occurs twice or more is reported to the chunks that hold it.
* **Verify.**  Only windows under a reported fingerprint are looked at: chunks send 128-bit
  BLAKE2 digests of the words of these windows, the first place of each in the chunk only,
  and learn which of them start earlier elsewhere.  A fingerprint alone never removes a word.
* **Compact.**  Before an append that finds ``fanout`` runs, they are merged into one.

A later batch can be judged against all history: ``remove_repeats(docs, index=index)`` keeps
the runs and the packed documents of each batch, and history counts as earlier.

No key is hot.  A fingerprint that one task meets in more than ``HOT`` chunks is known to
repeat, so the task reports it to those chunks itself and sends on two entries; and the
places of one window in many chunks are settled in parts of ``PART`` chunks first.  So a passage
that a third of all documents share costs a bucket a few entries a task or part.  A chunk is
about ``CHUNK_BYTES`` of text (or one document); documents travel as compressed Arrow batches.

"Earlier" is the smaller document id, or an earlier start in the same document; documents
with equal ids go by a digest of their text, those with a null id come after all others.
Null texts have no words; texts of fewer words than a window have no window and stay whole.
Further columns may bear any name: inside, columns are numbered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import new_path

WINDOW, GRAM = 20, 8
CHUNK_BYTES = 4 << 20
#: Text whose fingerprints share a bucket, about.
BUCKET_BYTES = 8 << 20
#: Chunks of one task beyond which it reports a fingerprint itself.
HOT = 8
#: Fingerprints that a task gathers before it writes them out as a piece of the run.
FLUSH = 2_000_000
#: Chunks whose places of one window meet in one task.
PART = 4096
PACK_BYTES = 16 << 20
LAST = np.iinfo(np.int64).max

_U32, _U64 = np.dtype("<u4"), np.dtype("<u8")


# --- packed columns -------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length; the first is sorted and kept as differences.  Byte planes compress well."""
    first = arrays[0].copy()
    first[1:] = arrays[0][1:] - arrays[0][:-1]
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in (first, *arrays[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The buckets (equal ranges of the hash) that sorted keys fall into, and where each lies."""
    if not len(keys):
        return []
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return [(int(of[s.start]), s) for s in _groups(of)]


def _groups(values: np.ndarray) -> list[slice]:
    """Where each run of equal neighbours lies."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``size`` neighbours, by doubling."""
    done = 1
    while done * 2 <= size:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = size - done
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


class Windows:
    """The words of some documents, their hashes, and the fingerprint of each window."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.data, self.window, self.gram = data, window, gram
        self.starts, self.ends, self.first = K.words(data, offsets)
        self.hashes = K.span_hashes(data, self.starts, self.ends)
        self.doc = K.doc_of(self.first)
        n = len(self.hashes) - window + 1
        self.valid = self.doc[:n] == self.doc[window - 1 :] if n > 0 else np.zeros(0, bool)
        self.grams = K.ngram_hashes(self.hashes, gram)
        self.prints = _sliding(self.grams, window - gram + 1, np.minimum) if n > 0 else np.zeros(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """Positions of the grams that are the fingerprint of some window around them."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        span = self.window - self.gram + 1
        seen = np.where(self.valid, self.prints, np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        most = _sliding(np.concatenate([pad, seen, pad]), span, np.maximum)
        return np.flatnonzero(most == self.grams)

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of a 128-bit digest of the words of the windows at some ascending positions."""
        out, begin = bytearray(), np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        for part in _groups(self.doc[at]):
            a, b = (int(self.first[self.doc[at[part.start]] + k]) for k in (0, 1))
            words = b" ".join(self.data[int(self.starts[a]) : int(self.ends[b - 1])].tobytes().split())
            low, high = begin[at[part]] - begin[a], begin[at[part] + self.window] - begin[a] - 1
            for i, j in zip(low.tolist(), high.tolist(), strict=True):
                out += hashlib.blake2b(words[i:j], digest_size=16).digest()
        both = np.frombuffer(out, _U64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


# --- the index ------------------------------------------------------------------------

_STEP = "kind int, bucket int, chunk int, blob binary"
_NEW, _RUN, _REPEAT, _SEEN, _LATER = -1, 0, 1, 2, 3


def _step_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "bucket", "chunk", "blob"])


def _step_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_step_batch(rows)])


def _to_chunks(kind: int, chunk: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """One row for each chunk with its different values, sorted; a bucket is only where it passes through."""
    order = np.lexsort((values, chunk))
    chunk, values = chunk[order], values[order]
    return [(kind, int(chunk[s.start]) % buckets, int(chunk[s.start]), pack(np.unique(values[s]))) for s in _groups(chunk)]


def _numbered(docs: DataFrame, base: int, chunks: int, keep: list[str]) -> DataFrame:
    """``id, text, k0, k1 ... , chunk``.  Rows without an id, or with equal ones, are spread by their texts."""
    chunk = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(chunks)).cast("int") + F.lit(base)
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), *kept, chunk.cast("int").alias("chunk"))


def _fingerprints(docs: DataFrame, base: int, buckets: int, chunks: int, window: int, gram: int) -> DataFrame:
    """Pieces of the new run: rows of ``_STEP``, sorted fingerprints with their chunks.

    Of equal pairs of fingerprint and chunk two are enough to show the repeat.  What repeats in
    more than ``HOT`` entries of a piece is reported at once; two entries tell all others.
    """

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def pieces():
            keys = np.concatenate([h[0] for h in held])
            chunk = np.concatenate([h[1] for h in held])
            held.clear()
            order = np.lexsort((chunk, keys))
            keys, chunk = keys[order], chunk[order]
            third = np.zeros(len(keys), bool)
            third[2:] = (keys[2:] == keys[:-2]) & (chunk[2:] == chunk[:-2])
            keys, chunk = keys[~third], chunk[~third]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(keys)))
            hot = np.repeat(size > HOT, size)
            rows = _to_chunks(_REPEAT, chunk[hot], keys[hot], buckets)
            stay = ~hot | (np.arange(len(keys)) - np.repeat(start, size) < 2)
            keys, chunk = keys[stay], chunk[stay]
            rows += [(_NEW, b, -1, pack(keys[s], chunk[s])) for b, s in _by_bucket(keys, buckets)]
            for i in range(0, len(rows), 4096):
                yield _step_batch(rows[i : i + 4096])

        for batch in batches:
            data, offsets = K.flat(batch.column(0))
            chunk = batch.column(1).to_numpy().astype(_U32)
            for i, j in K.slices(offsets):
                w = Windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, gram)
                at = w.anchors()
                held.append((w.grams[at], chunk[i:j][w.doc[at]]))
                count += len(at)
                if count > FLUSH:
                    yield from pieces()
                    count = 0
        if held:
            yield from pieces()
        K.release()

    return _numbered(docs, base, chunks, []).select("text", "chunk").mapInArrow(run, _STEP)


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b, _U64, _U32) for b in blobs]
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, _U64)
    chunk = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, _U32)
    order = np.argsort(keys, kind="stable")  # merges the sorted runs
    return keys[order], chunk[order]


class FingerprintIndex:
    """Sorted immutable runs below a folder; each ``append`` adds one and reports the repeats it made.

    ``chunks`` numbers are taken for each set of documents that ``remove_repeats`` adds.
    """

    def __init__(
        self, spark: SparkSession, chunks: int, buckets: int, *, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = 8
    ):
        if not 0 < gram <= window:
            raise ValueError("a gram is at most as long as a window")
        if fanout < 2:
            raise ValueError("a compaction takes two runs or more")
        self.spark, self.chunks, self.buckets = spark, chunks, buckets
        self.window, self.gram, self.fanout = window, gram, fanout
        self.path = path or new_path(spark, "index")
        self.runs: list[str] = []
        self.reports: list[str] = []
        self.documents: list[str] = []
        self.base = 0
        self.steps = 0

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(_STEP).parquet(path)

    def append(self, docs: DataFrame) -> None:
        """Add the documents (``doc_id``, ``text``) of one batch."""
        if len(self.runs) >= self.fanout:
            self.compact()
        self.steps += 1
        target = f"{self.path}/step-{self.steps:05d}"
        buckets = self.buckets
        rows = _fingerprints(docs, self.base, buckets, self.chunks, self.window, self.gram)
        for path in self.runs:
            rows = rows.union(self._read(path).where(F.col("kind") == _RUN))

        def merge_join(key, table):
            bucket = key[0].as_py()
            kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
            new, new_chunk = _merged([b for k, b in zip(kinds, blobs, strict=True) if k == _NEW])
            old, old_chunk = _merged([b for k, b in zip(kinds, blobs, strict=True) if k == _RUN])
            out = [(_RUN, bucket, -1, pack(new, new_chunk))] if len(new) else []
            again = np.zeros(len(new), bool)
            again[1:] = new[1:] == new[:-1]
            twice = np.unique(np.concatenate([new[again], np.intersect1d(new, old)]))
            if len(twice):
                keys, chunk = np.concatenate([new, old]), np.concatenate([new_chunk, old_chunk])
                at = np.searchsorted(twice, keys)
                hit = twice[np.minimum(at, len(twice) - 1)] == keys
                out += _to_chunks(_REPEAT, chunk[hit], keys[hit], buckets)
            passed = table.filter(pc.equal(table.column("kind"), _REPEAT))
            return pa.concat_tables([passed.cast(_step_table([]).schema), _step_table(out)])

        rows.groupBy("bucket").applyInArrow(merge_join, _STEP).write.parquet(target)
        self.runs.append(target)
        self.reports.append(target)

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) < 2:
            return
        self.steps += 1
        target = f"{self.path}/step-{self.steps:05d}"

        def merge(key, table):
            return _step_table([(_RUN, key[0].as_py(), -1, pack(*_merged(table.column("blob").to_pylist())))])

        rows = self._read(self.runs[0])
        for path in self.runs[1:]:
            rows = rows.union(self._read(path))
        rows.where(F.col("kind") == _RUN).groupBy("bucket").applyInArrow(merge, _STEP).write.parquet(target)
        self.runs = [target]

    def repeats(self) -> DataFrame:
        """What was reported so far: rows of ``_STEP`` of kind ``_REPEAT``."""
        out = self._read(self.reports[0])
        for path in self.reports[1:]:
            out = out.union(self._read(path))
        return out.where(F.col("kind") == _REPEAT)


# --- verification and removal ---------------------------------------------------------


_PACKED = "chunk int, blob binary"


def _packed(docs: DataFrame, base: int, chunks: int, keep: list[str]) -> DataFrame:
    """Rows ``(chunk, blob)``: the documents of a chunk that a task has met, as a compressed Arrow batch."""

    def run(batches):
        held, size = [], 0

        def blobs():
            table = pa.Table.from_batches(held)
            chunk = table.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            table = table.drop_columns(["chunk"])
            out = []
            for s in _groups(chunk[order]):
                sink = pa.BufferOutputStream()
                part = table.take(pa.array(order[s])).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part)
                out.append((int(chunk[order[s.start]]), zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())))
                if len(out) == 64:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["chunk", "blob"])

        for batch in batches:
            step = max(1, int(batch.num_rows * PACK_BYTES / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                held.append(part)
                size += part.nbytes
                if size >= PACK_BYTES:
                    yield from blobs()
                    held, size = [], 0
        if held:
            yield from blobs()
        K.release()

    return _numbered(docs, base, chunks, keep).mapInArrow(run, _PACKED)


def _documents(table: pa.Table) -> pa.Table:
    """The documents of a chunk in their order, and ``tie``, a digest of the text that orders equal ids; null ids last."""
    parts = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all() for b in table.column("blob").to_pylist()]
    docs = pa.concat_tables(parts)
    ties = [xxhash.xxh3_64_intdigest(t.as_py() or "") >> 32 for t in docs.column("text")]
    docs = docs.append_column("tie", pa.array(ties, pa.uint32()))
    return docs.sort_by([("id", "ascending"), ("tie", "ascending"), ("text", "ascending")]).combine_chunks()


class Chunk:
    """The windows of a chunk that stand under a repeated fingerprint, and where each first starts."""

    def __init__(self, docs: pa.Table, repeats: list[bytes], window: int, gram: int):
        data, offsets = K.flat(docs.column("text"))
        self.n_docs = docs.num_rows
        ids = docs.column("id").cast(pa.int64()).fill_null(LAST).to_numpy() if docs.num_rows else np.zeros(0, np.int64)
        self.w = w = Windows(data, offsets, window, gram)
        known = np.unique(np.concatenate([unpack(b, _U64)[0] for b in repeats])) if repeats else np.zeros(0, _U64)
        at = np.searchsorted(known, w.prints)
        found = known[np.minimum(at, len(known) - 1)] == w.prints if len(known) else np.zeros(len(w.prints), bool)
        at = np.flatnonzero(found & w.valid)  # window starts, in document order
        key, check = w.digests(at)
        order = np.lexsort((at, check, key))
        key, check, at = key[order], check[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        #: For each sorted window, which of the different ones it is; the first of each is its first place.
        self.sorted_at, self.which, self.is_first = at, np.cumsum(new) - 1, new
        self.key, self.check = key[new], check[new]
        place = at[new]
        self.ids = ids[w.doc[place]]
        self.tie = docs.column("tie").to_numpy()[w.doc[place]].astype(_U32) if self.n_docs else np.zeros(0, _U32)
        self.begin = (place - w.first[w.doc[place]]).astype(_U32)

    def removed(self, later: np.ndarray) -> np.ndarray:
        """Which words go: windows that repeat inside the chunk, or are among the numbers ``later``."""
        seen = np.zeros(len(self.key), bool)
        seen[later] = True
        gone = ~self.is_first | seen[self.which] if len(self.which) else np.zeros(0, bool)
        return K.cover(len(self.w.doc), self.sorted_at[gone], self.w.window)


#: Digest, id, tie, start, chunk and number in the chunk of a window's first place.
_PLACES = (_U64, _U64, np.dtype("<i8"), _U32, _U32, _U32, _U32)


def _losers(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of some places by key, and which places are not the first of their window."""
    key, check, ids, tie, begin, chunk, number = columns
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    at = some[np.lexsort((number[some], chunk[some], begin[some], tie[some], ids[some], chunk[some] >= base, check[some], key[some]))]
    lost = np.zeros(len(key), bool)
    lost[at[1:]] = (key[at[1:]] == key[at[:-1]]) & (check[at[1:]] == check[at[:-1]])
    return order, lost


def _sent(packed: DataFrame, repeats: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """First places of each chunk's different candidate windows, by bucket."""

    def send(left, right):
        if not left.num_rows or not right.num_rows:
            return _step_table([])
        c = Chunk(_documents(left), right.column("blob").to_pylist(), window, gram)
        chunk, n = left.column("chunk")[0].as_py(), len(c.key)
        columns = [c.key, c.check, c.ids, c.tie, c.begin, np.full(n, chunk, _U32), np.arange(n, dtype=_U32)]
        K.release()
        return _step_table([(_SEEN, b, chunk, pack(*(x[s] for x in columns))) for b, s in _by_bucket(c.key, buckets)])

    return packed.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(send, _STEP)


def _later(sent: DataFrame, base: int, buckets: int, chunks: int) -> DataFrame:
    """For each chunk the numbers of its windows that start earlier in another chunk.

    A window is held by a bucket at most once a chunk.  With more than ``PART`` chunks, parts of
    them are settled first, and only a part's first places go on.
    """

    def judge(final: bool):
        def run(key, table):
            kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
            parts = [unpack(b, *_PLACES) for k, b in zip(kinds, blobs, strict=True) if k == _SEEN]
            out = []
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                del parts
                order, lost = _losers(columns, base)
                out = _to_chunks(_LATER, columns[5][lost], columns[6][lost], buckets)
                if not final:
                    order = order[~lost[order]]
                    out.append((_SEEN, key[0].as_py(), -1, pack(*(x[order] for x in columns))))
                del columns
            K.release()
            table = table.select(["kind", "bucket", "chunk", "blob"])
            passed = table.filter(pc.equal(table.column("kind"), _LATER))
            return pa.concat_tables([passed.cast(_step_table([]).schema), _step_table(out)])

        return run

    if (parts := -(-chunks // PART)) > 1:
        sent = sent.withColumn("part", F.col("chunk") % parts).groupBy("bucket", "part").applyInArrow(judge(False), _STEP)
    return sent.groupBy("bucket").applyInArrow(judge(True), _STEP).where(F.col("kind") == _LATER)


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> bytes:
    """A text without some words and the blanks after them; all else stays as it is."""
    out, at = [], 0
    for i, j in zip(*K.runs(mask), strict=True):
        out.append(raw[at : starts[i]])
        at = int(starts[j]) if j < len(starts) else int(ends[-1])
    return b"".join([*out, raw[at:]])


def remove_repeats(
    docs: DataFrame,
    *,
    index: FingerprintIndex | None = None,
    n_batches: int = 3,
    fanout: int = 2,
    window: int = WINDOW,
    gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES,
    keep: list[str] | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Remove every word inside a window that also starts earlier.

    ``docs`` has ``doc_id`` (an integer), ``text`` and other columns, of which ``keep`` stay (all by
    default).  Batches are ranges of the id, appended to the index one after another; a given
    ``index`` goes on from its history, all of which is earlier, and keeps these documents too.
    Adds ``n_words, n_removed, kept_sha256`` and, unless ``keep_text`` is false, ``kept_text`` (the kept
    words joined by one space), ``cut_text`` (the text as it was but for the removed words, the
    same text or null where nothing goes) and ``removed_spans`` (``[begin, end)`` in words).
    """
    spark = docs.sparkSession
    made = ["n_words", "n_removed", "kept_sha256", "kept_text", "cut_text", "removed_spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*made, "text", "doc_id")]
    docs = docs.select("doc_id", "text", *[f"`{c}`" for c in keep])
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunks = max(8, -(-size // chunk_bytes))
    stored = index is not None
    if index is None:
        index = FingerprintIndex(spark, chunks, max(8, -(-size // BUCKET_BYTES)), window=window, gram=gram, fanout=fanout)
    index.chunks = chunks
    base, buckets, window, gram = index.base, index.buckets, index.window, index.gram
    edges = docs.approxQuantile("doc_id", [k / n_batches for k in range(1, n_batches)], 0.01) if n_batches > 1 else []
    edges = sorted({int(e) for e in edges})
    slim = docs.select("doc_id", "text")
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = slim
        if low is not None:
            part = part.where((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        index.append(part)
    repeats = index.repeats()
    # Both uses of the packed documents are one shuffle: the plans are equal, so Spark reuses the exchange.
    packed = everything = _packed(docs, base, chunks, keep)
    if stored:
        path = f"{index.path}/documents-{len(index.documents):05d}"
        packed.write.parquet(path)
        packed = everything = spark.read.schema(_PACKED).parquet(path)
        for old in index.documents:
            everything = everything.union(spark.read.schema(_PACKED).parquet(old))
        index.documents.append(path)
    index.base += chunks
    later = _later(_sent(everything, repeats, buckets, window, gram), base, buckets, index.base)
    reports = repeats.union(later).where(F.col("chunk") >= base)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", *keep, *(made if keep_text else made[:3])]

    def finish(left, right):
        table = _documents(left)
        kind, blobs = (right.column(c).to_pylist() for c in ("kind", "blob"))
        c = Chunk(table, [b for k, b in zip(kind, blobs, strict=True) if k == _REPEAT], window, gram)
        numbers = [unpack(b, _U32)[0] for k, b in zip(kind, blobs, strict=True) if k == _LATER]
        gone = c.removed(np.concatenate(numbers) if numbers else np.zeros(0, _U32))
        w, given = c.w, table.column("text")
        counts, sha, texts, cut, cuts = [], [], [], [], []
        for d in range(c.n_docs):
            a, b = int(w.first[d]), int(w.first[d + 1])
            mask = gone[a:b]
            words = w.data[int(w.starts[a]) : int(w.ends[b - 1])].tobytes().split() if b > a else []
            if mask.any():
                words = [x for x, g in zip(words, mask.tolist(), strict=True) if not g]
            text = b" ".join(words)
            counts.append((b - a, int(mask.sum())))
            sha.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                texts.append(text.decode())
                whole = given[d].as_py()
                if mask.any():
                    raw = whole.encode()
                    low = int(w.starts[a]) - (len(raw) - len(raw.lstrip(b" \t\n\v\f\r")))
                    whole = _without(raw, w.starts[a:b] - low, w.ends[a:b] - low, mask).decode()
                cut.append(whole)
                x, y = K.runs(mask)
                cuts.append([{"begin": int(i), "end": int(j)} for i, j in zip(x, y, strict=True)])
        out = [table.column("id"), *(table.column(f"k{i}") for i in range(len(keep)))]
        out += [pa.array([x[0] for x in counts], pa.int64()), pa.array([x[1] for x in counts], pa.int64()), pa.array(sha, pa.string())]
        if keep_text:
            out += [pa.array(texts, pa.string()), pa.array(cut, pa.string()), pa.array(cuts, spans)]
        return pa.table(out, names=names)

    more = ["kept_text string, cut_text string, removed_spans array<struct<begin:int,end:int>>"] * keep_text
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"`{c}` {kinds[c]}" for c in keep), "n_words long, n_removed long, kept_sha256 string", *more])
    return packed.groupBy("chunk").cogroup(reports.groupBy("chunk")).applyInArrow(finish, schema)
