"""SimHash near-duplicates by covering locality-sensitive hashing.

The fingerprint of a text: words between ASCII white space, A-Z lower-cased, shingles of
``shingle`` words with repeats, XXH64 (seed 42) of each, and for each bit the majority.

Covering masks: bit position ``i`` gets a vector ``m(i)`` of ``radius + 1`` bits.  For each
vector ``v`` except zero, the mask of table ``v`` keeps the positions where the inner
product of ``m(i)`` and ``v`` is odd.  Up to ``radius`` positions never span the whole
space, so some ``v`` is orthogonal to all of them, and two fingerprints that differ just
there agree under that mask: every pair within the radius meets in some table.

Only distinct fingerprints are sketched.  Tables are first counted (pre-aggregated); cells
with two fingerprints are compared at once, those with up to ``CELL`` in one vectorised
search that returns a spanning forest, never all pairs.  Larger cells are not compared
pairwise: each of their fingerprints lists the values within ``radius / 2`` flips, and all
that list the same value are within the radius of each other, which links them in linear
work (at most a fixed number can list one value).  No cell is capped or dropped.

Null and empty texts have fingerprint zero, which is linked like any other.  Rows with
equal ids keep a row each.  Rows whose id is null get the component of their fingerprint.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stage
from .textkernel import LOWER, release

SEED, BITS = 42, 64
#: Largest cell that is searched in one task (its fingerprints are 8 bytes each).
CELL = 4096
_HASH_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    if not text:
        return 0
    words = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    k = min(shingle, len(words))
    begin, end = begin[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, len(begin), _HASH_BLOCK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(begin[i : i + _HASH_BLOCK], end[i : i + _HASH_BLOCK], strict=True)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(begin)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the fingerprint as a signed long, ``fp``; one narrow pass."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keep, "fp"])
        release()

    return docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp long"]))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The ``2 ** (radius + 1) - 1`` masks; positions are dealt evenly over the nonzero vectors."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values within ``radius`` of each other."""
    values = np.unique(values)
    bits = values.view(np.uint64)  # of signed values numpy counts the bits of the magnitude
    left, links = np.ones(len(values), bool), []
    for root in range(len(values)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(bits[rest] ^ bits[at]) <= radius]
            left[near] = False
            links += [(at, int(j)) for j in near]
            front += near.tolist()
    return [(int(values[a]), int(values[b])) for a, b in links]


def links_within(fps: DataFrame, radius: int = 4, cell: int = CELL) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct values ``fp`` exactly as all pairs within ``radius`` do."""
    spark = fps.sparkSession
    sketches = [F.struct(F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("cell"), "fp") for v, m in enumerate(covering_masks(radius))]
    cells = fps.select(F.explode(F.array(*sketches)).alias("s")).select("s.cell", "s.fp")
    full = stage(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = full.where("n = 2").where(near).select("a", "b")

    def search(batches):
        for batch in batches:
            found = [x for row in batch.column(0) for x in forest(np.array(row.values.to_numpy(zero_copy_only=False), np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    grouped = cells.join(full.where(f"n > 2 and n <= {cell}").select("cell"), "cell").groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    found = grouped.select("fps").mapInArrow(search, "a long, b long")
    out = pairs.union(found)
    if full.where(f"n > {cell}").limit(1).count():
        hot = cells.join(full.where(f"n > {cell}").select("cell"), "cell").select("fp").distinct()
        flips = [0, *(sum(1 << i for i in c) for k in range(1, (radius + 1) // 2 + 1) for c in itertools.combinations(range(BITS), k))]
        table = np.array(flips, np.uint64).view(np.int64)

        def spread(batches):
            for batch in batches:
                values = batch.column(0).to_numpy()
                for i in range(0, len(values), 64):
                    part = values[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ table[None]).ravel()), pa.array(np.repeat(part, len(table)))], names=["value", "fp"])

        # A value is listed by at most len(flips) different fingerprints.
        met = hot.mapInArrow(spread, "value long, fp long").groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
        out = out.union(star.where(near))
    return out.distinct()


def _components(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct`` (a row for each fingerprint ``fp``) with ``component``, the same for all of a group."""
    links = stage(links_within(distinct.select("fp"), radius), "near")
    of = stage(connected_components(links), "components")
    return distinct.join(of, distinct.fp == of.node, "left").select(*distinct.columns, F.coalesce("component", "fp").alias("component"))


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each group: that of the least key (null last), then of the least digest of its text."""
    row = F.concat(F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n")), F.lit(" "), F.coalesce(F.sha2(F.col(text), 256), F.lit("n")))
    named = docs.withColumn("_row", row)
    prints = stage(with_fingerprints(named.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), "_row"), "text", shingle, ["doc_id", "_row"]), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")), "distinct")
    least = _components(distinct, radius).groupBy("component").agg(F.min("least").alias("least")).select("least._row")
    return named.join(stage(least, "least"), "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row; the component is its smallest key.

    ``fingerprint`` is 16 hex digits, ``n_group`` the number of rows in the component.
    """
    prints = stage(with_fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", shingle, ["doc_id"]), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")), "distinct")
    whole = _components(distinct, radius)
    groups = whole.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("rows").alias("n_group"))
    named = stage(whole.select("fp", "component").join(groups, "component").select("fp", "component_id", "n_group"), "groups")
    return prints.join(named, "fp").select(F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_group")
