"""URL allow and block rules in a sorted digest array.

A rule is ``host/path-prefix``.  It fits its host and all subdomains if the url's path
starts with the rule's path; the longest rule wins, of equal lengths the one with the
longer host.  Rules are kept as one file: sorted 64-bit xxhash keys, verdicts, and the full
strings.  Executors map it into memory, probe it with a vectorised binary search, and
compare the stored string of every hit, so a digest collision can never decide a url.

The file is written to the shared folder and goes to each executor once (``SparkContext.addFile``)
while it is no larger than ``max_index_bytes``; a larger rule set is joined instead, both sides
shuffled.  Both ways refuse a rule without host or path and a rule with two verdicts.

Null urls and urls without ``://`` have an empty host and path, and fit no rule.  A url
whose path is empty fits no rule, as each rule's path starts with ``/``.  Repeated rows stay.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path

ALLOW, BLOCK = "allow", "block"
MAX_INDEX_BYTES = 64 << 20
_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """``(host, path)``; both empty if there is no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    if not host or not slash:
        raise ValueError(f"a rule is host/path, not {rule!r}")
    return host.translate(_LOWER), slash + path


def suffixes(host: str) -> Iterator[str]:
    """The host and its parent domains, longest first."""
    while host:
        yield host
        host = host.partition(".")[2]


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every rule string that would fit: longest first, of equal lengths the longer host first."""
    found = [(s + path[:n], len(s)) for s in suffixes(host) for n in lengths if n <= len(path)]
    found.sort(key=lambda x: (-len(x[0]), -x[1]))
    return [x[0] for x in found]


class DigestArray:
    """A memory-mapped file of sorted digests, the verdicts, and the strings they stand for."""

    def __init__(self, path: str):
        head = np.fromfile(path, "<i8", 2)
        n, k = int(head[0]), int(head[1])
        at = 16
        self.lengths = np.fromfile(path, "<i8", k, offset=at).tolist()
        at += 8 * k
        self.keys = np.memmap(path, "<u8", "r", at, (n,)) if n else np.zeros(0, "<u8")
        at += 8 * n
        self.offsets = np.memmap(path, "<i8", "r", at, (n + 1,))
        at += 8 * (n + 1)
        self.verdicts = np.memmap(path, "u1", "r", at, (n,)) if n else np.zeros(0, "u1")
        at += n
        size = int(self.offsets[-1])
        self.strings = np.memmap(path, "u1", "r", at, (size,)) if size else np.zeros(0, "u1")

    @staticmethod
    def write(path: str, rules: Iterable[tuple[str, str]]) -> None:
        with open(path, "wb") as f:
            f.write(DigestArray.packed(rules))

    @staticmethod
    def packed(rules: Iterable[tuple[str, str]]) -> bytes:
        """The bytes of the file.  ``rules`` are pairs of rule and verdict; a rule given twice must not change its verdict."""
        known: dict[str, int] = {}
        for rule, verdict in rules:
            key = "".join(split_rule(rule))
            if known.setdefault(key, int(verdict == BLOCK)) != int(verdict == BLOCK):
                raise ValueError(f"two verdicts for {rule!r}")
        rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in known.items())
        lengths = sorted({len(split_rule(r)[1]) for r in known})
        with io.BytesIO() as f:
            f.write(np.array([len(rows), len(lengths), *lengths], "<i8").tobytes())
            f.write(np.array([k for k, _, _ in rows], "<u8").tobytes())
            f.write(np.cumsum([0, *(len(r) for _, r, _ in rows)], dtype="<i8").tobytes())
            f.write(bytes(v for _, _, v in rows))
            f.write(b"".join(r for _, r, _ in rows))
            return f.getvalue()

    def string(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def probe(self, wanted: list[bytes]) -> np.ndarray:
        """The row of each string, -1 where it is not stored."""
        digests = np.array([xxhash.xxh64_intdigest(w) for w in wanted], "<u8")
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(wanted), -1, np.int64)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests) if len(self.keys) else []):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # equal digests lie together
                if self.string(j) == wanted[i]:
                    out[i] = j
                    break
                j += 1
        return out


_OPEN: dict[str, DigestArray] = {}
_SENT: set[tuple[str, str]] = set()


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], *, url: str = "url", otherwise: str = ALLOW, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to the rows of ``pages`` (replacing columns of these names).

    ``rules``: pairs ``(rule, verdict)``, or a DataFrame with these two columns.  ``otherwise``
    is the verdict of urls that no rule fits.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", url)]
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    made = "host string, path string, rule string, verdict string"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{url}` {kinds[url]}", made])
    rows = pages.select(*[f"`{c}`" for c in keep], f"`{url}`")
    if isinstance(rules, DataFrame):
        rules = rules.select("rule", "verdict").where("rule is not null and verdict is not null")
        size = rules.agg(F.sum(F.octet_length("rule") + 17)).first()[0] or 0
        if size > max_index_bytes:
            return _joined(rows, rules, url, keep, otherwise)
        rules = [tuple(r) for r in rules.collect()]
    name = f"rules-{xxhash.xxh64_hexdigest(repr(sorted(rules)).encode())}.idx"
    known = (spark.sparkContext.applicationId, name)  # the name follows from the rules: equal rules are sent once
    if known not in _SENT:
        target = f"{new_path(spark, 'rules')}/{name}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(DigestArray.packed(rules)))
        out.close()
        spark.sparkContext.addFile(target)
        _SENT.add(known)

    def run(batches):
        if name not in _OPEN:
            _OPEN[name] = DigestArray(SparkFiles.get(name))
        index = _OPEN[name]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            wanted, owner = [], []
            for i, (host, path) in enumerate(parts):
                found = candidates(host, path, index.lengths)
                wanted += [c.encode() for c in found]
                owner += [i] * len(found)
            at = index.probe(wanted)
            rule: list[str | None] = [None] * len(parts)
            verdict = [otherwise] * len(parts)
            for j in np.flatnonzero(at >= 0)[::-1]:  # the first of each url comes last and stays
                rule[owner[j]] = wanted[j].decode()
                verdict[owner[j]] = BLOCK if index.verdicts[at[j]] else ALLOW
            made = [pa.array(x, pa.string()) for x in ([p[0] for p in parts], [p[1] for p in parts], rule, verdict)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, schema)


_HOST, _REST = "^[^/]*", "^[^/]*(.*)$"


def _joined(rows: DataFrame, rules: DataFrame, url: str, keep: list[str], otherwise: str) -> DataFrame:
    """The way for rule sets too large for each executor: candidate strings meet the rules in a shuffle.

    Urls that no rule can fit by its length get a key of their own each, so none is hot.
    """
    bad = rules.where(~F.col("rule").rlike("^[^/]+/")).select("rule").first()
    if bad:
        raise ValueError(f"a rule is host/path, not {bad.rule!r}")
    host = F.translate(F.regexp_extract("rule", _HOST, 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stored = rules.select(F.concat(host, F.regexp_extract("rule", _REST, 1)).alias("rule"), (F.col("verdict") == BLOCK).alias("block"))
    stored = stored.groupBy("rule").agg(F.min("block").alias("block"), F.max("block").alias("most"))
    if two := stored.where("block <> most").select("rule").first():
        raise ValueError(f"two verdicts for {two.rule!r}")
    lengths = sorted(r[0] for r in rules.select(F.length(F.regexp_extract("rule", _REST, 1))).distinct().collect())  # path lengths
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*keep, url])], F.monotonically_increasing_id().alias("row"))

    def run(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(len(keep)).to_pylist()]
            found = [candidates(h, p, lengths) or [f"/{r}"] for (h, p), r in zip(parts, batch.column(len(keep) + 1).to_pylist(), strict=True)]
            made = [pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "host", "path", "wanted"])

    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate([*keep, url])), "host string, path string, wanted array<string>"])
    split = plain.mapInArrow(run, schema)
    # Equal candidate lists are judged once.
    probes = split.where(~F.startswith(F.col("wanted")[0], F.lit("/"))).select("wanted").distinct().select("wanted", F.posexplode("wanted").alias("place", "rule"))
    best = probes.join(stored, "rule").groupBy("wanted").agg(F.min_by(F.struct("rule", "block"), "place").alias("hit"))
    verdict = F.when(F.col("hit.block"), F.lit(BLOCK)).when(~F.col("hit.block"), F.lit(ALLOW)).otherwise(F.lit(otherwise))
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate([*keep, url])]
    return split.join(best, "wanted", "left").select(*names, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
