"""Quality rules as a learned decision list.

Statistics of every whole text are counted in one pass.  From labelled rows, sequential
covering grows conjunctions of thresholds for the rejected class (information gain on two
thirds of the rows), prunes them on the last third, and takes a rule only while its pruned
precision stays at ``min_precision``; what the rules cover leaves the training rows, and
the next rule is grown.  The list is emitted as one ordered Spark ``CASE`` expression, so
deciding costs no Python.

Null and empty texts have no words.  Without labels, or without a rule that is precise
enough, nothing but the base rule rejects.  Input columns that bear the name of a statistic
are replaced.  Repeated rows each get the same decision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import below

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits")
#: Features a rule may test: name and SQL over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}
#: Labelled rows that are used at most (expected; chosen by a hash of the id).
SAMPLE_ROWS = 20_000

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = K.byte_table((65, 90))
_LETTER = K.byte_table((65, 90), (97, 122), (0xC0, 0xFF))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_DIGIT = K.byte_table((48, 57))
_START = ~K.byte_table((0x80, 0xBF))


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return np.diff(total[offsets])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the entries whose key occurs twice or more, and of those that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    twice[order] = same | np.concatenate([same[1:], [False]])[: len(same)]
    return twice, later


def _keyed(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return K.mix(hashes + K.mix(doc.astype(np.uint64)))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs ``(a[i], b[i])``, equal exactly if both members are; below ``len(a)``."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text of a batch; lines and windows are equal only if their bytes are."""
    n_docs = len(offsets) - 1
    starts, ends, first = K.words(data, offsets)
    doc = K.doc_of(first)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_doc(K.NOT_SPACE[data] & _START[data], offsets)
    for name, table in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARKS), ("n_digits", _DIGIT)):
        out[name] = _per_doc(table[data], offsets)
    a, b, of = K.lines(data, offsets)
    line_doc = K.doc_of(of)
    inside = np.concatenate([[0], np.cumsum(K.NOT_SPACE[data], dtype=np.int64)])
    full = inside[b] > inside[a]
    a, b, line_doc = a[full], b[full], line_doc[full]
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)
    # Hashes only point out what may repeat (all that does, and rarely more); bytes decide.
    again = _repeated(_keyed(line_doc, K.span_hashes(data, a, b)))[0]
    a, b, line_doc = a[again], b[again], line_doc[again]
    out["n_dup_lines"] = np.bincount(line_doc[_repeated(_pairs(line_doc, K.exact_ids(data, a, b)))[1]], minlength=n_docs)
    grams = K.ngram_hashes(K.span_hashes(data, starts, ends), 3)
    at = np.flatnonzero(doc[: len(grams)] == doc[2:]) if len(grams) else np.zeros(0, np.int64)
    at = at[_repeated(_keyed(doc[at], grams[at]))[0]]
    read = np.flatnonzero(K.cover(len(doc), at, 3))
    word = np.zeros(len(doc), np.int64)
    word[read] = K.exact_ids(data, starts[read], ends[read])
    same = _pairs(_pairs(_pairs(doc[at], word[at]), word[at + 1]), word[at + 2])
    covered = K.cover(len(doc), at[_repeated(same)[0]], 3)
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n_docs)
    return out


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the statistics of ``text`` (columns ``COUNTS``); one narrow pass."""
    kept = [c for c in docs.columns if c not in COUNTS]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} long" for c in COUNTS)])
    where = kept.index(text)

    def run(batches):
        for batch in batches:
            data, offsets = K.flat(batch.column(where))
            for i, j in K.slices(offsets):
                found = count_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*kept, *COUNTS])
        K.release()

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def base_failed() -> Column:
    """The rule that holds before any learned one."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# --- learning -------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES.get(self.feature, self.feature)}) {'>=' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _best(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest gain among the rows (``y``: belongs to the class)."""
    p0, n0 = int(y.sum()), int((~y).sum())
    base, top, found = math.log2(p0 / (p0 + n0)), 0.0, None
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, hit = values[order], y[order]
        p = np.concatenate([[0], np.cumsum(hit)])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        for above in (True, False):
            pos = p0 - p[cut] if above else p[cut]
            total = len(v) - cut if above else cut
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / total) - base), 0)
            if len(gain) and gain.max() > top + 1e-9:
                k = int(gain.argmax())
                top, found = float(gain[k]), Condition(name, above, float((v[cut[k] - 1] + v[cut[k]]) / 2))
    return top, found


def learn(x: dict[str, np.ndarray], reject: np.ndarray, *, min_precision: float = 0.95, max_rules: int = 12, max_conditions: int = 4, min_cover: int = 5) -> list[Rule]:
    """Ordered rules for the rejected class by sequential covering; deterministic."""
    rules: list[Rule] = []
    left = np.ones(len(reject), bool)
    third = np.arange(len(reject)) % 3 == 2
    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        if not (reject & grow).any():
            break
        inside, conditions = grow.copy(), []
        while len(conditions) < max_conditions and (~reject[inside]).any():
            _, found = _best({k: v[inside] for k, v in x.items()}, reject[inside])
            if found is None:
                break
            conditions.append(found)
            inside &= found.holds(x)

        def worth(c: tuple[Condition, ...], prune=prune) -> float:
            hit = Rule(c).holds(x) & prune
            p, n = int((hit & reject).sum()), int((hit & ~reject).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1:
            scores = [worth(tuple(conditions[:i] + conditions[i + 1 :])) for i in range(len(conditions))]
            if max(scores) < worth(tuple(conditions)):
                break
            conditions.pop(int(np.argmax(scores)))
        rule = Rule(tuple(conditions))
        hit = rule.holds(x) & left
        p, n = int((hit & reject).sum()), int((hit & ~reject).sum())
        if not conditions or p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, **how) -> list[Rule]:
    """Learn from the labelled rows of ``docs`` (label 0 is rejected, 1 kept, others unused).

    About ``sample_rows`` labelled ids at most are chosen by a hash of the id; an id with both
    labels counts as rejected, and of rows that share an id one counts.  Only their texts are read for it.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("_label"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.xxhash64("key", F.lit(5)) < below(sample_rows / n))
    rows = docs.select(F.col(key).alias("key"), F.col("text").alias("text")).join(F.broadcast(known), "key")  # about sample_rows pairs of numbers
    picked = with_counts(rows).where(~base_failed()).select("key", "_label", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    # Rows that share an id count once, so that the table is bounded whatever repeats.
    once = picked.groupBy("key", "_label").agg(F.min(F.struct(*FEATURES)).alias("x")).select("key", "_label", "x.*")
    table = once.toPandas().sort_values("key").reset_index(drop=True)
    if not len(table):
        return []
    return learn({name: table[name].to_numpy(float) for name in FEATURES}, (table["_label"] == 0).to_numpy(), **how)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered expression over the counts: true keeps."""
    arms = " ".join(f"WHEN {r.sql()} THEN false" for r in rules)
    return F.expr(f"CASE {arms} ELSE true END") if rules else F.lit(True)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept``."""
    rows = with_counts(docs.drop("base_failed", "kept"), text)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
