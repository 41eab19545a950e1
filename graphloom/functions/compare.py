"""Three-valued comparison and arithmetic on typed columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError, NotSupported
from ..plans.types import BOOL, FLOAT, INT, NULL, NUMBER, STR, TEMPORAL, T, Typed, coerce, join_types, list_of, nothing


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def both_known(a: Column, b: Column, then: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), then)


def equal(a: Typed, b: Typed) -> Column:
    ka, kb = a.t.kind, b.t.kind
    if "null" in (ka, kb):
        return unknown()
    if ka in NUMBER and kb in NUMBER:
        if ka == kb == "int":
            return a.col == b.col
        x, y = a.col.cast("double"), b.col.cast("double")
        return (x == y) & ~F.isnan(x)
    if ka != kb:
        return both_known(a.col, b.col, F.lit(False))
    if ka in ("node", "rel"):
        return a.col["id"] == b.col["id"]
    if ka == "list":
        return _lists_equal(a, b)
    if ka == "map":
        return _maps_equal(a, b)
    if ka == "time":
        return (a.col["nanos"] - a.col["off"] * 1_000_000_000) == (b.col["nanos"] - b.col["off"] * 1_000_000_000)
    return a.col == b.col


def _lists_equal(a: Typed, b: Typed) -> Column:
    ea, eb = a.t.elem, b.t.elem
    same = F.size(a.col) == F.size(b.col)
    if ea == eb and ea.kind in ("null",):
        inner = F.when(F.size(a.col) == 0, F.lit(True)).otherwise(unknown())
    else:
        pairs = F.arrays_zip(a.col.alias("x"), b.col.alias("y"))
        pairs = F.zip_with(a.col, b.col, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        inner = F.forall(pairs, lambda p: equal(Typed(p["x"], ea), Typed(p["y"], eb)))
    return both_known(a.col, b.col, F.when(same, inner).otherwise(F.lit(False)))


def _maps_equal(a: Typed, b: Typed) -> Column:
    if a.t.fields is None or b.t.fields is None:
        x, y = (F.array_sort(F.map_entries(c.col)) for c in (a, b))
        return x == y
    fa, fb = dict(a.t.fields), dict(b.t.fields)
    if set(fa) != set(fb):
        return both_known(a.col, b.col, F.lit(False))
    parts = [equal(Typed(a.col[n], fa[n]), Typed(b.col[n], fb[n])) for n in fa]
    return both_known(a.col, b.col, reduce(lambda x, y: x & y, parts, F.lit(True)))


def less(op: str, a: Typed, b: Typed) -> Column:
    ka, kb = a.t.kind, b.t.kind
    if ka in NUMBER and kb in NUMBER:
        x, y = (a.col, b.col) if ka == kb == "int" else (a.col.cast("double"), b.col.cast("double"))
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return out if ka == kb == "int" else out & ~F.isnan(x) & ~F.isnan(y)
    if ka != kb or ka not in ("str", "bool", *TEMPORAL):
        return unknown()
    x, y = a.col, b.col
    if ka == "time":
        x, y = (c["nanos"] - c["off"] * 1_000_000_000 for c in (x, y))
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def contained(x: Typed, items: Typed) -> Column:
    """``x IN items``: true wins, then unknown."""
    if items.t.kind == "null":
        return unknown()
    if items.t.kind != "list":
        raise ArgumentError(f"IN needs a list, not {items.t}")
    if x.t.kind == "null" or items.t.elem.kind == "null":
        return F.when(F.size(items.col) == 0, F.lit(False)).otherwise(unknown())
    if isinstance(items.value, list) and x.t.kind in ("int", "str") and items.t.elem == x.t and None not in items.value:
        return x.col.isin(items.value) if items.value else F.when(x.col.isNull(), F.lit(False)).otherwise(F.lit(False))
    return F.exists(items.col, lambda e: equal(Typed(e, items.t.elem), x))


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    ka, kb = a.t.kind, b.t.kind
    if op == "+":
        if ka == "list" or kb == "list":
            return _list_plus(a, b)
        if "str" in (ka, kb) and {ka, kb} <= {"str", "int", "float", "bool", "null"}:
            from .scalar import to_string

            return Typed(F.concat(to_string(a).col.cast("string"), to_string(b).col.cast("string")), STR)
    if "null" in (ka, kb):
        return nothing() if ka == kb else Typed(F.lit(None).cast("bigint" if "int" in (ka, kb) else "double"), INT if "int" in (ka, kb) else FLOAT) if {ka, kb} & {"int", "float"} else nothing()
    if ka in (*TEMPORAL, "duration") or kb in (*TEMPORAL, "duration"):
        from .temporal import temporal_arithmetic

        return temporal_arithmetic(op, a, b)
    if ka not in NUMBER or kb not in NUMBER:
        raise ArgumentError(f"cannot apply {op} to {a.t} and {b.t}")
    if op == "^":
        return Typed(F.pow(a.col.cast("double"), b.col.cast("double")), FLOAT)
    if ka == kb == "int":
        if op == "/":
            return Typed(F.call_function("div", a.col, b.col).cast("bigint"), INT)
        return Typed({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col, "%": a.col % b.col}[op].cast("bigint"), INT)
    x, y = a.col.cast("double"), b.col.cast("double")
    if op == "/":
        zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return Typed(F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(F.try_divide(x, y)), FLOAT)
    if op == "%":
        return Typed(F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, F.lit(float("nan"))).otherwise(F.call_function("try_mod", x, y)), FLOAT)
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], FLOAT)


def _list_plus(a: Typed, b: Typed) -> Typed:
    if "null" in (a.t.kind, b.t.kind):
        return nothing()
    ea = a.t.elem if a.t.kind == "list" else a.t
    eb = b.t.elem if b.t.kind == "list" else b.t
    e = join_types(ea, eb)
    if e is None:
        raise NotSupported(f"a list that mixes {ea} and {eb}")
    t = list_of(e)
    x = coerce(a, t) if a.t.kind == "list" else F.array(coerce(a, e))
    y = coerce(b, t) if b.t.kind == "list" else F.array(coerce(b, e))
    return Typed(F.concat(x, y), t)


def text_test(op: str, a: Typed, b: Typed) -> Column:
    if a.t.kind != "str" or b.t.kind != "str":
        return unknown()
    return {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a.col, b.col)


def full_match(a: Typed, b: Typed) -> Column:
    """``=~``: the whole string; constructs that need backtracking are refused."""
    import re

    if "null" in (a.t.kind, b.t.kind):
        return unknown()
    if a.t.kind != "str" or b.t.kind != "str":
        raise ArgumentError("=~ needs strings")
    if isinstance(b.value, str):
        bare = re.sub(r"\\[^1-9k]", "", b.value)
        if re.search(r"\\[1-9k]|\(\?[=!>]|\(\?<[=!]|[*+?}]\+", bare):
            raise ArgumentError(f"the pattern {b.value!r} needs backtracking")
        try:
            re.compile(re.sub(r"\\[pP]\{[^}]*\}", "x", b.value))
        except re.error as e:
            raise ArgumentError(f"the pattern {b.value!r}: {e}") from None
    return F.rlike(a.col, F.concat(F.lit("\\A(?:"), b.col, F.lit(")\\z")))


def truth(x: Typed) -> Column:
    if x.t.kind == "null":
        return unknown()
    if x.t.kind != "bool":
        raise ArgumentError(f"a condition must be boolean, not {x.t}")
    return x.col


__all__ = ["BOOL", "NULL", "T", "arithmetic", "contained", "equal", "full_match", "less", "text_test", "truth"]
