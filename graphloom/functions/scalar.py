"""Scalar functions on typed columns: one builder for each name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError, NotSupported
from ..plans.types import BOOL, ENTITY, FLOAT, INT, NULL, NUMBER, STR, T, Typed, coerce, from_spark, join_types, list_of, nothing, to_spark

FUNCTIONS: dict[str, tuple[Callable, int, int]] = {}
#: White space that the trim family removes (all Unicode white space, not only blanks).
_BLANK = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def function(names: str, low: int = 1, high: int | None = None):
    """Register a builder for some names, with the number of arguments it takes."""

    def keep(build):
        for n in names.split():
            FUNCTIONS[n] = (build, low, low if high is None else high)
        return build

    return keep


def apply(name: str, args: list[Typed]) -> Typed:
    if name not in FUNCTIONS:
        raise ArgumentError(f"there is no function {name}")
    build, low, high = FUNCTIONS[name]
    if not low <= len(args) <= high:
        raise ArgumentError(f"{name} takes {low if low == high else f'{low} to {high}'} arguments, not {len(args)}")
    return build(*args) if name not in _NAMED else build(name, *args)


_NAMED: set[str] = set()


def refuse(name: str, x: Typed, *kinds: str) -> None:
    if x.t.kind not in (*kinds, "null"):
        raise ArgumentError(f"{name} cannot take {x.t}")


@function("coalesce", 1, 99)
def _coalesce(*args: Typed) -> Typed:
    t = NULL
    for a in args:
        if (j := join_types(t, a.t)) is None:
            raise NotSupported(f"coalesce of {t} and {a.t}")
        t = j
    return nothing() if t == NULL else Typed(F.coalesce(*[coerce(a, t) for a in args]), t)


@function("size")
def _size(x: Typed) -> Typed:
    refuse("size", x, "list", "str")
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("bigint"), INT)
    n = F.char_length(x.col) if x.t.kind == "str" else F.when(x.col.isNotNull(), F.size(x.col))
    return Typed(n.cast("bigint"), INT)


@function("length")
def _length(x: Typed) -> Typed:
    refuse("length", x, "path")
    return Typed(F.when(x.col.isNotNull(), F.size(x.col["rels"])).cast("bigint"), INT)


@function("nodes")
def _nodes(x: Typed) -> Typed:
    refuse("nodes", x, "path")
    return Typed(x.col["nodes"], x.t.field("nodes"))


@function("relationships rels")
def _relationships(x: Typed) -> Typed:
    refuse("relationships", x, "path")
    return Typed(x.col["rels"], x.t.field("rels"))


@function("head")
def _head(x: Typed) -> Typed:
    refuse("head", x, "list")
    return nothing() if x.t.kind == "null" else Typed(F.try_element_at(x.col, F.lit(1)), x.t.elem)


@function("last")
def _last(x: Typed) -> Typed:
    refuse("last", x, "list")
    return nothing() if x.t.kind == "null" else Typed(F.try_element_at(x.col, F.lit(-1)), x.t.elem)


@function("tail")
def _tail(x: Typed) -> Typed:
    refuse("tail", x, "list")
    return nothing() if x.t.kind == "null" else Typed(F.slice(x.col, 2, F.greatest(F.size(x.col), F.lit(1))), x.t)


@function("reverse")
def _reverse(x: Typed) -> Typed:
    refuse("reverse", x, "list", "str")
    return Typed(F.reverse(x.col), x.t)


@function("range", 2, 3)
def _range(a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    step = step or Typed(F.lit(1).cast("bigint"), INT, 1)
    for x in (a, b, step):
        if x.t.kind != "int":
            raise ArgumentError(f"range needs integers, not {x.t}")
    if step.value == 0:
        raise ArgumentError("range needs a step other than 0")
    s = step.col
    some = ((s > 0) & (a.col <= b.col)) | ((s < 0) & (a.col >= b.col))
    bad = F.when(s == 0, F.raise_error(F.lit("range needs a step other than 0")).cast("array<bigint>"))
    return Typed(bad.when(some, F.sequence(a.col, F.when(some, b.col).otherwise(a.col), F.when(some, s).otherwise(F.lit(1).cast("bigint")))).otherwise(F.array().cast("array<bigint>")), list_of(INT))


@function("isempty")
def _is_empty(x: Typed) -> Typed:
    refuse("isEmpty", x, "list", "str", "map")
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("boolean"), BOOL)
    if x.t.kind == "str":
        return Typed(x.col == "", BOOL)
    if x.t.fields is not None:
        return Typed(F.when(x.col.isNotNull(), F.lit(not x.t.fields)), BOOL)
    return Typed(F.when(x.col.isNotNull(), F.size(x.col) == 0), BOOL)


@function("apoc.coll.toset")
def _to_set(x: Typed) -> Typed:
    refuse("toSet", x, "list")
    return Typed(F.array_distinct(x.col), x.t)


@function("apoc.coll.min")
def _coll_min(x: Typed) -> Typed:
    refuse("min", x, "list")
    return nothing() if x.t.kind == "null" else Typed(F.array_min(x.col), x.t.elem)


# --- maps and entities ------------------------------------------------------------------


def property_struct(x: Typed) -> tuple[Column, tuple[tuple[str, T], ...]]:
    if x.t.kind in ENTITY:
        return x.col["properties"], x.t.fields or ()
    return x.col, x.t.fields or ()


@function("keys")
def _keys(x: Typed) -> Typed:
    refuse("keys", x, "map", "node", "rel")
    if x.t.kind == "null":
        return nothing()
    if x.t.kind == "map" and x.t.fields is None:
        return Typed(F.map_keys(x.col), list_of(STR))
    props, fields = property_struct(x)
    if x.t.kind == "map":
        return Typed(F.when(x.col.isNotNull(), F.array(*[F.lit(n) for n, _ in fields]).cast("array<string>")), list_of(STR))
    names = [F.when(props[n].isNotNull(), F.lit(n)) for n, _ in sorted(fields)]
    return Typed(F.when(x.col.isNotNull(), F.array_compact(F.array(*names).cast("array<string>"))), list_of(STR))


@function("properties")
def _properties(x: Typed) -> Typed:
    refuse("properties", x, "map", "node", "rel")
    props, fields = property_struct(x)
    return x if x.t.kind in ("map", "null") else Typed(props, T("map", None, fields))


@function("labels")
def _labels(x: Typed) -> Typed:
    refuse("labels", x, "node")
    return Typed(x.col["labels"], list_of(STR))


@function("type")
def _type(x: Typed) -> Typed:
    refuse("type", x, "rel")
    return Typed(x.col["type"], STR)


@function("id")
def _id(x: Typed) -> Typed:
    refuse("id", x, "node", "rel")
    return Typed(x.col["id"], INT)


@function("elementid")
def _element_id(x: Typed) -> Typed:
    refuse("elementId", x, "node", "rel")
    return Typed(F.concat(F.lit("n:" if x.t.kind == "node" else "r:"), x.col["id"].cast("string")), STR)


# --- numbers ----------------------------------------------------------------------------


def _num(name: str, x: Typed) -> Column:
    refuse(name, x, *NUMBER)
    return x.col.cast("double")


@function("abs")
def _abs(x: Typed) -> Typed:
    refuse("abs", x, *NUMBER)
    return Typed(F.abs(x.col), x.t)


@function("sign")
def _sign(x: Typed) -> Typed:
    return Typed(F.signum(_num("sign", x)).cast("bigint"), INT)


for _name, _fn in {"sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "cot": F.cot, "degrees": F.degrees, "radians": F.radians}.items():
    function(_name)(lambda x, _name=_name, _fn=_fn: Typed(_fn(_num(_name, x)), FLOAT))
function("ceil")(lambda x: Typed(F.ceil(_num("ceil", x)).cast("double"), FLOAT))
function("floor")(lambda x: Typed(F.floor(_num("floor", x)).cast("double"), FLOAT))
function("haversin")(lambda x: Typed((1 - F.cos(_num("haversin", x))) / 2, FLOAT))
function("e", 0)(lambda: Typed(F.e(), FLOAT))
function("pi", 0)(lambda: Typed(F.pi(), FLOAT))
function("rand", 0)(lambda: Typed(F.rand(), FLOAT))


def _logarithm(name: str, fn):
    def build(x: Typed) -> Typed:
        v = _num(name, x)
        return Typed(F.when(v > 0, fn(v)).when(v == 0, F.lit(float("-inf"))).when(v.isNotNull(), F.lit(float("nan"))), FLOAT)

    return build


function("log")(_logarithm("log", F.ln))
function("log10")(_logarithm("log10", F.log10))


@function("round", 1, 2)
def _round(x: Typed, places: Typed | None = None) -> Typed:
    if places is not None and not isinstance(places.value, int):
        raise ArgumentError("round needs a constant number of places")
    return Typed(F.round(_num("round", x), places.value if places else 0).cast("double"), FLOAT)


@function("atan2", 2)
def _atan2(y: Typed, x: Typed) -> Typed:
    return Typed(F.atan2(_num("atan2", y), _num("atan2", x)), FLOAT)


# --- strings ----------------------------------------------------------------------------


def _text(name: str, x: Typed) -> Column:
    refuse(name, x, "str")
    return x.col.cast("string")


def _count(name: str, x: Typed) -> Column:
    refuse(name, x, "int")
    return F.when(x.col < 0, F.raise_error(F.lit(f"{name} needs a length of 0 or more")).cast("int")).otherwise(x.col.cast("int"))


@function("left", 2)
def _left(x: Typed, n: Typed) -> Typed:
    return Typed(F.substr(_text("left", x), F.lit(1), _count("left", n)), STR)


@function("right", 2)
def _right(x: Typed, n: Typed) -> Typed:
    s, k = _text("right", x), _count("right", n)
    return Typed(F.when(k == 0, F.when(s.isNotNull(), F.lit(""))).otherwise(F.substr(s, F.greatest(F.char_length(s) - k + 1, F.lit(1)), k)), STR)


@function("substring", 2, 3)
def _substring(x: Typed, start: Typed, n: Typed | None = None) -> Typed:
    s, a = _text("substring", x), _count("substring", start)
    return Typed(F.substr(s, a + 1, _count("substring", n) if n else F.char_length(s) + 1), STR)


function("trim")(lambda x: Typed(F.regexp_replace(_text("trim", x), f"^{_BLANK}+|{_BLANK}+$", ""), STR))
function("ltrim")(lambda x: Typed(F.regexp_replace(_text("ltrim", x), f"^{_BLANK}+", ""), STR))
function("rtrim")(lambda x: Typed(F.regexp_replace(_text("rtrim", x), f"{_BLANK}+$", ""), STR))
function("toupper")(lambda x: Typed(F.upper(_text("toUpper", x)), STR))
function("tolower")(lambda x: Typed(F.lower(_text("toLower", x)), STR))


@function("replace", 3)
def _replace(x: Typed, old: Typed, new: Typed) -> Typed:
    s, a, b = (_text("replace", v) for v in (x, old, new))
    return Typed(F.when(a == "", s).otherwise(F.replace(s, a, b)), STR)


@function("split", 2)
def _split(x: Typed, by: Typed) -> Typed:
    s, b = _text("split", x), _text("split", by)
    letters = F.split(s, "", -1)
    return Typed(F.when(b == "", F.filter(letters, lambda c: c != "")).otherwise(F.split(s, F.concat(F.lit("\\Q"), b, F.lit("\\E")), -1)), list_of(STR))


# --- conversion -------------------------------------------------------------------------


@function("tostringornull")
def _to_string_or_null(x: Typed) -> Typed:
    return Typed(F.lit(None).cast("string"), STR) if x.t.kind in ("list", "map", "node", "rel", "path") else to_string(x)


@function("tostring")
def to_string(x: Typed) -> Typed:
    k = x.t.kind
    if k in ("str", "int", "bool", "null", "date"):
        return Typed(x.col.cast("string"), STR)
    if k == "float":
        whole = (x.col == F.floor(x.col)) & (F.abs(x.col) < 1e15)
        named = F.when(F.isnan(x.col), F.lit("NaN")).when(x.col == float("inf"), F.lit("inf")).when(x.col == float("-inf"), F.lit("-inf"))
        return Typed(named.when(whole, F.concat(x.col.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(x.col.cast("string")), STR)
    from .temporal import to_text

    return to_text(x)


def _number(x: Typed, name: str) -> Column:
    s = F.regexp_replace(x.col, f"^{_BLANK}+|{_BLANK}+$", "")
    return F.when(F.rlike(s, F.lit("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$")), s)


def _to_integer(x: Typed, lenient: bool) -> Typed:
    k = x.t.kind
    if k == "str":
        s = _number(x, "toInteger")
        return Typed(F.coalesce(s.try_cast("bigint"), F.when(F.abs(s.try_cast("double")) < 9.2e18, s.try_cast("double")).cast("bigint")), INT)
    if k == "float":
        return Typed(F.when(F.isnan(x.col), F.lit(None)).otherwise(F.when(F.abs(x.col) < 9.3e18, x.col)).cast("bigint"), INT)
    if k in ("int", "bool", "null"):
        return Typed(x.col.cast("bigint"), INT)
    if lenient:
        return Typed(F.lit(None).cast("bigint"), INT)
    raise ArgumentError(f"toInteger cannot take {x.t}")


function("tointeger")(lambda x: _to_integer(x, False))
function("tointegerornull")(lambda x: _to_integer(x, True))


def _to_float(x: Typed, lenient: bool) -> Typed:
    if x.t.kind == "str":
        return Typed(_number(x, "toFloat").try_cast("double"), FLOAT)
    if x.t.kind in ("int", "float", "null"):
        return Typed(x.col.cast("double"), FLOAT)
    if lenient:
        return Typed(F.lit(None).cast("double"), FLOAT)
    raise ArgumentError(f"toFloat cannot take {x.t}")


function("tofloat")(lambda x: _to_float(x, False))
function("tofloatornull")(lambda x: _to_float(x, True))


def _to_boolean(x: Typed, lenient: bool) -> Typed:
    if x.t.kind == "str":
        s = F.lower(F.regexp_replace(x.col, f"^{_BLANK}+|{_BLANK}+$", ""))
        return Typed(F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False)), BOOL)
    if x.t.kind in ("bool", "null"):
        return Typed(x.col.cast("boolean"), BOOL)
    if x.t.kind == "int":
        return Typed(x.col != 0, BOOL)
    if lenient:
        return Typed(F.lit(None).cast("boolean"), BOOL)
    raise ArgumentError(f"toBoolean cannot take {x.t}")


function("toboolean")(lambda x: _to_boolean(x, False))
function("tobooleanornull")(lambda x: _to_boolean(x, True))


# --- JSON -------------------------------------------------------------------------------


@function("apoc.convert.tojson")
def _to_json(x: Typed) -> Typed:
    """Text of a value; null gives the text ``null``."""
    k = x.t.kind
    if k == "null":
        return Typed(F.lit("null"), STR)
    if k in ("int", "bool"):
        out = x.col.cast("string")
    elif k == "float":
        out = to_string(x).col
    elif k == "str":
        out = F.regexp_extract(F.to_json(F.struct(x.col.alias("v"))), "(?s)^\\{\"v\":(.*)\\}$", 1)
        out = F.when(x.col.isNotNull(), out)
    elif k in ("list", "map", "node", "rel"):
        out = F.to_json(x.col, {"ignoreNullFields": "false"})
    else:
        out = F.concat(F.lit('"'), to_string(x).col, F.lit('"'))
    return Typed(F.coalesce(out, F.lit("null")), STR)


def _from_json(name: str, x: Typed) -> Typed:
    """A constant text gives its full type; a column gives a map or list of texts."""
    refuse(name, x, "str")
    if x.t.kind == "null":
        return nothing()
    if isinstance(x.value, str):
        import json

        from pyspark.sql.types import _parse_datatype_string

        schema = "STRUCT<v: " + _json_type(json.loads(x.value)) + ">"
        col = F.from_json(F.concat(F.lit('{"v":'), x.col, F.lit("}")), schema)["v"]
        return Typed(col, from_spark(_parse_datatype_string(schema).fields[0].dataType))
    if name.endswith("map"):
        return Typed(F.from_json(x.col, "map<string,string>"), T("map", STR))
    return Typed(F.from_json(x.col, "array<string>"), list_of(STR))


def _json_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint"
    if isinstance(v, float):
        return "double"
    if isinstance(v, dict):
        return f"struct<{', '.join(f'`{k}`: {_json_type(x)}' for k, x in v.items())}>"
    if isinstance(v, list):
        kinds = {_json_type(x) for x in v if x is not None} or {"string"}
        return f"array<{kinds.pop() if len(kinds) == 1 else 'double' if kinds <= {'bigint', 'double'} else 'string'}>"
    return "string"


for _name in ("apoc.convert.fromjsonmap", "apoc.convert.fromjsonlist"):
    FUNCTIONS[_name] = (_from_json, 1, 1)
    _NAMED.add(_name)


# --- other ------------------------------------------------------------------------------


@function("exists")
def _exists(x: Typed) -> Typed:
    return Typed(x.col.isNotNull() if x.t.kind != "null" else F.lit(False), BOOL)


@function("timestamp", 0)
def _timestamp() -> Typed:
    return Typed(F.unix_millis(F.current_timestamp()), INT)


__all__ = ["FUNCTIONS", "apply", "to_spark", "to_string"]
