"""Static types of expressions, and typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import NotSupported


@dataclass(frozen=True)
class T:
    """``kind`` is null, bool, int, float, str, list, map, node, rel, path or a temporal name."""

    kind: str
    elem: T | None = None
    fields: tuple[tuple[str, T], ...] | None = None

    def __str__(self) -> str:
        return f"list<{self.elem}>" if self.kind == "list" else self.kind

    def field(self, name: str) -> T | None:
        return dict(self.fields or ()).get(name)


NULL, BOOL, INT, FLOAT, STR = (T(k) for k in ("null", "bool", "int", "float", "str"))
DATE, TIME, LOCALTIME, DATETIME, LOCALDATETIME, DURATION = (T(k) for k in ("date", "time", "localtime", "datetime", "localdatetime", "duration"))
TEMPORAL = ("date", "time", "localtime", "datetime", "localdatetime")
ENTITY = ("node", "rel")
NUMBER = ("int", "float")


def list_of(t: T) -> T:
    return T("list", t)


@dataclass
class Typed:
    """A column and its static type; ``value`` is set for literals and parameters."""

    col: Column
    t: T
    value: object = None


def nothing() -> Typed:
    return Typed(F.lit(None), NULL)


def from_spark(d: S.DataType) -> T:
    if isinstance(d, (S.LongType, S.IntegerType, S.ShortType, S.ByteType)):
        return INT
    if isinstance(d, (S.DoubleType, S.FloatType, S.DecimalType)):
        return FLOAT
    if isinstance(d, S.StringType):
        return STR
    if isinstance(d, S.BooleanType):
        return BOOL
    if isinstance(d, S.DateType):
        return DATE
    if isinstance(d, S.TimestampNTZType):
        return LOCALDATETIME
    if isinstance(d, S.TimestampType):
        return DATETIME
    if isinstance(d, S.NullType):
        return NULL
    if isinstance(d, S.ArrayType):
        return list_of(from_spark(d.elementType))
    if isinstance(d, S.StructType):
        names = [f.name for f in d.fields]
        if names == ["months", "days", "seconds", "nanos"]:
            return DURATION
        if names == ["nanos", "off"]:
            return TIME
        return T("map", None, tuple((f.name, from_spark(f.dataType)) for f in d.fields))
    if isinstance(d, S.MapType):
        return T("map", from_spark(d.valueType))
    raise NotSupported(f"values of type {d.simpleString()}")


def to_spark(t: T) -> str:
    """The column type of a static type, as DDL."""
    simple = {"null": "string", "bool": "boolean", "int": "bigint", "float": "double", "str": "string", "date": "date", "datetime": "timestamp", "localdatetime": "timestamp_ntz", "localtime": "bigint", "duration": "struct<months:bigint,days:bigint,seconds:bigint,nanos:bigint>", "time": "struct<nanos:bigint,off:int>"}
    if t.kind in simple:
        return simple[t.kind]
    if t.kind == "list":
        return f"array<{to_spark(t.elem or NULL)}>"
    if t.kind == "map" and t.fields is not None:
        return f"struct<{','.join(f'`{n}`:{to_spark(x)}' for n, x in t.fields)}>"
    if t.kind == "map":
        return f"map<string,{to_spark(t.elem or NULL)}>"
    if t.kind == "node":
        return f"struct<id:bigint,labels:array<string>,properties:struct<{','.join(f'`{n}`:{to_spark(x)}' for n, x in t.fields or ())}>>"
    if t.kind == "rel":
        return f"struct<id:bigint,src:bigint,dst:bigint,type:string,properties:struct<{','.join(f'`{n}`:{to_spark(x)}' for n, x in t.fields or ())}>>"
    raise NotSupported(f"a column of {t}")


def join_types(a: T, b: T) -> T | None:
    """The type both fit, or None."""
    if a == b or b.kind == "null":
        return a
    if a.kind == "null":
        return b
    if a.kind in NUMBER and b.kind in NUMBER:
        return FLOAT
    if a.kind == b.kind == "list":
        e = join_types(a.elem, b.elem)
        return e and list_of(e)
    if a.kind == b.kind and a.kind in (*ENTITY, "map") and a.fields is not None and b.fields is not None:
        merged = dict(a.fields)
        for n, t in b.fields:
            j = join_types(merged[n], t) if n in merged else t
            if j is None:
                return None
            merged[n] = j
        return T(a.kind, None, tuple(merged.items()))
    return None


def coerce(x: Typed, t: T) -> Column:
    """The column of ``x`` as type ``t`` (which its type joins to)."""
    if x.t == t:
        return x.col
    if x.t.kind == "null":
        return F.lit(None).cast(to_spark(t))
    if x.t.kind in NUMBER:
        return x.col.cast("double")
    if t.kind == "list":
        if x.t.elem.kind == "null":
            return F.when(x.col.isNotNull(), F.transform(x.col, lambda _: F.lit(None).cast(to_spark(t.elem))))
        return F.transform(x.col, lambda e: coerce(Typed(e, x.t.elem), t.elem))
    if t.kind in ENTITY:
        own = dict(x.t.fields)
        props = F.struct(*[(coerce(Typed(x.col["properties"][n], own[n]), ft) if n in own else F.lit(None).cast(to_spark(ft))).alias(n) for n, ft in t.fields])
        head = [x.col[n].alias(n) for n in (("id", "labels") if t.kind == "node" else ("id", "src", "dst", "type"))]
        return F.when(x.col.isNotNull(), F.struct(*head, props.alias("properties")))
    if t.kind == "map" and t.fields is not None:
        own = dict(x.t.fields)
        return F.when(x.col.isNotNull(), F.struct(*[(coerce(Typed(x.col[n], own[n]), ft) if n in own else F.lit(None).cast(to_spark(ft))).alias(n) for n, ft in t.fields]))
    return x.col
