"""Resolution of a writer's schema against a reader's: checked on the driver before any job runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import MISSING, AvroType, SchemaError, spark_type

#: Kinds that a reader's kind accepts besides its own.
PROMOTES = {"long": ("int",), "float": ("int", "long"), "double": ("int", "long", "float"), "string": ("bytes",), "bytes": ("string",)}


def field_pairs(w: AvroType, r: AvroType) -> dict[str, str]:
    """Writer field name to reader field name, by the reader's names and aliases, then by the writer's aliases."""
    out: dict[str, str] = {}
    for wf in w.fields:
        names = [rf.name for rf in r.fields if rf.name == wf.name] or [rf.name for rf in r.fields if wf.name in rf.aliases] or [rf.name for rf in r.fields if {rf.name, *rf.aliases} & set(wf.aliases)]
        if names:
            if names[0] in out.values():
                raise SchemaError(f"two writer fields map to {r.name}.{names[0]}")
            out[wf.name] = names[0]
    return out


def branch_for(w: AvroType, r: AvroType) -> int | None:
    """The first branch of a reader's union that the writer's type resolves to."""
    for i, b in enumerate(r.branches):
        try:
            check(w, b)
        except SchemaError:
            continue
        return i
    return None


def check(w: AvroType, r: AvroType, seen: frozenset = frozenset()) -> None:
    """Raise SchemaError where data of ``w`` can't be read as ``r``."""
    if (id(w), id(r)) in seen:
        return
    seen = seen | {(id(w), id(r))}
    fail = SchemaError(f"can't read {w.branch_name}{f' ({w.logical})' if w.logical else ''} as {r.branch_name}{f' ({r.logical})' if r.logical else ''}")
    if r.kind == "union":
        for b in w.branches if w.kind == "union" else [w]:
            if branch_for(b, r) is None:
                raise fail
        return
    if w.kind == "union" or (w.logical and w.logical != r.logical):
        raise fail
    if r.logical == "decimal" and w.logical and (w.precision, w.scale) != (r.precision, r.scale):
        raise fail
    if r.is_record:
        if not w.is_record or w.name not in (r.name, *r.aliases):
            raise fail
        pairs = field_pairs(w, r)
        for rf in r.fields:
            if rf.name not in pairs.values() and rf.default is MISSING:
                raise SchemaError(f"field {r.name}.{rf.name} is not in the data and has no default")
        for wf in w.fields:
            if wf.name in pairs:
                check(wf.type, r.field(pairs[wf.name]).type, seen)
    elif w.kind != r.kind:
        if w.kind not in PROMOTES.get(r.kind, ()) or w.logical or (r.logical and w.kind != r.kind):
            raise fail
    elif r.kind == "enum":
        if not r.matches_name(w) or (r.default is MISSING and not set(w.symbols) <= set(r.symbols)):
            raise fail
    elif r.kind == "fixed":
        if w.size != r.size or not r.matches_name(w):
            raise fail
    elif r.kind in ("array", "map"):
        check(w.items, r.items, seen)


def default_value(value, t: AvroType):
    """A JSON default as the Python value that the decoder gives for ``t``."""
    if t.kind == "union":
        if value is None:
            return None
        if isinstance(value, dict) and len(value) == 1:
            (name, inner), = value.items()
            for b in t.branches:
                if b.branch_name == name or b.short_name == name:
                    return union_value(t, b, default_value(inner, b))
        first = t.branches[0]
        return union_value(t, first, default_value(value, first))
    if t.kind in ("bytes", "fixed"):
        raw = value.encode("latin-1")
        return raw_value(raw, t)
    if t.kind in ("float", "double"):
        return float(value)
    if t.kind == "array":
        return [default_value(x, t.items) for x in value]
    if t.kind == "map":
        return [(k, default_value(x, t.items)) for k, x in value.items()]
    if t.is_record:
        return {f.name: default_value(value[f.name] if f.name in value else f.default, f.type) for f in t.fields}
    if t.logical in ("timestamp-millis", "local-timestamp-millis"):
        return value * 1000
    return value


def union_value(t: AvroType, branch: AvroType, value):
    """A branch's value in the shape of the union's column."""
    if t.nullable_of is not None or branch.kind == "null":
        return value
    return {f"member{t.members.index(branch)}": value}


def raw_value(raw: bytes, t: AvroType):
    """Bytes of a bytes or fixed type as its logical type's value."""
    import decimal
    import uuid

    if t.logical == "decimal":
        n = int.from_bytes(raw, "big", signed=True)
        return raw if t.precision > 38 else decimal.Context(prec=80).scaleb(decimal.Decimal(n), -t.scale)
    if t.logical == "uuid":
        return str(uuid.UUID(bytes=raw))
    if t.logical == "duration":
        return {n: int.from_bytes(raw[4 * i : 4 * i + 4], "little") for i, n in enumerate(("months", "days", "millis"))}
    return raw


def projection(w: AvroType, r: AvroType) -> list[Column]:
    """The resolution of two flat records as columns of a DataFrame that has the writer's columns.

    For data that is a DataFrame already: renames, casts, literals for defaults and enum fallbacks, all of it in Catalyst.
    """
    check(w, r)
    names = {rn: wn for wn, rn in field_pairs(w, r).items()}
    out = []
    for f in r.fields:
        kind = spark_type(f.type)
        if f.name not in names:
            value = F.lit(default_value(f.default, f.type)).cast(kind)
        else:
            wt, value = w.field(names[f.name]).type, F.col(f"`{names[f.name]}`")
            wi, ri = wt.nullable_of or wt, f.type.nullable_of or f.type
            if {wi.kind, ri.kind} == {"string", "bytes"}:
                value = F.encode(value, "UTF-8") if ri.kind == "bytes" else F.decode(value, "UTF-8")
            elif ri.kind == "enum" and ri.default is not MISSING:
                value = F.when(value.isNull() | value.isin(ri.symbols), value).otherwise(F.lit(ri.default))
            elif spark_type(wt) != kind:
                value = value.cast(kind)
        out.append(value.alias(f.name))
    return out
