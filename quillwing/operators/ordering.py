"""Avro's sort order as Spark sort keys and as a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.avro import from_avro, to_avro, wide_decimal_keys
from ..plans.schema import AvroType, parse


class NoOrder(ValueError):
    """A type without an order: a map, or an array of what can't be one Spark key."""


def _keys(t: AvroType, col: Column, descending: bool, mode: str) -> list[tuple[Column, bool]]:
    """(key, descending), most significant first; no key is null but for a null branch, which an index key before it tells."""
    if t.kind == "map":
        raise NoOrder("maps have no order in Avro")
    if t.kind == "null":
        return []
    if t.kind == "union":
        if t.nullable_of is not None:
            first = t.branches[0].kind == "null"
            index = F.when(col.isNull(), F.lit(0 if first else 1)).otherwise(F.lit(1 if first else 0))
            return [(index, descending), *_keys(t.nullable_of, col, descending, mode)]
        index = F.lit(next((i for i, b in enumerate(t.branches) if b.kind == "null"), -1))
        for i, b in reversed(list(enumerate(t.members))):
            index = F.when(col[f"member{i}"].isNotNull(), F.lit(t.branches.index(b))).otherwise(index)
        return [(index, descending)] + [k for i, b in enumerate(t.members) for k in _keys(b, col[f"member{i}"], descending, mode)]
    if t.is_record:
        out = []
        for f in t.fields:
            if f.order != "ignore":
                out += _keys(f.type, col[f.name], descending != (f.order == "descending"), mode)
        return out
    if t.logical == "duration":
        return [(col[n], descending) for n in ("months", "days", "millis")]
    if t.logical == "decimal" and t.precision > 38:
        return [(col, descending)] if mode == "bytes" else [(k, descending) for k in wide_decimal_keys(col)]
    if t.logical == "decimal" and mode == "bytes":
        raw = to_avro(col, t.to_json())
        return [(F.substring(raw, 2, 64) if t.kind == "bytes" else raw, descending)]
    if t.kind == "enum":
        return [(F.array_position(F.array(*[F.lit(s) for s in t.symbols]), col), descending)]
    if t.kind == "array":
        probe = _keys(t.items, F.lit(None), False, mode)
        if any(d for _, d in probe):
            raise NoOrder("an array of records with descending fields is no single key")

        def item(x: Column) -> Column:
            keys = _keys(t.items, x, False, mode)
            return keys[0][0] if len(keys) == 1 else F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)])

        return [(F.transform(col, item) if probe else F.size(col), descending)]
    return [(col, descending)]


def avro_order_keys(schema, col: Column | str | None = None, mode: str = "numeric") -> list[Column]:
    """Sort keys for ``orderBy`` that put values in Avro's order.

    For a record without ``col``, its fields are columns of the DataFrame. Enums sort
    by ordinal, unions by branch and then value, records by field as each field's order
    says. Decimals sort by value; mode "bytes" sorts their encoded bytes, unsigned.
    """
    t = parse(schema)
    if col is None:
        keys = [k for f in t.fields if f.order != "ignore" for k in _keys(f.type, F.col(f"`{f.name}`"), f.order == "descending", mode)]
    else:
        keys = _keys(t, F.col(col) if isinstance(col, str) else col, False, mode)
    return [k.desc_nulls_last() if d else k.asc_nulls_first() for k, d in keys]


def avro_compare(a: Column | str, b: Column | str, schema, mode: str = "numeric") -> Column:
    """-1, 0 or 1 as a sorts before, with or after b in Avro's order."""
    t = parse(schema)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    out = F.lit(0)
    for (x, descending), (y, _) in reversed(list(zip(_keys(t, a, False, mode), _keys(t, b, False, mode), strict=True))):
        low, high = (1, -1) if descending else (-1, 1)
        out = F.when(x < y, F.lit(low)).when(x > y, F.lit(high)).otherwise(out)
    return out


def avro_match(a: Column | str, b: Column | str, schema) -> Column:
    """``avro_compare`` of two binary columns that hold encoded values."""
    return avro_compare(from_avro(a, schema), from_avro(b, schema), schema)
