"""Column functions over Avro values: encode, decode, validate, measure, generate."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.codec import UUID, AvroDataError, plain_values, value_decoder, value_encoder
from ..operators.depth import fitted
from ..plans.schema import AvroType, is_nullable, parse, spark_type


def _text(schema: AvroType | str | dict | list) -> str:
    return parse(schema).dumps()


def _relaxed(kind: T.DataType) -> T.DataType:
    """The type with everything nullable, and without metadata, as Arrow columns come back from Python."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _relaxed(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_relaxed(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _relaxed(kind.valueType), True)
    return kind


def from_avro(col: Column | str, schema, reader_schema=None, mode: str = "FAILFAST", recursive_depth: int = 0) -> Column:
    """A binary column's Avro values as a typed column.

    With ``reader_schema`` the data resolve to it; whether that can be is
    checked here. Bytes left over or missing fail the query, or give null in mode PERMISSIVE. Null stays null.
    Records nested deeper than ``recursive_depth`` in themselves are null.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    w, r = _text(schema), None if reader_schema is None else _text(reader_schema)
    value_decoder(parse(w), parse(r) if r else None)
    kind = _relaxed(spark_type(parse(r or w), recursive_depth))

    @F.arrow_udf(returnType=kind)
    def decode(data: pa.Array) -> pa.Array:
        run = value_decoder(parse(w), parse(r) if r else None)
        out = []
        for b in data.to_pylist():
            try:
                out.append(None if b is None else run(b))
            except AvroDataError:
                if mode == "FAILFAST":
                    raise
                out.append(None)
        return fitted(out, to_arrow_type(kind))

    return decode(col)


def to_avro(col: Column | str, schema, validate: bool = True) -> Column:
    """A column's values as Avro binary. A null gives null, unless the schema has a null branch."""
    text = _text(schema)
    value_encoder(parse(text), validate)

    @F.arrow_udf(returnType=T.BinaryType())
    def encode(data: pa.Array) -> pa.Array:
        t = parse(text)
        run, keep = value_encoder(t, validate), is_nullable(t)
        return pa.array([None if v is None and not keep else run(v) for v in plain_values(data, t)], pa.binary())

    return encode(col)


def avro_encoded_size(col: Column | str, schema) -> Column:
    """Bytes that the values take."""
    return F.octet_length(to_avro(col, schema)).cast("long")


def avro_md5(col: Column | str) -> Column:
    """The MD5 of a string or binary column as 16 bytes."""
    return F.unhex(F.md5(col))


def wide_decimal_keys(raw: Column) -> tuple[Column, Column]:
    """Two keys that order big-endian two's complement numbers of any length by value.

    The first is the number of bytes without those that only repeat the sign,
    negative for negative numbers; the second those bytes in hex, of equal length wherever the first is equal.
    """
    h = F.hex(raw)
    negative = F.substring(h, 1, 1) >= "8"
    short = F.when(negative, F.regexp_replace(h, "^(FF)+", "")).otherwise(F.regexp_replace(h, "^(00)+", ""))
    n = (F.length(short) / 2).cast("int")
    return F.when(negative, -1 - n).otherwise(n), short


def _beyond_precision(raw: Column, precision: int) -> Column:
    """Whether a decimal's bytes have more digits than that."""
    places, digits = wide_decimal_keys(raw)
    most = 10**precision - 1
    size = most.bit_length() // 8 + 1
    high, low = most.to_bytes(size, "big").lstrip(b"\0"), (-most).to_bytes(size, "big", signed=True).lstrip(b"\xff")
    above = (places > len(high)) | ((places == len(high)) & (digits > high.hex().upper()))
    return above | (places < -1 - len(low)) | ((places == -1 - len(low)) & (digits < low.hex().upper()))


# Validation

_ERRORS = "array<struct<path:string,value:string,type:string>>"


def _shown(t: AvroType) -> str:
    return t.logical or t.branch_name


def _errors(col: Column, t: AvroType, path: Column) -> Column:
    none = F.expr(f"cast(array() as {_ERRORS})")

    def one(value: Column) -> Column:
        return F.array(F.struct(path.alias("path"), value.cast("string").alias("value"), F.lit(_shown(t)).alias("type")))

    missing = one(F.lit("null"))
    if t.kind == "union":
        if t.nullable_of is not None:
            return F.when(col.isNull(), none).otherwise(_errors(col, t.nullable_of, path))
        members = [F.when(col[f"member{i}"].isNull(), none).otherwise(_errors(col[f"member{i}"], b, path)) for i, b in enumerate(t.members)]
        unset = F.coalesce(*[col[f"member{i}"].isNotNull().cast("int") * 0 + F.when(col[f"member{i}"].isNotNull(), 1) for i in range(len(t.members))]).isNull()
        return F.when(col.isNull() | unset, none if is_nullable(t) else missing).otherwise(F.concat(*members))
    if t.kind == "null":
        return F.when(col.isNull(), none).otherwise(one(col))
    if t.is_record:
        if t.logical == "duration" or not t.fields:
            return F.when(col.isNull(), missing).otherwise(none)
        return F.when(col.isNull(), missing).otherwise(F.concat(*[_errors(col[f.name], f.type, F.concat(path, F.lit(f".{f.name}"))) for f in t.fields]))
    if t.kind == "array":
        inner = F.transform(col, lambda x, i: _errors(x, t.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(col.isNull(), missing).otherwise(F.flatten(inner))
    if t.kind == "map":
        inner = F.transform(F.map_entries(col), lambda e: _errors(e["value"], t.items, F.concat(path, F.lit("["), e["key"], F.lit("]"))))
        return F.when(col.isNull(), missing).otherwise(F.flatten(inner))
    wrong = F.lit(False)
    if t.logical == "uuid":
        wrong = ~col.rlike('^' + UUID.pattern.replace(r'\Z', '$'))
    elif t.logical in ("time-millis", "time-micros"):
        wrong = ~col.between(0, 86_400_000 * (1 if t.logical == "time-millis" else 1000) - 1)
    elif t.logical == "decimal" and t.precision <= 38:
        wrong = F.abs(col) >= F.lit(10 ** (t.precision - t.scale)).cast("decimal(38,0)") if t.precision > t.scale else F.lit(False)
    elif t.logical == "decimal":
        wrong = _beyond_precision(col, t.precision)
        if t.kind == "fixed":
            wrong = wrong | (F.octet_length(col) != t.size)
    elif t.logical == "duration":
        wrong = F.lit(False)
        for n in ("months", "days", "millis"):
            wrong = wrong | ~col[n].between(0, (1 << 32) - 1)
        return F.when(col.isNull(), missing).otherwise(F.when(F.coalesce(wrong, F.lit(True)), one(F.to_json(col))).otherwise(none))
    elif t.logical is None and t.kind == "int":
        wrong = ~col.cast("long").between(-(1 << 31), (1 << 31) - 1)
    elif t.kind == "enum":
        wrong = ~col.isin(t.symbols)
    elif t.kind == "fixed":
        wrong = F.octet_length(col) != t.size
    raw = t.kind in ("bytes", "fixed") and (t.logical is None or (t.logical == "decimal" and t.precision > 38))
    value = F.hex(col) if raw else col
    return F.when(col.isNull(), missing).otherwise(F.when(wrong, one(value)).otherwise(none))


def avro_validation_errors(col: Column | str, schema) -> Column:
    """Where a typed column's values don't conform: array of (path, value, type), empty if they do. Built-in expressions alone."""
    return _errors(F.col(col) if isinstance(col, str) else col, parse(schema), F.lit("$"))


def avro_is_valid(col: Column | str, schema) -> Column:
    """Whether a typed column's value conforms to the schema."""
    return F.size(avro_validation_errors(col, schema)) == 0


def avro_is_valid_binary(col: Column | str, schema) -> Column:
    """Whether bytes are one whole value of the schema; false for null."""
    text = _text(schema)

    @F.arrow_udf(returnType=T.BooleanType())
    def valid(data: pa.Array) -> pa.Array:
        run, out = value_decoder(parse(text)), []
        for b in data.to_pylist():
            try:
                out.append(b is not None and (run(b), True)[1])
            except AvroDataError:
                out.append(False)
        return pa.array(out, pa.bool_())

    return valid(col)


def render_errors(errors: list) -> str:
    """Validation errors as an indented tree of path parts."""
    tree: dict = {}
    for e in errors:
        at = tree
        for part in e["path"].replace("[", ".[").split("."):
            at = at.setdefault(part, {})
        at[f"{e['type']}: {e['value']}"] = {}
    lines: list[str] = []

    def walk(node: dict, depth: int) -> None:
        for k, v in node.items():
            lines.append("  " * depth + k)
            walk(v, depth + 1)

    walk(tree, 0)
    return "\n".join(lines)


# Random values


def _random(t: AvroType, seed: int, depth: int = 0) -> Column:
    r = lambda k=0: F.rand(seed * 31 + k)
    kind = spark_type(t)
    if t.kind == "union":
        if t.nullable_of is not None:
            return F.when(r(1) < 0.5, _random(t.nullable_of, seed + 7, depth))
        pick = F.floor(r(1) * len(t.branches))
        return F.struct(*[F.when(pick == t.branches.index(b), _random(b, seed + 11 * i, depth)).alias(f"member{i}") for i, b in enumerate(t.members)])
    if t.kind == "null":
        return F.lit(None)
    if t.is_record:
        return F.struct(*[_random(f.type, seed * 7 + 13 * i + 1, depth).alias(f.name) for i, f in enumerate(t.fields)])
    if t.kind == "array":
        return F.slice(F.array(*[_random(t.items, seed * 5 + i, depth + 1) for i in range(3)]), 1, (r(2) * 4).cast("int"))
    if t.kind == "map":
        return F.create_map(*[x for i in range(2) for x in (F.concat(F.lit(f"k{i}_"), F.hex((r(3 + i) * 1e6).cast("long"))), _random(t.items, seed * 5 + i, depth + 1))])
    if t.logical == "uuid":
        h = F.lower(F.md5(F.concat(r(1).cast("string"), r(2).cast("string"))))
        return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    if t.logical == "decimal":
        if t.precision <= 38:
            return (r() * 10 ** min(15, t.precision - t.scale)).cast(kind)
        n = ((10**t.precision).bit_length() - 1) // 8
        n, more = (min(n, t.size), max(0, t.size - n)) if t.kind == "fixed" else (n, 0)
        digits = F.substring(F.repeat(F.sha2(r().cast("string"), 512), n // 64 + 1), 1, 2 * n)
        return F.unhex(F.concat(F.when(digits >= "8", "ff" * more).otherwise("00" * more), digits))
    if t.logical == "duration":
        return F.struct(*[(r(i) * 1000).cast("long").alias(n) for i, n in enumerate(("months", "days", "millis"))])
    if t.logical == "date":
        return F.date_from_unix_date((r() * 20000).cast("int"))
    if t.logical in ("timestamp-millis", "timestamp-micros"):
        return F.timestamp_millis((r() * 2e12).cast("long"))
    if t.logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return F.timestamp_millis((r() * 2e12).cast("long")).cast("timestamp_ntz")
    if t.logical in ("time-millis", "time-micros"):
        return (r() * (86_400_000 if t.logical == "time-millis" else 86_400_000_000)).cast(kind)
    if t.kind == "boolean":
        return r() < 0.5
    if t.kind in ("int", "long"):
        return ((r() - 0.5) * (2**32 - 2 if t.kind == "int" else 2**52)).cast(kind)
    if t.kind in ("float", "double"):
        return r().cast(kind)
    if t.kind == "enum":
        return F.get(F.array(*[F.lit(s) for s in t.symbols]), F.floor(r() * len(t.symbols)).cast("int"))
    digest = F.sha2(r().cast("string"), 512)
    if t.kind == "fixed":
        return F.substring(F.unhex(F.repeat(digest, t.size // 64 + 1)), 1, t.size)
    return F.unhex(F.substring(digest, 1, 16)) if t.kind == "bytes" else F.substring(digest, 1, 10)


def avro_random(spark: SparkSession, schema, n: int, seed: int = 1) -> DataFrame:
    """``n`` random values of a schema: the record's fields, or one column ``value``."""
    t = parse(schema)
    value = _random(t, seed)
    rows = spark.range(n).select(value.alias("value"))
    return rows.select("value.*") if t.is_record else rows
