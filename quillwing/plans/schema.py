"""Avro schemas: parsing, names, logical types, JSON, and the mapping to and from Spark types."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
NAMED = ("record", "error", "request", "enum", "fixed")
ORDERS = ("ascending", "descending", "ignore")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
MISSING: Any = object()

#: Logical types and the types they annotate (fixed values of the format).
LOGICAL = {
    "decimal": ("bytes", "fixed"),
    "uuid": ("string", "fixed"),
    "date": ("int",),
    "time-millis": ("int",),
    "time-micros": ("long",),
    "timestamp-millis": ("long",),
    "timestamp-micros": ("long",),
    "timestamp-nanos": ("long",),
    "local-timestamp-millis": ("long",),
    "local-timestamp-micros": ("long",),
    "local-timestamp-nanos": ("long",),
    "duration": ("fixed",),
}


class SchemaError(ValueError):
    """A schema that can't be parsed, or a pair that doesn't resolve."""


@dataclass(eq=False)
class Field:
    name: str
    type: AvroType
    default: Any = MISSING
    order: str = "ascending"
    aliases: tuple[str, ...] = ()
    doc: str | None = None


@dataclass(eq=False)
class AvroType:
    """One node of a schema. Named types that are used again are the same object, so recursive schemas are cyclic."""

    kind: str
    name: str | None = None
    aliases: tuple[str, ...] = ()
    fields: list[Field] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    default: Any = MISSING
    size: int = 0
    items: AvroType | None = None
    branches: list[AvroType] = field(default_factory=list)
    logical: str | None = None
    precision: int = 0
    scale: int = 0
    doc: str | None = None

    @property
    def is_record(self) -> bool:
        return self.kind in ("record", "error", "request")

    @property
    def namespace(self) -> str:
        return self.name.rpartition(".")[0] if self.name else ""

    @property
    def short_name(self) -> str:
        return (self.name or self.kind).rpartition(".")[2]

    @property
    def branch_name(self) -> str:
        return self.name if self.kind in NAMED and self.name else self.kind

    def matches_name(self, other: AvroType) -> bool:
        """Whether the names or aliases of two named types overlap."""
        return bool({self.name, *self.aliases} & {other.name, *other.aliases})

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def nullable_of(self) -> AvroType | None:
        """The other branch of a two-branch union with null."""
        if self.kind == "union" and len(self.branches) == 2 and sum(b.kind == "null" for b in self.branches) == 1:
            return next(b for b in self.branches if b.kind != "null")
        return None

    @property
    def members(self) -> list[AvroType]:
        return [b for b in self.branches if b.kind != "null"]

    def to_json(self, seen: set[str] | None = None) -> Any:
        """The schema as JSON values: a named type in full where it first occurs, by name after that."""
        seen = set() if seen is None else seen
        extra: dict[str, Any] = {"logicalType": self.logical} if self.logical else {}
        if self.logical == "decimal":
            extra |= {"precision": self.precision} | ({"scale": self.scale} if self.scale else {})
        if self.kind in NAMED:
            if self.name in seen:
                return self.name
            seen.add(self.name or "")
            out: dict[str, Any] = {"type": self.kind, "name": self.name}
            if self.aliases:
                out["aliases"] = list(self.aliases)
            if self.doc is not None:
                out["doc"] = self.doc
            if self.kind == "enum":
                out["symbols"] = list(self.symbols)
                if self.default is not MISSING:
                    out["default"] = self.default
            elif self.kind == "fixed":
                out["size"] = self.size
            else:
                out["fields"] = [
                    {"name": f.name, "type": f.type.to_json(seen)}
                    | ({"default": f.default} if f.default is not MISSING else {})
                    | ({"order": f.order} if f.order != "ascending" else {})
                    | ({"aliases": list(f.aliases)} if f.aliases else {})
                    | ({"doc": f.doc} if f.doc is not None else {})
                    for f in self.fields
                ]
            return out | extra
        if self.kind == "array":
            return {"type": "array", "items": self.items.to_json(seen)}
        if self.kind == "map":
            return {"type": "map", "values": self.items.to_json(seen)}
        if self.kind == "union":
            return [b.to_json(seen) for b in self.branches]
        return {"type": self.kind} | extra if extra else self.kind

    def dumps(self) -> str:
        return json.dumps(self.to_json(), separators=(",", ":"))


def qualify(name: str, namespace: str) -> str:
    """A full name; each part must be a name, and a bare primitive's name isn't one."""
    full = name if "." in name or not namespace else f"{namespace}.{name}"
    if not all(NAME.match(p) for p in full.split(".")):
        raise SchemaError(f"invalid Avro name: {name!r}")
    if full.rpartition(".")[2] in PRIMITIVES:
        raise SchemaError(f"a primitive's name can't be defined: {name!r}")
    return full


class Parser:
    """Parses schemas against one registry of named types; forward references resolve once all is read."""

    def __init__(self, registry: dict[str, AvroType] | None = None):
        self.registry = {} if registry is None else registry
        self.open: list[tuple[str, str, Any]] = []

    def parse(self, schema: Any, namespace: str = "") -> AvroType:
        holder: list[AvroType] = []
        self._at(schema, namespace, holder.append)
        for name, space, put in self.open:
            found = self._known(name, space)
            if found is None:
                raise SchemaError(f"undefined Avro type: {name!r}")
            put(found)
        self.open = []
        self._check_unions(holder[0], set())
        return holder[0]

    def _known(self, name: str, namespace: str) -> AvroType | None:
        return self.registry.get(name if "." in name or not namespace else f"{namespace}.{name}") or self.registry.get(name)

    def _at(self, schema: Any, namespace: str, put: Any) -> None:
        """Parse and hand the type to ``put``, at once or when a forward reference resolves."""
        if isinstance(schema, AvroType):
            put(schema)
        elif isinstance(schema, str):
            if schema in PRIMITIVES:
                put(AvroType(schema))
            elif (found := self._known(schema, namespace)) is not None:
                put(found)
            else:
                qualify(schema, namespace)
                self.open.append((schema, namespace, put))
        elif isinstance(schema, list):
            put(self._union(schema, namespace))
        elif isinstance(schema, dict):
            self._object(schema, namespace, put)
        else:
            raise SchemaError(f"unsupported Avro schema: {schema!r}")

    def _slot(self, schema: Any, namespace: str, owner: Any, attribute: str) -> None:
        self._at(schema, namespace, lambda t: setattr(owner, attribute, t))

    def _union(self, schema: list, namespace: str) -> AvroType:
        if not schema:
            raise SchemaError("a union needs a branch")
        out = AvroType("union", branches=[AvroType("null")] * len(schema))
        for i, s in enumerate(schema):
            self._at(s, namespace, lambda t, i=i: out.branches.__setitem__(i, t))
        return out

    def _check_unions(self, t: AvroType, seen: set[int]) -> None:
        if id(t) in seen:
            return
        seen.add(id(t))
        if t.kind == "union":
            names = [b.branch_name for b in t.branches]
            if "union" in names:
                raise SchemaError("a union can't hold a union")
            if len(set(names)) < len(names):
                raise SchemaError(f"a union's branches must differ: {names}")
        for x in [*t.branches, *([t.items] if t.items else []), *(f.type for f in t.fields)]:
            self._check_unions(x, seen)

    def _object(self, schema: dict, namespace: str, put: Any) -> None:
        kind = schema.get("type")
        if isinstance(kind, (dict, list)):
            self._at(kind, namespace, put)
            return
        if kind not in (*PRIMITIVES, *NAMED, "array", "map"):
            if not isinstance(kind, str):
                raise SchemaError(f"unsupported Avro schema: {schema!r}")
            self._at(kind, namespace, put)
            return
        if kind in PRIMITIVES:
            put(self._logical(AvroType(kind), schema))
        elif kind == "array":
            if "items" not in schema:
                raise SchemaError("an array needs items")
            out = AvroType("array")
            self._slot(schema["items"], namespace, out, "items")
            put(out)
        elif kind == "map":
            if "values" not in schema:
                raise SchemaError("a map needs values")
            out = AvroType("map")
            self._slot(schema["values"], namespace, out, "items")
            put(out)
        else:
            put(self._named(kind, schema, namespace))

    def _named(self, kind: str, schema: dict, namespace: str) -> AvroType:
        if not isinstance(schema.get("name"), str) or not schema["name"]:
            raise SchemaError(f"a {kind} needs a name")
        name = qualify(schema["name"], schema.get("namespace", namespace) or "")
        space = name.rpartition(".")[0]
        aliases = tuple(dict.fromkeys(qualify(a, space) for a in schema.get("aliases") or ()))
        out = AvroType(kind, name=name, aliases=aliases, doc=schema.get("doc"))
        if kind == "enum":
            symbols = schema.get("symbols")
            if not isinstance(symbols, list) or not symbols or len(set(map(str, symbols))) < len(symbols) or not all(isinstance(s, str) and NAME.match(s) for s in symbols):
                raise SchemaError(f"invalid symbols of enum {name}: {symbols!r}")
            out.symbols, out.default = symbols, schema.get("default", MISSING)
            if out.default is not MISSING and out.default not in symbols:
                raise SchemaError(f"the default of enum {name} is no symbol: {out.default!r}")
        elif kind == "fixed":
            size = schema.get("size")
            if not isinstance(size, int) or isinstance(size, bool) or size < 1:
                raise SchemaError(f"invalid size of fixed {name}: {size!r}")
            out.size = size
        if kind != "request":
            if name in self.registry:
                raise SchemaError(f"Avro type defined twice: {name}")
            self.registry[name] = out
        if kind == "fixed":
            self._logical(out, schema)
        if out.is_record:
            if not isinstance(schema.get("fields"), list):
                raise SchemaError(f"record {name} needs fields")
            for f in schema["fields"]:
                if not isinstance(f, dict) or not isinstance(f.get("name"), str) or not NAME.match(f["name"]) or "type" not in f:
                    raise SchemaError(f"invalid field of record {name}: {f!r}")
                if out.field(f["name"]):
                    raise SchemaError(f"record {name} has two fields {f['name']}")
                order = f.get("order") if f.get("order") in ORDERS else "ascending"
                made = Field(f["name"], AvroType("null"), f.get("default", MISSING), order, tuple(f.get("aliases") or ()), f.get("doc"))
                out.fields.append(made)
                self._slot(f["type"], space, made, "type")
        return out

    def _logical(self, out: AvroType, schema: dict) -> AvroType:
        """Annotate a type; an unknown name, a wrong type or bad parameters leave it plain."""
        name = schema.get("logicalType")
        if name not in LOGICAL or out.kind not in LOGICAL[name]:
            return out
        if name == "decimal":
            p, s = schema.get("precision"), schema.get("scale", 0)
            whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (p, s))
            if not whole or p < 1 or not 0 <= s <= p or (out.kind == "fixed" and p > decimal_digits(out.size)):
                return out
            out.precision, out.scale = p, s
        elif (name == "uuid" and out.kind == "fixed" and out.size != 16) or (name == "duration" and out.size != 12):
            return out
        out.logical = name
        return out


def decimal_digits(size: int) -> int:
    """Most decimal digits that a signed number of ``size`` bytes always holds."""
    return len(str(2 ** (8 * size - 1) - 1)) - 1


def parse(schema: Any, namespace: str = "", registry: dict[str, AvroType] | None = None) -> AvroType:
    """A schema from a type, JSON values, JSON text or a type name."""
    if isinstance(schema, str) and schema.lstrip()[:1] in ("{", "[", '"'):
        schema = json.loads(schema)
    return Parser(registry).parse(schema, namespace)


def same_schema(a: AvroType, b: AvroType) -> bool:
    return a is b or a.to_json() == b.to_json()


# Spark types


def spark_type(t: AvroType, recursive_depth: int = 0, path: tuple[str, ...] = ()) -> T.DataType:
    """The Spark type of values of ``t`` (nullability is a field's, see ``struct_field``).

    A recursive record is refused, or expanded ``recursive_depth`` times; beyond that it is null.
    """
    plain = {
        "null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
        "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "enum": T.StringType(), "fixed": T.BinaryType(),
    }
    down = lambda x: spark_type(x, recursive_depth, path)
    if t.logical == "decimal":
        return T.DecimalType(t.precision, t.scale) if t.precision <= 38 else T.BinaryType()
    if t.logical == "uuid":
        return T.StringType()
    if t.logical == "date":
        return T.DateType()
    if t.logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if t.logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return T.TimestampNTZType()
    if t.logical == "duration":
        return T.StructType([T.StructField(n, T.LongType(), False) for n in ("months", "days", "millis")])
    if t.kind in plain:
        return plain[t.kind]
    if t.kind == "array":
        return T.ArrayType(down(t.items), is_nullable(t.items))
    if t.kind == "map":
        return T.MapType(T.StringType(), down(t.items), is_nullable(t.items))
    if t.kind == "union":
        if t.nullable_of is not None:
            return down(t.nullable_of)
        if not t.members:
            return T.NullType()
        return T.StructType([struct_field(f"member{i}", b, recursive_depth, path, nullable=True) for i, b in enumerate(t.members)])
    if path.count(t.name) > recursive_depth:
        if recursive_depth == 0:
            raise SchemaError(f"recursive record {t.name}: set recursiveDepth to expand it")
        return T.NullType()
    return T.StructType([struct_field(f.name, f.type, recursive_depth, (*path, t.name or "")) for f in t.fields])


def is_nullable(t: AvroType) -> bool:
    return t.kind == "null" or (t.kind == "union" and any(b.kind == "null" for b in t.branches))


def struct_field(name: str, t: AvroType, recursive_depth: int = 0, path: tuple[str, ...] = (), nullable: bool | None = None) -> T.StructField:
    """A field with what Spark's types can't say in its metadata: symbols, sizes, branch names, logical types."""
    inner = t.nullable_of or t
    meta: dict[str, Any] = {}
    if inner.kind == "enum":
        meta["avro.symbols"] = list(inner.symbols)
    if inner.kind == "fixed":
        meta["avro.size"] = inner.size
    if inner.kind in NAMED:
        meta["avro.name"] = inner.name
    if inner.logical:
        meta["avro.logicalType"] = inner.logical
    if inner.kind == "union":
        meta["avro.branches"] = [b.branch_name for b in inner.branches]
    return T.StructField(name, spark_type(t, recursive_depth, path), is_nullable(t) if nullable is None else nullable, meta)


def to_struct(t: AvroType, recursive_depth: int = 0) -> T.StructType:
    """A DataFrame's schema: the record's fields, or one column ``value``."""
    if t.is_record:
        return spark_type(t, recursive_depth)
    return T.StructType([struct_field("value", t, recursive_depth)])


def from_spark(schema: T.StructType, name: str = "topLevelRecord", namespace: str = "") -> AvroType:
    """An Avro record for a DataFrame's schema. Nullable columns become unions with null; metadata written by ``struct_field`` is used."""
    taken: set[str] = set()

    def fresh(base: str) -> str:
        out, n = base, 1
        while out in taken:
            n += 1
            out = f"{base}{n}"
        taken.add(out)
        return out

    def of(d: T.DataType, at: str, meta: dict) -> Any:
        logical = meta.get("avro.logicalType")
        if isinstance(d, T.BooleanType):
            return "boolean"
        if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType)):
            return {"type": "int", "logicalType": logical} if logical else "int"
        if isinstance(d, T.LongType):
            return {"type": "long", "logicalType": logical} if logical else "long"
        if isinstance(d, T.FloatType):
            return "float"
        if isinstance(d, T.DoubleType):
            return "double"
        if isinstance(d, T.StringType):
            if "avro.symbols" in meta:
                return {"type": "enum", "name": fresh(meta.get("avro.name", at)), "symbols": meta["avro.symbols"]}
            return {"type": "string", "logicalType": "uuid"} if logical == "uuid" else "string"
        if isinstance(d, T.BinaryType):
            return {"type": "fixed", "name": fresh(meta.get("avro.name", at)), "size": meta["avro.size"]} if "avro.size" in meta else "bytes"
        if isinstance(d, T.DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": d.precision, "scale": d.scale}
        if isinstance(d, T.DateType):
            return {"type": "int", "logicalType": "date"}
        if isinstance(d, T.TimestampType):
            return {"type": "long", "logicalType": logical or "timestamp-micros"}
        if isinstance(d, T.TimestampNTZType):
            return {"type": "long", "logicalType": logical or "local-timestamp-micros"}
        if isinstance(d, T.ArrayType):
            item = of(d.elementType, f"{at}_item", {})
            return {"type": "array", "items": ["null", item] if d.containsNull else item}
        if isinstance(d, T.MapType):
            if not isinstance(d.keyType, T.StringType):
                raise SchemaError(f"map keys must be strings: {at}")
            value = of(d.valueType, f"{at}_value", {})
            return {"type": "map", "values": ["null", value] if d.valueContainsNull else value}
        if isinstance(d, T.StructType):
            if logical == "duration":
                return {"type": "fixed", "name": fresh(meta.get("avro.name", at)), "size": 12, "logicalType": "duration"}
            return record(d, fresh(meta.get("avro.name", at)), at)
        if isinstance(d, T.NullType):
            return "null"
        raise SchemaError(f"no Avro type for {d.simpleString()} ({at})")

    def record(s: T.StructType, full: str, at: str) -> dict:
        fields = []
        for f in s.fields:
            if not NAME.match(f.name):
                raise SchemaError(f"not an Avro name: {f.name!r}; rename the column")
            inner = of(f.dataType, f"{at}_{f.name}".replace(".", "_"), f.metadata or {})
            fields.append({"name": f.name, "type": ["null", inner] if f.nullable and inner != "null" else inner})
        return {"type": "record", "name": full, "fields": fields}

    top = qualify(name, namespace)
    taken.add(top)
    return parse(record(schema, top, top.rpartition(".")[2]))
