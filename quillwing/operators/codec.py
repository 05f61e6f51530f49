"""Avro's binary encoding: functions generated for one schema (pair), from bytes to column lists and back."""

from __future__ import annotations

import decimal
import re
import struct
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa

from ..plans.resolve import branch_for, check, default_value, field_pairs
from ..plans.schema import MISSING, AvroType, SchemaError

UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\Z")
WIDE = decimal.Context(prec=80)


class AvroDataError(ValueError):
    """Bytes that aren't a value of the schema, or a value that doesn't conform to it."""


def read_varint(buf: bytes, p: int) -> tuple[int, int]:
    """A zigzag long of up to ten bytes at p; bits beyond 64 are dropped."""
    n = shift = 0
    for _ in range(10):
        b = buf[p]
        p += 1
        n |= (b & 127) << shift
        if b < 128:
            n &= 0xFFFFFFFFFFFFFFFF
            v = (n >> 1) ^ -(n & 1)
            return (v - (1 << 64) if v >= 1 << 63 else v), p
        shift += 7
    raise AvroDataError("varint too long")


def read_int(buf: bytes, p: int) -> tuple[int, int]:
    """A zigzag int of up to five bytes."""
    n = shift = 0
    for i in range(5):
        b = buf[p]
        p += 1
        n |= (b & 127) << shift
        if b < 128:
            if i == 4 and b & 0x70:
                break
            return (n >> 1) ^ -(n & 1), p
        shift += 7
    raise AvroDataError("varint too long for an int")


def varint(v: int) -> bytes:
    n = ((v << 1) ^ (v >> 63)) & 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


#: Encoded longs from -8192 to 8191.
SMALL = [varint(v) for v in range(8192)] + [varint(v) for v in range(-8192, 0)]


def to_uuid(raw: bytes) -> str:
    return str(uuid.UUID(bytes=bytes(raw)))


def to_decimal(raw: bytes, precision: int, scale: int) -> decimal.Decimal:
    n = int.from_bytes(raw, "big", signed=True)
    if abs(n) >= 10**precision:
        raise AvroDataError(f"decimal of more than {precision} digits")
    return WIDE.scaleb(decimal.Decimal(n), -scale)


def from_decimal(v: decimal.Decimal, precision: int, scale: int, size: int) -> bytes:
    n = int(WIDE.scaleb(v, scale).to_integral_exact(context=WIDE))
    if abs(n) >= 10**precision:
        raise AvroDataError(f"decimal of more than {precision} digits: {v}")
    width = size or max(1, (n.bit_length() // 8) + 1)
    return n.to_bytes(width, "big", signed=True)


def bad(what: str) -> None:
    raise AvroDataError(what)


class Source:
    """Lines of generated code with fresh names and the constants they use."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.names: dict[str, Any] = {
            "vl": read_varint, "vi": read_int, "bad": bad, "uf": struct.Struct("<f").unpack_from, "ud": struct.Struct("<d").unpack_from, "pf": struct.Struct("<f").pack,
            "pd": struct.Struct("<d").pack, "u3": struct.Struct("<III").unpack_from, "p3": struct.Struct("<III").pack, "to_uuid": to_uuid, "to_decimal": to_decimal,
            "from_decimal": from_decimal, "SMALL": SMALL, "varint": varint, "UUID": UUID.match, "uuid_bytes": lambda s: uuid.UUID(s).bytes,
        }
        self.made: dict[tuple[int, int], str] = {}
        self.todo: list[Callable[[], None]] = []
        self.count = 0

    def name(self, base: str = "v") -> str:
        self.count += 1
        return f"{base}{self.count}"

    def const(self, value: Any) -> str:
        n = self.name("K")
        self.names[n] = value
        return n

    def put(self, ind: int, text: str) -> None:
        self.lines.append("    " * ind + text)

    def build(self, entry: str) -> Any:
        exec(compile("\n".join(self.lines), "<avro>", "exec"), self.names)  # noqa: S102
        return self.names[entry]


class Decoder(Source):
    """Generates readers of data written as ``w`` that give values of ``r``; parts that ``r`` lacks are skipped, not decoded."""

    def long(self, ind: int, var: str, kind: str = "vl") -> None:
        self.put(ind, "b = buf[p]")
        self.put(ind, "if b < 128:")
        self.put(ind + 1, f"{var} = (b >> 1) ^ -(b & 1); p += 1")
        self.put(ind, "else:")
        self.put(ind + 1, f"{var}, p = {kind}(buf, p)")

    def size(self, ind: int) -> None:
        self.long(ind, "n")
        self.put(ind, "if n < 0: bad('negative length')")

    def read(self, w: AvroType, r: AvroType, var: str, ind: int, stack: tuple = ()) -> None:
        """Code that sets ``var`` to the next value."""
        if w.kind == "union":
            self._union(w, r, var, ind, stack)
        elif r.kind == "union":
            i = branch_for(w, r)
            b = r.branches[i]
            self.read(w, b, var, ind, stack)
            self._wrap(r, b, var, ind)
        elif r.is_record:
            self._record(w, r, var, ind, stack)
        elif r.kind in ("array", "map"):
            self._items(w, r, var, ind, stack)
        else:
            self._scalar(w, r, var, ind)

    def _wrap(self, r: AvroType, b: AvroType, var: str, ind: int) -> None:
        if r.nullable_of is None and b.kind != "null" and r.kind == "union":
            self.put(ind, f"{var} = {{'member{r.members.index(b)}': {var}}}")

    def _union(self, w: AvroType, r: AvroType, var: str, ind: int, stack: tuple) -> None:
        index = self.name("i")
        self.long(ind, index)
        for k, b in enumerate(w.branches):
            self.put(ind, f"{'if' if k == 0 else 'elif'} {index} == {k}:")
            if r.kind == "union":
                target = r.branches[k] if r is w else r.branches[branch_for(b, r)]
                self.read(b, target, var, ind + 1, stack)
                self._wrap(r, target, var, ind + 1)
            else:
                self.read(b, r, var, ind + 1, stack)
        self.put(ind, "else: bad('invalid union index')")

    def _record(self, w: AvroType, r: AvroType, var: str, ind: int, stack: tuple) -> None:
        if (id(w), id(r)) in stack or self._recursive(w):
            self.put(ind, f"{var}, p = {self._function(w, r)}(buf, p)")
            return
        parts = self._fields(w, r, ind, (*stack, (id(w), id(r))))
        self.put(ind, f"{var} = {{{', '.join(f'{f.name!r}: {parts[f.name]}' for f in r.fields)}}}")

    def _recursive(self, t: AvroType) -> bool:
        seen: set[int] = set()
        stack = [f.type for f in t.fields]
        while stack:
            x = stack.pop()
            if x is t:
                return True
            if id(x) not in seen:
                seen.add(id(x))
                stack += [*x.branches, *([x.items] if x.items else []), *(f.type for f in x.fields)]
        return False

    def _function(self, w: AvroType, r: AvroType) -> str:
        key = (id(w), id(r))
        if key not in self.made:
            name = self.made[key] = self.name("f")

            def make() -> None:
                self.put(0, f"def {name}(buf, p):")
                parts = self._fields(w, r, 1, ())
                self.put(1, f"return {{{', '.join(f'{f.name!r}: {parts[f.name]}' for f in r.fields)}}}, p")

            self.todo.append(make)
        return self.made[key]

    def _fields(self, w: AvroType, r: AvroType, ind: int, stack: tuple) -> dict[str, str]:
        pairs = {f.name: f.name for f in w.fields} if w is r else field_pairs(w, r)
        parts: dict[str, str] = {}
        for f in w.fields:
            if f.name in pairs:
                parts[pairs[f.name]] = v = self.name()
                self.read(f.type, r.field(pairs[f.name]).type, v, ind, stack)
            else:
                self.skip(f.type, ind, stack)
        for f in r.fields:
            if f.name not in parts:
                parts[f.name] = self.const(default_value(f.default, f.type))
        if not w.fields:
            self.put(ind, "pass")
        return parts

    def _items(self, w: AvroType, r: AvroType, var: str, ind: int, stack: tuple) -> None:
        n, v, k = self.name("n"), self.name(), self.name("k")
        self.put(ind, f"{var} = {'[]' if r.kind == 'array' else '{}'}")
        self.put(ind, "while True:")
        self.long(ind + 1, n)
        self.put(ind + 1, f"if {n} == 0: break")
        self.put(ind + 1, f"if {n} < 0:")
        self.put(ind + 2, f"{n} = -{n}")
        self.long(ind + 2, "b")
        self.put(ind + 1, f"for _ in range({n}):")
        if r.kind == "map":
            self._scalar(AvroType("string"), AvroType("string"), k, ind + 2)
        self.read(w.items, r.items, v, ind + 2, stack)
        self.put(ind + 2, f"{var}.append({v})" if r.kind == "array" else f"{var}[{k}] = {v}")
        if r.kind == "map":
            self.put(ind, f"{var} = list({var}.items())")

    def _scalar(self, w: AvroType, r: AvroType, var: str, ind: int) -> None:
        put = lambda text: self.put(ind, text)
        kind = w.kind
        if kind == "null":
            put(f"{var} = None")
        elif kind == "boolean":
            put(f"{var} = buf[p] != 0; p += 1")
        elif kind in ("int", "long"):
            self.long(ind, var, "vi" if kind == "int" else "vl")
            if r.kind in ("float", "double"):
                put(f"{var} = float({var})")
            elif r.logical in ("timestamp-millis", "local-timestamp-millis"):
                put(f"{var} *= 1000")
        elif kind in ("float", "double"):
            put(f"{var} = u{kind[0]}(buf, p)[0]; p += {4 if kind == 'float' else 8}")
        elif kind in ("bytes", "string"):
            self.size(ind)
            put(f"{var} = buf[p:p + n]; p += n")
            self._logical(r, var, ind)
            if r.kind == "string":
                put(f"{var} = {var}.decode('utf-8', 'replace')")
        elif kind == "fixed":
            put(f"{var} = buf[p:p + {w.size}]; p += {w.size}")
            put(f"if len({var}) < {w.size}: bad('Insufficient data for type')")
            self._logical(r, var, ind)
        elif kind == "enum":
            table = [s if s in r.symbols else r.default for s in w.symbols]
            self.long(ind, "n", "vi")
            put(f"if not 0 <= n < {len(table)}: bad('invalid enum index')")
            put(f"{var} = {self.const(table)}[n]")
        else:
            raise SchemaError(f"unsupported type {kind}")

    def _logical(self, r: AvroType, var: str, ind: int) -> None:
        if r.logical == "decimal" and r.precision <= 38:
            self.put(ind, f"{var} = to_decimal({var}, {r.precision}, {r.scale})")
        elif r.logical == "uuid" and r.kind == "fixed":
            self.put(ind, f"{var} = to_uuid({var})")
        elif r.logical == "duration":
            self.put(ind, f"{var} = dict(zip(('months', 'days', 'millis'), u3({var}, 0)))")

    def skip(self, w: AvroType, ind: int, stack: tuple = ()) -> None:
        """Code that passes over the next value."""
        put = lambda text: self.put(ind, text)
        if w.kind == "null":
            put("pass")
        elif w.kind == "boolean":
            put("buf[p]; p += 1")
        elif w.kind in ("int", "long", "enum"):
            put("while buf[p] > 127: p += 1")
            put("p += 1")
        elif w.kind in ("float", "double", "fixed"):
            put(f"p += {w.size or (4 if w.kind == 'float' else 8)}")
        elif w.kind in ("bytes", "string"):
            self.size(ind)
            put("p += n")
        elif w.kind in ("array", "map"):
            n = self.name("n")
            put("while True:")
            self.long(ind + 1, n)
            self.put(ind + 1, f"if {n} == 0: break")
            self.put(ind + 1, f"if {n} < 0:")
            self.size(ind + 2)
            self.put(ind + 2, "p += n; continue")
            self.put(ind + 1, f"for _ in range({n}):")
            if w.kind == "map":
                self.skip(AvroType("string"), ind + 2)
            self.skip(w.items, ind + 2, stack)
        elif w.kind == "union":
            index = self.name("i")
            self.long(ind, index)
            for k, b in enumerate(w.branches):
                put(f"{'if' if k == 0 else 'elif'} {index} == {k}:")
                self.skip(b, ind + 1, stack)
            put("else: bad('invalid union index')")
        elif id(w) in stack or self._recursive(w):
            key = (id(w), -1)
            if key not in self.made:
                name = self.made[key] = self.name("s")

                def make() -> None:
                    self.put(0, f"def {name}(buf, p):")
                    for f in w.fields:
                        self.skip(f.type, 1)
                    self.put(1, "return p")

                self.todo.append(make)
            put(f"p = {self.made[key]}(buf, p)")
        else:
            for f in w.fields:
                self.skip(f.type, ind, (*stack, id(w)))
            if not w.fields:
                put("pass")

    def finish(self, entry: str) -> Any:
        while self.todo:
            self.todo.pop()()
        return self.build(entry)


def block_decoder(w: AvroType, r: AvroType | None = None) -> Callable[[bytes, int, list[list]], None]:
    """A function (data, count, columns) that appends ``count`` records' fields to the columns, in the reader's order.

    The data must hold just those records. A schema that is no record has one column.
    """
    r = w if r is None else r
    if r is not w:
        check(w, r)
    d = Decoder()
    d.put(0, "def block(buf, count, columns):")
    names = [f.name for f in r.fields] if r.is_record else ["value"]
    adds = [d.name("a") for _ in names]
    for i, a in enumerate(adds):
        d.put(1, f"{a} = columns[{i}].append")
    d.put(1, "p = 0")
    d.put(1, "for _ in range(count):")
    if r.is_record and w.is_record:
        parts = d._fields(w, r, 2, ((id(w), id(r)),))
        for n, a in zip(names, adds, strict=True):
            d.put(2, f"{a}({parts[n]})")
    else:
        d.read(w, r, "value", 2)
        d.put(2, f"{adds[0]}(value)")
    d.put(1, "if p != len(buf): bad('Insufficient data for type' if p > len(buf) else 'data after the last record')")
    run = d.finish("block")

    def guarded(buf: bytes, count: int, columns: list[list]) -> None:
        try:
            run(buf, count, columns)
        except (IndexError, struct.error) as e:
            raise AvroDataError("Insufficient data for type") from e

    return guarded


def value_decoder(w: AvroType, r: AvroType | None = None, whole: bool = True) -> Callable:
    """A function of bytes that gives a value; with ``whole`` all bytes must be used, else it takes and returns a position too."""
    r = w if r is None else r
    if r is not w:
        check(w, r)
    d = Decoder()
    d.put(0, "def one(buf, p):")
    d.read(w, r, "value", 1)
    d.put(1, "return value, p")
    run = d.finish("one")

    def decode(buf: bytes, p: int = 0):
        try:
            v, end = run(buf, p)
        except (IndexError, struct.error) as e:
            raise AvroDataError("Insufficient data for type") from e
        if end > len(buf) or (whole and end != len(buf)):
            raise AvroDataError("Insufficient data for type")
        return v if whole else (v, end)

    return decode


class Encoder(Source):
    """Generates writers; values are what ``plain_type`` gives for Arrow columns."""

    def __init__(self, validate: bool = True):
        super().__init__()
        self.validate = validate

    def long(self, ind: int, v: str) -> None:
        self.put(ind, f"ext(SMALL[{v}] if -8192 <= {v} < 8192 else varint({v}))")

    def write(self, t: AvroType, v: str, ind: int, stack: tuple = ()) -> None:
        put = lambda text: self.put(ind, text)
        if t.kind == "union":
            self._union(t, v, ind, stack)
            return
        if t.kind == "null":
            put("pass" if not self.validate else f"if {v} is not None: bad('not null')")
            return
        put(f"if {v} is None: bad({f'null is no value of {t.branch_name}'!r})")
        if t.kind == "boolean":
            put(f"ext(b'\\x01' if {v} else b'\\x00')")
        elif t.kind in ("int", "long"):
            if t.logical in ("timestamp-millis", "local-timestamp-millis"):
                x = self.name()
                put(f"{x} = {v} // 1000")
                v = x
            elif self.validate and t.logical in ("time-millis", "time-micros"):
                put(f"if not 0 <= {v} < {86_400_000 if t.logical == 'time-millis' else 86_400_000_000}: bad('time out of range')")
            if self.validate:
                bits = 31 if t.kind == "int" else 63
                put(f"if not {-(1 << bits)} <= {v} < {1 << bits}: bad('{t.kind} out of range')")
            self.long(ind, v)
        elif t.kind in ("float", "double"):
            put(f"ext(p{t.kind[0]}({v}))")
        elif t.kind == "string":
            if self.validate and t.logical == "uuid":
                put(f"if not UUID({v}): bad('invalid uuid')")
            x = self.name()
            put(f"{x} = {v}.encode('utf-8', 'replace')")
            put(f"n = len({x})")
            self.long(ind, "n")
            put(f"ext({x})")
        elif t.kind in ("bytes", "fixed"):
            x = self.name()
            size = t.size if t.kind == "fixed" else 0
            if t.logical == "decimal" and t.precision <= 38:
                put(f"{x} = from_decimal({v}, {t.precision}, {t.scale}, {size})")
            elif t.logical == "uuid":
                put(f"if {self.validate} and not UUID({v}): bad('invalid uuid')")
                put(f"{x} = uuid_bytes({v})")
            elif t.logical == "duration":
                put(f"{x} = p3({v}['months'], {v}['days'], {v}['millis'])")
            else:
                put(f"{x} = {v}")
            if size:
                put(f"if len({x}) != {size}: bad('fixed of another size')")
            else:
                put(f"n = len({x})")
                self.long(ind, "n")
            put(f"ext({x})")
        elif t.kind == "enum":
            x = self.name()
            put(f"{x} = {self.const({s: varint(i) for i, s in enumerate(t.symbols)})}.get({v})")
            put(f"if {x} is None: bad('no symbol of the enum')")
            put(f"ext({x})")
        elif t.kind in ("array", "map"):
            x = self.name()
            put(f"if len({v}):")
            self.put(ind + 1, f"n = len({v})")
            self.long(ind + 1, "n")
            k = self.name()
            self.put(ind + 1, f"for {k + ', ' if t.kind == 'map' else ''}{x} in {v}:")
            if t.kind == "map":
                self.write(AvroType("string"), k, ind + 2)
            self.write(t.items, x, ind + 2, stack)
            put("ext(b'\\x00')")
        elif id(t) in stack:
            put(f"{self._function(t)}(ext, {v})")
        else:
            self._fields(t, v, ind, (*stack, id(t)))

    def _fields(self, t: AvroType, v: str, ind: int, stack: tuple) -> None:
        if not t.fields:
            self.put(ind, "pass")
        for f in t.fields:
            x = self.name()
            if f.default is MISSING:
                self.put(ind, f"{x} = {v}[{f.name!r}]" if not self.validate else f"{x} = {v}.get({f.name!r})")
            else:
                self.put(ind, f"{x} = {v}[{f.name!r}] if {f.name!r} in {v} else {self.const(default_value(f.default, f.type))}")
            self.write(f.type, x, ind, stack)

    def _function(self, t: AvroType) -> str:
        key = (id(t), 0)
        if key not in self.made:
            name = self.made[key] = self.name("w")

            def make() -> None:
                self.put(0, f"def {name}(ext, v):")
                self._fields(t, "v", 1, (id(t),))

            self.todo.append(make)
        return self.made[key]

    def _union(self, t: AvroType, v: str, ind: int, stack: tuple) -> None:
        null = next((i for i, b in enumerate(t.branches) if b.kind == "null"), None)
        self.put(ind, f"if {v} is None:")
        self.put(ind + 1, f"ext({varint(null)!r})" if null is not None else "bad('null is no branch of the union')")
        single = t.nullable_of
        self.put(ind, "else:")
        if single is not None:
            self.put(ind + 1, f"ext({varint(t.branches.index(single))!r})")
            self.write(single, v, ind + 1, stack)
            return
        first = True
        for m, b in enumerate(t.members):
            x = self.name()
            self.put(ind + 1, f"{x} = {v}.get('member{m}')")
            self.put(ind + 1, f"if {x} is not None:" if first else f"if not hit and {x} is not None:")
            self.put(ind + 2, f"hit = True; ext({varint(t.branches.index(b))!r})")
            self.write(b, x, ind + 2, stack)
            if first:
                self.put(ind + 1, "else: hit = False")
                first = False
        self.put(ind + 1, "if not hit:")
        self.put(ind + 2, f"ext({varint(null)!r})" if null is not None else "bad('no member of the union is set')")

    def finish(self, entry: str) -> Any:
        while self.todo:
            self.todo.pop()()
        return self.build(entry)


def row_encoder(t: AvroType, names: list[str] | None = None, validate: bool = True) -> Callable[[Callable[[bytes], Any], tuple], None]:
    """A function (extend, row) that writes a tuple of the named columns as a record; columns that it lacks take their defaults."""
    e = Encoder(validate)
    e.put(0, "def row(ext, values):")
    if t.is_record:
        names = [f.name for f in t.fields] if names is None else names
        at = {n: i for i, n in enumerate(names)}
        for f in t.fields:
            x = e.name()
            if f.name in at:
                e.put(1, f"{x} = values[{at[f.name]}]")
            elif f.default is not MISSING:
                e.put(1, f"{x} = {e.const(default_value(f.default, f.type))}")
            else:
                raise SchemaError(f"no column for field {t.name}.{f.name}, which has no default")
            e.write(f.type, x, 1, (id(t),))
        if not t.fields:
            e.put(1, "pass")
    else:
        e.put(1, "v = values[0]")
        e.write(t, "v", 1)
    return e.finish("row")


def value_encoder(t: AvroType, validate: bool = True) -> Callable[[Any], bytes]:
    e = Encoder(validate)
    e.put(0, "def one(ext, v):")
    e.write(t, "v", 1)
    run = e.finish("one")

    def encode(v: Any) -> bytes:
        out = bytearray()
        try:
            run(out.extend, v)
        except (KeyError, TypeError, AttributeError, struct.error, OverflowError) as x:
            raise AvroDataError(f"Record does not conform to the schema: {x}") from x
        return bytes(out)

    return encode


# Arrow


def plain_type(t: AvroType) -> pa.DataType:
    """The Arrow type whose Python values the encoder takes: dates and times as numbers."""
    kinds = {"null": pa.null(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "bytes": pa.binary(), "fixed": pa.binary(), "string": pa.string(), "enum": pa.string()}
    if t.logical == "decimal" and t.precision <= 38:
        return pa.decimal128(t.precision, t.scale)
    if t.logical == "uuid":
        return pa.string()
    if t.logical == "duration":
        return pa.struct([(n, pa.int64()) for n in ("months", "days", "millis")])
    if t.kind in kinds:
        return kinds[t.kind]
    if t.kind == "array":
        return pa.list_(plain_type(t.items))
    if t.kind == "map":
        return pa.map_(pa.string(), plain_type(t.items))
    if t.kind == "union":
        return plain_type(t.nullable_of) if t.nullable_of is not None else pa.struct([(f"member{i}", plain_type(b)) for i, b in enumerate(t.members)])
    return pa.struct([(f.name, plain_type(f.type)) for f in t.fields])


def plain_values(column: pa.Array, t: AvroType) -> list:
    """Python values of an Arrow column for the encoder."""
    return _plain(column, t).to_pylist()


def _plain(a: pa.Array, t: AvroType) -> pa.Array:
    """Numbers for dates and times, also inside lists, maps and structs."""
    kind = a.type
    if pa.types.is_date32(kind):
        return a.cast(pa.int32())
    if pa.types.is_timestamp(kind):
        return a.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()) if kind.unit != "us" else a.cast(pa.int64())
    if pa.types.is_time(kind):
        return a.cast(pa.int64()) if pa.types.is_time64(kind) else a.cast(pa.int32())
    if not _has_time(kind):
        return a
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_plain(a.field(i), t) for i in range(kind.num_fields)], names=[kind.field(i).name for i in range(kind.num_fields)], mask=a.is_null())
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(a.offsets, a.keys, _plain(a.items, t), mask=a.is_null()) if a.null_count else pa.MapArray.from_arrays(a.offsets, a.keys, _plain(a.items, t))
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        maker = pa.ListArray if pa.types.is_list(kind) else pa.LargeListArray
        return maker.from_arrays(a.offsets, _plain(a.values, t), mask=a.is_null()) if a.null_count else maker.from_arrays(a.offsets, _plain(a.values, t))
    return a


def _has_time(kind: pa.DataType) -> bool:
    if pa.types.is_nested(kind):
        return any(_has_time(kind.field(i).type) for i in range(kind.num_fields)) if not pa.types.is_map(kind) else _has_time(kind.item_type)
    return pa.types.is_temporal(kind)
