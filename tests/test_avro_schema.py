import json

import pytest
from pyspark.sql import types as T

from quillwing.operators.codec import AvroDataError, block_decoder, row_encoder, value_decoder, value_encoder
from quillwing.plans.resolve import check
from quillwing.plans.schema import SchemaError, from_spark, parse, same_schema, to_struct


def rec(name, *fields, **more):
    return {"type": "record", "name": name, "fields": [{"name": f[0], "type": f[1]} | (f[2] if len(f) > 2 else {}) for f in fields]} | more


WIRE = [
    ("null", None, ""), ("boolean", True, "01"), ("boolean", False, "00"), ("int", 0, "00"), ("int", -1, "01"), ("int", 1, "02"), ("int", -64, "7f"), ("int", 64, "8001"),
    ("int", 2**31 - 1, "feffffff0f"), ("int", -(2**31), "ffffffff0f"), ("long", 2**63 - 1, "feffffffffffffffff01"), ("long", -(2**63), "ffffffffffffffffff01"), ("long", 8191, "fe7f"),
    ("long", -8193, "818001"), ("float", 1.5, "0000c03f"), ("double", -2.25, "00000000000002c0"), ("string", "foo", "06666f6f"), ("string", "é", "04c3a9"), ("bytes", b"\x00\xff", "0400ff"),
    ({"type": "array", "items": "long"}, [3, 27], "04063600"), ({"type": "array", "items": "long"}, [], "00"), ({"type": "map", "values": "int"}, [("a", 1)], "0202610200"),
    ({"type": "enum", "name": "E", "symbols": ["A", "B", "C"]}, "C", "04"), ({"type": "fixed", "name": "F", "size": 2}, b"ab", "6162"), (["null", "string"], None, "00"),
    (["null", "string"], "a", "020261"), (["string", "null"], None, "02"), (["int", "string", "boolean"], {"member1": "x"}, "020278"), (rec("R", ("a", "long"), ("b", "string")), {"a": 27, "b": "foo"}, "3606666f6f"),
    ({"type": "bytes", "logicalType": "decimal", "precision": 5, "scale": 2}, __import__("decimal").Decimal("-1.00"), "029c"),
    ({"type": "fixed", "name": "U", "size": 16, "logicalType": "uuid"}, "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8"),
    ({"type": "fixed", "name": "D", "size": 12, "logicalType": "duration"}, {"months": 1, "days": 2, "millis": 2**32 - 1}, "0100000002000000ffffffff"),
]


@pytest.mark.parametrize(("schema", "value", "wire"), WIRE)
def test_wire_bytes(schema, value, wire):
    t = parse(schema)
    assert value_encoder(t)(value).hex() == wire
    assert value_decoder(t)(bytes.fromhex(wire)) == value


def test_reading_variants():
    assert value_decoder(parse("boolean"))(b"\x05") is True
    array = parse({"type": "array", "items": "long"})
    assert value_decoder(array)(bytes.fromhex("0206" + "03043602" + "00")) == [3, 27, 1]
    assert value_decoder(array)(bytes.fromhex("03" + "04" + "0636" + "00")) == [3, 27]  # a block with its size in bytes
    assert value_decoder(parse({"type": "map", "values": "int"}))(bytes.fromhex("04" + "026102" + "026104" + "00")) == [("a", 2)]
    assert value_decoder(parse("string"))(b"\x02\xff") == "�"
    for bad, schema in (("", "int"), ("06666f", "string"), ("0000", "int"), ("ffffffff7f", "int"), ("ffffffffffffffffffff01", "long"), ("08", ["null", "int"]), ("06", {"type": "enum", "name": "E", "symbols": ["A"]}), ("01", "bytes")):
        with pytest.raises(AvroDataError):
            value_decoder(parse(schema))(bytes.fromhex(bad))


@pytest.mark.parametrize(("schema", "value"), [
    ("int", 2**31), ("int", None), ("string", None), ("null", 1), ({"type": "fixed", "name": "F", "size": 2}, b"a"), ({"type": "enum", "name": "E", "symbols": ["A"]}, "B"),
    ({"type": "string", "logicalType": "uuid"}, "6ba7b810-9dad-71d1-80b4-00c04fd430c8"), ({"type": "int", "logicalType": "time-millis"}, 86_400_000), (["int", "string"], {"member0": None, "member1": None}),
    ({"type": "bytes", "logicalType": "decimal", "precision": 4, "scale": 2}, __import__("decimal").Decimal("1234.56")),
])
def test_values_that_do_not_conform(schema, value):
    with pytest.raises(AvroDataError):
        value_encoder(parse(schema))(value)


@pytest.mark.parametrize("schema", [
    "unknown.Type", {"type": "record", "name": "R"}, {"type": "record", "fields": []}, rec("1x"), rec("int"), rec("R", ("a", "int"), ("a", "int")), {"type": "enum", "name": "E", "symbols": []},
    {"type": "enum", "name": "E", "symbols": ["A", "A"]}, {"type": "enum", "name": "E", "symbols": ["a b"]}, {"type": "enum", "name": "E", "symbols": ["A"], "default": "B"}, {"type": "fixed", "name": "F", "size": 0},
    {"type": "fixed", "name": "F"}, {"type": "array"}, {"type": "map"}, [], ["int", "int"], ["int", ["string"]], ["null", rec("A"), rec("A")], 5, {"type": 7}, rec("R", ("a", rec("R"))),
])
def test_schemas_that_are_refused(schema):
    with pytest.raises(SchemaError):
        parse(schema)


def test_names_namespaces_and_references():
    t = parse(rec("R", ("e", {"type": "enum", "name": "E", "symbols": ["A"]}), ("again", "E"), ("far", ["null", "x.y.R"]), namespace="x.y", aliases=["Old", "z.Older"]))
    assert t.name == "x.y.R" and t.aliases == ("x.y.Old", "z.Older")
    assert t.fields[1].type is t.fields[0].type and t.fields[2].type.branches[1] is t
    assert parse(t.dumps()).to_json() == t.to_json() and t.dumps().count('"symbols"') == 1
    assert parse(rec("a.b.C", namespace="x")).name == "a.b.C" and parse(rec("C", namespace="")).name == "C"
    forward = parse(["null", rec("Uses", ("f", "Foo")), rec("Foo", ("id", "string"))])
    assert forward.branches[1].fields[0].type is forward.branches[2]
    registry = {}
    parse(rec("Shared"), registry=registry)
    assert parse("Shared", registry=registry).name == "Shared"
    with pytest.raises(SchemaError, match="twice"):
        parse(rec("Shared"), registry=registry)


def test_logical_types_fail_open():
    for schema in ({"type": "int", "logicalType": "nonsense"}, {"type": "string", "logicalType": "date"}, {"type": "bytes", "logicalType": "decimal", "precision": 0}, {"type": "bytes", "logicalType": "decimal", "precision": 2, "scale": 3}, {"type": "fixed", "name": "F", "size": 2, "logicalType": "decimal", "precision": 9}, {"type": "fixed", "name": "F", "size": 8, "logicalType": "uuid"}, {"type": "fixed", "name": "F", "size": 8, "logicalType": "duration"}):
        assert parse(schema).logical is None
    assert parse({"type": "fixed", "name": "F", "size": 2, "logicalType": "decimal", "precision": 4}).logical == "decimal"


def test_spark_types():
    t = parse(rec("R", ("a", "int"), ("b", ["null", "string"]), ("u", ["int", "string"]), ("m", {"type": "map", "values": ["null", "long"]}), ("d", {"type": "bytes", "logicalType": "decimal", "precision": 39}), ("e", {"type": "enum", "name": "E", "symbols": ["X"]}), ("n", {"type": "long", "logicalType": "timestamp-nanos"})))
    s = to_struct(t)
    assert [f.nullable for f in s] == [False, True, False, False, False, False, False]
    assert s["u"].dataType == T.StructType([T.StructField("member0", T.IntegerType()), T.StructField("member1", T.StringType())]) and s["u"].metadata["avro.branches"] == ["int", "string"]
    assert s["m"].dataType == T.MapType(T.StringType(), T.LongType(), True) and s["d"].dataType == T.BinaryType() and s["e"].metadata["avro.symbols"] == ["X"] and s["n"].dataType == T.LongType()
    assert from_spark(to_struct(parse(rec("R", ("e", {"type": "enum", "name": "E", "symbols": ["X"]})))), "R").to_json() == rec("R", ("e", {"type": "enum", "name": "E", "symbols": ["X"]}))
    node = rec("Node", ("value", "int"), ("next", ["null", "Node"]))
    with pytest.raises(SchemaError, match="recursive"):
        to_struct(parse(node))
    assert to_struct(parse(node), 1)["next"].dataType["next"].dataType == T.NullType()
    with pytest.raises(SchemaError, match="rename"):
        from_spark(T.StructType([T.StructField("a b", T.LongType())]))


def test_introspection():
    t = parse(rec("R", ("a", "int"), namespace="n.s"))
    assert (t.namespace, t.short_name, t.field("a").type.kind, t.field("z")) == ("n.s", "R", "int", None)
    assert t.matches_name(parse(rec("Q", aliases=["n.s.R"]))) and same_schema(t, parse(t.dumps()))


def resolved(writer, reader, value):
    return value_decoder(parse(writer), parse(reader))(value_encoder(parse(writer))(value))


NS = {"namespace": "depot.stock"}
R1 = rec("Shelf", ("label", "string"), ("room", "long"), **NS)
R2 = rec("Rack", ("label", "string"), ("room", "long"), ("keeper", "string", {"default": "none"}), aliases=["Shelf"], **NS)
E = lambda symbols, **more: {"type": "enum", "name": "E", "symbols": symbols} | more


@pytest.mark.parametrize(("writer", "reader", "value", "want"), [
    (R1, R2, {"label": "A7", "room": 3}, {"label": "A7", "room": 3, "keeper": "none"}),
    (R2, R1 | {"aliases": ["Rack"]}, {"label": "A7", "room": 3, "keeper": "Kim"}, {"label": "A7", "room": 3}),
    (rec("R", ("old", "long")), rec("R", ("new", "long", {"aliases": ["old"]})), {"old": 5}, {"new": 5}),
    (rec("R", ("old", "long", {"aliases": ["new"]})), rec("R", ("new", "long")), {"old": 5}, {"new": 5}),
    (rec("R", ("d", "string")), rec("R", ("d", "bytes")), {"d": "é"}, {"d": "é".encode()}),
    (rec("R", ("d", "bytes")), rec("R", ("d", "string")), {"d": b"ab"}, {"d": "ab"}),
    (rec("R", ("a", "string"), ("b", "long")), rec("R", ("b", "long"), ("a", "string")), {"a": "x", "b": 2}, {"b": 2, "a": "x"}),
    ("int", "long", 7, 7), ("int", "float", 7, 7.0), ("long", "double", 7, 7.0), ("float", "double", 1.5, 1.5),
    (E(["A", "B"]), E(["B"], default="B"), "A", "B"), (E(["A"]), E(["A", "B"]), "A", "A"),
    ({"type": "array", "items": "int"}, {"type": "array", "items": "double"}, [1], [1.0]), ({"type": "map", "values": "int"}, {"type": "map", "values": "long"}, [("k", 1)], [("k", 1)]),
    ("int", ["long", "int"], 3, {"member0": 3}), ("string", ["null", "string"], "s", "s"), (["int", "string"], ["string", "null", "double"], {"member0": 4}, {"member1": 4.0}),
    ("long", {"type": "long", "logicalType": "timestamp-micros"}, 9, 9),
    ({"type": "fixed", "name": "F", "size": 2}, {"type": "fixed", "name": "G", "size": 2, "aliases": ["F"]}, b"ab", b"ab"),
    (rec("R", ("skip", {"type": "array", "items": ["null", {"type": "map", "values": rec("In", ("x", "double"), ("y", "bytes"))}]}), ("k", "int")), rec("R", ("k", "int")), {"skip": [None, [("a", {"x": 1.0, "y": b"zz"})]], "k": 3}, {"k": 3}),
])
def test_resolution(writer, reader, value, want):
    assert resolved(writer, reader, value) == want


@pytest.mark.parametrize(("writer", "reader"), [
    (R1, rec("Drawer", ("label", "string"), ("keeper", "string", {"default": "none"}), **NS)), (rec("R", ("a", "string")), rec("R", ("a", "long"))), (rec("R", ("a", "int")), rec("R", ("b", "int"))),
    (["int", "string"], "int"), ("long", "int"), ("double", "float"), ({"type": "int", "logicalType": "date"}, "int"), (E(["A", "B"]), E(["A"])), (["int", "bytes"], ["int"]), ("string", "int"),
    ({"type": "fixed", "name": "F", "size": 2}, {"type": "fixed", "name": "F", "size": 3}), (rec("R", ("a", "int"), ("b", "int")), rec("R", ("c", "int", {"aliases": ["a", "b"]}))),
    ({"type": "bytes", "logicalType": "decimal", "precision": 5, "scale": 2}, {"type": "bytes", "logicalType": "decimal", "precision": 5, "scale": 1}), ({"type": "array", "items": "string"}, {"type": "array", "items": "int"}),
])
def test_pairs_that_do_not_resolve(writer, reader):
    with pytest.raises(SchemaError):
        check(parse(writer), parse(reader))


def test_every_default():
    reader = rec(
        "Whole", ("id", "int"), ("nul", "null", {"default": None}), ("flag", "boolean", {"default": True}), ("i", "int", {"default": 1}), ("l", "long", {"default": 1}), ("f", "float", {"default": 1.5}),
        ("d", "double", {"default": 1.1}), ("b", "bytes", {"default": "ÿ"}), ("s", "string", {"default": "foo"}), ("r", rec("Nested", ("a", "int")), {"default": {"a": 1}}), ("e", {"type": "enum", "name": "TE", "symbols": ["FOO", "BAR"]}, {"default": "FOO"}),
        ("arr", {"type": "array", "items": "int"}, {"default": [1]}), ("m", {"type": "map", "values": "int"}, {"default": {"a": 1}}), ("fx", {"type": "fixed", "name": "TF", "size": 1}, {"default": "ÿ"}),
        ("u", ["string", "int", "null"], {"default": "bare"}), ("w", ["null", "string"], {"default": {"string": "wrapped"}}),
    )
    got = resolved(rec("Whole", ("id", "int")), reader, {"id": 42})
    assert got == {"id": 42, "nul": None, "flag": True, "i": 1, "l": 1, "f": 1.5, "d": 1.1, "b": b"\xff", "s": "foo", "r": {"a": 1}, "e": "FOO", "arr": [1], "m": [("a", 1)], "fx": b"\xff", "u": {"member0": "bare"}, "w": "wrapped"}
    row = bytearray()
    row_encoder(parse(reader), ["id"])(row.extend, (42,))
    columns = [[] for _ in reader["fields"]]
    block_decoder(parse(reader))(bytes(row), 1, columns)
    assert [c[0] for c in columns] == list(got.values())


def test_recursive_values():
    node = parse(rec("Node", ("value", "int"), ("next", ["null", "Node"])))
    v = {"value": 1, "next": {"value": 2, "next": {"value": 3, "next": None}}}
    assert value_decoder(node)(value_encoder(node)(v)) == v
    deep = None
    for k in range(200):
        deep = {"value": k, "next": deep}
    assert value_decoder(node)(value_encoder(node)(deep)) == deep
    assert json.loads(node.dumps())["fields"][1]["type"] == ["null", "Node"]
