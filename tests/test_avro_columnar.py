import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from quillwing.operators import columnar
from quillwing.operators.codec import AvroDataError, block_decoder, plain_values, row_encoder
from quillwing.plans.schema import parse, to_struct

FIELDS = [
    ("b", "boolean"), ("i", "int"), ("l", "long"), ("f", "float"), ("d", "double"), ("s", "string"), ("y", "bytes"), ("e", {"type": "enum", "name": "E", "symbols": ["P", "Q", "R"]}),
    ("day", {"type": "int", "logicalType": "date"}), ("ms", {"type": "long", "logicalType": "timestamp-millis"}), ("us", {"type": "long", "logicalType": "local-timestamp-micros"}),
]


def value(name, r):
    return {
        "b": lambda: r.random() < 0.5, "i": lambda: r.choice([0, -1, 63, 64, -(2**31), 2**31 - 1, r.randint(-9999, 9999)]), "l": lambda: r.choice([0, 2**63 - 1, -(2**63), r.randint(-(2**40), 2**40)]),
        "f": lambda: 0.5 * r.randint(-9, 9), "d": lambda: r.random(), "s": lambda: r.choice(["", "é😀", "x" * 200, "abc"]), "y": lambda: bytes(r.randrange(256) for _ in range(r.randint(0, 70))),
        "e": lambda: r.choice("PQR"), "day": lambda: datetime.date(1970, 1, 1) + datetime.timedelta(r.randint(-9999, 9999)), "ms": lambda: datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=r.randint(-(10**12), 10**12)),
        "us": lambda: datetime.datetime(1999, 1, 1) + datetime.timedelta(microseconds=r.randint(-(10**15), 10**15)),
    }[name]()


def sample(nullable, rows, seed=1):
    r = random.Random(seed)
    kinds = {"first": lambda t: ["null", t], "last": lambda t: [t, "null"], "never": lambda t: t}[nullable]
    t = parse({"type": "record", "name": "R", "fields": [{"name": n, "type": kinds(k)} for n, k in FIELDS]})
    schema = to_arrow_schema(to_struct(t))
    columns = [pa.array([None if nullable != "never" and r.random() < 0.2 else value(f.name, r) for _ in range(rows)], f.type) for f in schema]
    return t, schema, columns


@pytest.mark.parametrize("nullable", ["first", "last", "never"])
def test_both_codecs_agree(nullable):
    t, schema, columns = sample(nullable, 500)
    row, want = row_encoder(t), []
    for values in zip(*[plain_values(c, f.type) for c, f in zip(columns, t.fields, strict=True)], strict=True):
        out = bytearray()
        row(out.extend, values)
        want.append(bytes(out))
    body, ends = columnar.encode_rows(t, [c.slice(0) for c in columns])
    assert body.tobytes() == b"".join(want) and ends.tolist() == [sum(map(len, want[: k + 1])) for k in range(500)]
    sliced, _ = columnar.encode_rows(t, [c.slice(100, 50) for c in columns])
    assert sliced.tobytes() == b"".join(want[100:150])

    cuts = [0, 1, 40, 40, 200, 350, 500]
    counts = [b - a for a, b in zip(cuts, cuts[1:]) if b > a]
    blocks = [b"".join(want[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
    got = columnar.decode_blocks(t, t, counts, blocks, schema)
    slow = [[] for _ in t.fields]
    for n, b in zip(counts, blocks, strict=True):
        block_decoder(t)(b, n, slow)
    for k, f in enumerate(schema):
        assert got.column(k).to_pylist() == columns[k].to_pylist() == pa.array(slow[k], f.type).to_pylist()

    some = parse({"type": "record", "name": "R", "fields": [x for x in reversed(t.to_json()["fields"]) if x["name"] in ("s", "i", "d")]})
    part = columnar.decode_blocks(t, some, counts, blocks, to_arrow_schema(to_struct(some)))
    assert part.schema.names == ["s", "d", "i"] and part.column(0).to_pylist() == columns[5].to_pylist()


def test_broken_blocks():
    t, schema, columns = sample("first", 40)
    body, _ = columnar.encode_rows(t, columns)
    data = body.tobytes()
    for bad, n in ((data[:-1], 40), (data + b"\x00", 40), (data, 39), (data, 41), (b"\x08" + data[1:], 40)):
        with pytest.raises(AvroDataError):
            columnar.decode_blocks(t, t, [n], [bad], schema)
    t, _, columns = sample("never", 3)
    with pytest.raises(AvroDataError):
        columnar.encode_rows(t, [pa.array([None] * 3, c.type) for c in columns])
    columns[7] = pa.array(["P", "Z", "Q"])
    with pytest.raises(AvroDataError):
        columnar.encode_rows(t, columns)


def test_bytes_that_are_no_text():
    t = parse({"type": "record", "name": "R", "fields": [{"name": "s", "type": "string"}]})
    got = columnar.decode_blocks(t, t, [2], [b"\x02\xff\x04ab"], pa.schema([("s", pa.string())]))
    assert got.column(0).to_pylist() == ["�", "ab"]


def test_what_is_flat():
    assert not columnar.is_flat(parse("int")) and columnar.is_flat(sample("first", 1)[0])
    for kind in ({"type": "array", "items": "int"}, ["null", "int", "string"], {"type": "bytes", "logicalType": "decimal", "precision": 4}, {"type": "string", "logicalType": "uuid"}, {"type": "int", "logicalType": "time-millis"}):
        assert not columnar.is_flat(parse({"type": "record", "name": "R", "fields": [{"name": "x", "type": kind}]}))
