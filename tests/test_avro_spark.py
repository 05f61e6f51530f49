import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwing.functions import avro as A
from quillwing.functions import protocol as P
from quillwing.operators.codec import AvroDataError, value_encoder
from quillwing.operators.ordering import NoOrder, avro_compare, avro_order_keys
from quillwing.plans.queries import QUERIES
from quillwing.plans.schema import SchemaError, parse
from quillwing.sources import container
from quillwing.sources.datasource import StreamWriter, Writing, read_avro, write_avro

from .conftest import SF

PARCEL = {"type": "record", "name": "depot.Parcel", "fields": [{"name": "code", "type": "string"}, {"name": "sent", "type": "long"}, {"name": "grams", "type": "int"}]}
ROWS = [("P-1", 1_700_000_000_123, 950), ("P-1", -5, 0), ("Q é", 1 << 40, -20), ("", 0, 2**31 - 1), ("R-77", -(1 << 62), 64)]


@pytest.fixture
def parcels(spark):
    return spark.createDataFrame(ROWS, "code string not null, sent long not null, grams int not null").coalesce(1)


def files(path):
    return [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".avro")]


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_what_we_write_java_reads(spark, parcels, tmp_path, codec):
    write_avro(parcels, f"{tmp_path}/w", avroSchema=json.dumps(PARCEL), compression=codec)
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(files(f"{tmp_path}/w")[0]), jvm.org.apache.avro.generic.GenericDatumReader())
    rows = []
    while reader.hasNext():
        r = reader.next()
        rows.append((str(r.get("code")), r.get("sent"), r.get("grams")))
    assert rows == ROWS
    assert read_avro(spark, f"{tmp_path}/w").collect() == parcels.collect()


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_what_java_writes_we_read(spark, tmp_path, codec):
    jvm = spark.sparkContext._jvm
    schema = jvm.org.apache.avro.Schema.Parser().parse(json.dumps(PARCEL))
    writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(schema))
    writer.setCodec(jvm.org.apache.avro.file.CodecFactory.fromString(codec))
    writer.setMeta("other", "kept")
    path = f"{tmp_path}/java.avro"
    writer.create(schema, jvm.java.io.File(path))
    for s, t, x in ROWS:
        r = jvm.org.apache.avro.generic.GenericData.Record(schema)
        r.put("code", s)
        r.put("sent", jvm.java.lang.Long(t))
        r.put("grams", x)
        writer.append(r)
    writer.close()
    assert [tuple(r) for r in read_avro(spark, path).collect()] == ROWS
    assert [tuple(r) for r in read_avro(spark, path, columns=["grams", "code"]).collect()] == [(x, s) for s, _, x in ROWS]


def test_splits_give_the_same_rows(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "concat('text ', id % 97) as s", "repeat('x', cast(id % 50 as int)) as pad").coalesce(1)
    for codec in ("null", "deflate"):
        write_avro(df, f"{tmp_path}/{codec}", compression=codec, blockSize="3000")
        for size in ("1000000000", "7001", "40000"):
            got = read_avro(spark, f"{tmp_path}/{codec}", splitBytes=size)
            assert got.count() == 20_000 and got.agg(F.sum("id"), F.sum(F.length("pad"))).collect() == df.agg(F.sum("id"), F.sum(F.length("pad"))).collect()
    assert got.rdd.getNumPartitions() > 1


def test_a_marker_inside_data_is_passed_over(spark, tmp_path):
    sync = bytes(range(16))
    df = spark.range(300).select("id", F.unhex(F.lit(sync.hex())).alias("b")).coalesce(1)
    write_avro(df, f"{tmp_path}/m", syncMarker=sync.hex(), blockSize="400")
    for size in ("100", "999"):
        assert read_avro(spark, f"{tmp_path}/m", splitBytes=size).agg(F.count("id"), F.sum("id")).first() == (300, 300 * 299 // 2)


def corrupt(tmp_path, parcels, name, change, **options):
    write_avro(parcels, f"{tmp_path}/{name}", avroSchema=json.dumps(PARCEL), **options)
    path = files(f"{tmp_path}/{name}")[0]
    data = open(path, "rb").read()
    open(path, "wb").write(change(data))
    return f"{tmp_path}/{name}"


def test_corrupt_files(spark, parcels, tmp_path):
    cases = {
        "truncated": lambda d: d[:-20], "garbage": lambda d: d + b"junk", "sync": lambda d: d[:-1] + bytes([d[-1] ^ 1]),
        "count": lambda d: d[: d.index(d[-16:]) + 16] + b"\x0c" + d[d.index(d[-16:]) + 17 :],
    }
    for name, change in cases.items():
        path = corrupt(tmp_path, parcels, name, change)
        with pytest.raises(Exception, match="(?i)avro|insufficient|truncated|sync|corrupt"):
            read_avro(spark, path).collect()
        assert read_avro(spark, path, ignoreCorruptFiles="true").count() <= 5
    assert read_avro(spark, f"{tmp_path}/sync", verifySync="false").count() == 5
    with pytest.raises(Exception, match="magic"):
        read_avro(spark, corrupt(tmp_path, parcels, "magic", lambda d: b"XXXX" + d[4:])).collect()
    with pytest.raises(Exception, match="deflatx"):
        read_avro(spark, corrupt(tmp_path, parcels, "codec", lambda d: d.replace(b"deflate", b"deflatx"), compression="deflate")).collect()
    with pytest.raises(Exception, match="avro.schema"):
        read_avro(spark, corrupt(tmp_path, parcels, "schema", lambda d: d.replace(b"avro.schema", b"avro.schemx"))).collect()


def test_writer_options(spark, parcels, tmp_path):
    for bad in ({"blockSize": "0"}, {"syncMarker": "00"}, {"avro.meta.avro.codec": "x"}, {"compression": "nope"}):
        with pytest.raises(Exception):  # noqa: B017
            write_avro(parcels, f"{tmp_path}/bad", **bad)
    with pytest.raises(ValueError, match="built-in"):
        container.register_codec("deflate", bytes, bytes)
    with pytest.raises(Exception, match="(?i)default"):
        write_avro(parcels, f"{tmp_path}/bad", avroSchema=json.dumps(PARCEL).replace('"grams"', '"more"'))
    with pytest.raises(Exception, match="conform"):
        write_avro(parcels.selectExpr("cast(null as string) code", "sent", "grams"), f"{tmp_path}/bad", avroSchema=json.dumps(PARCEL))
    write_avro(parcels, f"{tmp_path}/a", avroSchema=json.dumps(PARCEL))
    write_avro(parcels, f"{tmp_path}/a", mode="append", avroSchema=json.dumps(PARCEL))
    assert read_avro(spark, f"{tmp_path}/a").count() == 10
    write_avro(parcels, f"{tmp_path}/a", avroSchema=json.dumps(PARCEL))
    assert read_avro(spark, f"{tmp_path}/a").count() == 5 and not [x for x in os.listdir(f"{tmp_path}/a") if x.startswith("_")]
    write_avro(parcels.where("false"), f"{tmp_path}/none", avroSchema=json.dumps(PARCEL))
    assert len(files(f"{tmp_path}/none")) == 1 and read_avro(spark, f"{tmp_path}/none").count() == 0


def test_reader_schema_is_checked_on_the_driver(spark, parcels, tmp_path):
    write_avro(parcels, f"{tmp_path}/w", avroSchema=json.dumps(PARCEL))
    with pytest.raises(Exception, match="no default"):
        read_avro(spark, f"{tmp_path}/w", readerSchema=json.dumps(PARCEL).replace('"grams"', '"other"')).collect()
    reader = {"type": "record", "name": "depot.Parcel", "fields": [PARCEL["fields"][2], PARCEL["fields"][0]]}
    assert [tuple(r) for r in read_avro(spark, f"{tmp_path}/w", readerSchema=json.dumps(reader)).collect()] == [(x, s) for s, _, x in ROWS]


def test_order(spark):
    bid = {"type": "record", "name": "market.Bid", "fields": [{"name": "lot", "type": "string"}, {"name": "cents", "type": "long", "order": "descending"}, {"name": "note", "type": "string", "order": "ignore"}, {"name": "firm", "type": "boolean"}]}
    v = lambda lot, cents, firm, note="": f"named_struct('lot', '{lot}', 'cents', {cents}L, 'note', '{note}', 'firm', {firm})"
    for a, b, want in ((v("a", 1, "true"), v("b", 9, "false"), -1), (v("a", 9, "true"), v("a", 1, "false"), -1), (v("a", 1, "true"), v("a", 1, "false"), 1), (v("a", 1, "true", "x"), v("a", 1, "true", "y"), 0)):
        assert spark.sql(f"select {a} a, {b} b").select(avro_compare("a", "b", bid)).first()[0] == want
    with pytest.raises(NoOrder):
        avro_order_keys({"type": "map", "values": "int"}, "m")
    first, last = spark.createDataFrame([(None,), (2,), (1,)], "x int"), ["int", "null"]
    assert [r.x for r in first.orderBy(*avro_order_keys(["null", "int"], "x")).collect()] == [None, 1, 2]
    assert [r.x for r in first.orderBy(*avro_order_keys(last, "x")).collect()] == [1, 2, None]
    money = {"type": "bytes", "logicalType": "decimal", "precision": 6, "scale": 0}
    pair = spark.sql("select cast(-1 as decimal(6,0)) a, cast(1 as decimal(6,0)) b")
    assert pair.select(avro_compare("a", "b", money)).first()[0] == -1 and pair.select(avro_compare("a", "b", money, mode="bytes")).first()[0] == 1
    union = ["null", "long", "string"]
    u = spark.sql("select named_struct('member0', cast(5 as bigint), 'member1', cast(null as string)) a, named_struct('member0', cast(null as bigint), 'member1', 'a') b")
    assert u.select(avro_compare("a", "b", union), avro_compare("b", "a", union)).first() == (-1, 1)


def test_order_of_other_kinds(spark):
    """Booleans, doubles with NaN, bytes, arrays, time stamps, durations."""
    duration = {"type": "fixed", "name": "D", "size": 12, "logicalType": "duration"}
    span = lambda m, d, k: f"named_struct('months', {m}L, 'days', {d}L, 'millis', {k}L)"
    cases = [
        ("boolean", ["false", "true"]), ("double", ["double('-inf')", "-1.5D", "0D", "2D", "double('inf')", "double('nan')"]), ("bytes", ["X''", "X'00'", "X'7f'", "X'80'", "X'8000'"]),
        ({"type": "array", "items": "int"}, ["array(1)", "array(1, 2)", "array(2)"]), ({"type": "long", "logicalType": "timestamp-millis"}, ["timestamp'1960-01-01 00:00:00'", "timestamp'2020-01-01 00:00:00'"]),
        (duration, [span(0, 40, 0), span(1, 0, 5), span(1, 2, 0), span(1, 2, 7)]),
    ]
    for schema, values in cases:
        pairs = " union all ".join(f"select {i} i, {j} j, {a} a, {b} b" for i, a in enumerate(values) for j, b in enumerate(values))
        for r in spark.sql(pairs).select("i", "j", avro_compare("a", "b", schema).alias("c")).collect():
            assert r.c == (r.i > r.j) - (r.i < r.j), (schema, r)
        rows = spark.sql(" union all ".join(f"select {i} i, {x} a" for i, x in reversed(list(enumerate(values)))))
        assert [r.i for r in rows.orderBy(*avro_order_keys(schema, "a")).collect()] == list(range(len(values)))


def test_wide_decimals(spark):
    wide = {"type": "bytes", "logicalType": "decimal", "precision": 45, "scale": 0}
    raw = lambda n: bytearray(n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))
    numbers = [0, 1, -1, 127, 128, -128, -129, 255, 256, -256, -257, 10**40, -(10**40), 10**45 - 1, 1 - 10**45]
    df = spark.createDataFrame([(str(n), raw(n)) for n in numbers] + [("5", bytearray(b"\0\0\0\5")), ("-7", bytearray(b"\xff\xff\xf9"))], "n string, d binary")
    assert [int(r.n) for r in df.orderBy(*avro_order_keys(wide, "d")).collect()] == sorted([*numbers, 5, -7])
    assert df.where(~A.avro_is_valid("d", wide)).count() == 0
    beyond = spark.createDataFrame([(raw(n),) for n in (10**45, -(10**45), 10**60)], "d binary")
    assert beyond.where(A.avro_is_valid("d", wide)).count() == 0
    pair = spark.createDataFrame([(raw(-1), raw(1))], "a binary, b binary")
    assert pair.select(avro_compare("a", "b", wide), avro_compare("a", "b", wide, mode="bytes")).first() == (-1, 1)
    for schema in (wide, {"type": "fixed", "name": "F", "size": 30, "logicalType": "decimal", "precision": 45}):
        made = A.avro_random(spark, schema, 40, 3)
        assert made.where(~A.avro_is_valid("value", schema)).count() == 0 and made.distinct().count() == 40


def test_recursion_beyond_the_depth_is_null(spark, tmp_path):
    node = {"type": "record", "name": "Node", "fields": [{"name": "value", "type": "int"}, {"name": "next", "type": ["null", "Node"]}]}
    body = value_encoder(parse(node))({"value": 1, "next": {"value": 2, "next": {"value": 3, "next": None}}})
    df = spark.createDataFrame([(bytearray(body),)], "b binary")
    for mode in ("FAILFAST", "PERMISSIVE"):
        assert df.select(A.from_avro("b", node, mode=mode, recursive_depth=1).alias("x")).first().x == (1, (2, None))
    path = f"{tmp_path}/deep.avro"
    with open(path, "wb") as f:
        f.write(container.header_bytes(json.dumps(node), "null", bytes(16), {}) + bytes([2, 2 * len(body)]) + body + bytes(16))
    assert read_avro(spark, path, recursiveDepth="1").collect() == [(1, (2, None))]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    def add(k):
        write_avro(spark.range(10 * k, 10 * k + 10).coalesce(1), f"{tmp_path}/in", mode="append")

    def run():
        stream = spark.readStream.format("avro_ocf").option("maxFilesPerTrigger", "2").load(f"{tmp_path}/in").writeStream.format("parquet")
        query = stream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for k in range(4):
        add(k)
    run()
    for k in range(4, 7):
        add(k)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(70))


def test_a_repeated_batch_replaces_its_files(spark, tmp_path):
    kinds = T.StructType([T.StructField("id", T.LongType(), False)])

    def write(batch, *tasks):
        w = StreamWriter(Writing(f"{tmp_path}/s", {"sinkid": "q"}, kinds, False, container.codecs(), {}))
        w.commit([w.write(iter([pa.RecordBatch.from_pydict({"id": ids})])) for ids in tasks], batch)

    write(0, [1, 2])
    write(1, [3], [4])
    write(1, [3, 4])
    write(0, [1, 2])
    assert sorted(r.id for r in read_avro(spark, f"{tmp_path}/s").collect()) == [1, 2, 3, 4]


def test_modes_and_validation(spark):
    df = spark.createDataFrame([(bytearray(b"\x06foo"),), (bytearray(b"\x06fo"),), (None,)], "b binary")
    assert [r[0] for r in df.select(A.from_avro("b", "string", mode="PERMISSIVE")).collect()] == ["foo", None, None]
    with pytest.raises(Exception, match="Insufficient"):
        df.select(A.from_avro("b", "string")).collect()
    with pytest.raises(SchemaError):
        A.from_avro("b", "string", "int")
    schema = {"type": "record", "name": "R", "fields": [{"name": "l", "type": {"type": "array", "items": {"type": "fixed", "name": "F", "size": 2}}}, {"name": "t", "type": {"type": "int", "logicalType": "time-millis"}}, {"name": "u", "type": ["null", {"type": "string", "logicalType": "uuid"}]}]}
    bad = spark.sql("select named_struct('l', array(X'0102', X'01'), 't', -1, 'u', cast(null as string)) r")
    found = bad.select(A.avro_validation_errors("r", schema).alias("e"), A.avro_is_valid("r", schema).alias("ok")).first()
    assert [(e.path, e.type) for e in found.e] == [("$.l[1]", "F"), ("$.t", "time-millis")] and not found.ok
    assert "time-millis: -1" in A.render_errors([e.asDict() for e in found.e])


def test_random_values_conform(spark):
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "int", "string"]}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["P", "Q"]}}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "u", "type": {"type": "string", "logicalType": "uuid"}}, {"name": "f", "type": {"type": "fixed", "name": "F", "size": 70}}, {"name": "d", "type": {"type": "fixed", "name": "D", "size": 12, "logicalType": "duration"}}]}
    df = A.avro_random(spark, schema, 50, 2)
    assert df.select(F.struct("*").alias("r")).where(~A.avro_is_valid("r", schema)).count() == 0
    encoded = df.select(A.to_avro(F.struct("*"), schema).alias("b"))
    assert encoded.select(A.from_avro("b", schema)).count() == 50


def test_protocol_rules():
    ok = {"protocol": "P", "messages": {"m": {"request": [{"name": "a", "type": "int"}], "response": "null", "one-way": True}}}
    p = P.AvroProtocol.parse(json.dumps(ok))
    assert p.messages["m"].errors.to_json() == ["string"] and len(p.md5) == 16
    for change in ({"response": "int"}, {"errors": ["int"]}):
        with pytest.raises(SchemaError):
            P.AvroProtocol({"protocol": "P", "messages": {"m": ok["messages"]["m"] | change}})
    with pytest.raises(SchemaError):
        P.AvroProtocol({"messages": {}})
    child = p.subprotocol()
    p.on("m", lambda d: d)
    assert child.handler("m") is p.handler("m")
    remote = P.AvroProtocol({"protocol": "P", "messages": {"m": {"request": [{"name": "a", "type": "long", "default": 1}], "response": "null", "one-way": True}}})
    assert p.add_remote(remote) in p.remotes
    with pytest.raises(SchemaError, match="lacks"):
        p.add_remote(P.AvroProtocol({"protocol": "P", "messages": {}}))


def test_calls_of_a_remote_version(spark):
    spec = lambda fields: {"protocol": "P", "messages": {"m": {"request": fields, "response": "long"}}}
    theirs = P.AvroProtocol(spec([{"name": "gone", "type": "string"}, {"name": "n", "type": "int"}]))
    ours = P.AvroProtocol(spec([{"name": "n", "type": "long"}, {"name": "more", "type": "string", "default": "d"}]))
    assert ours.add_remote(theirs, "listener") == theirs.md5
    meta = F.create_map(F.lit("id"), P.call_id(F.lit(7)))
    call = P.encode_call_request(meta, "m", F.struct(F.lit("x").alias("gone"), F.lit(5).alias("n")), theirs)
    got = spark.range(1).select(P.decode_call_envelope(call).alias("e")).select(P.decode_call_params(F.col("e.params"), "m", ours, theirs.md5).alias("p"), "e.meta").first()
    assert (got.p.n, got.p.more) == (5, "d") and bytes(got.meta["id"]) == b"\x00\x00\x00\x07"


def test_handlers_answer_errors_and_remote_versions(spark):
    spec = lambda kind: {"protocol": "P", "messages": {"half": {"request": [{"name": "n", "type": kind}], "response": "long"}}}
    ours, theirs = P.AvroProtocol(spec("long")), P.AvroProtocol(spec("int"))
    with pytest.raises(SchemaError):
        ours.add_remote(theirs)
    with pytest.raises(SchemaError):
        ours.add_remote(P.AvroProtocol(spec("string")), "listener")
    known = ours.add_remote(theirs, "listener")
    odd = F.when(F.expr("params.n % 2 = 1"), F.struct(F.lit("odd").alias("member0")))
    ours.on("half", lambda d: d.withColumn("response", F.expr("params.n div 2")).withColumn("error", odd))
    meta = F.create_map(F.lit("id"), P.call_id(F.lit(1)))
    calls = spark.createDataFrame([(4,), (7,)], "n int").select("n", P.decode_call_envelope(P.encode_call_request(meta, "half", F.struct("n"), theirs)).alias("envelope"))
    got = {r.n: r.r for r in P.dispatch(calls, ours, remote=known).select("n", P.decode_response_envelope("response").alias("r")).collect()}
    assert not got[4].is_error and bytes(got[4].payload) == b"\x04" and got[7].is_error and b"odd" in bytes(got[7].payload)


def test_framing_and_errors(spark):
    df = spark.createDataFrame([(bytearray(b"hello world"),), (bytearray(b""),)], "b binary")
    framed = [bytes(r[0]) for r in df.select(P.avro_frame("b", 4)).collect()]
    assert framed == [b"\x00\x00\x00\x04hell\x00\x00\x00\x04o wo\x00\x00\x00\x03rld\x00\x00\x00\x00", b"\x00\x00\x00\x00"]
    assert P.unframe_bytes(framed[0]) == (b"hello world", len(framed[0])) and P.unframe_bytes(framed[0][:-1]) is None
    with pytest.raises(AvroDataError):
        P.unframe_bytes(framed[0], limit=5)
    p = P.AvroProtocol({"protocol": "P", "messages": {"m": {"request": [], "response": "int"}}})
    meta = F.create_map(F.lit("k"), F.encode(F.lit("v"), "UTF-8"))
    one = spark.range(1)
    failed = one.select(P.encode_call_response(meta, "m", F.lit(1), p, error=F.struct(F.lit("oops").alias("member0"))).alias("r"))
    answer = failed.select(P.decode_response_envelope("r").alias("x")).select("x.is_error", A.from_avro("x.payload", ["string"]).alias("e")).first()
    assert answer.is_error and answer.e.member0 == "oops"
    unknown = one.select("id", P.decode_call_envelope(F.concat(A.to_avro(meta, P.META), A.to_avro(F.lit("nope"), "string"))).alias("envelope"))
    got = P.dispatch(unknown, p).select(P.decode_response_envelope("response").alias("r")).first().r
    assert got.is_error and b"nope" in bytes(got.payload)
    shake = F.struct(F.lit(bytearray(16)).alias("clientHash"), F.lit(None).cast("string").alias("clientProtocol"), F.lit(bytearray(16)).alias("serverHash"), F.lit(None).cast("map<string,binary>").alias("meta"))
    call = P.encode_call_request(meta, "m", F.struct(), p)
    both = one.select(P.decode_call_envelope(F.concat(P.encode_handshake_request(shake), call), "optional").alias("x"), P.decode_call_envelope(call, "optional").alias("y")).first()
    assert both.x.message == both.y.message == "m" and both.x.handshake is not None and both.y.handshake is None


def test_handshake_actions(spark):
    df = spark.createDataFrame([("BOTH", False, False), ("NONE", False, False), ("NONE", True, False), ("NONE", False, True), ("CLIENT", False, False)], "m string, e boolean, s boolean")
    assert [r[0] for r in df.select(P.handshake_action(F.col("m"), F.col("e"), F.col("s"))).collect()] == ["proceed", "retry", "fail", "fail", "proceed"]


def pytest_generate_tests(metafunc):
    if "query_name" in metafunc.fixturenames:
        from quillwing.plans.queries import SQL

        metafunc.parametrize("query_name", sorted(SQL))


def test_queries_agree_with_sql(spark, query_name):
    import duckdb

    from quillwing.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[query_name])
    order = sorted(want.columns)
    got = QUERIES[query_name](spark, SF)
    assert sorted(got.columns) == order
    rows = sorted((tuple(r) for r in got.select(*order).collect()), key=repr)
    assert rows == sorted(want.project(", ".join(f'"{c}"' for c in order)).fetchall(), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def without_events(spark, path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_frames_of_a_stream_stay_off_the_driver(spark, tmp_path):
    assert QUERIES["stream_frames"](spark, SF).inputFiles()
    assert QUERIES["stream_frames"](spark, without_events(spark, tmp_path)).collect() == []


def test_rows_of_a_streamed_scan_stay_off_the_driver(spark, tmp_path):
    assert QUERIES["stream_scan"](spark, SF).inputFiles()
    assert QUERIES["stream_scan"](spark, without_events(spark, tmp_path)).collect() == []
