"""Queries over the test tables for every Avro operator, with SQL that says the same of the tables themselves."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import avro as A
from ..functions import protocol as P
from ..operators.ordering import avro_compare, avro_match, avro_order_keys
from ..sources import container
from ..sources.datasource import NAME, read_avro, read_avro_binary, read_avro_header, register, write_avro
from ..streaming.frames import assemble_frames
from .resolve import projection
from .schema import from_spark, parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession) -> str:
    """A new folder below the session's shared one, or below a temporary one where the session names none (tests)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/avro-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp(prefix='quillwing-')}/avro"


def stored(df: DataFrame, **options: str) -> str:
    path = work_path(df.sparkSession)
    write_avro(df, path, **options)
    return path


def through(df: DataFrame, write: dict | None = None, columns: list[str] | None = None, **read: str) -> DataFrame:
    """What comes back of ``df`` from container files."""
    return read_avro(df.sparkSession, stored(df, **(write or {})), columns, **read)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream makes of all that its source has now, by files: no row passes through the driver, as with a memory sink."""
    spark = stream.sparkSession
    path = work_path(spark)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", work_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def record(name: str, *fields) -> str:
    import json

    return json.dumps({"type": "record", "name": name, "fields": [{"name": f[0], "type": f[1]} | (f[2] if len(f) > 2 else {}) for f in fields]})


# Scans and sinks


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
def ocf_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over a projected, split Avro scan (the analysis is Spark's own)."""
    df = through(table(spark, sf_dir, "lineitem"), {"compression": "deflate"}, ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"])
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return df.where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_base_price"), F.count(F.lit(1)).alias("count_order"))


@query("SELECT * FROM lineitem")
def ocf_roundtrip_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "lineitem"))


@query("SELECT * FROM orders")
def ocf_roundtrip_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "orders"), {"compression": "deflate"})


@query("SELECT * FROM supplier")
def ocf_custom_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import lzma

    container.register_codec("xz", lzma.compress, lzma.decompress)
    return through(table(spark, sf_dir, "supplier"), {"compression": "xz"})


@query("SELECT * FROM region")
def ocf_byte_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    flip = bytes(255 - i for i in range(256))
    container.register_transform("flip", lambda b: b.translate(flip), lambda b: b.translate(flip))
    return through(table(spark, sf_dir, "region"), {"byteTransform": "flip"}, byteTransform="flip")


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem")
def ocf_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = through(table(spark, sf_dir, "lineitem").coalesce(1), {"blockSize": "16000"}, splitBytes="250000")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum(F.col("l_linenumber").cast("long")).alias("numbers"))


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def ocf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "lineitem"), columns=["l_orderkey", "l_linenumber", "l_tax"])


@query("SELECT * FROM customer")
def ocf_binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    files = spark.read.format("binaryFile").load(stored(df, compression="deflate"))
    return read_avro_binary(files, from_spark(df.schema).dumps())


@query("SELECT 'Obj' AS magic, 16 AS sync_size, 'deflate' AS codec, 'tests' AS made_by, true AS has_schema")
def ocf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = read_avro_header(spark, stored(table(spark, sf_dir, "nation").coalesce(1), compression="deflate", **{"avro.meta.made.by": "tests"}))
    meta = lambda k: F.element_at("meta", k)
    return h.select(F.decode(F.substring("magic", 1, 3), "UTF-8").alias("magic"), F.octet_length("sync").alias("sync_size"), "codec", F.decode(meta("made.by"), "UTF-8").alias("made_by"), meta("avro.schema").isNotNull().alias("has_schema"))


@query("SELECT 0 AS n, 'r_regionkey,r_name' AS names FROM (SELECT 1)")
def ocf_empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = through(table(spark, sf_dir, "region").where("false"))
    return df.agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("names", F.lit(",".join(df.columns)))


@query("SELECT * FROM events")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return drained(spark.readStream.format(NAME).load(stored(table(spark, sf_dir, "events").repartition(3))))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    df, out = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), work_path(spark)
    source, kinds = work_path(spark), df.schema
    df.write.parquet(source)
    stream = spark.readStream.schema(kinds).parquet(source).writeStream.format(NAME).option("path", out).option("checkpointLocation", work_path(spark))
    stream.trigger(availableNow=True).start().awaitTermination()
    return read_avro(spark, out)


# Evolution


@query("SELECT *, 'x' AS c_new FROM customer")
def ocf_evolution_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    reader = from_spark(df.schema).to_json()
    reader["fields"].append({"name": "c_new", "type": "string", "default": "x"})
    return through(df, readerSchema=parse(reader).dumps())


@query("SELECT s_suppkey AS supplier_key, s_acctbal AS balance FROM supplier")
def ocf_evolution_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = record("Supplier2", ("supplier_key", ["null", "long"], {"aliases": ["s_suppkey"]}), ("balance", ["null", "double"], {"aliases": ["s_acctbal"]}))
    return through(table(spark, sf_dir, "supplier"), {"recordName": "Supplier"}, readerSchema=reader.replace('"name": "Supplier2"', '"name": "Supplier2", "aliases": ["Supplier"]', 1))


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation")
def ocf_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "nation"), {"recordName": "N"}, readerSchema=record("N", ("n_regionkey", ["null", "int"]), ("n_name", ["null", "string"]), ("n_nationkey", ["null", "int"])))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(p_size AS DOUBLE) AS p_size_d, CAST(p_size AS FLOAT) AS p_size_f FROM part")
def ocf_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_size").alias("p_size_d"), F.col("p_size").alias("p_size_f"))
    return through(df, {"recordName": "N"}, readerSchema=record("N", ("p_partkey", ["null", "long"]), ("p_size", ["null", "long"]), ("p_size_d", ["null", "double"]), ("p_size_f", ["null", "float"])))


@query("SELECT n_nationkey, CAST(octet_length(encode(n_name)) AS INT) AS size, n_name AS back FROM nation")
def ocf_string_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = through(table(spark, sf_dir, "nation"), {"recordName": "N"}, readerSchema=record("N", ("n_nationkey", ["null", "int"]), ("n_name", ["null", "bytes"])))
    again = through(df, {"recordName": "N"}, readerSchema=record("N", ("n_nationkey", ["null", "int"]), ("n_name", ["null", "string"])))
    return df.select("n_nationkey", F.octet_length("n_name").alias("size")).join(again.select("n_nationkey", F.col("n_name").alias("back")), "n_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'O' END AS o_orderstatus FROM orders")
def enum_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    enum = lambda symbols, **more: {"type": "enum", "name": "Status", "symbols": symbols} | more
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return through(df, {"avroSchema": record("O", ("o_orderkey", "long"), ("o_orderstatus", enum(["P", "O", "F"])))}, readerSchema=record("O", ("o_orderkey", "long"), ("o_orderstatus", enum(["F", "O"], default="O"))))


@query("SELECT event_id, event_type = 'click' AS is_click, CASE WHEN event_type = 'click' THEN user_id END AS as_long, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS as_text FROM events")
def union_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """int and string branches read by a union of null, long and string."""
    v = F.struct(F.when(F.col("event_type") == "click", F.col("user_id").cast("int")).alias("member0"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("member1"))
    df = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    got = through(df, {"avroSchema": record("E", ("event_id", "long"), ("v", ["int", "string"]))}, readerSchema=record("E", ("event_id", "long"), ("v", ["null", "long", "string"])))
    return got.select("event_id", F.col("v.member0").isNotNull().alias("is_click"), F.col("v.member0").alias("as_long"), F.col("v.member1").alias("as_text"))


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS n_nationkey, 7 AS version FROM nation")
def resolve_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same resolution as columns, for data that is a DataFrame already."""
    df = table(spark, sf_dir, "nation")
    reader = parse(record("N", ("name", ["null", "string"], {"aliases": ["n_name"]}), ("n_nationkey", ["null", "long"]), ("version", "int", {"default": 7})))
    return df.select(*projection(from_spark(df.schema, "N"), reader))


# Types


@query("SELECT event_id, nullif(event_type, 'click') AS event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events")
def nullable_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return through(df.select("event_id", F.expr("nullif(event_type, 'click')").alias("event_type"), F.expr("case when event_id % 3 = 0 then null else value end").alias("value")))


@query("SELECT event_id, CASE WHEN event_id % 4 = 1 THEN user_id END AS l, CASE WHEN event_id % 4 = 2 THEN value END AS d, CASE WHEN event_id % 4 = 3 THEN event_type END AS s FROM events")
def general_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k, c, n: F.when(F.col("event_id") % 4 == k, F.col(c)).alias(n)
    df = table(spark, sf_dir, "events").select("event_id", F.struct(part(1, "user_id", "member0"), part(2, "value", "member1"), part(3, "event_type", "member2")).alias("v"))
    got = through(df, {"avroSchema": record("E", ("event_id", "long"), ("v", ["null", "long", "double", "string"]))})
    return got.select("event_id", F.col("v.member0").alias("l"), F.col("v.member1").alias("d"), F.col("v.member2").alias("s"))


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def nested_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_custkey").alias("head")).join(lines, "o_orderkey")
    return through(df).select("o_orderkey", F.col("head.o_custkey"), F.explode("lines").alias("x")).select("o_orderkey", "o_custkey", "x.l_linenumber", "x.l_quantity")


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings")
def array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = through(table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", F.size("embedding").cast("long").alias("n"), F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"))


@query("SELECT event_id, event_type AS k, value AS v FROM events UNION ALL SELECT event_id, 'user', CAST(user_id AS DOUBLE) FROM events")
def map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.create_map("event_type", "value", F.lit("user"), F.col("user_id").cast("double")).alias("m"))
    return through(df).select("event_id", F.explode("m").alias("k", "v"))


@query("SELECT r_regionkey, upper(hex(substr(md5(r_name), 1, 4))) AS code FROM region")
def fixed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region").select("r_regionkey", F.encode(F.substring(F.md5("r_name"), 1, 4), "UTF-8").alias("code"))
    got = through(df, {"avroSchema": record("R", ("r_regionkey", "int"), ("code", {"type": "fixed", "name": "Code", "size": 4}))})
    return got.select("r_regionkey", F.hex("code").alias("code"))


@query("SELECT r_regionkey AS id, r_regionkey + 1 AS next, r_regionkey + 2 AS after FROM region")
def recursive_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linked list, written from two levels and read with the recursion expanded twice."""
    node = record("Node", ("id", "int"), ("next", ["null", "Node"]))
    key = F.col("r_regionkey")
    chain = F.struct((key + 2).alias("id"), F.lit(None).cast("string").alias("next"))
    for k in (1, 0):
        chain = F.struct((key + k).alias("id"), chain.alias("next"))
    encoded = table(spark, sf_dir, "region").select(A.to_avro(chain, node).alias("b"))
    return encoded.select(A.from_avro("b", node, recursive_depth=2).alias("v")).select("v.id", F.col("v.next.id").alias("next"), F.col("v.next.next.id").alias("after"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def logical_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")))


@query("SELECT event_id, ts FROM events")
def logical_local_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(table(spark, sf_dir, "events").select("event_id", "ts"))


@query("SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events")
def logical_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("us"))
    kinds = record("E", ("event_id", "long"), ("us", {"type": "long", "logicalType": "timestamp-micros"}), ("ms", {"type": "long", "logicalType": "timestamp-millis"}))
    got = through(df.withColumn("ms", F.col("us")), {"avroSchema": kinds})
    return got.select("event_id", F.unix_micros("us").alias("us"), F.unix_millis("ms").alias("ms"))


@query("SELECT event_id, CAST(event_id % 86400000 AS INT) AS t_ms, event_id * 1000 % 86400000000 AS t_us, event_id * 1000000 AS ns FROM events")
def logical_time_nanos(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 86_400_000).cast("int").alias("t_ms"), (F.col("event_id") * 1000 % 86_400_000_000).alias("t_us"), (F.col("event_id") * 1_000_000).alias("ns"))
    kinds = record("E", ("event_id", "long"), ("t_ms", {"type": "int", "logicalType": "time-millis"}), ("t_us", {"type": "long", "logicalType": "time-micros"}), ("ns", {"type": "long", "logicalType": "timestamp-nanos"}))
    return through(df, {"avroSchema": kinds})


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price, CAST(-CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS owed FROM lineitem")
def logical_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price"), (-price).cast("decimal(12,2)").alias("owed"))
    kinds = record("L", ("l_orderkey", "long"), ("l_linenumber", "int"), ("price", {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}), ("owed", {"type": "fixed", "name": "D", "size": 8, "logicalType": "decimal", "precision": 12, "scale": 2}))
    got = through(df, {"avroSchema": kinds})
    return got.select("l_orderkey", "l_linenumber", F.col("price").cast("double").alias("price"), F.col("owed").cast("double").alias("owed"))


_UUID_SQL = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)".format(h="md5(c_name)")


@query(f"SELECT c_custkey, {_UUID_SQL} AS u, {_UUID_SQL} AS f FROM customer")
def logical_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_UUID_SQL).alias("u"), F.expr(_UUID_SQL).alias("f"))
    kinds = record("C", ("c_custkey", "long"), ("u", {"type": "string", "logicalType": "uuid"}), ("f", {"type": "fixed", "name": "U", "size": 16, "logicalType": "uuid"}))
    return through(df, {"avroSchema": kinds})


@query("SELECT o_orderkey, o_custkey % 12 AS months, o_custkey % 31 AS days, o_orderkey * 10 AS millis FROM orders")
def logical_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.struct((F.col("o_custkey") % 12).alias("months"), (F.col("o_custkey") % 31).alias("days"), (F.col("o_orderkey") * 10).alias("millis"))
    kinds = record("O", ("o_orderkey", "long"), ("d", {"type": "fixed", "name": "D", "size": 12, "logicalType": "duration"}))
    return through(table(spark, sf_dir, "orders").select("o_orderkey", span.alias("d")), {"avroSchema": kinds}).select("o_orderkey", "d.*")


# Column functions


@query("SELECT * FROM customer")
def to_from_avro_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    kind = from_spark(df.schema)
    return df.select(A.to_avro(F.struct(*df.columns), kind).alias("b")).select(A.from_avro("b", kind).alias("v")).select("v.*")


@query("SELECT count(*) AS n, count(CASE WHEN c_custkey % 2 = 0 THEN 1 END) AS readable FROM customer")
def from_avro_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", A.to_avro("c_name", "string").alias("b"))
    cut = df.select(F.when(F.col("c_custkey") % 2 == 0, F.col("b")).otherwise(F.expr("substring(b, 1, 3)")).alias("b"))
    return cut.select(A.from_avro("b", "string", mode="PERMISSIVE").alias("v"), A.avro_is_valid_binary("b", "string").alias("ok")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok") & F.col("v").isNotNull(), 1)).alias("readable"))


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey < 64 THEN 1 ELSE 2 END AS BIGINT) AS key_size, CAST(1 + octet_length(encode(n_name)) AS BIGINT) AS name_size FROM nation")
def encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", A.avro_encoded_size("n_nationkey", "int").alias("key_size"), A.avro_encoded_size("n_name", "string").alias("name_size"))


_SALE = record("S", ("o_orderkey", "long"), ("o_orderstatus", {"type": "enum", "name": "Status", "symbols": ["F", "O"]}))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS ok, CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE '$.o_orderstatus' END AS path FROM orders")
def validate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderkey", "o_orderstatus").alias("r"))
    found = df.select("o_orderkey", A.avro_is_valid("r", _SALE).alias("ok"), A.avro_validation_errors("r", _SALE).alias("e"))
    return found.select("o_orderkey", "ok", F.get("e", F.lit(0))["path"].alias("path"))


@query()
def random_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.avro_random(spark, record("R", ("a", "int"), ("b", ["null", "string"]), ("c", {"type": "array", "items": "double"}), ("d", {"type": "long", "logicalType": "timestamp-micros"})), 1000, 5)


@query("SELECT r_regionkey, upper(md5(r_name)) AS digest FROM region")
def md5_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.hex(A.avro_md5("r_name")).alias("digest"))


# Order


_ORDER = record("O", ("o_orderpriority", "string", {"order": "descending"}), ("o_custkey", "long"), ("o_orderstatus", "string", {"order": "ignore"}), ("o_orderkey", "long"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_custkey, o_orderkey) AS place FROM orders")
def order_asc_desc_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = avro_order_keys(_ORDER)
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


_STATUS = {"type": "enum", "name": "S", "symbols": ["P", "F", "O"]}


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) AS place FROM orders")
def order_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*avro_order_keys(_STATUS, "o_orderstatus"), *avro_order_keys("long", "o_orderkey")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_name < b.n_name THEN -1 WHEN a.n_name > b.n_name THEN 1 ELSE 0 END AS by_name, sign(b.n_nationkey - a.n_nationkey) AS by_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def compare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    kind = record("N", ("k", "int", {"order": "descending"}))
    pairs = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y")), "n_regionkey")
    encoded = pairs.select("a", "b", A.to_avro("x", "string").alias("x"), A.to_avro("y", "string").alias("y"), F.struct(F.col("a").alias("k")).alias("p"), F.struct(F.col("b").alias("k")).alias("q"))
    return encoded.select("a", "b", avro_match("x", "y", "string").alias("by_name"), avro_compare("p", "q", kind).cast("tinyint").alias("by_key"))


# Protocols

PROTOCOL = P.AvroProtocol({
    "protocol": "Events", "namespace": "quillwing.tests",
    "types": [{"type": "record", "name": "Event", "fields": [{"name": "id", "type": "long"}, {"name": "kind", "type": "string"}]}],
    "messages": {
        "describe": {"request": [{"name": "event", "type": "Event"}], "response": "string"},
        "twice": {"request": [{"name": "n", "type": "long"}], "response": "long"},
        "note": {"request": [{"name": "text", "type": "string"}], "response": "null", "one-way": True},
    },
})


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("id"), P.call_id(F.col("event_id")))
    event = F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")).alias("event"))
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return df.select("event_id", F.when(F.col("event_id") % 2 == 0, P.encode_call_request(meta, "describe", event, PROTOCOL)).otherwise(P.encode_call_request(meta, "twice", F.struct(F.col("user_id").alias("n")), PROTOCOL)).alias("request"))


@query("SELECT event_id, event_type AS payload, CAST(4 * (1 + CAST(ceil(octet_length(encode(event_type)) / 3.0) AS INT)) + octet_length(encode(event_type)) AS INT) AS framed, 2 AS messages FROM events")
def frame_unframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", P.avro_frame(F.encode("event_type", "UTF-8"), 3).alias("f"))
    got = df.select("event_id", F.octet_length("f").alias("framed"), P.avro_unframe(F.concat("f", "f")).alias("m"))
    return got.select("event_id", F.decode(F.col("m")[1]["payload"], "UTF-8").alias("payload"), "framed", F.size("m").alias("messages"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'describe' ELSE 'twice' END AS message, false AS is_error, CASE WHEN event_id % 2 = 0 THEN event_id || ' is ' || event_type END AS text, CASE WHEN event_id % 2 = 1 THEN 2 * user_id END AS number, CAST(event_id AS BIGINT) AS call FROM events")
def call_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = PROTOCOL.subprotocol()
    served.on("describe", lambda d: d.withColumn("response", F.concat(F.col("params.event.id").cast("string"), F.lit(" is "), F.col("params.event.kind"))))
    served.on("twice", lambda d: d.withColumn("response", F.col("params.n") * 2))
    answers = P.dispatch(_requests(spark, sf_dir).select("event_id", P.decode_call_envelope("request").alias("envelope")), served)
    got = answers.select("event_id", "message", P.decode_response_envelope("response").alias("r"))
    payload = lambda m: F.when(F.col("message") == m, F.col("r.payload"))
    return got.select("event_id", "message", "r.is_error", A.from_avro(payload("describe"), "string").alias("text"), A.from_avro(payload("twice"), "long").alias("number"), F.conv(F.hex(F.element_at("r.meta", "id")), 16, 10).cast("long").alias("call"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'BOTH' WHEN 1 THEN 'CLIENT' ELSE 'NONE' END AS match, CASE WHEN event_id % 3 = 2 THEN 'retry' ELSE 'proceed' END AS action FROM events")
def handshake_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = F.lit(bytearray(PROTOCOL.md5)), A.avro_md5(F.lit("another"))
    kind = F.col("event_id") % 3
    shake = F.struct(F.when(kind == 2, other).otherwise(own).alias("clientHash"), F.lit(None).cast("string").alias("clientProtocol"), F.when(kind == 1, other).otherwise(own).alias("serverHash"), F.lit(None).cast("map<string,binary>").alias("meta"))
    df = table(spark, sf_dir, "events").select("event_id", P.decode_handshake_request(P.encode_handshake_request(shake)).alias("h"))
    match = P.handshake_match(F.col("h.clientHash"), F.col("h.serverHash"), PROTOCOL.md5, [])
    answer = F.struct(match.alias("match"), F.lit(None).cast("string").alias("serverProtocol"), own.alias("serverHash"), F.lit(None).cast("map<string,binary>").alias("meta"))
    got = df.select("event_id", P.decode_handshake_response(P.encode_handshake_response(answer)).alias("r"))
    return got.select("event_id", "r.match", P.handshake_action(F.col("r.match"), F.lit(False), F.lit(False)).alias("action"))


@query("SELECT user_id AS connection, count(*) AS messages, CAST(sum(octet_length(encode(event_type))) AS BIGINT) AS bytes FROM events GROUP BY user_id")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed messages cut into chunks at odd places, put together again by a stateful stream."""
    df = table(spark, sf_dir, "events").select("user_id", "event_id", P.avro_frame(F.encode("event_type", "UTF-8"), 4).alias("f"))
    halves = F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.expr("substring(f, 1, 5)").alias("data")), F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.expr("substring(f, 6)").alias("data")))
    chunks, source = df.select(F.col("user_id").alias("connection"), F.explode(halves).alias("x")).select("connection", "x.*"), work_path(spark)
    chunks.write.parquet(source)
    got = drained(assemble_frames(spark.readStream.schema(chunks.schema).parquet(source)))
    return got.groupBy("connection").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"))
