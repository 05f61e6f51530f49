"""Avro protocols as column functions: handshakes, call envelopes, framing, dispatch."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.codec import AvroDataError, value_decoder
from ..plans.resolve import check
from ..plans.schema import MISSING, AvroType, Field, Parser, SchemaError, parse
from .avro import from_avro, to_avro

FRAME_SIZE = 8192
REQUEST_LIMIT = 10 << 20
META = '{"type":"map","values":"bytes"}'

# The schemas of the handshake, as the Avro specification gives them.
HANDSHAKE_REQUEST = json.dumps({
    "type": "record", "name": "HandshakeRequest", "namespace": "org.apache.avro.ipc", "fields": [
        {"name": "clientHash", "type": {"type": "fixed", "name": "MD5", "size": 16}},
        {"name": "clientProtocol", "type": ["null", "string"]},
        {"name": "serverHash", "type": "MD5"},
        {"name": "meta", "type": ["null", {"type": "map", "values": "bytes"}]},
    ],
})
HANDSHAKE_RESPONSE = json.dumps({
    "type": "record", "name": "HandshakeResponse", "namespace": "org.apache.avro.ipc", "fields": [
        {"name": "match", "type": {"type": "enum", "name": "HandshakeMatch", "symbols": ["BOTH", "CLIENT", "NONE"]}},
        {"name": "serverProtocol", "type": ["null", "string"]},
        {"name": "serverHash", "type": ["null", {"type": "fixed", "name": "MD5", "size": 16}]},
        {"name": "meta", "type": ["null", {"type": "map", "values": "bytes"}]},
    ],
})


class Message:
    """One message: a request record, a response, and errors as a union that begins with string."""

    def __init__(self, name: str, spec: dict, parser: Parser, namespace: str):
        self.name, self.one_way, self.doc = name, bool(spec.get("one-way", False)), spec.get("doc")
        if not isinstance(spec.get("request"), list):
            raise SchemaError(f"message {name} needs a request list")
        self.request = parser.parse({"type": "request", "name": name, "fields": spec["request"]}, namespace)
        self.response = parser.parse(spec.get("response", "null"), namespace)
        declared = [e for e in spec.get("errors") or [] if e != "string"]
        self.errors = parser.parse(["string", *declared], namespace)
        if self.one_way and (self.response.kind != "null" or declared):
            raise SchemaError(f"one-way message {name} must return null and declare no errors")


class AvroProtocol:
    """A protocol: named types, messages, and the MD5 of its JSON."""

    def __init__(self, spec: dict, parent: AvroProtocol | None = None):
        if not isinstance(spec.get("protocol"), str) or not spec["protocol"]:
            raise SchemaError("a protocol needs a name")
        self.spec, self.parent = spec, parent
        self.namespace = spec.get("namespace") or spec["protocol"].rpartition(".")[0]
        short = spec["protocol"].rpartition(".")[2]
        self.name = f"{self.namespace}.{short}" if self.namespace else short
        parser = Parser()
        for t in spec.get("types") or []:
            parser.parse(t, self.namespace)
        self.types = dict(parser.registry)
        self.messages = {n: Message(n, m, parser, self.namespace) for n, m in (spec.get("messages") or {}).items()}
        self.handlers: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.remotes: dict[bytes, AvroProtocol] = {}

    @staticmethod
    def parse(spec: Any) -> AvroProtocol:
        return spec if isinstance(spec, AvroProtocol) else AvroProtocol(json.loads(spec) if isinstance(spec, str) else spec)

    def to_json(self) -> str:
        """The protocol's JSON, which its hash is of: not a canonical form, so key order counts."""
        return json.dumps(self.spec, separators=(",", ":"), ensure_ascii=False)

    @property
    def md5(self) -> bytes:
        return hashlib.md5(self.to_json().encode()).digest()  # noqa: S324

    def subprotocol(self) -> AvroProtocol:
        """The same messages with handlers of its own; those it lacks are its parent's."""
        return AvroProtocol(self.spec, self)

    def message(self, name: str) -> Message:
        if name not in self.messages:
            raise SchemaError(f"unknown message {name!r} of protocol {self.name}")
        return self.messages[name]

    def on(self, name: str, handler: Callable[[DataFrame], DataFrame]) -> AvroProtocol:
        """Register what answers a message: a function of a DataFrame with its ``params`` to one with a ``response`` added."""
        self.message(name)
        self.handlers[name] = handler
        return self

    def handler(self, name: str) -> Callable[[DataFrame], DataFrame] | None:
        return self.handlers.get(name) or (self.parent.handler(name) if self.parent else None)

    def add_remote(self, remote: AvroProtocol, side: str = "emitter") -> bytes:
        """Know a remote version by its hash.

        As an emitter we call it: all our messages must exist there and resolve, our
        requests as theirs, their responses and errors as ours. As a listener it calls
        us: of the messages both have, its requests must resolve as ours, our responses and errors as its.
        """
        if side not in ("emitter", "listener"):
            raise ValueError(f"unknown side {side!r}")
        for name, r in remote.messages.items() if side == "listener" else ():
            if m := self.messages.get(name):
                check(_as_named(r.request, m.request.name), m.request)
                check(m.response, r.response)
                check(m.errors, r.errors)
        for name, m in self.messages.items() if side == "emitter" else ():
            if name not in remote.messages:
                raise SchemaError(f"remote protocol {remote.name} lacks message {name!r}")
            r = remote.messages[name]
            check(m.request, _as_named(r.request, m.request.name))
            check(r.response, m.response)
            check(r.errors, m.errors)
        self.remotes[remote.md5] = remote
        return remote.md5


def _as_named(t: AvroType, name: str | None) -> AvroType:
    out = AvroType(t.kind, name=name)
    out.fields = list(t.fields)
    return out


# Handshakes


def encode_handshake_request(col: Column | str) -> Column:
    """A struct (clientHash, clientProtocol, serverHash, meta) as bytes."""
    return to_avro(col, HANDSHAKE_REQUEST)


def decode_handshake_request(col: Column | str) -> Column:
    return from_avro(col, HANDSHAKE_REQUEST)


def encode_handshake_response(col: Column | str) -> Column:
    """A struct (match, serverProtocol, serverHash, meta) as bytes."""
    return to_avro(col, HANDSHAKE_RESPONSE)


def decode_handshake_response(col: Column | str) -> Column:
    return from_avro(col, HANDSHAKE_RESPONSE)


def handshake_match(client_hash: Column, server_hash: Column, own_hash: bytes, known: list[bytes], has_protocol: Column | None = None) -> Column:
    """BOTH, CLIENT or NONE: a known client (or one that sends its protocol) with our hash, with another, or an unknown client."""
    known_client = client_hash.isin([bytearray(h) for h in {own_hash, *known}])
    if has_protocol is not None:
        known_client = known_client | has_protocol
    return F.when(~known_client, "NONE").when(server_hash == F.lit(bytearray(own_hash)), "BOTH").otherwise("CLIENT")


def handshake_action(match: Column, has_error: Column, sent_protocol: Column) -> Column:
    """What a client does with an answer: proceed, retry with its protocol, or fail."""
    return F.when(match != "NONE", "proceed").when(sent_protocol | has_error, "fail").otherwise("retry")


# Calls


def encode_call_request(meta: Column, message: str, params: Column, protocol: AvroProtocol) -> Column:
    """Metadata, message name and request record as one envelope."""
    m = protocol.message(message)
    return F.concat(to_avro(meta, META), to_avro(F.lit(message), "string"), to_avro(params, _record(m.request)))


def _record(t: AvroType) -> AvroType:
    out = AvroType("record", name=t.name, aliases=t.aliases)
    out.fields = [Field(f.name, f.type, f.default if f.default is not MISSING else MISSING, f.order, f.aliases) for f in t.fields]
    return out


def decode_call_envelope(col: Column | str, handshake: str = "none") -> Column:
    """Envelope of a request: struct (handshake, meta, message, params binary).

    ``handshake``: "none", "required", or "optional", which tries to read one and
    takes the bytes as a bare call where that, or the call after it, doesn't parse.
    """
    if handshake not in ("none", "required", "optional"):
        raise ValueError(f"unknown handshake mode {handshake!r}")
    kind = T.StructType([T.StructField("handshake", T.BinaryType()), T.StructField("meta", T.MapType(T.StringType(), T.BinaryType())), T.StructField("message", T.StringType()), T.StructField("params", T.BinaryType())])

    @F.arrow_udf(returnType=kind)
    def decode(data: pa.Array) -> pa.Array:
        shake = value_decoder(parse(HANDSHAKE_REQUEST), whole=False)
        meta, text = value_decoder(parse(META), whole=False), value_decoder(parse("string"), whole=False)

        def call(b: bytes, p: int) -> dict:
            m, p = meta(b, p)
            name, p = text(b, p)
            return {"meta": m, "message": name, "params": b[p:]}

        def one(b: bytes) -> dict:
            if handshake != "none":
                try:
                    _, p = shake(b, 0)
                    return {"handshake": b[:p]} | call(b, p)
                except AvroDataError:
                    if handshake == "required":
                        raise
            return {"handshake": None} | call(b, 0)

        types = pa.struct([("handshake", pa.binary()), ("meta", pa.map_(pa.string(), pa.binary())), ("message", pa.string()), ("params", pa.binary())])
        return pa.array([None if b is None else one(b) for b in data.to_pylist()], types)

    return decode(col)


def decode_call_params(params: Column, message: str, protocol: AvroProtocol, remote: bytes | None = None) -> Column:
    """A request's record; of a remote version (by hash), resolved to ours."""
    m = protocol.message(message)
    if remote is None or remote == protocol.md5:
        return from_avro(params, _record(m.request))
    theirs = protocol.remotes[remote].message(message)
    w = _record(theirs.request)
    w.name = m.request.name
    return from_avro(params, w, _record(m.request))


def encode_call_response(meta: Column, message: str, response: Column, protocol: AvroProtocol, error: Column | None = None) -> Column:
    """Metadata, the error flag, and the response; where ``error`` (a value of the errors union) isn't null, that instead."""
    m = protocol.message(message)
    good = F.concat(to_avro(F.lit(False), "boolean"), to_avro(response, m.response))
    if error is None:
        return F.concat(to_avro(meta, META), good)
    bad = F.concat(to_avro(F.lit(True), "boolean"), to_avro(error, m.errors))
    return F.concat(to_avro(meta, META), F.when(error.isNotNull(), bad).otherwise(good))


def decode_response_envelope(col: Column | str) -> Column:
    """Envelope of a response: struct (meta, is_error, payload binary)."""
    kind = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.BinaryType())), T.StructField("is_error", T.BooleanType()), T.StructField("payload", T.BinaryType())])

    @F.arrow_udf(returnType=kind)
    def decode(data: pa.Array) -> pa.Array:
        meta, flag = value_decoder(parse(META), whole=False), value_decoder(parse("boolean"), whole=False)
        out = []
        for b in data.to_pylist():
            if b is None:
                out.append(None)
                continue
            m, p = meta(b, 0)
            is_error, p = flag(b, p)
            out.append({"meta": m, "is_error": is_error, "payload": b[p:]})
        return pa.array(out, pa.struct([("meta", pa.map_(pa.string(), pa.binary())), ("is_error", pa.bool_()), ("payload", pa.binary())]))

    return decode(col)


def call_id(n: Column) -> Column:
    """A call's number as the metadata value ``id``: four bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


# Framing


def avro_frame(col: Column | str, size: int = FRAME_SIZE) -> Column:
    """Bytes cut into frames of at most ``size``, each after its length (big-endian), then an empty frame. Built-in expressions alone."""
    if size < 1:
        raise ValueError("a frame's size must be positive")
    data = F.col(col) if isinstance(col, str) else col
    n = F.octet_length(data)
    count = F.ceil(n / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def frame(i: Column) -> Column:
        length = F.least(F.lit(size), n - i * size)
        return F.concat(F.unhex(F.lpad(F.hex(length.cast("long")), 8, "0")), F.substring(data, i * size + 1, F.lit(size)))

    body = F.aggregate(F.transform(starts, frame), F.expr("cast(X'' as binary)"), lambda a, x: F.concat(a, x))
    return F.when(data.isNotNull(), F.concat(body, F.expr("X'00000000'")))


def unframe_bytes(data: bytes, at: int = 0, limit: int = REQUEST_LIMIT) -> tuple[bytes, int] | None:
    """The message whose frames begin at ``at`` and where the next begins; None where it isn't complete."""
    out = bytearray()
    while at + 4 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if len(out) + n > limit:
            raise AvroDataError(f"a message of more than {limit} bytes")
        if at + 4 + n > len(data):
            return None
        at += 4
        if n == 0:
            return bytes(out), at
        out += data[at : at + n]
        at += n
    return None


def avro_unframe(col: Column | str, limit: int = REQUEST_LIMIT) -> Column:
    """All complete messages in framed bytes: array of struct (payload, next_offset); explode it for a row each. An incomplete end is left out."""
    kind = T.ArrayType(T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("next_offset", T.IntegerType())]))

    @F.arrow_udf(returnType=kind)
    def unframe(data: pa.Array) -> pa.Array:
        out = []
        for b in data.to_pylist():
            found, at = [], 0
            while b is not None and (x := unframe_bytes(b, at, limit)):
                at = x[1]
                found.append({"payload": x[0], "next_offset": at})
            out.append(None if b is None else found)
        return pa.array(out, pa.list_(pa.struct([("payload", pa.binary()), ("next_offset", pa.int32())])))

    return unframe(col)


# Dispatch


def dispatch(requests: DataFrame, protocol: AvroProtocol, envelope_col: str = "envelope", remote: bytes | None = None) -> DataFrame:
    """Answer a DataFrame of decoded envelopes (see ``decode_call_envelope``): the other columns, message, and the response envelope.

    Each message with a handler is one branch of the plan: its rows, their decoded
    params, the handler's DataFrame, the encoded response. A handler may add a column
    ``error`` (of the message's errors union); rows where it isn't null are
    answered by it. Messages without a handler get an error of the string branch.
    ``remote`` is the hash of the version that the requests are written in, where it isn't ours.
    """
    keep = [c for c in requests.columns if c != envelope_col]
    flat = requests.select(*keep, F.col(f"{envelope_col}.meta").alias("meta"), F.col(f"{envelope_col}.message").alias("message"), F.col(f"{envelope_col}.params").alias("_params"))
    theirs = protocol if remote is None or remote == protocol.md5 else protocol.remotes[remote]
    handled = [n for n in protocol.messages if protocol.handler(n) and n in theirs.messages]
    out = None
    for name in handled:
        rows = flat.where(F.col("message") == name).withColumn("params", decode_call_params(F.col("_params"), name, protocol, remote))
        answered = protocol.handler(name)(rows)
        error = F.col("error") if "error" in answered.columns and "error" not in rows.columns else None
        part = answered.select(*keep, "message", encode_call_response(F.col("meta"), name, F.col("response"), protocol, error).alias("response"))
        out = part if out is None else out.unionByName(part)
    text = F.concat(F.lit("no handler for message "), F.coalesce("message", F.lit("null")))
    rest = flat.where(~F.coalesce(F.col("message").isin(handled) if handled else F.lit(False), F.lit(False)))
    missing = rest.select(*keep, "message", F.concat(to_avro(F.col("meta"), META), F.expr("X'01'"), F.expr("X'00'"), to_avro(text, "string")).alias("response"))
    return missing if out is None else out.unionByName(missing)
