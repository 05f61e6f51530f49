"""The codec in numpy for flat records: a whole batch of rows is encoded, or many blocks are decoded side by side.

Flat means a record of booleans, numbers, strings, bytes and enums (with date and
timestamp logical types), each also as a union with null. Other schemas take the
generated code of ``codec``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.resolve import field_pairs
from ..plans.schema import AvroType
from .codec import AvroDataError

NUMBERS = {"boolean": np.bool_, "int": np.int32, "long": np.int64, "float": np.float32, "double": np.float64}
MILLIS = ("timestamp-millis", "local-timestamp-millis")
#: Logical types that are their underlying number, or that Arrow casts to it.
PLAIN = (None, "date", "timestamp-micros", "local-timestamp-micros", "timestamp-nanos", "local-timestamp-nanos", *MILLIS)
#: Blocks to decode side by side; with fewer, the generated code is as fast.
LANES = 16


def is_flat(t: AvroType) -> bool:
    def plain(x: AvroType) -> bool:
        x = x.nullable_of or x
        return (x.kind in NUMBERS and x.logical in PLAIN) or (x.kind in ("string", "bytes", "enum") and x.logical is None)

    return t.is_record and bool(t.fields) and all(plain(f.type) for f in t.fields)


# Encoding


def zigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def varint_sizes(n: np.ndarray) -> np.ndarray:
    out = np.ones(len(n), np.int64)
    for k in range(1, 10):
        more = n >= np.uint64(1 << (7 * k))
        if not more.any():
            break
        out += more
    return out


def put_varints(out: np.ndarray, at: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> None:
    """Write each number's bytes from its place on."""
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = np.flatnonzero(sizes > k)
        low = (n[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[some] + k] = (low | np.where(sizes[some] > k + 1, np.uint64(128), np.uint64(0))).astype(np.uint8)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run of its size, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _valid(a: pa.Array) -> np.ndarray:
    return np.asarray(a.is_valid())


def encode_rows(t: AvroType, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, and where each row ends. Columns are in the order of the fields."""
    rows = len(columns[0])
    parts = []  # per field: branch (or None), what is written, sizes
    for f, a in zip(t.fields, columns, strict=True):
        valid, x = _valid(a), f.type.nullable_of or f.type
        if f.type.nullable_of is None and not valid.all():
            raise AvroDataError(f"null is no value of {x.branch_name}")
        branch = np.where(valid, f.type.branches.index(x), 1 - f.type.branches.index(x)).astype(np.uint8) * 2 if f.type.nullable_of is not None else None
        if x.kind in ("string", "bytes"):
            a = a.cast(pa.large_binary())
            offsets = np.frombuffer(a.buffers()[1], np.int64, rows + 1, a.offset * 8) if rows else np.zeros(1, np.int64)
            data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
            size = np.where(valid, np.diff(offsets), 0)
            n = zigzag(size)
            parts.append((branch, valid, "text", n, varint_sizes(n), (data, offsets[:-1], size)))
            continue
        if x.kind == "enum":
            codes = pc.index_in(a.cast(pa.string()), value_set=pa.array(x.symbols, pa.string()))
            if codes.null_count > a.null_count:
                raise AvroDataError("no symbol of the enum")
            v = np.asarray(codes.fill_null(0)).astype(np.int64)
        elif x.kind == "boolean":
            v = np.asarray(a.cast(pa.uint8()).fill_null(0))
        else:
            if pa.types.is_timestamp(a.type):
                a = a.cast(pa.timestamp("us", a.type.tz)).cast(pa.int64())
            elif pa.types.is_date32(a.type):
                a = a.cast(pa.int32())
            v = np.asarray(a.cast(pa.from_numpy_dtype(NUMBERS[x.kind])).fill_null(0))
        if x.kind in ("int", "long", "enum"):
            n = zigzag(v // 1000 if x.logical in MILLIS else v)
            parts.append((branch, valid, "number", n, varint_sizes(n), None))
        else:
            raw = v if x.kind == "boolean" else v.astype("<f4" if x.kind == "float" else "<f8")
            width = raw.dtype.itemsize
            parts.append((branch, valid, "fixed", raw.view(np.uint8).reshape(rows, width), np.full(rows, width), None))
    total = np.zeros(rows, np.int64)
    for branch, valid, _, _, sizes, text in parts:
        total += (branch is not None) + np.where(valid, sizes + (text[2] if text else 0), 0)
    ends = np.cumsum(total)
    out, at = np.zeros(int(ends[-1]) if rows else 0, np.uint8), ends - total
    for branch, valid, kind, n, sizes, text in parts:
        if branch is not None:
            out[at] = branch
            at = at + 1
        some = slice(None) if valid.all() else np.flatnonzero(valid)
        if kind == "fixed":
            for k in range(n.shape[1]):
                out[at[some] + k] = n[some, k]
        else:
            put_varints(out, at[some], n[some], sizes[some])
        at = at + np.where(valid, sizes, 0)
        if text:
            data, starts, size = text
            out[spread(at, size)] = data[spread(starts, size)]
            at = at + size
    return out, ends


# Decoding


class Lanes:
    """Positions in many blocks at once, longest block first; every read moves lanes on. ``some`` is a slice or an index array."""

    def __init__(self, blocks: list[bytes], order: np.ndarray):
        sizes = np.array([len(b) for b in blocks], np.int64)
        self.data = np.frombuffer(b"".join(blocks) + bytes(32), np.uint8)
        self.last = len(self.data) - 16
        self.ends = np.cumsum(sizes)[order]
        self.at = self.ends - sizes[order]

    def varint(self, some: slice | np.ndarray) -> np.ndarray:
        """The next varint of the lanes, as zigzag decoded longs."""
        p = np.array(self.at[some])  # not a view: the lanes move on below
        b = self.data[p]
        n = (b & 127).astype(np.uint64)
        more = np.flatnonzero(b > 127)
        self.at[some] += 1
        if len(more):
            step, k = np.zeros(len(p), np.int64), 1
            while len(more):
                if k == 10:
                    raise AvroDataError("varint too long")
                b = self.data[p[more] + k]
                n[more] |= (b & 127).astype(np.uint64) << np.uint64(7 * k)
                step[more] = k
                more, k = more[b > 127], k + 1
            self.at[some] += step
        return (n >> np.uint64(1)).view(np.int64) ^ -(n & np.uint64(1)).view(np.int64)


def side_by_side(counts: list[int]) -> bool:
    """Whether the blocks are many enough, and alike enough, to be decoded at once."""
    return len(counts) >= LANES and max(counts) * len(counts) <= 4 * sum(counts)


def decode_blocks(w: AvroType, r: AvroType, counts: list[int], blocks: list[bytes], kinds: pa.Schema) -> pa.RecordBatch:
    """All records of the blocks in order, as the reader's columns. Both schemas are flat, and ``r`` takes ``w``'s fields with their types."""
    pairs = {f.name: f.name for f in w.fields} if w is r else field_pairs(w, r)
    count = np.array(counts, np.int64)
    order = np.argsort(-count, kind="stable")
    lanes, sizes, most = Lanes(blocks, order), count[order], int(count.max()) if len(count) else 0
    still_open = np.searchsorted(-sizes, -np.arange(most), "left").tolist()
    store = {}
    for f in w.fields:
        x = f.type.nullable_of or f.type
        kind = np.int64 if x.kind in ("int", "long", "enum", "string", "bytes") else NUMBERS[x.kind]
        text = x.kind in ("string", "bytes")
        store[f.name] = (np.ones((most, len(count)), bool), np.zeros((most, len(count)), kind), np.zeros((most, len(count)), np.int64) if text else None) if f.name in pairs else None
    for step, n_open in enumerate(still_open):
        live = slice(0, n_open)
        for f in w.fields:
            x, some, slot = f.type.nullable_of or f.type, live, store[f.name]
            if f.type.nullable_of is not None:
                mine = f.type.branches.index(x)
                b = lanes.data[lanes.at[live]]
                if (b == 2 * mine).all():
                    lanes.at[live] += 1
                else:
                    branch = lanes.varint(live)
                    if ((branch < 0) | (branch > 1)).any():
                        raise AvroDataError("invalid union index")
                    some = np.flatnonzero(branch == mine)
                    if slot is not None:
                        slot[0][step, np.flatnonzero(branch != mine)] = False
            if x.kind in ("int", "long", "enum"):
                v = lanes.varint(some)
                if slot is not None:
                    slot[1][step, some] = v
            elif x.kind in ("string", "bytes"):
                size = lanes.varint(some)
                if (size < 0).any():
                    raise AvroDataError("negative length")
                if slot is not None:
                    slot[1][step, some], slot[2][step, some] = lanes.at[some], size
                lanes.at[some] += size
                if (lanes.at > lanes.last).any():
                    raise AvroDataError("Insufficient data for type")
            else:
                width = np.dtype(NUMBERS[x.kind]).itemsize
                if slot is not None:
                    raw = lanes.data[lanes.at[some][:, None] + np.arange(width)]
                    slot[1][step, some] = raw[:, 0] != 0 if width == 1 else raw.view("<f4" if width == 4 else "<f8")[:, 0]
                lanes.at[some] += width
            if (lanes.at[live] > lanes.ends[live]).any():
                raise AvroDataError("Insufficient data for type")
    if (lanes.at != lanes.ends).any():
        raise AvroDataError("data after the last record")
    names = {v: k for k, v in pairs.items()}
    back = np.argsort(order, kind="stable")
    real = (np.arange(most)[None, :] < count[:, None]).ravel()
    in_order = lambda x: None if x is None else np.ascontiguousarray(x[:, back].T).ravel()[real]
    columns = []
    for i, f in enumerate(r.fields):
        slot = store.pop(names[f.name])
        columns.append(_column(w.field(names[f.name]).type, tuple(map(in_order, slot)), lanes.data, kinds.field(i).type))
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


def _column(t: AvroType, slot: tuple, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    valid, v, size = slot
    x, mask = t.nullable_of or t, None if valid.all() else ~valid
    if x.kind in ("string", "bytes"):
        offsets = np.concatenate([[0], np.cumsum(size)])
        body = pa.py_buffer(data[spread(v, size)].tobytes())
        bits = None if mask is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        raw = pa.Array.from_buffers(pa.large_binary(), len(v), [bits, pa.py_buffer(offsets.astype(np.int64).tobytes()), body])
        if x.kind == "bytes":
            return raw.cast(kind)
        try:
            return raw.cast(pa.large_string()).cast(kind)
        except pa.ArrowInvalid:  # bytes that are no UTF-8 become U+FFFD
            return pa.array([None if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()], kind)
    if x.kind == "enum":
        if ((v < 0) | (v >= len(x.symbols)))[valid].any():
            raise AvroDataError("invalid enum index")
        return pa.array(x.symbols, pa.string()).take(pa.array(v, mask=mask)).cast(kind)
    if x.kind == "int":
        if ((v < -(1 << 31)) | (v >= 1 << 31)).any():
            raise AvroDataError("varint too long for an int")
        v = v.astype(np.int32)
    if x.logical in MILLIS:
        v = v * 1000
    out = pa.array(v, mask=mask)
    return out if out.type == kind else out.cast(pa.int64()).cast(kind) if pa.types.is_timestamp(kind) else out.cast(kind)
