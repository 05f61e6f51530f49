"""Token ids in binary shards with a minimal perfect hash index from document keys to payload offsets."""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes
from .pieces import ChunkedEncoder

MAGIC = b"QWIDX1\n"
#: Slots a key, at each level of the hash; higher is faster to look up and larger.
GAMMA = 1.7
LEVELS = 24


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over int64 keys (uint64 out)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: cascaded bit arrays with ranks.

    At each level a key has one slot; slots that one key alone claims are set,
    the other keys go on to the next level. A key's number is the count of set
    bits before its bit. Keys that no level settles lie sorted in ``rest``.
    ``fingerprints`` (32 bits, by number) tell other keys apart.
    """

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray, fingerprints: np.ndarray):
        self.bits, self.rest, self.fingerprints = bits, rest, fingerprints
        sums = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.base = sums[:-1]
        self.ranks = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in bits]
        self.settled = int(sums[-1])

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        left, bits = np.unique(keys.astype(np.int64)), []
        found = left
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * GAMMA))
            slot = (mix(left, level) % np.uint64(size)).astype(np.int64)
            once = np.bincount(slot, minlength=size) == 1
            bits.append(once)
            left = left[~once[slot]]
        out = PerfectHash(bits, left, np.zeros(len(found), np.uint32))
        out.fingerprints[out.number(found)] = out.fingerprint(found)
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 977) >> np.uint64(32)).astype(np.uint32)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, without a check that they are known."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            slot = (mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[slot]
            out[open_[hit]] = self.base[level] + self.ranks[level][slot[hit]]
            open_ = open_[~hit]
        if len(self.rest):
            out[open_] = self.settled + np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for a key whose fingerprint isn't the stored one."""
        out = self.number(keys)
        known = out >= 0
        known[known] = self.fingerprints[out[known]] == self.fingerprint(keys[known])
        return np.where(known, out, -1)


def pack_arrays(head: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """MAGIC, length of a JSON header (uint32, little-endian), the header, then the arrays' raw bytes."""
    body = [np.ascontiguousarray(x) for x in arrays.values()]
    head = head | {"arrays": [[k, x.dtype.str, len(x)] for k, x in zip(arrays, body, strict=True)]}
    text = json.dumps(head).encode()
    return MAGIC + len(text).to_bytes(4, "little") + text + b"".join(x.tobytes() for x in body)


def unpack_arrays(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an index file: wrong magic")
    at = len(MAGIC) + 4
    size = int.from_bytes(data[at - 4 : at], "little")
    head, at, out = json.loads(data[at : at + size]), at + size, {}
    for name, kind, n in head["arrays"]:
        out[name] = np.frombuffer(data, np.dtype(kind), n, at)
        at += out[name].nbytes
    return head, out


class Shard:
    """One shard's index, and its payload if given. ``get`` gives the ids of every document under a key in constant time."""

    def __init__(self, index: bytes, payload: bytes | None):
        self.head, a = unpack_arrays(index)
        self.ids = np.frombuffer(payload or b"", self.head["dtype"])
        if payload is not None and len(self.ids) != self.head["n_ids"]:
            raise ValueError("the payload's length isn't the index's")
        self.keys, self.null, self.offsets, self.first, self.copies = a["keys"], a["null"], a["offsets"], a["first"], a["copies"]
        sizes = self.head["levels"]
        cuts = np.cumsum([0, *sizes])
        bits = np.unpackbits(a["bits"], count=int(cuts[-1])).astype(bool)
        self.hash = PerfectHash([bits[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], a["rest"], a["fingerprints"])

    @staticmethod
    def index(keys: np.ndarray, null: np.ndarray, offsets: np.ndarray, dtype: str) -> bytes:
        known = keys[~null]
        h = PerfectHash.build(known)
        distinct, first, copies = np.unique(known, return_index=True, return_counts=True)
        number = h.number(distinct)
        by, n = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
        by[number], n[number] = first + int(null.sum()), copies
        head = {"dtype": dtype, "n_docs": len(keys), "n_ids": int(offsets[-1]), "levels": [len(b) for b in h.bits]}
        bits = np.packbits(np.concatenate([np.zeros(0, bool), *h.bits]))
        return pack_arrays(head, {"keys": keys, "null": null, "offsets": offsets, "first": by, "copies": n, "bits": bits, "rest": h.rest, "fingerprints": h.fingerprints})

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Position of the first document under each key; -1 where there is none."""
        number = self.hash.lookup(keys)
        return np.where(number >= 0, self.first[np.maximum(number, 0)].astype(np.int64) if len(self.first) else -1, -1)

    def get(self, key: int) -> list[np.ndarray]:
        number = int(self.hash.lookup(np.array([key], np.int64))[0])
        if number < 0:
            return []
        at = int(self.first[number])
        return [self.ids[self.offsets[i] : self.offsets[i + 1]] for i in range(at, at + int(self.copies[number]))]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", lead: bool = False, shard_bytes: int = 16 << 20) -> str:
    """Write shards of about ``shard_bytes`` of text in ascending id order below ``path``, a folder all executors see; returns the manifest's URI.

    A shard is two files: raw little-endian ids, and the index. Range
    partitioning orders the shards; a task streams its texts into its payload
    and keeps one key and one offset a document. A task writes under names of
    its own attempt and reports them, so a lost or repeated task leaves only
    files that no manifest names. The driver gets one row a shard. Null ids come
    first, unkeyed; rows that repeat an id lie side by side under one key, in
    the texts' order. Null texts are empty. Other columns are ignored. The
    manifest has each shard's range of keys, for ``TokenFiles``.
    """
    count = max(1, -(-text_bytes(df, text_col)[1] // shard_bytes))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.repartitionByRange(count, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = ChunkedEncoder.of(tokenizer_path, lead)
        dtype = encoder.pool.dtype.newbyteorder("<")
        part = TaskContext.get().partitionId()
        name, (store, root) = f"{part:06d}-{uuid.uuid4().hex}", _store(path)
        store.create_dir(root, recursive=True)
        keys, null, sizes = [], [], []
        with store.open_output_stream(f"{root}/{name}.ids") as out:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    ids, counts = encoder.encode(batch.column(1).to_pylist())
                    ends = np.cumsum(counts)
                    out.write(np.insert(ids, ends, end_id).astype(dtype).tobytes())
                    null.append(np.asarray(batch.column(0).is_null()))
                    keys.append(np.asarray(batch.column(0).fill_null(0)))
                    sizes.append(counts + 1)
        if not keys:
            store.delete_file(f"{root}/{name}.ids")
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(Shard.index(np.concatenate(keys), np.concatenate(null), offsets, dtype.str))
        keyed = np.concatenate(keys)[~np.concatenate(null)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, name, len(offsets) - 1, int(offsets[-1]), *((keyed[0], keyed[-1]) if len(keyed) else (None, None))), kinds, strict=True)], names)

    names, kinds = ["part", "name", "n_docs", "n_ids", "low", "high"], [pa.int64(), pa.string(), *[pa.int64()] * 4]
    rows = sorted(docs.mapInArrow(run, "part long, name string, n_docs long, n_ids long, low long, high long").collect(), key=lambda r: r[0])
    shards, start = [], 0
    for _, name, n_docs, n_ids, low, high in rows:
        shards.append({"name": name, "start": start, "n_docs": n_docs, "n_ids": n_ids, "low": low, "high": high})
        start += n_ids
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"shards": shards, "end_id": end_id}).encode())
    return f"{path}/manifest.json"


def read_manifest(path: str) -> dict:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def open_shard(path: str, name: str) -> Shard:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/{name}.idx") as i, store.open_input_stream(f"{root}/{name}.ids") as p:
        return Shard(i.read(), p.read())


class TokenFiles:
    """Keyed access over all shards below ``path``.

    Shards hold contiguous ranges of keys, so the manifest's ranges name the one
    shard that may have a key (a binary search in memory), its perfect hash the
    place there: one lookup opens one index, kept for ``kept`` shards, and reads
    one stretch of one payload, whatever the number of documents.
    """

    def __init__(self, path: str, kept: int = 16):
        self.path, self.kept = path, kept
        self.shards = [s for s in read_manifest(path)["shards"] if s["low"] is not None]
        self.highs = [s["high"] for s in self.shards]
        self.opened: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document under ``key``, in the files' order; none if no document has it."""
        at = bisect.bisect_left(self.highs, key)
        if at == len(self.shards) or key < self.shards[at]["low"]:
            return []
        name = self.shards[at]["name"]
        store, root = _store(self.path)
        if name not in self.opened:
            while len(self.opened) >= self.kept:
                self.opened.pop(next(iter(self.opened)))
            with store.open_input_stream(f"{root}/{name}.idx") as f:
                self.opened[name] = Shard(f.read(), None)
        shard = self.opened[name]
        place = int(shard.places(np.array([key], np.int64))[0])
        if place < 0 or int(shard.keys[place]) != key:
            return []
        last = int(np.searchsorted(shard.keys, key, "right")) if place + 1 < len(shard.keys) and shard.keys[place + 1] == key else place + 1
        begin, end = int(shard.offsets[place]), int(shard.offsets[last])
        kind = np.dtype(shard.head["dtype"])
        with store.open_input_file(f"{root}/{name}.ids") as f:
            ids = np.frombuffer(f.read_at((end - begin) * kind.itemsize, begin * kind.itemsize), kind)
        return [ids[a - begin : b - begin] for a, b in zip(shard.offsets[place:last], shard.offsets[place + 1 : last + 1], strict=True)]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32: every document, found by its key through the index and checked against the payload.

    One task a shard; each holds one shard.
    """
    shards = [(s["name"], s["start"]) for s in read_manifest(path)["shards"]]
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = open_shard(path, name)
                n = len(s.keys)
                at = np.arange(n)
                keyed = ~s.null
                place = s.places(s.keys[keyed])
                if (place < 0).any():
                    raise ValueError(f"{name}: the index misses a key")
                at[keyed] = place + np.arange(n)[keyed] - int(s.null.sum()) - np.searchsorted(s.keys[keyed], s.keys[keyed])
                begin, end = s.offsets[at], s.offsets[at + 1]
                crc = [zlib.crc32(s.ids[x:y].astype("<u4").tobytes()) for x, y in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys, mask=s.null), pa.array(begin + start), pa.array(end - begin), pa.array(crc, pa.int64())], schema=schema)

    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return spark.createDataFrame(shards, "name string, start long").repartition(len(shards)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
