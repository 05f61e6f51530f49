"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .pieces import ENCODERS, ChunkedEncoder

#: Rests are cut into pieces of at most a window's so many-th part, so that a window gets several and the sums come out near-equal.
PARTS = 4
#: Windows' worth of rests that one differencing works on.
BLOCK = 96


def karmarkar_karp(sizes: list[int], ways: int) -> list[list[int]]:
    """Split the numbers into ``ways`` sets of near-equal sums; returns each set's indices.

    A partial partition is a list of (sum, set) in descending order. The two
    partial partitions with the largest spreads are merged with opposing
    imbalances: the largest sum of one meets the smallest of the other.
    """
    heap: list = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]  # sets that are empty are left out
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= ways:
            sets = a + b
        else:
            lone_a, lone_b = a[: max(0, ways - len(b))], b[: max(0, ways - len(a))]
            rest_a, rest_b = a[len(lone_a) :], b[len(lone_b) :]
            sets = lone_a + lone_b + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(rest_a, reversed(rest_b), strict=True)]
        sets.sort(key=lambda x: -x[0])
        tie += 1
        heapq.heappush(heap, (-(sets[0][0] - (sets[-1][0] if len(sets) == ways else 0)), tie, sets))
    out = []
    for _, tree in heap[0][2] if heap else []:
        flat, stack = [], [tree]
        while stack:
            x = stack.pop()
            stack.extend(x) if isinstance(x, tuple) else flat.append(x)
        out.append(sorted(flat))
    return out


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number starts at the least possible and rises while one is too full."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = karmarkar_karp(sizes, ways)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return sets
        ways += 1


class Packer:
    """Packs one partition's documents: whole windows at once, rests in blocks of ``BLOCK`` windows' worth."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.rows: list[tuple] = []
        self.rests: list[tuple] = []
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        full = n // cap * cap
        for at in range(0, full, cap):
            self._emit(doc, at, ids[at : at + cap], n, self.next, 0)
            self.next += 1
        part = max(1, cap // PARTS)
        for at in range(full, n, part):
            self.rests.append((doc, at, ids[at : min(at + part, n)], n))
        self.held += n - full
        if self.held >= BLOCK * cap:
            self.flush()

    def _emit(self, doc, at, ids, n, sequence, offset) -> None:
        self.rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset))

    def flush(self) -> None:
        if self.rests:
            for s in windows_for([len(r[2]) for r in self.rests], self.capacity):
                offset = 0
                for doc, at, ids, n in (self.rests[i] for i in s):
                    self._emit(doc, at, ids, n, self.next, offset)
                    offset += len(ids)
                self.next += 1
        self.rests, self.held = [], 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
OUT = ", ".join(f"{x} long" for x in FIELDS)


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, lead: bool = True) -> DataFrame:
    """One row a piece: FIELDS. Every id of every document (its text's ids, then ``end_id``) lies in exactly one piece.

    A document's whole windows stand alone. What is left of it is cut into
    pieces of at most capacity / PARTS; about ``BLOCK`` windows' worth of them are
    spread by differencing. A partition's tasks hold one block of rests and one
    Arrow batch of texts; nothing is shuffled, and a lost task packs its rows again
    alike. Windows are numbered partition * 2^40 + n. Null texts are empty;
    null ids and repeated rows are packed like others. Other columns are ignored.
    ``lead`` says that the tokenizer keeps white space (byte-level) rather than dropping it.
    """
    schema = pa.schema([(x, pa.int64()) for x in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back(ENCODERS)
        encoder, packer = ChunkedEncoder.of(tokenizer_path, lead), Packer(capacity, TaskContext.get().partitionId() << 40)

        def out() -> Iterator[pa.RecordBatch]:
            rows = packer.take()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, counts = encoder.encode(batch.column(1).to_pylist())
                begin = 0
                for doc, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                    packer.add(doc, np.append(ids[begin : begin + n], np.array([end_id], ids.dtype)))
                    begin += n
                yield from out()
        packer.flush()
        yield from out()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT)
