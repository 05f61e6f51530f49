"""Object container files: header, blocks, block codecs, and splitting at sync markers."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

from pyarrow import fs

from ..operators.codec import AvroDataError, read_varint, value_decoder, varint
from ..plans.schema import AvroType, parse

MAGIC = b"Obj\x01"
SYNC_SIZE = 16
META = parse({"type": "map", "values": "bytes"})
BLOCK_SIZE = 64_000

Codec = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]


def _deflate(data: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data, wbits=-15)
    except zlib.error as e:
        raise AvroDataError(f"corrupt deflate block: {e}") from e


#: Codecs by name: (encode, decode). Those of the format can't be replaced.
BUILT_IN: dict[str, Codec] = {"null": (lambda b: b, lambda b: b), "deflate": (_deflate, _inflate)}
_custom: dict[str, Codec] = {}
_transforms: dict[str, Codec] = {}


def register_codec(name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> None:
    """Make a block codec known to sources and sinks that this driver creates from now on; both functions are shipped to the tasks."""
    if name in BUILT_IN:
        raise ValueError(f"the built-in codec {name!r} can't be replaced")
    _custom[name] = (encode, decode)


def register_transform(name: str, outward: Callable[[bytes], bytes], inward: Callable[[bytes], bytes]) -> None:
    """A transformation of whole files' bytes, for ``byteTransform``: outward when written, inward when read. Such files aren't split."""
    _transforms[name] = (outward, inward)


def codecs() -> dict[str, Codec]:
    return BUILT_IN | _custom


def transforms() -> dict[str, Codec]:
    return dict(_transforms)


@dataclass
class Header:
    meta: dict[str, bytes]
    sync: bytes
    end: int

    @property
    def codec(self) -> str:
        return self.meta.get("avro.codec", b"").decode() or "null"

    @property
    def schema(self) -> AvroType:
        return parse(json.loads(self.meta["avro.schema"]))


def read_header(f: BinaryIO) -> Header:
    """The header at the file's start."""
    data, step = b"", 1 << 14
    while True:
        more = f.read(step)
        data += more
        if data[: len(MAGIC)] != MAGIC[: len(data)] or len(data) < len(MAGIC):
            raise AvroDataError("Invalid AVRO file: incorrect magic bytes")
        try:
            pairs, at = value_decoder(META, whole=False)(data, len(MAGIC))
            if at + SYNC_SIZE <= len(data):
                break
        except AvroDataError:
            pass
        if not more:
            raise AvroDataError("Invalid AVRO file: truncated header")
        step *= 2
    meta = dict(pairs)
    if not meta.get("avro.schema"):
        raise AvroDataError("Invalid AVRO file: no avro.schema in the header")
    return Header(meta, data[at : at + SYNC_SIZE], at + SYNC_SIZE)


def header_bytes(schema: str, codec: str, sync: bytes, meta: dict[str, bytes]) -> bytes:
    """A header; ``avro.codec`` is written only where it isn't null."""
    entries = {"avro.schema": schema.encode()} | ({"avro.codec": codec.encode()} if codec != "null" else {}) | meta
    out = bytearray(MAGIC) + varint(len(entries))
    for k, v in entries.items():
        out += varint(len(k.encode())) + k.encode() + varint(len(v)) + v
    return bytes(out + b"\x00" + sync)


def check_meta(meta: dict[str, bytes]) -> dict[str, bytes]:
    for k in meta:
        if not k or k in ("avro.schema", "avro.codec"):
            raise ValueError(f"metadata key not allowed: {k!r}")
    return meta


class Window:
    """Bytes of a file around a position, read in large steps."""

    def __init__(self, f: BinaryIO, size: int, at: int, step: int = 1 << 20):
        self.f, self.size, self.at, self.data, self.step = f, size, at, b"", step

    def need(self, pos: int, n: int) -> bytes:
        """n bytes at pos, fewer at the file's end."""
        if pos < self.at or pos + n > self.at + len(self.data):
            self.f.seek(pos)
            self.at, self.data = pos, self.f.read(max(n, min(self.step, self.size - pos)))
        return self.data[pos - self.at : pos - self.at + n]

    def find(self, what: bytes, pos: int) -> int:
        """The first occurrence at or after pos, or -1."""
        while pos < self.size:
            part = self.need(pos, min(self.step, self.size - pos))
            i = part.find(what)
            if i >= 0:
                return pos + i
            pos += max(1, len(part) - len(what) + 1) if pos + len(part) < self.size else self.size
        return -1


def blocks(f: BinaryIO, size: int, header: Header, start: int = 0, end: int | None = None, verify: bool = True, probe: Callable[[int, bytes], bool] | None = None) -> Iterator[tuple[int, bytes]]:
    """(records, raw block) of every block whose preceding sync marker begins in [start, end).

    A range that begins inside the file looks for the next marker; bytes in a
    block that look like one aren't followed by a chain of blocks, the first of which
    decodes (``probe``), and are passed over.
    """
    end = size if end is None else end
    w = Window(f, size, 0)
    first = header.end - SYNC_SIZE
    mark = first if start <= first else w.find(header.sync, start)
    while start > first and 0 <= mark < end and not _chained(w, size, header.sync, mark, probe):
        mark = w.find(header.sync, mark + 1)
    while 0 <= mark < end and mark + SYNC_SIZE < size:
        count, at, length = _block(w, size, mark)
        body = w.need(at, length + SYNC_SIZE)
        if verify and body[length:] != header.sync:
            raise AvroDataError("a block's sync marker isn't the file's")
        yield count, body[:length]
        mark = at + length


#: Blocks in a row that must fit before a marker in mid-file is believed.
CHAIN = 4


def _block(w: Window, size: int, mark: int) -> tuple[int, int, int]:
    """Records, data position and data length of the block after a marker."""
    try:
        head = w.need(mark + SYNC_SIZE, 20)
        count, i = read_varint(head, 0)
        length, i = read_varint(head, i)
    except IndexError as e:
        raise AvroDataError("truncated block") from e
    at = mark + SYNC_SIZE + i
    if count < 0 or length < 0 or at + length + SYNC_SIZE > size:
        raise AvroDataError("truncated or corrupt block")
    return count, at, length


def _chained(w: Window, size: int, sync: bytes, mark: int, probe: Callable[[int, bytes], bool] | None) -> bool:
    """Whether the bytes after a marker are blocks, each with its own marker: up to CHAIN of them, or to the file's end."""
    for _ in range(CHAIN):
        if mark + SYNC_SIZE == size:
            return True
        try:
            count, at, length = _block(w, size, mark)
        except AvroDataError:
            return False
        mark = at + length
        if w.need(mark, SYNC_SIZE) != sync or (probe is not None and not probe(count, w.need(at, length))):
            return False
        probe = None
    return True


class BlockWriter:
    """Collects encoded records and writes a block when they come to ``block_size`` bytes."""

    def __init__(self, out: BinaryIO, schema: str, codec: str, encode: Callable[[bytes], bytes], sync: bytes, meta: dict[str, bytes], block_size: int = BLOCK_SIZE):
        self.out, self.encode, self.sync, self.block_size = out, encode, sync, block_size
        self.buffer, self.count, self.closed = bytearray(), 0, False
        out.write(header_bytes(schema, codec, sync, meta))

    def record(self) -> None:
        """Count the record that was just put in ``buffer``."""
        self.count += 1
        if len(self.buffer) >= self.block_size:
            self.flush()

    def records(self, body: Any, ends: Any) -> None:
        """Take many encoded records: a numpy array of bytes, and where each record ends in it."""
        import numpy as np

        start = row = 0
        while row < len(ends):
            # The records that fill the block: up to the first end at or beyond its size.
            last = int(np.searchsorted(ends, start + self.block_size - len(self.buffer), "left"))
            upto = min(last, len(ends) - 1)
            self.buffer += body[start : ends[upto]].tobytes()
            self.count += upto + 1 - row
            start, row = int(ends[upto]), upto + 1
            if len(self.buffer) >= self.block_size:
                self.flush()

    def flush(self) -> None:
        if self.closed:
            raise ValueError("the writer is closed")
        if self.count:
            body = self.encode(bytes(self.buffer))
            self.out.write(varint(self.count) + varint(len(body)) + body + self.sync)
            self.buffer.clear()
            self.count = 0

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.closed = True


# Files


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in uri or uri.startswith("file:/"):
        return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
    return fs.LocalFileSystem(), os.path.abspath(uri)


def is_http(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def list_files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of a file, of a folder's files (hidden ones and those that start with _ left out), of a glob's, or of a URL (size -1)."""
    import fnmatch

    if is_http(path):
        return [(path, -1)]
    s, p = store(path)
    prefix = path[: len(path) - len(p)] if path.endswith(p) and path != p else ""
    if any(c in p for c in "*?["):
        base = p[: min(p.index(c) for c in "*?[" if c in p)].rpartition("/")[0]
        found = [x for x in s.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if fnmatch.fnmatch(x.path, p)]
    else:
        info = s.get_file_info(p)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such file or folder: {path}")
        found = [info] if info.type == fs.FileType.File else s.get_file_info(fs.FileSelector(p, recursive=True))
    base = p.rstrip("/")
    visible = [x for x in found if x.type == fs.FileType.File and not any(n[:1] in "._" for n in x.path.removeprefix(base).split("/") if n)]
    return sorted((prefix + x.path, x.size) for x in visible)


def open_input(path: str, transform: Codec | None = None) -> tuple[Any, int]:
    """A seekable file and its size; URLs and transformed files are read whole."""
    import io

    if is_http(path):
        from urllib.request import urlopen

        with urlopen(path) as r:  # noqa: S310
            if not 200 <= r.status < 300:
                raise OSError(f"{path}: HTTP status {r.status}")
            data = r.read()
    elif transform is None:
        s, p = store(path)
        return s.open_input_file(p), s.get_file_info(p).size
    else:
        s, p = store(path)
        with s.open_input_stream(p) as f:
            data = f.read()
    if transform is not None:
        data = transform[1](data)
    return io.BytesIO(data), len(data)
