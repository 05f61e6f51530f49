"""The data source ``avro_ocf``: batch and streaming reads and writes of object container files."""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.codec import AvroDataError, block_decoder, plain_values, row_encoder
from ..operators.columnar import decode_blocks, encode_rows, is_flat, side_by_side
from ..operators.depth import fitted
from ..plans.resolve import check, field_pairs
from ..plans.schema import AvroType, Field, SchemaError, from_spark, parse, to_struct
from . import container as c

NAME = "avro_ocf"
SPLIT_BYTES = 32 << 20
BATCH_ROWS = 10_000
#: Rows that are decoded side by side at most.
SIDE_ROWS = 400_000


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() in ("true", "1", "yes")


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Part(WriterCommitMessage):
    rows: int
    temporary: str
    final: str


def pruned(t: AvroType, names: list[str]) -> AvroType:
    """The record with only the named fields, in that order: the others are skipped in the data, not decoded."""
    out = AvroType(t.kind, name=t.name, aliases=t.aliases)
    for n in names:
        f = t.field(n)
        if f is None:
            raise SchemaError(f"no field {n} in {t.name}")
        out.fields.append(Field(f.name, f.type, f.default, f.order, f.aliases))
    return out


class Reading:
    """What tasks need to turn splits into Arrow batches. Options are checked here, on the driver."""

    def __init__(self, options: dict, schema: T.StructType, files: list[tuple[str, int]], codecs: dict[str, c.Codec], transforms: dict[str, c.Codec]):
        self.options, self.schema, self.files = options, schema, files
        self.codecs = codecs
        name = options.get("bytetransform")
        self.transform = transforms[name] if name else None
        self.lenient = _flag(options, "ignorecorruptfiles", False)
        self.verify = _flag(options, "verifysync", True)
        self.reader = options.get("readerschema")
        if files and self.reader:
            f, _ = c.open_input(files[0][0], self.transform)
            with f:
                check(c.read_header(f).schema, parse(self.reader))

    def splits(self, files: list[tuple[str, int]]) -> list[Split]:
        step = max(1, int(self.options.get("splitbytes", SPLIT_BYTES)))
        out = []
        for path, size in files:
            if size < 0 or self.transform is not None:
                out.append(Split(path, 0, -1))
            else:
                out += [Split(path, s, min(size, s + step)) for s in range(0, size, step)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        try:
            yield from self._read(split)
        except (AvroDataError, OSError):
            if not self.lenient:
                raise

    def _read(self, split: Split) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        f, size = c.open_input(split.path, self.transform)
        with f:
            header = c.read_header(f)
            if header.codec not in self.codecs:
                raise AvroDataError(f"unsupported codec {header.codec!r}")
            writer = header.schema
            reader = parse(self.reader) if self.reader else writer
            wanted = self.schema.names
            if reader.is_record and wanted != [x.name for x in reader.fields]:
                reader = pruned(reader, wanted)
            decode, inflate = block_decoder(writer, reader), self.codecs[header.codec][1]
            columns: list[list] = [[] for _ in wanted]
            rows = 0

            def probe(count: int, raw: bytes) -> bool:
                try:
                    decode(inflate(raw), count, [[] for _ in wanted or [0]])
                except Exception:  # whatever a custom codec raises
                    return False
                return True

            found = c.blocks(f, size, header, split.start, size if split.end < 0 else split.end, self.verify, probe)
            if wanted and is_flat(writer) and is_flat(reader) and self._same_types(writer, reader):
                yield from self._side_by_side(writer, reader, found, inflate, decode, kinds)
                return
            for count, raw in found:
                decode(inflate(raw), count, columns if wanted else [[]])
                rows += count
                if rows >= BATCH_ROWS:
                    yield self._batch(columns, kinds, rows)
                    columns, rows = [[] for _ in wanted], 0
            if rows:
                yield self._batch(columns, kinds, rows)

    @staticmethod
    def _same_types(w: AvroType, r: AvroType) -> bool:
        """Whether the reader takes all its fields from the data with the data's types."""
        pairs = {v: k for k, v in field_pairs(w, r).items()}
        return all(f.name in pairs and w.field(pairs[f.name]).type.to_json() == f.type.to_json() for f in r.fields)

    def _side_by_side(self, w: AvroType, r: AvroType, found: Iterator[tuple[int, bytes]], inflate: Any, decode: Any, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Decode many blocks at once; the last few one by one."""
        counts: list[int] = []
        bodies: list[bytes] = []

        def out() -> Iterator[pa.RecordBatch]:
            if counts and side_by_side(counts):
                batch = decode_blocks(w, r, counts, bodies, kinds)
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    yield batch.slice(at, BATCH_ROWS)
            elif counts:
                columns: list[list] = [[] for _ in kinds]
                for n, body in zip(counts, bodies, strict=True):
                    decode(body, n, columns)
                yield self._batch(columns, kinds, sum(counts))
            counts.clear()
            bodies.clear()

        for count, raw in found:
            counts.append(count)
            bodies.append(inflate(raw))
            if sum(counts) >= SIDE_ROWS:
                yield from out()
        yield from out()

    @staticmethod
    def _batch(columns: list[list], kinds: pa.Schema, rows: int) -> pa.RecordBatch:
        if not columns:
            return pa.RecordBatch.from_struct_array(pa.array([{}] * rows, pa.struct([])))
        return pa.RecordBatch.from_arrays([fitted(x, f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)


class BatchReader(DataSourceReader):
    def __init__(self, reading: Reading):
        self.reading = reading

    def partitions(self) -> list[Split]:
        return self.reading.splits(self.reading.files) or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return self.reading.read(split) if split.path else iter(())


class StreamReader(DataSourceStreamReader):
    """Files as they arrive. An offset is the sorted list of files seen; ``maxFilesPerTrigger`` bounds a batch.

    With ``availableNow`` Spark asks for one latest offset and stops there, so leave the bound out.
    A restarted query tells its last offset by ``partitions`` before it asks for the latest one.
    """

    def __init__(self, path: str, reading: Reading):
        self.path, self.reading = path, reading
        self.most = int(reading.options.get("maxfilespertrigger", 1 << 30))
        self.seen: set[str] = set()

    def initialOffset(self) -> dict:
        return {"files": "[]"}

    def latestOffset(self) -> dict:
        new = [f for f, _ in c.list_files(self.path) if f not in self.seen]
        self.seen.update(new[: self.most])
        return {"files": json.dumps(sorted(self.seen))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        old = set(json.loads(start["files"]))
        self.seen.update(json.loads(end["files"]))
        sizes = dict(c.list_files(self.path))
        return self.reading.splits([(f, sizes[f]) for f in json.loads(end["files"]) if f not in old and f in sizes])

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return self.reading.read(split)

    def commit(self, end: dict) -> None:
        pass


class Writing:
    """One file a task, written aside and moved when the job commits; checks of options happen on the driver."""

    def __init__(self, path: str, options: dict, schema: T.StructType, overwrite: bool, codecs: dict[str, c.Codec], transforms: dict[str, c.Codec]):
        self.path, self.overwrite, self.names = path.rstrip("/"), overwrite, schema.names
        given = options.get("avroschema")
        self.type_json = given if given else from_spark(schema, options.get("recordname", "topLevelRecord"), options.get("recordnamespace", "")).dumps()
        t = parse(self.type_json)
        row_encoder(t, self.names if t.is_record else None)  # raises where they don't fit
        self.codec = options.get("compression") or options.get("codec") or "null"
        if self.codec not in codecs:
            raise ValueError(f"unsupported codec {self.codec!r}")
        self.encode = codecs[self.codec][0]
        self.block_size = int(options.get("blocksize", c.BLOCK_SIZE))
        if self.block_size < 1:
            raise ValueError("blockSize must be a positive integer")
        sync = options.get("syncmarker")
        self.sync = bytes.fromhex(sync) if sync else None
        if self.sync is not None and len(self.sync) != c.SYNC_SIZE:
            raise ValueError("syncMarker must be 16 bytes, in hex")
        self.meta = c.check_meta({k.removeprefix("avro.meta."): v.encode() for k, v in options.items() if k.startswith("avro.meta.")})
        self.validate = _flag(options, "validate", True)
        name = options.get("bytetransform")
        self.transform = transforms[name] if name else None
        self.sink = options.get("sinkid", "")
        if "/" in self.sink:
            raise ValueError("sinkId becomes part of file names")
        self.job = uuid.uuid4().hex
        self.aside = f"{self.path}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        t, rows = parse(self.type_json), 0
        names = self.names if t.is_record else None
        types = [t.field(n).type if t.is_record and t.field(n) else t for n in self.names]
        row = row_encoder(t, names, self.validate)
        flat = is_flat(t) and set(names or []) >= {f.name for f in t.fields}
        context = TaskContext.get()
        name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.avro"
        fs_, root = c.store(self.aside)
        out, w = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if w is None:
                fs_.create_dir(root, recursive=True)
                out = io.BytesIO() if self.transform else fs_.open_output_stream(f"{root}/{name}")
                w = c.BlockWriter(out, self.type_json, self.codec, self.encode, self.sync or os.urandom(c.SYNC_SIZE), self.meta, self.block_size)
            rows += batch.num_rows
            if flat:
                try:
                    body, ends = encode_rows(t, [batch.column(names.index(f.name)) for f in t.fields])
                except (AvroDataError, pa.ArrowInvalid) as e:
                    raise AvroDataError(f"Record does not conform to the schema. {e}") from e
                w.records(body, ends)
                continue
            columns = [plain_values(x, ty) for x, ty in zip(batch.columns, types, strict=True)]
            extend = w.buffer.extend
            try:
                for values in zip(*columns, strict=True) if columns else [()] * batch.num_rows:
                    row(extend, values)
                    w.record()
            except (KeyError, TypeError, AttributeError) as e:
                raise AvroDataError(f"Record does not conform to the schema: {e}") from e
            except AvroDataError as e:
                raise AvroDataError(f"Record does not conform to the schema. {e}") from e
        if w is None:
            return Part(0, "", "")
        w.close()
        if self.transform:
            with fs_.open_output_stream(f"{root}/{name}") as f:
                f.write(self.transform[0](out.getvalue()))
        else:
            out.close()
        return Part(rows, f"{self.aside}/{name}", f"{self.path}/{name}")

    def commit(self, parts: list[Part | None], batch: int | None = None) -> None:
        """Shows the new files, and only then deletes those they replace: all on overwriting, a repeated batch's own where ``sinkId`` names the sink."""
        fs_, root = c.store(self.path)
        fs_.create_dir(root, recursive=True)
        done = sorted((p for p in parts if p is not None and p.rows), key=lambda p: p.temporary)
        finals = [c.store(p.final)[1] for p in done]
        old = [c.store(path)[1] for path, _ in c.list_files(self.path)] if self.overwrite else []
        if batch is not None and self.sink:
            stem = f"part-{self.sink}-{batch:010d}-"
            finals = [f"{root}/{stem}{k:05d}.avro" for k in range(len(done))]
            old = [p for p in (c.store(path)[1] for path, _ in c.list_files(self.path)) if p.rpartition("/")[2].startswith(stem)]
        for p, final in zip(done, finals, strict=True):
            fs_.move(c.store(p.temporary)[1], final)
        if not done and batch is None:
            data = c.header_bytes(self.type_json, self.codec, self.sync or os.urandom(c.SYNC_SIZE), self.meta)
            with fs_.open_output_stream(f"{root}/part-00000-{self.job}.avro") as f:
                f.write(self.transform[0](data) if self.transform else data)
        for path in set(old) - set(finals):
            fs_.delete_file(path)
        self.abort()

    def abort(self) -> None:
        fs_, root = c.store(self.aside)
        from pyarrow import fs

        if fs_.get_file_info(root).type != fs.FileType.NotFound:
            fs_.delete_dir(root)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, writing: Writing):
        self.writing = writing

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self.writing.write(iterator)

    def commit(self, messages: list) -> None:
        self.writing.commit(messages)

    def abort(self, messages: list) -> None:
        self.writing.abort()


class StreamWriter(DataSourceStreamArrowWriter):
    """A batch's files appear when it commits.

    With the option ``sinkId`` (one of its own for each query that writes to the folder) files are
    named by it and the batch, so a batch that is run again after its commit replaces
    its own files; without it, the files are added again.
    """

    def __init__(self, writing: Writing):
        self.writing = writing

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self.writing.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.writing.commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.writing.abort()


class AvroContainerSource(DataSource):
    """``spark.read.format("avro_ocf")`` and its writes and streams.

    Reading: ``path`` (file, folder, glob, any URI that pyarrow or HTTP opens),
    ``readerSchema`` (resolved on the driver), ``splitBytes``, ``verifySync``,
    ``ignoreCorruptFiles``, ``recursiveDepth``, ``byteTransform``,
    ``maxFilesPerTrigger``. A user schema's columns alone are decoded, the rest skipped.
    Writing: ``avroSchema``, ``recordName``, ``recordNamespace``, ``compression``,
    ``blockSize``, ``syncMarker`` (hex), ``avro.meta.<key>``, ``validate``, ``byteTransform``,
    ``sinkId`` (streams: a repeated batch replaces its own files).
    Custom codecs and transformations are those known when ``register`` was called.
    """

    codecs: dict[str, c.Codec] = c.BUILT_IN
    transforms: dict[str, c.Codec] = {}

    @classmethod
    def name(cls) -> str:
        return NAME

    def _options(self) -> dict:
        return {k.lower() if not k.lower().startswith("avro.meta.") else k: v for k, v in self.options.items()}

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return self.options["path"]

    def schema(self) -> T.StructType:
        options = self._options()
        depth = int(options.get("recursivedepth", 0))
        if options.get("readerschema"):
            return to_struct(parse(options["readerschema"]), depth)
        files = c.list_files(self._path())
        if not files:
            raise ValueError(f"no files in {self._path()}")
        name = options.get("bytetransform")
        f, _ = c.open_input(files[0][0], self.transforms[name] if name else None)
        with f:
            return to_struct(c.read_header(f).schema, depth)

    def reader(self, schema: T.StructType) -> BatchReader:
        return BatchReader(Reading(self._options(), schema, c.list_files(self._path()), self.codecs, self.transforms))

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(self._path(), Reading(self._options(), schema, [], self.codecs, self.transforms))

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(Writing(self._path(), self._options(), schema, overwrite, self.codecs, self.transforms))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(Writing(self._path(), self._options(), schema, False, self.codecs, self.transforms))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with the codecs and transformations registered so far.

    The class is made anew, so it is shipped by value, codecs included.
    """
    spark.dataSource.register(type("RegisteredAvroSource", (AvroContainerSource,), {"codecs": c.codecs(), "transforms": c.transforms()}))


def read_avro(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Read container files; with ``columns`` only those are decoded (Spark doesn't prune Python sources by itself)."""
    register(spark)
    reader = spark.read.format(NAME).options(**options)
    if columns is not None:
        full = reader.load(path).schema
        reader = reader.schema(T.StructType([full[n] for n in columns]))
    return reader.load(path)


def write_avro(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    register(df.sparkSession)
    df.write.format(NAME).options(**options).mode(mode).save(path)


def read_avro_header(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, magic, sync, codec, meta (map of string to binary): one row a file, read in the tasks."""
    schema = "path string, magic binary, sync binary, codec string, meta map<string,binary>"
    files = c.list_files(path)
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                f, _ = c.open_input(p)
                with f:
                    h = c.read_header(f)
                rows.append((p, c.MAGIC, h.sync, h.codec, list(h.meta.items())))
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.string(), pa.map_(pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "magic", "sync", "codec", "meta"])

    return spark.createDataFrame([(p,) for p, _ in files], "path string").mapInArrow(run, schema)


def read_avro_binary(df: DataFrame, schema: AvroType | str, content_col: str = "content", reader_schema: str | None = None) -> DataFrame:
    """Decode whole files held in a binary column (``spark.read.format("binaryFile")``, any store that Spark reads); ``schema`` is theirs."""
    out = to_struct(parse(reader_schema) if reader_schema else parse(schema))
    known = c.codecs()
    target = reader_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out)
        for b in batches:
            for data in b.column(0).to_pylist():
                f = io.BytesIO(data)
                h = c.read_header(f)
                decode = block_decoder(h.schema, parse(target)) if target else block_decoder(h.schema)
                for count, raw in c.blocks(f, len(data), h):
                    columns: list[list] = [[] for _ in out.names]
                    decode(known[h.codec][1](raw), count, columns)
                    yield Reading._batch(columns, kinds, count)

    return df.select(content_col).mapInArrow(run, out)
