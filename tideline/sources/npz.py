"""A data source for vectors in NPZ files: a matrix and one array per key, row by row parallel.

Reading plans ranges of rows from the array headers alone; a task seeks to its range in every
member, so a file is many tasks and none holds a file. Members of compressed files cannot be
sought in; such a file is one task that streams. Writing gives files of bounded size under names of
their own; a list of the files of all tasks that succeeded is written last, and readers follow it.
Paths are those of ``pyarrow.fs``: local or shared folders, ``hdfs://``, ``s3://``, ``gs://``.
"""

from __future__ import annotations

import io
import json
import math
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

FORMAT, LISTED = "npz_vectors", "_files.json"
#: Rows a task reads, bytes of a batch, and bytes of vectors in a file that is written.
ROWS, BATCH_BYTES, FILE_BYTES = 262_144, 1 << 22, 1 << 26


@dataclass
class Member:
    """An array inside a file: its shape and type, and where its numbers start."""

    shape: tuple[int, ...]
    by_columns: bool
    dtype: np.dtype
    start: int

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def member_header(archive: zipfile.ZipFile, name: str) -> Member:
    with archive.open(name + ".npy") as stream:
        version = np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_columns, dtype = read(stream)
        if dtype.hasobject:
            raise ValueError(f"{name}: arrays of Python objects are not read")
        return Member(shape, by_columns and len(shape) > 1, dtype, stream.tell())


class Section:
    """An uncompressed member: reads go straight to their place in the file."""

    def __init__(self, raw, info: zipfile.ZipInfo):
        # the local header: 30 bytes, the last four of which are the lengths of what follows it
        name, extra = struct.unpack("<HH", raw.read_at(4, info.header_offset + 26))
        self.raw, self.base, self.at = raw, info.header_offset + 30 + name + extra, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, size: int) -> bytes:
        return self.raw.read_at(size, self.base + self.at)

    def close(self) -> None:
        pass


def member_stream(raw, archive: zipfile.ZipFile, name: str):
    info = archive.getinfo(name + ".npy")
    return Section(raw, info) if info.compress_type == zipfile.ZIP_STORED else archive.open(info)


def _read(stream, at: int, count: int, dtype: np.dtype) -> np.ndarray:
    stream.seek(at)
    data = stream.read(count * dtype.itemsize)
    if len(data) < count * dtype.itemsize:
        raise ValueError("the file ends before its rows do")
    return np.frombuffer(data, dtype)


def member_rows(stream, member: Member, start: int, stop: int) -> np.ndarray:
    """Rows ``start`` to ``stop`` of an array, whichever way it is laid out."""
    size = member.dtype.itemsize
    if not member.by_columns:
        flat = _read(stream, member.start + start * member.width * size, (stop - start) * member.width, member.dtype)
        return flat.reshape(stop - start, *member.shape[1:])
    columns = [
        _read(stream, member.start + (c * member.shape[0] + start) * size, stop - start, member.dtype) for c in range(member.width)
    ]
    return np.stack(columns, axis=1)


class VectorReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.matrix = options["path"], options.get("matrix", "embeddings")
        self.rows = int(options.get("rows", ROWS))
        self.schema = schema
        self.keys, self.vector = schema.names[:-1], schema.names[-1]

    def _files(self) -> list[str]:
        files, path = place(self.path)
        if files.get_file_info(path).type == fs.FileType.File:
            return [path]
        if files.get_file_info(f"{path}/{LISTED}").type == fs.FileType.File:
            with files.open_input_stream(f"{path}/{LISTED}") as stream:
                return [f"{path}/{name}" for name in json.loads(stream.read())]
        found = files.get_file_info(fs.FileSelector(path))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))

    def partitions(self) -> list[InputPartition]:
        files, _ = place(self.path)
        parts: list[InputPartition] = []
        for path in self._files():
            with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                members = {name: member_header(archive, name) for name in [*self.keys, self.matrix]}
                n = members[self.matrix].shape[0]
                if len(members[self.matrix].shape) != 2 or any(members[k].shape != (n,) for k in self.keys):
                    raise ValueError(f"{path}: keys and vectors differ in number")
                packed = any(archive.getinfo(m + ".npy").compress_type != zipfile.ZIP_STORED for m in members)
            step = max(1, n if packed else self.rows)
            parts += [Rows(path, start, min(start + step, n)) for start in range(0, n, step)]
        return parts

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, _ = place(self.path)
        with files.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            members = {name: member_header(archive, name) for name in [*self.keys, self.matrix]}
            matrix = members[self.matrix]
            step = max(1, BATCH_BYTES // max(1, matrix.width * matrix.dtype.itemsize))
            streams = {name: member_stream(raw, archive, name) for name in members}
            for start in range(partition.start, partition.stop, step):
                stop = min(start + step, partition.stop)
                rows = member_rows(streams[self.matrix], matrix, start, stop).astype("float32")
                ends = pa.array(np.arange(stop - start + 1, dtype="int32") * matrix.width)
                columns = [
                    pa.array(member_rows(streams[k], members[k], start, stop).tolist(), to_arrow_type(self.schema[k].dataType))
                    for k in self.keys
                ]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=self.schema.names
                )
            for stream in streams.values():
                stream.close()


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.matrix = options["path"], options.get("matrix", "embeddings")
        self.bytes = int(options.get("bytes", FILE_BYTES))
        self.keys, self.vector, self.overwrite = schema.names[:-1], schema.names[-1], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = place(self.path)
        held: list[tuple[dict, np.ndarray]] = []
        written: list[str] = []

        def finish() -> None:
            if not held:
                return
            if len({vectors.shape[1] for _, vectors in held}) > 1:
                raise ValueError("vectors of uneven length")
            arrays = {k: np.concatenate([keys[k] for keys, _ in held]) for k in self.keys}
            arrays[self.matrix] = np.concatenate([vectors for _, vectors in held])
            held.clear()
            content = io.BytesIO()
            np.savez(content, **arrays)
            name = f"part-{uuid.uuid4().hex}.npz"
            files.create_dir(path, recursive=True)
            with files.open_output_stream(f"{path}/{name}") as out:
                out.write(content.getbuffer())
            written.append(name)

        for batch in iterator:
            if not batch.num_rows:
                continue
            if any(column.null_count for column in batch.columns):
                raise ValueError("a key or vector is null")
            lists = batch.column(self.vector)
            lengths = lists.value_lengths().to_numpy()
            if (lengths != lengths[0]).any():
                raise ValueError("vectors of uneven length")
            values = lists.flatten()
            if values.null_count:
                raise ValueError("a vector holds a null")
            vectors = values.to_numpy().astype("float32").reshape(batch.num_rows, -1)
            held.append(({k: np.array(batch.column(k).to_pylist()) for k in self.keys}, vectors))
            if sum(v.nbytes for _, v in held) >= self.bytes:
                finish()
        finish()
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = place(self.path)
        names = [name for m in messages if m is not None for name in m.files]
        known = f"{path}/{LISTED}"
        if not self.overwrite and files.get_file_info(known).type == fs.FileType.File:
            with files.open_input_stream(known) as stream:
                names = [*json.loads(stream.read()), *names]
        files.create_dir(path, recursive=True)
        staged = f"{path}/.{uuid.uuid4().hex}"
        with files.open_output_stream(staged) as out:
            out.write(json.dumps(names).encode())
        files.move(staged, known)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to do: files that no list names are not read."""


class VectorFiles(DataSource):
    """Columns are the keys, then the vector, as the given schema names them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return VectorWriter(self.options, schema, overwrite)
