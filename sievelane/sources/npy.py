"""Vectors and numbers in ``.npy`` and ``.npz`` files, as a Spark data source called ``npy``.

Files are opened by pyarrow's file systems, so a path may be in any store that it knows. Reading plans ranges of rows from the headers, a task reads its bytes alone; a whole file
is never held. Writing gives a file for each task and one small list of the files that count, put in place at the end.
"""

from __future__ import annotations

import ast
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a task is meant to read, and that it gives at once.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
LIST = "_files.json"


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return pafs.LocalFileSystem(), path


def _header(f) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, bytes before the data) of an open .npy file."""
    head = f.read(10)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    size, more = (struct.unpack("<H", head[8:10])[0], b"") if head[6] == 1 else (None, f.read(2))
    size = size if size is not None else struct.unpack("<I", head[8:10] + more)[0]
    said = ast.literal_eval(f.read(size).decode("latin1" if head[6] < 3 else "utf8"))
    if said["fortran_order"] and len(said["shape"]) > 1:
        raise ValueError("columns first isn't read")
    kind = np.dtype(said["descr"])
    if kind.kind not in "fiu" or len(said["shape"]) not in (1, 2):
        raise ValueError(f"arrays of {kind} in {len(said['shape'])} dimensions aren't read")
    return kind, tuple(said["shape"]), 10 + len(more) + size


@dataclass
class Rows(InputPartition):
    """Rows ``first`` up to ``past`` of an array that starts ``skip`` bytes into a file, or into a packed ``member`` of it."""

    path: str
    name: str
    kind: str
    width: int
    first: int
    past: int
    skip: int
    member: str | None = None


class NpyReader(DataSourceReader):
    def __init__(self, path: str, member: str | None, range_bytes: int, vectors: bool):
        self.path, self.member, self.range_bytes, self.vectors = path, member, range_bytes, vectors

    def _files(self, fs, path: str) -> list[str]:
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            return [path]
        if fs.get_file_info(f"{path}/{LIST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{LIST}") as f:
                return [f"{path}/{x}" for x in json.loads(f.read())]
        return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.path.endswith((".npy", ".npz")))

    def partitions(self) -> list[Rows]:
        fs, path = _open(self.path)
        out = []
        for file in self._files(fs, path):
            with fs.open_input_file(file) as f:
                member = None
                base = 0
                if file.endswith(".npz"):
                    with zipfile.ZipFile(f) as z:
                        names = [n for n in z.namelist() if self.member is None or n.removesuffix(".npy") == self.member]
                        if len(names) != 1:
                            raise ValueError(f"{file} has the arrays {z.namelist()}; the option 'member' chooses one")
                        info = z.getinfo(names[0])
                        with z.open(info) as m:
                            kind, shape, skip = _header(m)
                        if info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1:
                            f.seek(info.header_offset + 26)
                            base = info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
                        else:
                            member = names[0]
                else:
                    kind, shape, skip = _header(f)
            width = shape[1] if len(shape) == 2 else 0
            if (width > 0) != self.vectors and shape[0]:
                raise ValueError(f"{file} holds {'vectors' if width else 'numbers'}; see the option 'kind'")
            each = kind.itemsize * max(1, width)
            step = shape[0] if member else max(1, self.range_bytes // each)  # what is packed is read from its start
            out += [Rows(file, file.rpartition("/")[2], kind.str, width, lo, min(shape[0], lo + step), base + skip, member) for lo in range(0, shape[0], max(1, step))]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is nothing
            return
        fs, _ = _open(self.path)
        kind = np.dtype(partition.kind)
        each = kind.itemsize * max(1, partition.width)
        step = max(1, BATCH_BYTES // each)
        with fs.open_input_file(partition.path) as file:
            f = zipfile.ZipFile(file).open(partition.member) if partition.member else file
            if partition.member:
                f.read(partition.skip)
            else:
                f.seek(partition.skip + partition.first * each)
            for lo in range(partition.first, partition.past, step):
                n = min(step, partition.past - lo)
                data = f.read(n * each)
                if len(data) != n * each:
                    raise OSError(f"{partition.path} ends early")
                flat = np.frombuffer(data, kind)
                values = pa.array(flat.astype(np.int64 if kind.kind in "iu" and not partition.width else np.float32 if kind.itemsize <= 4 and kind.kind == "f" else np.float64))
                if partition.width:
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.width, pa.int32()), values.cast(pa.float32()))
                else:
                    values = values.cast(pa.float64()) if kind.kind == "f" else values
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n, pa.string()), pa.array(np.arange(lo, lo + n)), values], names=["file", "row", "value"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NpyWriter(DataSourceArrowWriter):
    """A file of vectors for each task, and one of their ids beside it, of the same rows."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _open(self.path)
        name, ids, parts, width = uuid.uuid4().hex, [], [], None
        temp = []
        fs.create_dir(path, recursive=True)
        n = 0
        for batch in batches:  # a batch is written as it comes; headers need the number of rows, so files of one batch each
            if not batch.num_rows:
                continue
            own = batch.column(1)
            if own.null_count or batch.column(0).null_count:
                raise ValueError("null ids and null vectors can't be written")
            sizes = np.unique(np.diff(own.offsets.to_numpy()))
            if len(sizes) != 1 or width not in (None, int(sizes[0])):
                raise ValueError("vectors of several lengths can't be one array")
            width = int(sizes[0])
            parts.append(np.asarray(own.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width))
            ids.append(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64))
            n += batch.num_rows
            if sum(p.nbytes for p in parts) >= RANGE_BYTES:
                temp.append(self._save(fs, path, f"{name}-{len(temp):05d}", parts, ids))
                parts, ids = [], []
        if parts:
            temp.append(self._save(fs, path, f"{name}-{len(temp):05d}", parts, ids))
        return Written(temp)

    @staticmethod
    def _save(fs, path: str, name: str, parts: list[np.ndarray], ids: list[np.ndarray]) -> str:
        for kind, arrays in (("vectors", parts), ("ids", ids)):
            fs.create_dir(f"{path}/{kind}", recursive=True)
            with fs.open_output_stream(f"{path}/{kind}/{name}.npy") as f:
                np.lib.format.write_array(f, np.concatenate(arrays))
        return f"{name}.npy"

    def commit(self, messages: list[Written]) -> None:
        fs, path = _open(self.path)
        names = sorted(n for m in messages if m is not None for n in m.names)
        for kind in ("vectors", "ids"):
            fs.create_dir(f"{path}/{kind}", recursive=True)
            before = []
            if not self.overwrite and fs.get_file_info(f"{path}/{kind}/{LIST}").type == pafs.FileType.File:
                with fs.open_input_stream(f"{path}/{kind}/{LIST}") as f:
                    before = json.loads(f.read())
            with fs.open_output_stream(f"{path}/{kind}/{LIST}") as f:
                f.write(json.dumps([*before, *names]).encode())

    def abort(self, messages: list[Written]) -> None:
        fs, path = _open(self.path)
        for m in messages:
            for n in m.names if m is not None else []:
                for kind in ("vectors", "ids"):
                    if fs.get_file_info(f"{path}/{kind}/{n}").type == pafs.FileType.File:
                        fs.delete_file(f"{path}/{kind}/{n}")


class NpySource(DataSource):
    """Options: path; ``kind``: ``vectors`` (the default) or ``numbers`` for arrays of one dimension, whole numbers with ``integers``; ``member`` of .npz files; ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _kind(self) -> str:
        return self.options.get("kind", "vectors")

    def schema(self) -> str:
        return f"file string, row bigint, value {({'vectors': 'array<float>', 'numbers': 'double', 'integers': 'bigint'})[self._kind()]}"

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(self.options["path"], self.options.get("member"), int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))), self._kind() == "vectors")

    def writer(self, schema: T.StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], overwrite)


def read_npy(spark: SparkSession, path: str, kind: str = "vectors", member: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, row, value): the rows of all arrays at ``path``, a file or a folder, each with its place in its file."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").option("kind", kind).option("rangeBytes", range_bytes)
    return (reader.option("member", member) if member else reader).load(path)


def write_vectors_npy(df: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    """Vectors and their whole-number ids as pairs of .npy files of the same rows, below ``path``/vectors and ``path``/ids."""
    df.sparkSession.dataSource.register(NpySource)
    df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("embedding")).write.format("npy").mode("append").save(path)


def read_vectors_npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of what ``write_vectors_npy`` wrote: ids and vectors meet by file and row."""
    ids = read_npy(spark, f"{path}/ids", "integers").withColumnRenamed("value", "id")
    return ids.join(read_npy(spark, f"{path}/vectors").withColumnRenamed("value", "embedding"), ["file", "row"]).select("id", "embedding")
