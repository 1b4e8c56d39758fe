"""Spark data source for NumPy's packed arrays: dense arrays as columns, sparse matrices as (row, col, value), read in row ranges.

    spark.dataSource.register(NpzDataSource)
    spark.read.format("npz").option("arrays", "feature,label,node_types").load("/data/reddit_data.npz")
    spark.read.format("npz").option("sparse", "true").load("/data/reddit_graph.npz")

A member that is stored (np.savez) is read at the place of its rows; one that is deflated
(np.savez_compressed, scipy's save_npz) is inflated from its beginning, in pieces, up to them. Either way a task holds ``batch`` rows at a time.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SQL = {"f": {2: "float", 4: "float", 8: "double"}, "i": {1: "int", 2: "int", 4: "int", 8: "long"}, "u": {1: "int", 2: "int", 4: "long", 8: "long"}, "b": {1: "boolean"}}
_ARROW = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


@dataclass
class Member:
    """An array in a file: type, shape, where its bytes are in the file and how many of them precede its numbers."""

    dtype: np.dtype
    shape: tuple[int, ...]
    at: int
    deflated: bool
    head: int

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def kind(self) -> str:
        found = _SQL.get(self.dtype.kind, {}).get(self.dtype.itemsize)
        if found is None:
            raise ValueError(f"arrays of {self.dtype} can't be read")
        return found


def _opened(path: str):
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def members(path: str) -> dict[str, Member]:
    """The arrays of a file, from its directory and their headers only."""
    out = {}
    with _opened(path) as stream, zipfile.ZipFile(stream) as packed:
        for info in packed.infolist():
            if not info.filename.endswith(".npy"):
                continue
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{info.filename}: compression {info.compress_type} can't be read")
            with packed.open(info) as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                head = f.tell()
            if fortran and len(shape) > 1:
                raise ValueError(f"{info.filename}: columns first, rows can't be read by range")
            # the local header has a name and an extra field of its own length
            name, extra = struct.unpack("<HH", stream.read_at(4, info.header_offset + 26))
            out[info.filename.removesuffix(".npy")] = Member(dtype, shape, info.header_offset + 30 + name + extra, info.compress_type == zipfile.ZIP_DEFLATED, head)
    return out


def read_range(path: str, member: Member, start: int, stop: int, batch: int) -> Iterator[np.ndarray]:
    """Rows ``start`` to ``stop`` of an array, ``batch`` rows at a time."""
    width = member.row_bytes
    with _opened(path) as stream:
        inflated = _inflated(stream, member.at) if member.deflated else None
        if inflated:
            inflated.skip(member.head + start * width)
        for at in range(start, stop, batch):
            n = min(batch, stop - at)
            raw = inflated.take(n * width) if inflated else stream.read_at(n * width, member.at + member.head + at * width)
            if len(raw) < n * width:
                raise ValueError(f"{path} ends early")
            yield np.frombuffer(raw, member.dtype).reshape(n, *member.shape[1:])


class _inflated:  # noqa: N801
    """A deflated stream that is read forward."""

    def __init__(self, stream, at: int, block: int = 1 << 20):
        self.stream, self.at, self.block = stream, at, block
        self.unzip, self.rest = zlib.decompressobj(wbits=-15), b""

    def _more(self, most: int) -> bytes:
        if self.unzip.eof:
            return b""
        raw = self.unzip.unconsumed_tail
        if not raw:
            raw = self.stream.read_at(self.block, self.at)
            self.at += len(raw)
        return self.unzip.decompress(raw, most)

    def take(self, n: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < n and (more := self._more(max(1, n - have))):
            parts.append(more)
            have += len(more)
            if self.unzip.eof:
                break
        data = b"".join(parts)
        self.rest = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        while n > 0:
            got = len(self.take(min(n, 1 << 24)))
            if not got:
                raise ValueError("the array ends early")
            n -= got


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int
    first: int


class NpzDataSource(DataSource):
    """Options: ``arrays``, the names of arrays with equally many rows (all of them if unset); ``sparse`` for a matrix in coordinate or compressed row form;
    ``rows`` of a partition (1,000,000) and of a ``batch`` (4,096). A path may be a folder of files, whose rows follow each other in the order of their names.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def files(self) -> list[str]:
        path = self.options["path"]
        store, at = fs.FileSystem.from_uri(path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type != fs.FileType.Directory:
            return [path]
        inside = store.get_file_info(fs.FileSelector(at))
        return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in inside if i.base_name.endswith(".npz"))

    @property
    def sparse(self) -> bool:
        return self.options.get("sparse", "false").lower() == "true"

    def arrays(self) -> list[str]:
        found = members(self.files()[0])
        if self.sparse:
            return ["row", "col", *(["data"] if "data" in found else [])] if "row" in found else ["indptr", "indices", "data"]
        said = [x.strip() for x in self.options.get("arrays", "").split(",") if x.strip()]
        unknown = [x for x in said if x not in found]
        if unknown:
            raise ValueError(f"no arrays {unknown}, there are {sorted(found)}")
        return said or list(found)

    def schema(self) -> str:
        if self.sparse:
            return "row long, col long, value double"
        found = members(self.files()[0])
        for a in self.arrays():
            if not 1 <= len(found[a].shape) <= 2:
                raise ValueError(f"{a} has {len(found[a].shape)} dimensions")
        return ", ".join(["row long", *(f"`{a}` array<{found[a].kind}>" if len(found[a].shape) == 2 else f"`{a}` {found[a].kind}" for a in self.arrays())])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self, schema)


class _Reader(DataSourceReader):
    def __init__(self, source: NpzDataSource, schema):
        self.files, self.arrays, self.sparse = source.files(), source.arrays(), source.sparse
        self.rows, self.batch = int(source.options.get("rows", 1_000_000)), int(source.options.get("batch", 4096))

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for path in self.files:
            found = members(path)
            sizes = {found[a].shape[0] for a in self.arrays if a != "indptr"}
            if len(sizes) > 1:
                raise ValueError(f"{path}: arrays of {sorted(sizes)} rows")
            n = sizes.pop()
            out += [Rows(path, k, min(k + self.rows, n), first) for k in range(0, n, self.rows)]
            # a compressed row matrix's rows follow those of the file before it, coordinates are absolute
            first += (found["indptr"].shape[0] - 1 if "indptr" in self.arrays else 0) if self.sparse else n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        found = members(partition.path)
        each = [read_range(partition.path, found[a], partition.start, partition.stop, self.batch) for a in self.arrays if a != "indptr"]
        at = partition.start
        starts = self._starts(partition, found) if "indptr" in self.arrays and self.sparse else None
        for parts in zip(*each, strict=True):
            n = len(parts[0])
            if not self.sparse:
                columns = [pa.array(np.arange(at, at + n) + partition.first)]
                columns += [_column(p, found[a].kind) for a, p in zip(self.arrays, parts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["row", *self.arrays])
            else:
                if starts is not None:
                    base, ends = starts
                    row = base + np.searchsorted(ends, np.arange(at, at + n), side="right") + partition.first
                    col, data = parts
                else:
                    row, col, data = (*parts, np.ones(n))[:3]
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(col.astype(np.int64)), pa.array(data.astype(np.float64))], ["row", "col", "value"])
            at += n

    def _starts(self, partition: Rows, found: dict[str, Member]) -> tuple[int, np.ndarray]:
        """The matrix row in which the range begins, and the ends of that and the following rows up to the range's end."""
        ends, base = [], 0
        member = found["indptr"]
        for part in read_range(partition.path, member, 1, member.shape[0], self.batch * 16):
            base += int((part <= partition.start).sum())
            ends.append(part[part > partition.start])
            if len(part) and part[-1] >= partition.stop:
                break
        return base, np.concatenate(ends) if ends else np.zeros(0, np.int64)


def _column(x: np.ndarray, kind: str) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).ravel().astype(_ARROW[kind].to_pandas_dtype()), _ARROW[kind])
    if x.ndim == 1:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def read_packed_graph(spark: SparkSession, data_path: str, graph_path: str, rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y, split) and distinct edges (src, dst) from packed ``feature``, ``label`` and ``node_types`` (1 train, 2 val, 3 test) and a sparse adjacency.

    Values of ``node_types`` other than these give a null split. Edges of value 0 that are stored count, as their places do.
    """
    spark.dataSource.register(NpzDataSource)
    read = spark.read.format("npz").option("rows", rows)
    data = read.option("arrays", "feature,label,node_types").load(data_path)
    kind = F.col("node_types")
    split = F.when(kind == 1, "train").when(kind == 2, "val").when(kind == 3, "test")
    nodes = data.select(F.col("row").alias("node_id"), F.col("feature").cast("array<double>").alias("x"), F.col("label").cast("int").alias("y"), split.alias("split"))
    edges = spark.read.format("npz").option("rows", rows).option("sparse", "true").load(graph_path)
    return nodes, edges.select(F.col("row").alias("src"), F.col("col").alias("dst")).distinct()
