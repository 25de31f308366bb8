"""Blocks of numbers in .npy and .npz files as a Spark data source.

Each key of an .npz file (or each .npy file of a folder, by its name) is a block: one row of it for each row of the table,
one-dimensional blocks as numbers, two-dimensional ones as arrays. Blocks are read by ranges of rows, a partition each;
only the keys that are asked for are opened. Nothing is unpickled: arrays of objects are refused.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _members(path: str) -> dict[str, str | None]:
    """Key -> name inside the .npz file, or None where the key is a file of its own."""
    store, at = _store(path)
    if at.endswith(".npz"):
        with store.open_input_file(at) as f:
            return {n.removesuffix(".npy"): n for n in zipfile.ZipFile(f).namelist()}
    if at.endswith(".npy"):
        return {at.rsplit("/", 1)[-1].removesuffix(".npy"): None}
    files = store.get_file_info(pafs.FileSelector(at))
    return {f.base_name.removesuffix(".npy"): None for f in files if f.base_name.endswith(".npy")}


class _Open:
    """One block, opened after its header: shape, type and a stream of its rows."""

    def __init__(self, path: str, key: str, member: str | None):
        store, at = _store(path)
        if member is None:
            self.file = store.open_input_file(at if at.endswith(".npy") else f"{at}/{key}.npy")
            self.stream = self.file
        else:
            self.file = store.open_input_file(at)
            self.stream = zipfile.ZipFile(self.file).open(member)
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.stream)
        if self.dtype.hasobject:
            raise ValueError(f"block {key} holds objects, not numbers")
        if fortran and len(self.shape) > 1 or len(self.shape) not in (1, 2):
            raise ValueError(f"block {key} isn't one or two dimensions of rows")
        self.width = self.shape[1] if len(self.shape) == 2 else None
        self.row = self.dtype.itemsize * (self.width if self.width is not None else 1)

    def rows(self, first: int, count: int) -> np.ndarray:
        """``count`` rows from ``first`` on; a compressed member is read up to there."""
        self.stream.seek(first * self.row, 1)
        got = np.frombuffer(self.stream.read(count * self.row), self.dtype, count * (self.width if self.width is not None else 1))
        return got if self.width is None else got.reshape(count, self.width)

    def close(self) -> None:
        self.stream.close()
        self.file.close()


class _Rows(InputPartition):
    def __init__(self, first: int, count: int, key: str | None = None):
        self.first, self.count, self.key = first, count, key


class BlockSource(DataSource):
    """``spark.read.format("blocks")`` with ``path``, ``keys`` (comma-separated, all if left out) and ``rows`` of a partition.

    With ``parts`` the .npy files of a folder are pieces of one block: (file, row_id in the file, values).
    """

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def _keys(self) -> dict[str, str | None]:
        found = _members(self.options["path"])
        asked = [k for k in self.options.get("keys", "").split(",") if k] or sorted(found)
        if missing := [k for k in asked if k not in found]:
            raise ValueError(f"no block {missing}")
        return {k: found[k] for k in asked}

    def schema(self) -> str:
        columns, keys = ["row_id long"], self._keys()
        if self.options.get("parts"):
            columns, keys = ["file string", *columns], dict([next(iter(keys.items()))]) if keys else {}
        for key, member in keys.items():
            block = _Open(self.options["path"], key, member)
            kind = {"f4": "float", "f8": "double", "f2": "float"}.get(block.dtype.str[1:], "long" if block.dtype.kind in "iub" else None)
            if kind is None:
                raise ValueError(f"block {key} holds {block.dtype}, not numbers")
            name = "values" if self.options.get("parts") else key
            columns.append(f"`{name}` {kind if block.width is None else f'array<{kind}>'}")
            block.close()
        return ", ".join(columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PartsReader if self.options.get("parts") else BlockReader
        return kind(self.options["path"], self._keys(), int(self.options.get("rows", "100000")), schema)


class BlockReader(DataSourceReader):
    def __init__(self, path: str, keys: dict[str, str | None], rows: int, schema: StructType):
        self.path, self.keys, self.size, self.kinds = path, keys, rows, {f.name: f.dataType.simpleString() for f in schema.fields}

    def partitions(self) -> list[InputPartition]:
        counts = {}
        for key, member in self.keys.items():
            block = _Open(self.path, key, member)
            counts[key] = block.shape[0]
            block.close()
        if len(set(counts.values())) > 1:
            raise ValueError(f"blocks of different lengths: {counts}")
        n = next(iter(counts.values()), 0)
        return [_Rows(a, min(self.size, n - a)) for a in range(0, n, self.size)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        step, at, end = 4096, partition.first, partition.first + partition.count
        blocks = {key: _Open(self.path, key, member) for key, member in self.keys.items()}
        try:
            skip = partition.first
            while at < end:
                n = min(step, end - at)
                columns = [pa.array(np.arange(at, at + n), pa.int64())]
                for key, block in blocks.items():
                    x = block.rows(skip, n)
                    kind = {"float": np.float32, "double": np.float64}.get(self.kinds[key].removeprefix("array<").removesuffix(">"), np.int64)
                    flat = pa.array(np.ascontiguousarray(x, kind).ravel())
                    columns.append(flat if block.width is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * block.width, pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, ["row_id", *blocks])
                skip, at = 0, at + n
        finally:
            for block in blocks.values():
                block.close()


class PartsReader(BlockReader):
    """Pieces of one block: each file by its own ranges of rows."""

    def partitions(self) -> list[InputPartition]:
        out = []
        for key in sorted(self.keys):
            block = _Open(self.path, key, None)
            out += [_Rows(a, min(self.size, block.shape[0] - a), key) for a in range(0, block.shape[0], self.size)]
            block.close()
        return out or [_Rows(0, 0, None)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if partition.key is None:
            return
        one = BlockReader.__new__(BlockReader)
        one.path, one.keys, one.size, one.kinds = self.path, {partition.key: None}, self.size, {partition.key: self.kinds["values"]}
        for batch in one.read(partition):
            yield pa.RecordBatch.from_arrays([pa.array([f"{partition.key}.npy"] * batch.num_rows), *batch.columns], ["file", "row_id", "values"])


def read_parts(spark: SparkSession, folder: str, rows: int = 100_000) -> DataFrame:
    """(file, row_id in the file, values) of a folder of .npy files of one width."""
    spark.dataSource.register(BlockSource)
    return spark.read.format("blocks").option("path", folder).option("rows", str(rows)).option("parts", "true").load()


def read_blocks(spark: SparkSession, path: str, keys: list[str] | None = None, rows: int = 100_000) -> DataFrame:
    """(row_id, a column for each key) of an .npz file, an .npy file or a folder of .npy files."""
    spark.dataSource.register(BlockSource)
    source = spark.read.format("blocks").option("path", path).option("rows", str(rows))
    return (source.option("keys", ",".join(keys)) if keys else source).load()


def write_blocks(df: DataFrame, folder: str) -> DataFrame:
    """Write (values) of each partition as an .npy file of float32 rows below ``folder``; returns (file, ids), a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyspark import TaskContext

        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
        if ids:
            store, at = _store(folder)
            store.create_dir(at, recursive=True)
            name = f"part-{TaskContext.get().partitionId():06d}.npy"
            data = io.BytesIO()
            np.save(data, np.array(rows, np.float32), allow_pickle=False)
            with store.open_output_stream(f"{at}/.{name}") as out:
                out.write(data.getvalue())
            store.move(f"{at}/.{name}", f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids], pa.list_(pa.int64()))], ["file", "ids"])

    return df.select("row_id", "values").mapInArrow(run, "file string, ids array<long>")
