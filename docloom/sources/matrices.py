"""Matrices of 32-bit floats as plain binary files, and tables whose rows belong together by position."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a task reads, unless told otherwise; rows that it hands over at a time.
TASK_BYTES, BATCH_ROWS = 1 << 26, 4096
MANIFEST = "_matrix.json"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Stretch(InputPartition):
    """Rows of a file that a task reads: its name, the first row in it, how many, and the first one's number in the matrix."""

    name: str
    start: int
    rows: int
    number: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 0))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        files, root = _at(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.Directory:
            with files.open_input_stream(f"{root}/{MANIFEST}") as f:
                manifest = json.loads(f.read())
            self.width = self.width or manifest["width"]
            self.names = [f"{root}/{n}" for n in manifest["files"]]
        elif info.type == fs.FileType.File:
            self.names = [root]
        else:
            raise FileNotFoundError(self.path)
        if self.width < 1:
            raise ValueError("the option width says how many numbers a row has")
        self.sizes = [files.get_file_info(n).size for n in self.names]
        if bad := [n for n, size in zip(self.names, self.sizes) if size % (4 * self.width)]:
            raise ValueError(f"not a multiple of {4 * self.width} bytes: {bad}")

    def partitions(self) -> list[Stretch]:
        step, out, number = max(1, self.task_bytes // (4 * self.width)), [], 0
        for name, size in zip(self.names, self.sizes):
            rows = size // (4 * self.width)
            out += [Stretch(name, at, min(step, rows - at), number + at) for at in range(0, rows, step)]
            number += rows
        return out

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no rows at all
            return
        files, _ = _at(self.path)
        with files.open_input_file(part.name) as f:
            f.seek(part.start * 4 * self.width)
            for at in range(0, part.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, part.rows - at)
                values = np.frombuffer(f.read(n * 4 * self.width), dtype="<f4")
                offsets = np.arange(0, (n + 1) * self.width, self.width, dtype=np.int32)
                yield pa.record_batch([pa.array(np.arange(part.number + at, part.number + at + n)), pa.ListArray.from_arrays(offsets, values)], names=["row", "vector"])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    width: int


class MatrixWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; the manifest, written last, makes those of the tasks that were committed the matrix."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        files, root = _at(self.path)
        if not overwrite and files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            raise FileExistsError(self.path)
        files.create_dir(root)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        partition, (files, root) = TaskContext.get().partitionId(), _at(self.path)
        name, rows, width = f"part-{partition:06d}-{uuid.uuid4().hex}.f32", 0, 0
        with files.open_output_stream(f"{root}/{name}") as f:
            for batch in batches:
                vectors = batch.column(0)
                values = vectors.flatten()
                lengths = np.diff(vectors.offsets.to_numpy())
                width = width or (int(lengths[0]) if len(lengths) else 0)
                if vectors.null_count or values.null_count or (lengths != width).any():
                    raise ValueError("a matrix has rows of one length without nulls")
                f.write(values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                rows += len(vectors)
        return Written(partition, name, rows, width)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        widths = {m.width for m in done}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"rows of several lengths: {sorted(widths)}")
        files, root = _at(self.path)
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"width": max(widths, default=1), "rows": sum(m.rows for m in done), "files": [m.name for m in done]}).encode())
        keep = {m.name for m in done} | {MANIFEST}
        for x in files.get_file_info(fs.FileSelector(root)):
            if x.base_name not in keep and x.base_name.endswith(".f32"):
                files.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _at(self.path)
        for m in messages:
            if m is not None and files.get_file_info(f"{root}/{m.name}").type == fs.FileType.File:
                files.delete_file(f"{root}/{m.name}")


class Matrix(DataSource):
    """``spark.read.format("f32matrix").option("width", 768).load(path)``: (row, vector). ``path``: a file, or a folder that was written by this source."""

    @classmethod
    def name(cls) -> str:
        return "f32matrix"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def read_matrix(spark: SparkSession, path: str, width: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(row, vector) of a matrix, rows numbered from 0, in tasks of about task_bytes. A size that isn't a multiple of a row's is refused."""
    spark.dataSource.register(Matrix)
    reader = spark.read.format("f32matrix").option("taskbytes", task_bytes)
    return (reader.option("width", width) if width else reader).load(path)


def write_matrix(df: DataFrame, path: str, vector: str, order: list) -> None:
    """The vectors in order, a file for each range of it; row n of the matrix is row n of df in that order. An older matrix there is replaced."""
    df.sparkSession.dataSource.register(Matrix)
    df.orderBy(*order).select(F.col(vector).cast("array<float>").alias("vector")).write.format("f32matrix").mode("overwrite").save(path)


def numbered_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``row``: its rows' numbers from 0, files by path and rows as they stand in each.

    A row's number is its index in the file plus the rows of the files before; only one count a file is summed up, never the rows themselves.
    """
    table = spark.read.parquet(path)
    placed = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = files.select("__file", before.alias("__before"))
    return placed.join(firsts, "__file").select(*table.columns, (F.col("__before") + F.col("__index")).alias("row"))


def joined_by_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row n of left beside row n of right, by their column ``row``. Tables of unequal lengths are refused."""
    (a,), (b,) = (df.agg(F.count("row")).first() for df in (left, right))
    if a != b:
        raise ValueError(f"{a} rows beside {b}")
    return left.join(right, "row")


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; a temporary one where Spark is local and none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docloom-")
    return f"{root}/matrix-{uuid.uuid4().hex}"
