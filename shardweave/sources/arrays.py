"""Numeric files by byte ranges (A6, A11, B1): .npy arrays and raw floats of any size, read and written in parts by many tasks.

Paths are those Spark takes; tasks open them with Arrow's file systems. A file's
header is read by the task that lists it; after that every range is a row, and
ranges are dealt to tasks, so no file is ever held whole.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 32 << 20  # bytes a range
_HEAD = "path string, kind string, at long, rows long, width long, apart boolean"
_RANGE = "path string, kind string, at long, rows long, width long, apart boolean, first long, last long"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if (local := re.sub(r"^file:/+", "/", path)).startswith("/"):
        return pyarrow.fs.LocalFileSystem(), local
    return pyarrow.fs.FileSystem.from_uri(path)


def _header(path: str) -> tuple[str, int, tuple[int, ...], bool]:
    """(dtype, offset of the data, shape, whether columns lie together)."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        head = io.BytesIO(f.read_at(min(f.size(), 4096), 0))
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(head) == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(head)
    return kind.str, head.tell(), shape, fortran


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length); contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _ranges(heads: DataFrame) -> DataFrame:
    per = F.greatest(F.lit(1), F.floor(F.lit(CHUNK) / (F.col("width") * F.substring("kind", 3, 2).cast("int")))).cast("long")
    starts = heads.where("rows > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, per)))
    return starts.withColumn("last", F.least(F.col("first") + per, F.col("rows"))).repartition("path", "first")


def _read(ranges: DataFrame, name: str, listed: bool, whole: bool, single: bool = False) -> DataFrame:
    """(path, row, ``name``) of each range's rows; a row is a number, or a list where ``listed``."""
    cell = pa.int64() if whole else pa.float32() if single else pa.float64()
    kind = pa.list_(cell) if listed else cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, at = _open(r["path"])
                dtype, n, width = np.dtype(r["kind"]), r["last"] - r["first"], r["width"]
                with fs.open_input_file(at) as f:
                    if r["apart"]:
                        cols = [np.frombuffer(f.read_at(n * dtype.itemsize, r["at"] + (c * r["rows"] + r["first"]) * dtype.itemsize), dtype) for c in range(width)]
                        m = np.stack(cols, axis=1)
                    else:
                        m = np.frombuffer(f.read_at(n * width * dtype.itemsize, r["at"] + r["first"] * width * dtype.itemsize), dtype).reshape(n, width)
                m = m.astype(cell.to_pandas_dtype())
                for i in range(0, n, 8192):
                    part = np.ascontiguousarray(m[i : i + 8192])
                    flat = pa.array(part.ravel())
                    values = pa.FixedSizeListArray.from_arrays(flat, width).cast(kind) if listed else flat
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(part)), pa.array(np.arange(r["first"] + i, r["first"] + i + len(part))), values], names=["path", "row", name])

    spark_cell = "long" if whole else "float" if single else "double"
    return ranges.mapInArrow(run, f"path string, row long, {name} {f'array<{spark_cell}>' if listed else spark_cell}")


def _heads(spark: SparkSession, path: str, pairs: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                kind, at, shape, apart = _header(p)
                rows_, width = (shape[0], prod(shape[1:])) if shape else (1, 1)
                if pairs and shape[0] == 2 and len(shape) == 2 and shape[1] != 2:  # two rows of ids: read as columns that lie together
                    rows_, width, apart = shape[1], 2, not apart
                rows.append((p, kind, at, rows_, width, apart and width > 1))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "kind", "at", "rows", "width", "apart"])

    return _files(spark, path).select("path").mapInArrow(run, _HEAD)


def read_npy(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(path, row, value) of .npy files: 1-D arrays give numbers, others a list a row; floats come as doubles, integers as longs.

    Either order of cells in the file will do. All files of ``path`` are alike.
    """
    first = _files(spark, path).orderBy("path").first()
    if first is None:
        raise FileNotFoundError(path)
    kind, _, shape, _ = _header(first["path"])
    return _read(_ranges(_heads(spark, path, False)), name, len(shape) > 1, np.dtype(kind).kind in "iub")


def read_npy_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, eid) of an edge array, two rows of ids or two columns; eid is the place in the file (C3). An array of two by two has a row an edge."""
    rows = _read(_ranges(_heads(spark, path, True)), "ends", True, True)
    return rows.select(F.col("ends")[0].alias("src"), F.col("ends")[1].alias("dst"), F.col("row").alias("eid"))


def read_raw_floats(spark: SparkSession, path: str, width: int, kind: str = "<f4") -> DataFrame:
    """(row, feat) of raw numbers, ``width`` a row (A6), or (row, value) where ``width`` is 1; what is left of the last row is not read."""
    size = np.dtype(kind).itemsize
    heads = _files(spark, path).select("path", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("at"), F.floor(F.col("length") / (width * size)).cast("long").alias("rows"), F.lit(width).cast("long").alias("width"), F.lit(False).alias("apart"))
    return _read(_ranges(heads), "feat" if width > 1 else "value", width > 1, False, True).drop("path")


def write_npy(rows: DataFrame, path: str, column: str, order: str, kind: str = "<f4", parts: int | None = None) -> int:
    """Write ``column`` (numbers, or lists of one length) in order of ``order`` as .npy files part-00000.npy... under ``path``.

    A task writes a file; files follow each other in order. Returns how many
    rows were written. A task that runs again writes the same file again.
    """
    dealt = rows.select(order, column).repartitionByRange(*([parts] if parts else []), order).sortWithinPartitions(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for b in batches:
            if b.num_rows:
                c = b.column(1)
                made.append(np.asarray(c.flatten() if pa.types.is_list(c.type) else c).astype(kind).reshape((b.num_rows, -1) if pa.types.is_list(c.type) else -1))
        if made:
            out = io.BytesIO()
            np.save(out, np.concatenate(made))
            fs, at = _open(path)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/part-{TaskContext.get().partitionId():05d}.npy") as f:
                f.write(out.getbuffer())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, made))], pa.int64())], names=["n"])

    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
