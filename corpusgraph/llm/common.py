"""Shared pieces: the shared work folder and the Arrow plumbing of the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a broadcast side at most; beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 200_000

#: For tables of long rows: Parquet looks at a page's and a row group's bytes only after 100 rows,
#: and all of a row group is in memory where it is written and read, its pages in direct memory too.
LONG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset on one
    machine (local mode, as in tests) a new temporary folder, which is then set as checkpoint folder.

    On a cluster an unset folder is an error: executors would write to their own disks and others
    would read nothing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_RESIDENT: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]) -> object:
    """One large object, such as a vocabulary with its kept words, per Python worker.

    Workers are used again by later stages; the next stage's object takes the place of the last.
    """
    if name not in _RESIDENT:
        release()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def release() -> None:
    """Lets go of what is resident, and gives its memory back to the system, which others need next."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library of other systems may lack it
            ctypes.CDLL(None).malloc_trim(0)


class Workspace:
    """Tables written to the shared folder, which cut the lineage and survive lost executors."""

    _open: list[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if Workspace._open:
            Workspace._open[-1].append(self)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no returned frame reads any more; the whole workspace without names."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for where in [f"{self.path}/{name}" for name in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(where)
            with contextlib.suppress(Exception):  # an undeleted work table costs disk only
                path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes the workspaces that were opened in the block: for callers that have written their result."""
    Workspace._open.append([])
    try:
        yield
    finally:
        for work in Workspace._open.pop():
            work.drop()


def packed(keep: list[str]) -> Column:
    """The kept columns as one column, so that their names can't meet those an operator uses."""
    return F.struct(*[F.col(f"`{k}`") for k in keep] or [F.lit(None).cast("boolean").alias("none")]).alias("__keep")


def unpacked(keep: list[str], own: list[str]) -> list[Column]:
    """The kept columns again; where the operator returns a column of the same name, that one stands."""
    return [F.col(f"__keep.`{k}`").alias(k) for k in keep if k not in own]


#: What tells rows apart, beside their content: the file and the place in it.
ROW_KEY = ["__file", "__place"]


def _is_table(df: DataFrame) -> bool:
    """Whether a frame is a table of files, perhaps with fewer rows and other columns, but no row twice."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def with_row_key(docs: DataFrame, work: Workspace) -> DataFrame:
    """docs and ROW_KEY: a key of each row that stays as it is whenever the table is read again.

    Rows of a Parquet table have one; any other frame is written first.
    """
    key = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place")]
    with contextlib.suppress(AnalysisException):  # tables of other formats have no row numbers
        if _is_table(docs):
            return docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key)
    docs = work.save(docs, "rows")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key)


def join_small(big: DataFrame, small: DataFrame, on: list[str] | str, how: str, small_rows: int) -> DataFrame:
    """Joins on keys; the small side is broadcast only if it has at most BROADCAST_ROWS rows.

    Beyond that it is a sort-merge join, whose hot keys adaptive execution splits.
    """
    return big.join(F.broadcast(small) if small_rows <= BROADCAST_ROWS else small, on, how)


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a row is never cut, so a longer one stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def map_text(df: DataFrame, text: str, keep: list[str], added: str, work: Callable[..., dict[str, object]], most: int = 1 << 20, uses_resident: bool = False) -> DataFrame:
    """Runs work(bytes, offsets, rows) over blocks of whole texts and returns one row per text.

    `keep` columns of the input are passed on and stand first. work gives the columns that `added`
    lists as DDL by name, each an array of one value per row of the block. What reaches Python at
    once is bounded by Spark's bytes per Arrow batch, what is worked on at once by `most`. Unless
    work uses it, what an earlier stage left resident in a worker goes.
    """
    added_fields = _parse_datatype_string(added)
    kept = df.select(*keep)
    fields = added_fields.fieldNames()
    schema = StructType([*kept.schema.fields, *added_fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not uses_resident:
            release()
        for batch in batches:
            data, offsets = utf8_parts(batch.column(batch.schema.get_field_index("__text")))
            for a, b in row_blocks(offsets, most):
                part = batch.slice(a, b - a)
                got = work(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], part)
                arrays = [part.column(i) for i in range(len(keep))] + [x if isinstance(x := got[f], pa.Array) else pa.array(x) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *fields])

    return df.select(*[F.col(k) for k in keep], F.col(text).alias("__text")).mapInArrow(run, schema)


def strings(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The rows as Python strings; bytes that are no UTF-8 are replaced."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
