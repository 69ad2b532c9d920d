"""Vectors as array Columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: list[float] | Column) -> Column:
    """The cosine similarity; null for other dimensions or a vector of zeros."""
    if isinstance(b, list):
        n = float(sum(x * x for x in b)) ** 0.5
        v = F.array(*[F.lit(float(x)) for x in b])
        return F.when(F.size(a) == len(b), F.try_divide(dot(a, v), norm(a) * n))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


#: Keys whose sums a task holds before it passes them on, and the parts into which a key's sums are dealt.
HELD_KEYS, PARTS = 1000, 32


def _added(sums: dict, key, x: np.ndarray, n: np.ndarray) -> None:
    if key in sums and len(sums[key][0]) >= len(x):
        sums[key][0][: len(x)] += x
        sums[key][1][: len(n)] += n
    else:
        old = sums.get(key)
        sums[key] = [x.copy(), n.copy()]
        if old:
            sums[key][0][: len(old[0])] += old[0]
            sums[key][1][: len(old[1])] += old[1]


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): element-wise means; of vectors of several lengths each counts where it has elements.

    Tasks add vectors up before anything is shuffled, and a key's sums meet in two steps, so a row is
    shuffled for each key and task, and no key is a hot one.
    """
    kind = df.schema[key].dataType
    schema = StructType([StructField("key", kind), *_parse_datatype_string("sums array<double>, counts array<long>, part int").fields])

    def rows(sums: dict, part: int, key_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(list(sums), key_type), pa.array([x.tolist() for x, _ in sums.values()], pa.list_(pa.float64())), pa.array([n.tolist() for _, n in sums.values()], pa.list_(pa.int64())), pa.array([part] * len(sums), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        part = TaskContext.get().partitionId() % PARTS
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if v.is_valid:
                    x = v.values.to_numpy(zero_copy_only=False).astype(float)
                    known = ~np.isnan(x)
                    _added(sums, k, np.where(known, x, 0.0), known.astype(np.int64))
                if len(sums) >= HELD_KEYS:
                    yield rows(sums, part, batch.schema.field(0).type)
                    sums = {}
        if sums:
            yield rows(sums, part, batch.schema.field(0).type)

    def combined(table: pa.Table) -> pa.Table:
        sums: dict = {}
        for x, n in zip(table.column("sums"), table.column("counts"), strict=True):
            _added(sums, None, x.values.to_numpy().astype(float), n.values.to_numpy())
        x, n = sums[None]
        first = table.slice(0, 1)
        return pa.table({"key": first.column("key"), "sums": pa.array([x.tolist()], pa.list_(pa.float64())), "counts": pa.array([n.tolist()], pa.list_(pa.int64())), "part": first.column("part")})

    own = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(partial, schema)
    for keys in (["key", "part"], ["key"]):
        own = own.groupBy(*keys).applyInArrow(combined, schema)
    mean = F.zip_with("sums", "counts", lambda x, n: F.try_divide(x, n.cast("double")))
    return own.select(F.col("key").alias(key), mean.alias(vector))
