"""mapInArrow with plain column access, for the operators that need code of their own."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_ROOT = str(Path(__file__).resolve().parents[2])


def _reachable(spark: SparkSession) -> None:
    """Local workers import this package from where the driver has it; a cluster ships it with --py-files."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, _ROOT])


def map_batches(df: DataFrame, body: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, object]]], schema: T.StructType) -> DataFrame:
    """`body` gets the record batches of a partition and yields dicts of columns (lists or Arrow arrays)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    _reachable(df.sparkSession)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in body(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return batch.column(name).cast(pa.binary()).to_pylist()
