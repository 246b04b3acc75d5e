"""Opinions that arrive in a folder, verified as they come.

The base is static, so each micro-batch is the batch plan: no state and no
watermark. Every batch is written by `foreachBatch` under its own number, so a
batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Base
from ..plans.verify import verify
from ..sources.opinions import from_files


def watch(spark: SparkSession, folder: str, base: Base, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query over new `.txt` files; `once` ends it when those present are done."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    writer = files.select("path", "content").writeStream.foreachBatch(lambda batch, n: sink(verify(from_files(batch), base), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_parquet(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own."""
    return lambda frame, n: frame.write.mode("overwrite").parquet(f"{folder}/batch={n}")
