"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """`body` with `value` bound to a lambda variable, so that it is evaluated once even where `body` reads it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a table into the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many staged tables of this process there are."""
    return len(_STAGED)


def clear_stages(spark: SparkSession, begin: int = 0, end: int | None = None) -> None:
    """Deletes the tables that this process has staged, those from `begin` to `end`; only after the results that read them are written."""
    for name in _STAGED[begin:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _STAGED[begin:end]
