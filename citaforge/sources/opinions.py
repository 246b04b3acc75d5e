"""Opinions from a folder of text files."""

from __future__ import annotations

import re
import unicodedata
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workers import reachable

_SCHEMA = "path string, content binary"


def text_paths(spark: SparkSession, folder: str) -> list[str]:
    """Text files of a folder, in order; those of folders inside only if it has none itself. Listed by Spark's file system, so hidden names count too."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(recurse: bool) -> list[str]:
        found, files = [], fs.listFiles(fs_path, recurse)
        while files.hasNext():
            path = files.next().getPath().toString()
            if re.search(r"\.txt$", path, re.IGNORECASE):
                found.append(path)
        return sorted(found)

    top = listed(False)
    if not top and (inside := listed(True)):
        warnings.warn(f"no text file in {folder}; reading the folders inside", stacklevel=2)
        return inside
    return top


def decode(content: Column) -> Column:
    """UTF-8 with invalid bytes replaced; line ends as they are."""
    return F.decode(F.make_valid_utf8(content).cast("binary"), "UTF-8")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed form; Spark has no function for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def from_files(files: DataFrame) -> DataFrame:
    """(documento_id, path, texto) from (path, content): the id is the name without its last suffix."""
    reachable(files.sparkSession)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("documento_id"), "path", nfc(decode(F.col("content"))).alias("texto"))


def read_opinions(spark: SparkSession, folder: str) -> DataFrame:
    paths = text_paths(spark, folder)
    if not paths:
        return spark.createDataFrame([], "documento_id string, path string, texto string")
    frame = spark.read.format("binaryFile").load([p.replace("{", "\\{").replace("[", "\\[") for p in paths]).select("path", "content")
    read = from_files(frame)
    hidden = [p for p in paths if re.search(r"/[._][^/]*$", p)]
    if hidden:  # Spark's readers skip these names
        rows = [(p, bytearray(_bytes(spark, p))) for p in hidden]
        read = read.unionByName(from_files(spark.createDataFrame(rows, _SCHEMA)))
    return read


def _bytes(spark: SparkSession, path: str) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
