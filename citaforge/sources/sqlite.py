"""A read-only data source for the canonical base in SQLite."""

from __future__ import annotations

import sqlite3
import warnings
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.workers import reachable

_COLUMNS = ("documento_id", "id", "tribunal", "natureza", "texto", "texto_len")
SCHEMA = "documento_id string, id string, tribunal string, natureza string, texto string, texto_len bigint, posicao bigint"


def _whole(value: object) -> int | None:
    """An id or length: whole numbers, floats without a fraction, digits as text; never a truth value."""
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        return int(value) if value.strip().isdigit() else None
    return int(value) if isinstance(value, int | float) and value == int(value) else None


def rows(path: str, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """Rows of `documentos` in the order of the file. If the file can't be read as it is, once more as immutable."""

    def scan(more: str) -> list[tuple]:
        link = sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro" + more, uri=True)
        link.text_factory = lambda b: b.decode("utf-8", errors="replace")
        try:
            return link.execute(f"select {', '.join(_COLUMNS)} from documentos limit ? offset ?", (-1 if last is None else last - first, first)).fetchall()
        finally:
            link.close()

    try:
        found = scan("")
    except sqlite3.OperationalError as error:
        warnings.warn(f"reading {path} failed ({error}); once more as immutable", stacklevel=2)
        found = scan("&immutable=1")
    for n, (document, key, court, nature, text, length) in enumerate(found, first):
        word = lambda v: None if v is None else str(v)
        yield word(document), word(_whole(key)), word(court), word(nature), text if isinstance(text, str) else None, _whole(length), n


class _Part(InputPartition):
    def __init__(self, first: int, last: int | None) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    """Parts of `rows` rows each, so a task holds no more than that."""

    def __init__(self, options) -> None:
        self.path, self.size = options["path"], int(options.get("rows", "20000"))

    def partitions(self) -> list[InputPartition]:
        try:
            link = sqlite3.connect(Path(self.path).resolve().as_uri() + "?mode=ro", uri=True)
            n = link.execute("select count(*) from documentos").fetchone()[0]
        except sqlite3.OperationalError:
            link = sqlite3.connect(Path(self.path).resolve().as_uri() + "?mode=ro&immutable=1", uri=True)
            n = link.execute("select count(*) from documentos").fetchone()[0]
        finally:
            link.close()
        return [_Part(i, min(n, i + self.size)) for i in range(0, n, self.size)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from rows(self.path, partition.first, partition.last)


class SqliteBase(DataSource):
    """spark.read.format("sqlite_base").load(path); option `rows`: rows of a partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_base"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_base(spark: SparkSession, path: str, rows_per_part: int = 20000) -> DataFrame:
    reachable(spark)
    spark.dataSource.register(SqliteBase)
    return spark.read.format("sqlite_base").option("rows", rows_per_part).load(path)
