"""Small tables from CSV and spreadsheet files, and archives."""

from __future__ import annotations

import hashlib
import re
import shutil
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = ("nivel", "documento_id", "citacao_id", "inicio", "fim", "trecho", "tipo", "classificacao", "id_canonico")
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of a CSV in UTF-8 with or without a byte order mark, and `linha`, the row's place; a missing column is an error."""
    frame = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', encoding="UTF-8")
    frame = frame.toDF(*[c.lstrip("﻿") for c in frame.columns])
    if missing := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return frame.select(*columns).withColumn("linha", F.monotonically_increasing_id())


def typed_gold(frame: DataFrame) -> DataFrame:
    """A gold set with whole numbers: ids written as decimals (`123.0`) are whole too, empty ones null."""
    whole = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), r"\.0+$", "").try_cast("bigint")
    kinds: dict[str, Column] = {c: whole(c).cast("int") for c in ("nivel", "inicio", "fim")} | {"id_canonico": whole("id_canonico")}
    return frame.select(*[kinds.get(c, F.col(c).cast("string")).alias(c) for c in GOLD])


def sheet_rows(path: str | Path) -> Iterator[dict[str, str]]:
    """Rows of the first sheet of a spreadsheet by the names of its first row."""
    with zipfile.ZipFile(path) as z:
        words = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))
        shared = [words(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))

    def value(cell: ET.Element) -> str:
        if cell.get("t") == "inlineStr":
            return words(cell)
        text = cell.findtext(f"{_SHEET}v") or ""
        return shared[int(text)] if cell.get("t") == "s" else text

    names: dict[str, str] = {}
    for row in sheet.iter(f"{_SHEET}row"):
        cells = {re.match("[A-Z]+", c.get("r", "A"))[0]: value(c) for c in row.iter(f"{_SHEET}c")}
        if names:
            yield {name: cells.get(k, "") for k, name in names.items()}
        else:
            names = cells


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A gold set from a spreadsheet, typed."""
    rows = [tuple(r.get(c, "") for c in GOLD) for r in sheet_rows(path)]
    return typed_gold(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in GOLD)))


def extract(archive: str | Path, target: str | Path, root: str = "") -> list[Path]:
    """Files of a zip without the folder `root` and without what a desktop system leaves; nothing is written outside `target`."""
    done, target = [], Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            parts = [p for p in Path(info.filename).parts if p not in ("/", "..")]
            parts = parts[1:] if parts[:1] == [root] else parts
            if info.is_dir() or not parts or parts[0] == "__MACOSX" or parts[-1] == ".DS_Store":
                continue
            path = target.joinpath(*parts)
            path.parent.mkdir(parents=True, exist_ok=True)
            with z.open(info) as source, path.open("wb") as out:
                shutil.copyfileobj(source, out)
            done.append(path)
    return done


def sha256(path: str | Path) -> str:
    with Path(path).open("rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
