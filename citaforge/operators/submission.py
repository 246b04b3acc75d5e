"""The tabular output: one cell per document, its checks, and the JSON contract."""

from __future__ import annotations

import contextlib
import csv
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import iou
from ..functions.lexicon import KINDS, LABELS, SCHEMA_VERSION
from .evaluate import MIN_IOU

HEADER = ("documento_id", "citacoes")
MISSING = "-"


def cells(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """(documento_id, citacoes) for every document; `-` if it has no citation. Blocks are inicio,fim,classe,id,confianca in order of place."""
    block = F.concat_ws(
        ",", F.col("inicio").cast("string"), F.col("fim").cast("string"), "classificacao",
        F.coalesce(F.when(F.col("classificacao") == "real", F.col("id_canonico").cast("string")), F.lit(MISSING)),
        F.coalesce(F.format_string("%.4f", F.col("confianca").cast("double")), F.lit(MISSING)),
    )
    block = F.when(F.col("confianca").isNull(), F.regexp_replace(block, ",[^,]*$", f",{MISSING}")).otherwise(block)
    packed = resolved.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("inicio", "fim", block.alias("b")))).alias("x"))
    joined = documents.select("documento_id").distinct().join(packed, "documento_id", "left")
    return joined.select("documento_id", F.coalesce(F.array_join(F.transform("x", lambda b: b["b"]), "|"), F.lit(MISSING)).alias("citacoes"))


def last_by_path(files: DataFrame) -> DataFrame:
    """Of documents with the same id the one with the last path."""
    return files.withColumn("n", F.row_number().over(Window.partitionBy("documento_id").orderBy(F.desc("path")))).where("n = 1").drop("n")


def repeated_ids(files: DataFrame) -> DataFrame:
    return files.groupBy("documento_id").agg(F.count("*").alias("n")).where("n > 1")


def write_csv(table: DataFrame, path: str) -> None:
    """One CSV in the order of `id.json`, CRLF line ends, written beside and then moved, so that a reader sees the old file or the whole new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            out = csv.writer(file)
            out.writerow(HEADER)
            out.writerows(tuple(r) for r in table.select(*HEADER).orderBy(F.concat("documento_id", F.lit(".json"))).toLocalIterator())
        mask = os.umask(0)
        os.umask(mask)
        with contextlib.suppress(OSError):
            os.chmod(name, 0o666 & ~mask)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def contract_json(documents: DataFrame, resolved: DataFrame, source: str = "base") -> DataFrame:
    """(documento_id, json): the output contract of each document, citations numbered c1, c2, … by place; `source` names the base."""
    real = (F.col("classificacao") == "real") & F.col("id_canonico").isNotNull()
    resolution = F.when(real, F.struct(F.lit(source).alias("fonte"), F.col("id_canonico").cast("string").alias("id_canonico")))
    number = F.row_number().over(Window.partitionBy("documento_id").orderBy("inicio", "fim"))
    one = F.struct(F.concat(F.lit("c"), F.col("n").cast("string")).alias("id"), "inicio", "fim", "trecho", "tipo", "classificacao", resolution.alias("resolucao"), F.round("confianca", 4).alias("confianca"))
    packed = resolved.withColumn("n", number).groupBy("documento_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("c")))), lambda x: x["c"]).alias("citacoes"))
    kind = packed.schema["citacoes"].dataType.simpleString()
    joined = documents.select("documento_id").distinct().join(packed, "documento_id", "left")
    whole = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "documento_id", F.coalesce("citacoes", F.array().cast(kind)).alias("citacoes"))
    return joined.select("documento_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def write_json(contracts: DataFrame, folder: str) -> int:
    """One indented UTF-8 file per document; how many. A confidence that is null is left out."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for document, text in contracts.select("documento_id", "json").toLocalIterator():
        data = json.loads(text)
        for c in data["citacoes"]:
            if c["confianca"] is None:
                del c["confianca"]
        Path(folder, f"{document}.json").write_text(json.dumps(data, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
        n += 1
    return n


def contract_problems(resolved: DataFrame, opinions: DataFrame | None = None) -> DataFrame:
    """(documento_id, id, problema) for each rule of the contract that a citation breaks; with opinions also that `trecho` stands at its offsets."""
    repeated = F.count("*").over(Window.partitionBy("documento_id", "id")) > 1
    j = resolved.withColumn("repetido", repeated)
    rules: dict[str, Column] = {
        "id repetido": F.col("repetido"),
        "campo ausente": F.col("id").isNull() | F.col("inicio").isNull() | F.col("fim").isNull() | F.col("trecho").isNull(),
        "tipo inválido": ~F.coalesce(F.col("tipo").isin(*KINDS), F.lit(False)),
        "classificacao inválida": ~F.coalesce(F.col("classificacao").isin(*LABELS), F.lit(False)),
        "span inválido": (F.col("inicio") < 0) | (F.col("fim") <= F.col("inicio")),
        "real exige id_canonico": (F.col("classificacao") == "real") & F.col("id_canonico").isNull(),
        "resolucao deve ser null": (F.col("classificacao") != "real") & F.col("id_canonico").isNotNull(),
        "confianca fora de [0, 1]": ~F.coalesce("confianca", F.lit(0.0)).between(0.0, 1.0),
    }
    if opinions is not None:
        j = j.join(opinions.select("documento_id", "texto"), "documento_id", "left")
        rules["trecho não corresponde"] = ~F.col("trecho").eqNullSafe(F.expr("substring(texto, inicio + 1, fim - inicio)"))
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return j.select("documento_id", "id", F.explode(found).alias("problema"))


def submission_problems(table: DataFrame, expected: DataFrame | None = None, min_iou: float = MIN_IOU) -> DataFrame:
    """(documento_id, posicao, problema): documents without a row, blocks of a wrong form, and pairs of blocks that overlap too much."""
    blocks = table.select("documento_id", F.posexplode(F.split(F.trim(F.coalesce("citacoes", F.lit(""))), r"\|")).alias("p", "block"))
    blocks = blocks.where(~F.trim("block").isin("", MISSING)).select("documento_id", (F.col("p") + 1).alias("posicao"), F.transform(F.split("block", ","), lambda v: F.trim(v)).alias("f"))
    whole = F.size("f") == 5
    at = lambda i: F.get(F.col("f"), F.lit(i))
    span = at(0).rlike("^[0-9]+$") & at(1).rlike("^[0-9]+$") & (F.try_to_number(at(1), F.lit("9" * 18)) > F.try_to_number(at(0), F.lit("9" * 18)))
    value = at(4).try_cast("double")
    stated = ~at(4).isin("", MISSING)
    rules = {
        "campos": ~whole,
        "span": whole & ~F.coalesce(span, F.lit(False)),
        "classe": whole & span & ~at(2).isin(*LABELS),
        "id": whole & span & (at(2) == "real") & ~at(3).rlike("^[0-9]+$"),
        "confianca": whole & span & stated & ~F.coalesce(value.between(0.0, 1.0), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())
    out = blocks.select("documento_id", "posicao", F.explode(found).alias("problema"))
    spans = blocks.where(whole & span).select("documento_id", "posicao", at(0).cast("bigint").alias("a"), at(1).cast("bigint").alias("b"))
    other = spans.select("documento_id", F.col("posicao").alias("q"), F.col("a").alias("c"), F.col("b").alias("d"))
    pairs = spans.join(other, "documento_id").where("posicao < q and b > c and d > a")
    out = out.unionByName(pairs.where(iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")) >= min_iou).select("documento_id", "posicao", F.lit("iou").alias("problema")))
    if expected is not None:
        lost = expected.select("documento_id").distinct().join(table, "documento_id", "left_anti")
        out = out.unionByName(lost.select("documento_id", F.lit(0).alias("posicao"), F.lit("sem linha").alias("problema")))
    return out


def first_rows(table: DataFrame, documents: DataFrame) -> DataFrame:
    """A submission as the evaluation reads it: of repeated documents the first row (by `linha`), `-` for those without any."""
    first = table.groupBy("documento_id").agg(F.min_by("citacoes", "linha").alias("citacoes"))
    return documents.select("documento_id").distinct().join(first, "documento_id", "left").select("documento_id", F.coalesce("citacoes", F.lit(MISSING)).alias("citacoes"))


def summary(resolved: DataFrame) -> DataFrame:
    """Citations by label."""
    return resolved.groupBy("classificacao").agg(F.count("*").alias("n"))
