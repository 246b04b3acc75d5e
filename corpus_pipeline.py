"""The corpus pipeline: each stage takes the documents that the one before it left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citaforge.llm import decontaminate, mixing, quality_rules, simhash, token_files
from citaforge.llm.common import clear_stages, stage, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: fingerprints, the sampling order and the token files have none.
ORACLE_SQL = None


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows and ties are judged alike; texts of any length are judged whole; an empty table gives an empty one; columns beyond those of documents are dropped."""
    return quality_rules.apply_rules(docs.select(*COLUMNS)).where("quality.kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (pairs from balls of SimHash fingerprints, then from shingles for what no ball reaches; all confirmed at a similarity of 0.8 on five words) the document with the smallest doc_id, a null one last, and of equal ids the smallest text hash; ids don't group documents. Texts without words are alike; of equal rows one stays; an empty table gives an empty one."""
    found = simhash.similar_rows(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("kept_id"), F.col("x.mark").alias("kept_mark"))
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi").dropDuplicates(["doc_id", "mark"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item: one leaked item is enough to go. Null and empty texts have no window and stay; repeated rows are judged alike and stay; an empty table of either kind is none to compare."""
    rows = docs.select(F.struct(*COLUMNS).alias("doc_id"), "text")  # the operator gives each row's columns back
    found = decontaminate.find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.col("n_hit") == 0).select("doc_id.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null texts have size 0 and come as often as the complete epochs; null sources are one source; repeated rows are documents of their own; ties of keys go by id and text; an empty table gives an empty one."""
    rows = stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "mix-rows")
    mixed = mixing.mix(rows, carry=("row",)).where("epochs > 0").select("row", "epochs")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs")))
    return rows.join(mixed, "row").select(*COLUMNS, times.alias("epoch")).drop("epoch")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of doc_id, read back: (doc_id, start, n_tokens, ids_crc32) per copy. Null ids come first, null texts have the end id alone; of equal ids the smaller text comes first; an empty table gives no file."""
    import public_tokenizers

    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_by_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(STAGES) - 1
    for k, (_, f) in enumerate(STAGES):
        begin = staged()
        docs = f(spark, docs, sf_dir)
        if k < last:
            docs = stage(docs, "pipeline")
            clear_stages(spark, begin - (k > 0), staged() - 1)  # what the stage has written beside its result, and its input
    return docs
