"""Mixing sources to target weights by Efraimidis-Spirakis sampling; built-in functions only.

Each document draws an exponential key whose rate is its quality weight. Of
each source the mix takes as many complete epochs as its target holds, and
then, in the order of the keys, the documents whose running size fits into the
rest, and the one document that fills what is left best. The running sum of a source is found in two steps: sums of key ranges,
then the rows of the one range in which the budget ends. So no task holds a
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, stage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Key ranges per source; a range holds this part of a source on average.
RANGES = 4096
SEED = 20240607


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return let(plain, lambda p: F.when(p == "", F.lit(0)).otherwise(F.size(F.split(p, " +")))).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 to 1: higher the smaller the share of digits and symbols."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(t, "0123456789#*$%&|<>@_=+/\\{}[]^~", ""))
    return F.lit(0.5) + F.lit(0.5) * plain / F.greatest(F.length(t), F.lit(1))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh `weights` in turn and share `share`
    of all sizes; none gets over `max_epochs` times its size, what exceeds that
    is shared anew by weight. That is one water level: the sources under it are
    filled up, and the order of size by weight tells which.
    """
    everywhere = Window.partitionBy()
    rank = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    up = everywhere.orderBy("full_at", F.col("source").asc_nulls_last())
    t = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everywhere) * F.lit(float(share)))
    t = t.withColumn("filled", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    # the level at the first source that it does not fill
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(everywhere)["level"])
    return t.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, ranges: int = RANGES, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, epochs, taken) per document.

    epochs: how often the mix takes the document; taken: its words times that.
    Keys depend on doc_id, text hash and seed alone, so reruns agree. Null
    texts have size 0 (taken 0, and as many epochs as the complete ones); null
    sources are one source, the last; of equal keys the smaller (doc_id, hash)
    comes first, and repeated rows are documents of their own. An empty table
    gives an empty one. Columns named in `carry` come back with their rows.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    draw = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mark"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"), mark.alias("mark"), *carry)
    slim = slim.withColumn("key", -F.log(draw) / F.col("weight")).withColumn("range", F.floor(F.lit(ranges) * (1 - F.exp(-F.col("key")))).cast("int"))
    slim = stage(slim.select("doc_id", "source", "size", "mark", "key", "range", F.monotonically_increasing_id().alias("uid"), *carry), "mix-keys")

    by_range = slim.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("whole", F.least(F.lit(max_epochs), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))).withColumn("rest", F.when(F.col("whole") >= max_epochs, F.lit(0.0)).otherwise(F.col("target") - F.col("whole") * F.col("source_size")))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as sources times ranges at most
    plan = by_range.withColumn("before", before).join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = stage(plan, "mix-plan").withColumnRenamed("source", "of").withColumnRenamed("range", "of_range")
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range"))).drop("of", "of_range")
    inside, out = F.col("before") + F.col("range_size") <= F.col("rest"), F.col("before") >= F.col("rest")
    cols = ["doc_id", "source", "size", "source_size", "target", *carry]
    sure = rows.where(inside | out).select(*cols, "whole", "uid", "key", (inside & ~out).alias("in_rest"))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "mark", "uid").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(~(inside | out)).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("fits", F.col("ahead") + F.col("size") <= F.col("rest"))
    edge = stage(edge.select(*cols, "whole", "rest", "ahead", "uid", "key", "fits"), "mix-edge")
    # what is left of a source's budget, and the document outside that fills it best
    left = edge.groupBy("source").agg(F.min("rest").alias("rest"), F.max(F.when(F.col("fits"), F.col("ahead") + F.col("size")).otherwise(0)).alias("filled"), F.min("ahead").alias("start"))
    left = left.select(F.col("source").alias("of"), (F.col("rest") - F.greatest("filled", "start")).alias("left"))
    spare = sure.where(~F.col("in_rest")).select("source", "uid", "key", "size").unionByName(edge.where("not fits").select("source", "uid", "key", "size"))
    miss = F.abs(F.col("size") - F.col("left"))
    last = spare.join(left, F.col("source").eqNullSafe(F.col("of"))).where(miss < F.col("left")).groupBy("source").agg(F.min(F.struct(miss, "key", "uid"))["uid"].alias("last_uid")).select("last_uid")
    picked = sure.select(*cols, "uid", "whole", "in_rest").unionByName(edge.select(*cols, "uid", "whole", F.col("fits").alias("in_rest")))
    picked = picked.join(last, F.col("uid") == F.col("last_uid"), "left")  # one row per source
    epochs = F.col("whole") + (F.col("in_rest") | F.col("last_uid").isNotNull()).cast("int")
    return picked.select(*cols, epochs.cast("long").alias("epochs")).withColumn("taken", F.col("epochs") * F.col("size"))
