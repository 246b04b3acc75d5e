"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most two bits share a variant: each
emits itself and its 64 one-bit changes, rows are shuffled by variant, and of
those that meet only a bit mask is gathered. A variant can meet 65 different
fingerprints at most, so no group grows with the data; copies are folded into
their fingerprint before.

`similar_documents` serves a similarity. The balls and their components come
first, and each link of theirs is confirmed by its exact similarity. Texts that
share 0.8 of their 5-word shingles may differ in some 10 of 64 bits, too far for
a ball; for those there is an exact way: by the prefix filter two such texts
share one of the first shingles of each in an order that all texts have in
common, and pairs that meet there and aren't joined yet are confirmed likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_batches, utf8
from .common import clear_stages, stage, staged

SHINGLE_WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ; the variants cover half of it.
RADIUS = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; lanes of 255 rows are summed in bytes."""
    rows = -len(hashes) % 255
    bits = np.unpackbits(np.concatenate([hashes, np.zeros(rows, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def simhash(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text in UTF-8: a bit is 1 if set in over half the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    w = (text or b"").translate(_LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    starts = list(accumulate([len(x) + 1 for x in w], initial=0))
    ends = starts[shingle:] or starts[-1:]
    hashes = np.fromiter([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)], np.uint64)
    return int(np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) per row; fp is the unsigned fingerprint as a signed long."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = np.array([simhash(t, shingle) for t in utf8(b, "text")], np.uint64)
            yield {"doc_id": b.column("doc_id"), "fp": pa.array(found.view(np.int64))}

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return map_batches(docs.select("doc_id", "text"), body, schema)


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints `fp` at two bits at most: each member of a variant's group to its smallest. They connect what all such pairs would."""

    def flipped(fp: Column, b: Column) -> Column:
        return fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))

    each = lambda b: F.struct(F.when(b < 64, flipped(F.col("fp"), b)).otherwise(F.col("fp")).alias("v"), F.when(b < 64, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")).alias("mask"), (b == 64).cast("int").alias("own"))
    # few bytes become 65 rows each, so they are dealt out before
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = spread.select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(64)), each)))
    met = variants.groupBy("v").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where(F.bit_count("mask") + F.col("own") > 1)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1).cast("long")) == 1)
    members = F.concat(F.transform(bits, lambda b: flipped(F.col("v"), b)), F.when(F.col("own") == 1, F.array("v")).otherwise(F.array().cast("array<bigint>")))
    links = met.select(members.alias("m")).select(F.explode("m").alias("a"), F.array_min("m").alias("b"))
    return links.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b), root the smallest node reachable: large-star and small-star steps until nothing changes, each written out. A hub's links meet as a minimum and a join, never in one group."""
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    last = mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a != b").distinct()
        edges = stage(small, "links")
        if (now := mark(edges)) == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row (doc_id, fp, component_id) per document.

    component_id: the smallest doc_id reachable over links of two bits at
    most. Null and empty texts have fingerprint 0 and are linked like others;
    repeated rows stay, each with its component; null ids are ignored in the
    smallest id; other columns are not read; an empty table gives an empty one.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected(ball_links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stage(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


# -- by similarity ---------------------------------------------------------------

#: One text in so many is sampled to count the common shingles, and how many shingles are told apart by it; both set the order only.
SAMPLED, COMMON = 4, 1 << 20
#: Members of one part of a shingle's group that are gathered in a row; more make several rows.
GATHERED = 500
#: Bits of an id by which texts are looked up before they are joined; the filter has 2 ** (LOOKUP_BITS - 3) bytes at any size of the corpus.
LOOKUP_BITS = 26


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; all words are one if there are fewer."""
    from xxhash import xxh64_intdigest

    w = (text or b"").translate(_LOWER).split()
    words = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    k = max(1, min(shingle, len(words)))
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9FB21C651E98DF25) + words[j : len(words) - k + 1 + j]
    return np.unique(_mix(grams))


def _set_id(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of the texts, ascending, and how often. Common shingles come last in the order; any order gives the same links."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"h": np.concatenate([np.zeros(0, np.uint64), *[shingle_set(t, shingle) for t in utf8(b, "text")]]).view(np.int64)}

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    counts = map_batches(some, body, T.StructType([T.StructField("h", T.LongType())])).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.col("n").desc(), "h").limit(COMMON).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sets have a Jaccard similarity of `t` at least."""
    mask = (1 << LOOKUP_BITS) - 1
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.col("id").bitwiseAND(F.lit(mask).cast("long")).alias("k"))
    # a filter of fixed size: 2 ** (LOOKUP_BITS - 6) words at most
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = ids.groupBy(F.shiftright("k", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    filled = np.zeros(1 << LOOKUP_BITS - 6, np.int64)
    filled[words["w"].to_numpy()] = words["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(filled.view(np.uint8))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        wanted, seen = sent.value, set()
        for b in batches:
            ids, sets = [], []
            for text in utf8(b, "text"):
                found = shingle_set(text, shingle)
                k = (i := _set_id(found)) & mask
                if wanted[k >> 3] >> (k & 7) & 1 and i not in seen:
                    seen.add(i)
                    ids.append(i)
                    sets.append(found.view(np.int64))
            yield {"id": pa.array(np.array(ids, np.uint64).view(np.int64)), "s": sets}

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])
    sets = stage(map_batches(docs.select("text"), body, schema), "shingle-sets").groupBy("id").agg(F.first("s").alias("s"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    shared, sizes = F.size(F.array_intersect("x", "y")).cast("long"), (F.size("x") + F.size("y")).cast("long")
    return both.where(shared * (t.numerator + t.denominator) >= sizes * t.numerator).select("a", "b")


def ball_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the ids in rows (fp, id): each id with the smallest of its fingerprint, and those smallest ones along the links of the balls. They connect what all pairs at two bits would."""
    marks = stage(prints.select("fp", "id").distinct(), "marks")
    first = stage(marks.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    copies = marks.join(first, "fp").select(F.col("id").alias("a"), F.col("first").alias("b"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_id")) for c in "ab")
    linked = ball_links(first.select("fp")).join(a, "a").join(b, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return _ordered(copies.unionByName(linked).where("a != b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _kept(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stages what `make` gives and deletes what it has staged on its way."""
    begin = staged()
    found = stage(make(), name)
    clear_stages(spark, begin, staged() - 1)
    return found


def _parted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of shingles with their texts' components as `part`; shingles that one component alone has have no further pairs."""
    own = Window.partitionBy("token")
    rows = shared.join(roots, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("root", "id")).drop("node", "root")
    return rows.withColumn("alone", F.min("part").over(own) == F.max("part").over(own)).where("not alone").drop("alone")


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row (doc_id, mark, root) per document: mark is a hash of the text, root the same for all documents of a component (see `similar_documents`)."""
    t = Fraction(similarity).limit_denominator(10_000)
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common(docs, shingle))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("mark", T.LongType()), T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("head", T.ArrayType(T.LongType()))])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, counts = common.value
        for b in batches:
            ids, fps, sizes, heads = [], [], [], []
            for text in utf8(b, "text"):
                found = shingle_set(text, shingle)
                fps.append(simhash(text))
                n, uses = len(found), np.zeros(len(found), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    uses = np.where(known[at] == found, counts[at], 0)
                ids.append(_set_id(found))
                sizes.append(n)
                # a text shares at least ceil(t n) shingles with one that is alike, so one of these
                heads.append(found[np.argsort(uses, kind="stable")][: n + 1 + -n * t.numerator // t.denominator].view(np.int64))
            yield {"doc_id": b.column("doc_id"), "mark": b.column("mark"), "id": pa.array(np.array(ids, np.uint64).view(np.int64)), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "n": sizes, "head": heads}

    prints = stage(map_batches(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")), body, schema), "shingle-heads")
    # the balls of the fingerprints lead: shingles add pairs across the components that they contract
    common.unpersist()
    near = _kept(spark, lambda: ball_pairs(prints), "pairs")
    roots = _kept(spark, lambda: connected(near), "roots")
    classes = prints.groupBy("id").agg(F.first("n").alias("n"), F.first("head").alias("head"))
    # left: shingles from the place on; if two texts first meet there, they share no more than the lesser
    places = classes.select("id", "n", F.posexplode("head").alias("pos", "token")).select("token", "id", "n", (F.col("n") - F.col("pos")).alias("left"))
    group = Window.partitionBy("token")
    places = places.withColumn("one", F.min("id").over(group) == F.max("id").over(group))
    shared = stage(places.where("not one").drop("one"), "shared-shingles")
    enough = lambda left, size: left * (t.numerator + t.denominator) >= size * t.numerator

    # The text most of whose first shingles others have too leads a group: an original leads its copies, which differ from each other twice as much.
    hubs = stage(shared.groupBy("id").agg((F.count("*") / F.greatest(F.max("n"), F.lit(1))).alias("hub")), "hubs")
    leader = F.max(F.struct("hub", "id", "n", "left", "part")).over(group)
    led = _parted(shared.join(hubs, "id"), roots).withColumn("lead", leader).where(F.col("part") != F.col("lead.part")).where(enough(F.least("left", "lead.left"), F.col("n") + F.col("lead.n")))
    asked = stage(near.unionByName(_ordered(led.select(F.col("id").alias("a"), F.col("lead.id").alias("b")))), "pairs")
    links = _kept(spark, lambda: _confirmed(docs, asked, shingle, t), "links")
    roots = _kept(spark, lambda: connected(links), "roots")

    # then every pair of a group that isn't joined by a confirmed link yet, also within a component of the balls
    joined = _parted(shared, roots).select("token", "part", F.struct("id", "n", "left").alias("m"))
    joined = joined.withColumn("share", F.pmod(F.xxhash64("m.id"), F.ceil(F.count("*").over(Window.partitionBy("token", "part")) / GATHERED)))
    parts = stage(joined.groupBy("token", "part", "share").agg(F.collect_list("m").alias("m"), F.min("m.n").alias("n"), F.max("m.left").alias("left")), "parts")
    x, y = (parts.select("token", *[F.col(c).alias(f"{k}_{c}") for c in ("part", "m", "n", "left")]) for k in "xy")
    meet = x.join(y, "token").where("x_part > y_part").where(enough(F.least("x_left", "y_left"), F.col("x_n") + F.col("y_n")))
    alike = lambda p: F.transform(F.filter("y_m", lambda q: enough(F.least(p["left"], q["left"]), p["n"] + q["n"])), lambda q: F.struct(p["id"].alias("a"), q["id"].alias("b")))
    rest = stage(_ordered(meet.select(F.inline(F.flatten(F.transform("x_m", alike))))).join(asked, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        roots = stage(connected(links.unionByName(_confirmed(docs, rest, shingle, t))), "roots")
    return prints.select("doc_id", "mark", "id").join(roots, F.col("id") == F.col("node"), "left").select("doc_id", "mark", F.coalesce("root", "id").alias("root"))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row (doc_id, component_id) per document.

    component_id: the smallest doc_id reachable over links of a Jaccard
    similarity of `similarity` or more on distinct shingles of `shingle` words
    (by 64-bit hashes). Pairs of fingerprints in one ball come first; every
    other such pair meets in a shingle, and every link is confirmed, but for
    pairs that are in one component already. Texts without
    words are alike; null ids are ignored in the smallest id; repeated rows
    stay.
    """
    rows = stage(similar_rows(docs, shingle, similarity), "similar")
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "root").select("doc_id", "component_id")
