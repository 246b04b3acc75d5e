"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

A window must be found whole, so by the prefix filter its rarest word alone is
joined: words are ordered by how many times all documents use them. A document
word that is the key of windows gives candidates at the key's offset; those
that would begin before the document or end after it are dropped, the others
verified word by word. The windows go to the executors in blocks of bounded
size; each document is held against every block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_batches, utf8
from .common import stage

WINDOW = 8
MIN_ITEMS = 2
#: UTF-8 bytes of items in one block, which is broadcast.
BLOCK_BYTES = 8 << 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, in UTF-8."""
    return (text or b"").translate(_WORD).split()


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        data = (text or "").encode()
        if block and size + len(data) > limit:
            yield block
            block, size = [], 0
        block.append((item, data))
        size += len(data)
    yield block


def _windows(block: list[tuple[str | None, bytes]], window: int) -> dict[bytes, set[str | None]]:
    found: dict[bytes, set[str | None]] = defaultdict(set)
    for item, text in block:
        w = split_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found[b" ".join(w[i : i + window])].add(item)
    return dict(found)


def _rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Uses of the vocabulary's words in all documents; as many rows as the vocabulary has words at most."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter = Counter()
        for b in batches:
            seen.update(filter(sent.value.__contains__, chain.from_iterable(map(split_words, utf8(b, "text")))))
        yield {"word": list(seen), "uses": list(seen.values())}

    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("uses", T.LongType())])
    return {bytes(r[0]): r[1] for r in map_batches(docs.select("text"), body, schema).groupBy("word").agg(F.sum("uses")).toLocalIterator()}


def _keyed(windows: dict[bytes, set[str | None]], uses: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """For each key word the places (offset, words of the window) at which it may stand."""
    keys: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
    for text in windows:
        w = text.split(b" ")
        at = min(range(len(w)), key=lambda i: (uses.get(w[i], 0), w[i], i))
        keys[w[at]].add((at, len(w)))
    return {k: sorted(v) for k, v in keys.items()}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) per row of `docs`.

    A window is `window` consecutive words of an item, or all words of a
    shorter one. n_hit: words inside any occurrence; items: ids (as strings,
    sorted) of the items with an occurring window; contaminated: at least
    `min_items` of them. Null and empty texts have no words; items without
    words match nothing; an item without an id hits words but isn't listed;
    repeated items count once, repeated documents each; other columns are not
    read. No shuffle but for the counts of benchmark words.
    """
    spark = docs.sparkSession
    base = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text", T.StringType())]
    extra = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", "text", F.lit(None).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        windows = _windows(block, window)
        vocabulary = set(chain.from_iterable(w.split(b" ") for w in windows))
        keys = _keyed(windows, _rarity(rows, vocabulary) if windows else {})
        sent = spark.sparkContext.broadcast((windows, keys))

        def body(batches: Iterator[pa.RecordBatch], sent=sent, keep_text=True) -> Iterator[dict]:
            windows, keys = sent.value
            for b in batches:
                n, spans, items = [], [], []
                for text, old, had in zip(utf8(b, "text"), b.column("spans").to_pylist(), b.column("items").to_pylist()):
                    w = split_words(text)
                    n.append(len(w))
                    if not keys.keys().isdisjoint(w):
                        new, ids = list(zip(old[::2], old[1::2])), set(had)
                        for i, x in enumerate(w):
                            for at, size in keys.get(x, ()):
                                s = i - at
                                if s >= 0 and s + size <= len(w) and (owners := windows.get(b" ".join(w[s : s + size]))):
                                    new.append((s, s + size))
                                    ids |= owners
                        old, had = list(chain.from_iterable(_merge(new))), sorted(ids - {None})
                    spans.append(old)
                    items.append(had)
                yield {"doc_id": b.column("doc_id"), "text": b.column("text"), "n_words": n, "spans": spans, "items": items}

        if k:
            found = stage(found, "decontaminate")
        found = map_batches(found, body, T.StructType(base + extra))
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", (F.size("items") >= min_items).alias("contaminated"))
