"""Repeated passages by longest-previous-factor arrays over a partitioned suffix order.

A suffix matters here by its first `length` bytes, its window. Windows that are
equal share their minimizer (the smallest hash of the `SEED_BYTES`-grams in
them, leftmost first), and hold it at the same place. So the suffix order is
partitioned by minimizer, and equal windows always meet.

1. Each run of windows with one minimizer is a row: its minimizer's hash, a
   hash of all bytes that the run covers, its place.
2. Minimizers that occur once have no repeated window. Where all runs of a
   minimizer cover equal bytes, each window of each run is repeated. These two
   cases need no text, and are nearly all.
3. Of the others, the bytes of each different run are put into suffix order
   (`factors`), and each window's previous and next places in it say whether
   its longest previous factor, or its longest next one, reaches `length`.
4. A minimizer with very many different runs is dealt to several tasks. Each
   settles the windows that repeat within its share; of what is left one of
   each kind goes on, by hash, and is compared across the shares.

`keep="none"` removes every occurrence, `keep="first"` leaves the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_batches, utf8
from .common import stage

LENGTH = 200
SEED_BYTES = 40
#: Different runs of one minimizer that one task puts into order; more are dealt to several.
SPREAD = 4096
#: Bytes of runs that are put into order at once, and bits of a place among them.
ORDER_BYTES = 1 << 20
_PLACE_BITS = np.uint64(21)
#: Bytes of a text that are hashed at once; any length is handled in such pieces.
_PIECE = 1 << 20
_RANDOM, _OTHER = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray, table: np.ndarray = _RANDOM) -> tuple[np.ndarray, np.ndarray]:
    """Running sums whose differences, scaled back, are hashes of substrings."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=sums[1:])
    return sums, down


def window_hashes(data: np.ndarray, length: int, table: np.ndarray = _RANDOM) -> np.ndarray:
    """A hash of each substring of `length` bytes."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    sums, down = _sums(data, table)
    return _mix((sums[length:] - sums[:-length]) * down[: len(data) - length + 1])


def _runs(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(minimizer's hash, hash of the bytes covered, start, end) of the runs of windows with one minimizer."""
    width = length - seed + 1
    n = len(data) - length + 1
    sums, down = _sums(data)
    grams = _mix((sums[seed:] - sums[:-seed]) * down[: len(data) - seed + 1])
    place = np.uint64((1 << 24) - 1)
    keyed = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(keyed) % width
    blocks = np.concatenate([keyed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & place).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(start[1:], n) - 1 + length
    at = least[start]
    cover = (sums[end] - sums[start]) * down[start]
    cover = _mix(cover + (at - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return grams[at], cover, start, end


def text_runs(text: bytes, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """`_runs` of a text of any length, taken in pieces."""
    data = np.frombuffer(text, np.uint8)
    parts = [_runs(data[i : i + _PIECE + length - 1], length, seed) for i in range(0, max(1, len(data) - length + 1), _PIECE) if len(data) - i >= length]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), *(np.concatenate([p[k] + i * _PIECE for i, p in enumerate(parts)]) for k in (2, 3))


def longest_previous_factors(text: bytes) -> np.ndarray:
    """The LPF array of one text: for each position the length of the longest substring from there that also starts earlier. By the suffix array, LCPs, and previous and next smaller positions in suffix order."""
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])
    common = [0] * (n + 1)
    for k in range(1, n):
        a, b, h = order[k - 1], order[k], 0
        while a + h < n and b + h < n and text[a + h] == text[b + h]:
            h += 1
        common[k] = h
    lpf, stack = np.zeros(n, np.int64), []
    for k in range(n + 1):  # a suffix leaves the stack when the next smaller position arrives
        p, low = (order[k], common[k]) if k < n else (-1, 0)
        while stack and p < stack[-1][0]:
            q, before = stack.pop()
            lpf[q] = max(before, low)
            low = min(low, before)
        stack.append((p, low))
    return lpf


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their keys (below 2**42) and then of places, and the rank of each key in that order."""
    packed = keys << _PLACE_BITS | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    top = packed >> _PLACE_BITS
    rank = np.zeros(len(keys), np.uint64)
    np.cumsum(top[1:] != top[:-1], out=rank[1:])
    return (packed & np.uint64((1 << 21) - 1)).astype(np.int64), rank


def factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous factor of each start reaches `length`, and whether the longest next one does.

    `data` holds at least `length` bytes from each start (ascending), and less
    than 2**21 in all. The suffixes are ordered by their first `length` bytes
    (ranks of prefixes are joined to ranks of prefixes twice as long) and equal
    ones by place. So where a suffix has `length` bytes in common with one at a
    smaller place, its previous smaller place in the order is the neighbour
    before it, and the next greater place likewise the neighbour behind.
    """
    n, depth = len(data), min(5, length)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)]).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(depth):
        keys = keys << np.uint64(8) | padded[j : n + j]
    ranks = np.empty(n, np.uint64)
    while True:
        at, rank = _order(keys)
        ranks[at] = rank
        step = min(depth, length - depth)
        if 2 * depth >= length:
            break
        keys = ranks << _PLACE_BITS
        keys[:-step] |= ranks[step:]
        depth += step
    at, rank = _order(ranks[starts] << _PLACE_BITS | ranks[starts + step])
    same = rank[1:] == rank[:-1]
    before, after = np.zeros(len(at), bool), np.zeros(len(at), bool)
    before[at[1:]], after[at[:-1]] = same, same
    return before, after


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    by = np.lexsort((ends, starts))
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1] if len(at) else ends


_LONG, _INT = T.LongType(), T.IntegerType()
_PLACE = [T.StructField("key", _LONG), T.StructField("s", _INT), T.StructField("e", _INT)]


def find_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", seed: int = SEED_BYTES, spread: int = SPREAD) -> DataFrame:
    """Intervals (key, s, e) of bytes that go, from `docs` (key, ord, text); key identifies a text, ord orders it for keep="first"."""
    row = docs.schema["ord"].dataType
    run_type = T.StructType([T.StructField("h", _LONG), T.StructField("u", _LONG), T.StructField("ord", row), *_PLACE])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [text_runs(t or b"", length, seed) for t in utf8(b, "text")]
            n = np.array([len(f[0]) for f in found], np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            h, u, s, e = (np.concatenate([f[k] for f in found]) for k in range(4))
            yield {"h": pa.array(h.view(np.int64)), "u": pa.array(u.view(np.int64)), "ord": b.column("ord").take(at), "key": b.column("key").take(at), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32))}

    # With keep="first" the place of a minimizer's first run is needed too.
    first = [F.min(F.struct("ord", "key", "s")).alias("first")] if keep == "first" else []
    occurring = map_batches(docs.select("key", "ord", "text"), runs, run_type)
    many = stage(occurring.groupBy("h").agg(F.count("*").alias("n"), F.min("u").alias("u1"), F.max("u").alias("u2"), *first).where("n > 1").select(F.col("h").alias("hh"), (F.col("u1") == F.col("u2")).alias("alike"), *(["first"] if first else [])), "minimizers")
    shared = stage(occurring.join(many, F.col("h") == F.col("hh")).drop("hh"), "shared-runs")

    later = ~F.struct("ord", "key", "s").eqNullSafe(F.col("first")) if first else F.lit(True)
    out = shared.where("alike").where(later).select("key", "s", "e")
    mixed = shared.where("not alike")
    kinds = mixed.groupBy("h", "u").agg(F.count("*").alias("c"), F.min(F.struct("ord", "key", "s", "e")).alias("rep"))
    kinds = stage(kinds.select("h", "u", "c", "rep.ord", "rep.key", "rep.s", "rep.e"), "different-runs")
    # runs that equal another one go whole, but for the first one's if that is kept
    copied = mixed.join(kinds.where("c > 1").select(F.col("h").alias("h2"), F.col("u").alias("u2"), F.col("key").alias("key2"), F.col("s").alias("s2")), (F.col("h") == F.col("h2")) & (F.col("u") == F.col("u2")))
    if keep == "first":
        copied = copied.where(~((F.col("key") == F.col("key2")) & (F.col("s") == F.col("s2"))))
    out = out.unionByName(copied.select("key", "s", "e"))

    # only groups with a run that must be told window by window
    open_ = kinds.groupBy("h").agg(F.count("*").alias("different"), F.min("c").alias("least")).where("different > 1" + (" and least = 1" if keep == "none" else ""))
    kinds = kinds.join(open_.select(F.col("h").alias("ho"), F.ceil(F.col("different") / spread).cast("int").alias("shares")), F.col("h") == F.col("ho")).drop("ho")
    asked = kinds.groupBy("key").agg(F.collect_list(F.struct("h", "c", "s", "e", "shares")).alias("runs"))
    texts = docs.select("key", "ord", "text").join(asked.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "ord", "text", "runs")
    place = [T.StructField("ord", row), *_PLACE[:2]]
    piece = T.StructType([T.StructField("h", _LONG), T.StructField("shares", _INT), T.StructField("share", _INT), T.StructField("ask", T.BooleanType()), *place, T.StructField("data", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            h, shares, share, ask, at, s, data = [], [], [], [], [], [], []
            for i, (text, key, asked) in enumerate(zip(utf8(b, "text"), b.column("key").to_pylist(), b.column("runs").to_pylist())):
                for r in asked:
                    h.append(r["h"])
                    shares.append(r["shares"])
                    share.append((key ^ r["s"] * 0x9E3779B1) % r["shares"])
                    ask.append(keep == "first" or r["c"] == 1)
                    at.append(i)
                    s.append(r["s"])
                    data.append(text[r["s"] : r["e"]])
            at = pa.array(at, pa.int64())
            yield {"h": h, "shares": shares, "share": share, "ask": ask, "ord": b.column("ord").take(at), "key": b.column("key").take(at), "s": s, "data": data}

    # a text that occurs in several rows has one key, and is asked once
    pieces = stage(map_batches(texts.dropDuplicates(["key"]), cut, piece), "pieces")

    lists = [T.StructField(c, T.ArrayType(t)) for c, t in (("first", _LONG), ("second", _LONG), ("inner", _INT), ("asks", T.BooleanType()))]
    found = T.StructType([T.StructField("h", _LONG), T.StructField("bucket", _INT), T.StructField("ord", row), *_PLACE, *lists])

    def intervals(gone: np.ndarray, piece: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start, end) of the runs of windows that go."""
        at, start = piece[gone], start[gone]
        last = np.flatnonzero(np.concatenate([(at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1), [True]])) if len(at) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        return at[last], start[begin], start[last] + length

    def settled(ord_: pa.Array, key: np.ndarray, s: np.ndarray, e: np.ndarray) -> dict:
        none = pa.nulls(len(s))
        return {"h": none, "bucket": none, "ord": ord_, "key": pa.array(key), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32)), **{f.name: none for f in lists}}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Groups arrive whole, one after the other; several are put into order at once, and one that is too large in several shares."""
        held: list[tuple] = []

        def flush(cut_off: bool) -> Iterator[dict]:
            hs, shares, asks, ords, keys, places, data = zip(*held)
            sizes, places = np.array([max(0, len(d) - length + 1) for d in data], np.int64), np.array(places, np.int64)
            run = np.repeat(np.arange(len(sizes)), sizes)
            inner = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            base = np.cumsum([0, *map(len, data)])[:-1]
            before, after = factors(np.frombuffer(b"".join(data), np.uint8), base[run] + inner, length)
            ask = np.array(asks, bool)
            gone = (before if keep == "first" else before | after) & ask[run]
            at, s, e = intervals(gone, run, places[run] + inner)
            ord_, key = pa.array(ords, row_type), np.array(keys, np.int64)
            yield settled(ord_.take(pa.array(at)), key[at], s, e)
            # what other shares of a group must see of this one
            if shared := [i for i, n in enumerate(shares) if n > 1 or cut_off and hs[i] == hs[-1] or hs[i] == part_of[0]]:
                rows: dict[str, list] = {f.name: [] for f in found}
                ends = np.cumsum(sizes)
                for i in shared:
                    one = slice(int(ends[i] - sizes[i]), int(ends[i]))
                    own = np.frombuffer(data[i], np.uint8)
                    new, first, second = ~before[one], window_hashes(own, length).view(np.int64), window_hashes(own, length, _OTHER).view(np.int64)
                    asking = ask[i] & ~gone[one]
                    bucket = first % shares[i]
                    for k in np.unique(bucket[new]).tolist():
                        sel = np.flatnonzero(new & (bucket == k))
                        for name, value in zip(rows, (hs[i], k, ords[i], keys[i], int(places[i]), None, first[sel], second[sel], sel.astype(np.int32), asking[sel])):
                            rows[name].append(value)
                yield rows
            part_of[0] = hs[-1] if cut_off else None
            held.clear()

        size, part_of, row_type = 0, [None], None
        for b in batches:
            row_type = b.column("ord").type
            for x in zip(*[b.column(c).to_pylist() for c in ("h", "shares", "ask", "ord", "key", "s", "data")]):
                if size + len(x[-1]) > ORDER_BYTES:
                    yield from flush(x[0] == held[-1][0])
                    size = 0
                held.append(x)
                size += len(x[-1])
        if held:
            yield from flush(False)

    grouped = pieces.repartition("h", "share").sortWithinPartitions("h", "ord", "key", "s")
    seen = stage(map_batches(grouped, judged, found), "factors")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Windows of different shares, a bucket of their hashes at a time, in the order of places."""
        held: list[tuple] = []

        def flush() -> dict:
            _, _, ords, keys, places, first, second, inner, asks = zip(*held)
            piece = np.repeat(np.arange(len(held)), [len(x) for x in inner])
            first, second, inner, asks = (np.concatenate([np.array(y) for y in x]) for x in (first, second, inner, asks))
            by = np.lexsort((np.arange(len(first)), second, first))
            same = (first[by][1:] == first[by][:-1]) & (second[by][1:] == second[by][:-1])
            before, after = np.zeros(len(by), bool), np.zeros(len(by), bool)
            before[by[1:]], after[by[:-1]] = same, same
            at, s, e = intervals((before if keep == "first" else before | after) & asks.astype(bool), piece, np.array(places, np.int64)[piece] + inner)
            held.clear()
            return settled(pa.array(ords, row_type).take(pa.array(at)), np.array(keys, np.int64)[at], s, e)

        row_type = None
        for b in batches:
            row_type = b.column("ord").type
            for x in zip(*[b.column(c).to_pylist() for c in ("h", "bucket", "ord", "key", "s", "first", "second", "inner", "asks")]):
                if held and held[-1][:2] != x[:2]:
                    yield flush()
                held.append(x)
        if held:
            yield flush()

    crossing = seen.where("h is not null").repartition("h", "bucket").sortWithinPartitions("h", "bucket", "ord", "key", "s")
    return out.unionByName(seen.where("h is null").select("key", "s", "e")).unionByName(map_batches(crossing, across, found).select("key", "s", "e"))


def deduplicate(docs: DataFrame, length: int = LENGTH, keep: str = "first", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, and the remaining bytes as `kept` if asked for.

    Texts are UTF-8 bytes, null ones empty; matches never cross documents;
    overlapping occurrences count; strings are judged on the input. Rows that
    repeat doc_id and text are copies of each other (keep="first" keeps one
    text, in each of its rows). Order for "first": doc_id, null first, then a
    hash of the text. Texts shorter than `length` stay whole; texts of any
    length are taken in pieces; an empty table gives an empty one; other columns
    are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("key"), F.col("doc_id").alias("ord"), "text")
    gone = find_repeats(rows, length, keep).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")).withColumnRenamed("key", "k")
    joined = rows.join(gone, F.col("key") == F.col("k"), "left").select("ord", "text", "spans")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            n, removed, spans, marks, kept = [], [], [], [], []
            flat = b.column("spans")
            for i, data in enumerate(utf8(b, "text")):
                s, e = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if flat[i].is_valid:
                    x = flat[i].values
                    s, e = merged(x.field("s").to_numpy().astype(np.int64), x.field("e").to_numpy().astype(np.int64))
                n.append(len(data))
                removed.append(int((e - s).sum()))
                spans.append(len(s))
                rest = b"".join(data[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(data)]))
                marks.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield {"doc_id": b.column("ord"), "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept_sha256": marks} | ({"kept": kept} if with_text else {})

    schema = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, _LONG) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    return map_batches(joined, body, T.StructType([*schema, *([T.StructField("kept", T.BinaryType())] if with_text else [])]))
