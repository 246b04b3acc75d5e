"""Token-ID files: texts are tokenized and written in the order of doc_id as static range asymmetric numeral systems.

A file is a table of segments, each with one shared frequency table, an index
of its documents, and independent blocks. A block interleaves up to 4,096
coder states over its ids, ends with a checksum, and is found by a checkpoint
(its offset) in the segment's header, so blocks decode in parallel.

Segment: b"RSG2", then little-endian u32: symbols in the table, documents,
blocks, bytes of the packed table, bytes of the packed index; u64: sequence
number; checkpoints (u64), the table (zlib of u32 steps from id to id, then u32
frequencies, which sum to 2**20), the index (zlib of u32 lengths), then the
blocks. Block: u32 ids, u32 states, u32 crc32
of the ids as little-endian u32, u32 words, states (u64), words (u32).
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_batches
from .common import stage

END_ID = 2
SEGMENT_IDS = 1 << 20
BLOCK_IDS = 1 << 19
LANES = 4096
_BITS = 20
_LOW = np.uint64(1 << 31)
_MAGIC = b"RSG2"
_HEAD = "<IIIIIQ"
#: Distinct words and pieces whose ids a worker remembers lately (some 200 bytes each), and as many from before.
MEMO = 400_000
#: Characters of a piece that is remembered at most: scripts without spaces have words of any length.
LONGEST = 100
_ENCODERS: dict[str, _Encoder] = {}


class _Memo(dict):
    """Ids of pieces of text in two generations: what is asked for again moves to the younger one, which is this dictionary; when that is full, it replaces the older one."""

    def __init__(self, size: int, make: Callable[[str], bytes]):
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.make(piece)
        found = self.old.get(piece) or self.make(piece)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class _Apart(Exception):
    """A word whose ids depend on its neighbours."""


#: Before a mark that ends a word, and before a word that begins a line; a text that holds one of them is split as a whole.
_MARK, _LINE = "\x00", "\x02"
_ID = attrgetter("id")
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each piece that is remembered.

    A byte-level tokenizer splits a text by its pattern, and merges within the
    pieces only. No piece holds a space but at its beginning, so the words
    between single spaces have ids of their own, unless what stands before the
    space is white space too; and so have a mark behind a letter or digit and
    a lone line end behind a mark, which are parted from their words first.
    Where that doesn't hold, the text is split as a whole. Texts that hold the
    string of an added token, and all texts of any other tokenizer, are encoded
    whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        form = json.loads(self.tokenizer.to_str())
        first = form["pre_tokenizer"] or {}
        self.by_pieces = form["normalizer"] is None and form["model"]["type"] == "BPE" and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.added = [x["content"] for x in form["added_tokens"]]
        # bytes that print stand for themselves, the others for the characters from U+0100 on, in order
        printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = "".join(chr(b if b in printed else next(rest)) for b in range(256))
        self.pieces, self.words = _Memo(MEMO // 4, self._ids), _Memo(MEMO, self._new)

    def _ids(self, piece: str) -> bytes:
        return self._packed(charmap_decode(piece.encode(), "strict", self.alphabet)[0])

    def _packed(self, spelt: str) -> bytes:
        ids = [*map(_ID, self.tokenize(spelt))]
        return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _new(self, word: str) -> bytes:
        """Ids of a word that is not remembered, with the space before it unless it begins with a sign."""
        if word.isalpha():
            return self._packed("\u0120" + word) if word.isascii() else self._ids(" " + word)  # a space in the alphabet of the merges
        if not word or word[-1].isspace() and word[0] != _MARK or word[0] == _LINE and (len(word) == 1 or word[1].isspace()):
            raise _Apart
        return self._split(word[1:] if word[0] in (_MARK, _LINE) else " " + word)

    def _parted(self, text: str) -> bytes | None:
        """The ids by words, or None if the words don't stand alone."""
        text = text.replace(", ", f" {_MARK}, ").replace(". ", f" {_MARK}. ").replace(".\n", f" {_MARK}.\n {_LINE}")
        before = text.split(f" {_MARK}")
        del before[-1]
        if not all([x[-1:].isalnum() for x in before]):
            return None  # a mark behind a mark may be one piece with it
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return None
        try:
            return self._split(first) + b"".join(map(self.words.__getitem__, words))
        except _Apart:
            return None

    def encode(self, text: str | None, end_id: int) -> np.ndarray:
        text = text or ""
        if not self.by_pieces or any(map(text.__contains__, self.added)):
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end_id], "<u4")
        parted = None if _MARK in text or _LINE in text else self._parted(text)
        return np.frombuffer((self._split(text) if parted is None else parted) + struct.pack("<I", end_id), "<u4")


def encode_texts(texts: list[str | None], path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text as the tokenizer's file gives them without special tokens around, `end_id` last."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return [_ENCODERS[path].encode(t, end_id) for t in texts]


def _quantized(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**20."""
    freq = np.maximum(1, counts * (1 << _BITS) // counts.sum())
    short = (1 << _BITS) - int(freq.sum())
    for i in np.argsort(-freq, kind="stable"):
        step = max(short, 1 - int(freq[i]))
        freq[i] += step
        short -= step
        if not short:
            break
    return freq.astype(np.uint64)


def _encode_block(index: np.ndarray, ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    lanes = max(1, min(LANES, len(index) // 256))
    x, words = np.full(lanes, _LOW, np.uint64), []
    f, c = freq[index], start[index]
    shift, limit, mask = np.uint64(32), np.uint64(63 - _BITS), np.uint64(0xFFFFFFFF)
    for at in range((len(index) - 1) // lanes * lanes, -1, -lanes):
        ff, cc = f[at : at + lanes], c[at : at + lanes]
        n = len(ff)
        y = x[:n]
        if (full := y >= ff << limit).any():
            words.append((y[full] & mask).astype("<u4"))
            y = np.where(full, y >> shift, y)
        q = y // ff
        x[:n] = (q << np.uint64(_BITS)) + (y - q * ff) + cc
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return struct.pack("<IIII", len(index), lanes, zlib.crc32(ids.astype("<u4").tobytes()), len(stream)) + x.astype("<u8").tobytes() + stream.tobytes()


def _decode_block(data: memoryview, slots: np.ndarray, symbols: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    n, lanes, crc, n_words = struct.unpack_from("<IIII", data)
    x = np.frombuffer(data, "<u8", lanes, 16).astype(np.uint64)
    stream, at = np.frombuffer(data, "<u4", n_words, 16 + 8 * lanes).astype(np.uint64), 0
    out = np.empty(n, np.uint32)
    mask, bits, shift = np.uint64((1 << _BITS) - 1), np.uint64(_BITS), np.uint64(32)
    for k in range(0, n, lanes):
        y = x[: min(lanes, n - k)]
        slot = y & mask
        s = slots[slot]
        y = freq[s] * (y >> bits) + slot - start[s]
        if m := int((low := y < _LOW).sum()):
            y[low] = (y[low] << shift) | stream[at : at + m]
            at += m
        out[k : k + len(y)] = symbols[s]
        x[: len(y)] = y
    if zlib.crc32(out.astype("<u4").tobytes()) != crc or at != n_words:
        raise ValueError("a block of a token file is damaged")
    return out


def encode_segment(docs: list[np.ndarray], sequence: int = 0) -> bytes:
    ids = np.concatenate(docs)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        places = np.cumsum(counts > 0) - 1
        index, counts = places[ids], counts[symbols]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = _quantized(counts)
    start = np.cumsum(freq) - freq
    blocks = [_encode_block(index[i : i + BLOCK_IDS], ids[i : i + BLOCK_IDS], freq, start) for i in range(0, len(ids), BLOCK_IDS)]
    places = np.cumsum([0, *map(len, blocks)])[:-1]
    table = zlib.compress(np.concatenate([np.diff(symbols, prepend=0), freq]).astype("<u4").tobytes())
    packed = zlib.compress(np.array([len(d) for d in docs], "<u4").tobytes())
    head = _MAGIC + struct.pack(_HEAD, len(symbols), len(docs), len(blocks), len(table), len(packed), sequence)
    return b"".join([head, places.astype("<u8").tobytes(), table, packed, *blocks])


def decode_segment(data: bytes, only: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the documents, ids); `only` names the blocks to decode."""
    view = memoryview(data)
    if bytes(view[:4]) != _MAGIC:
        raise ValueError("not a segment of a token file")
    n_symbols, n_docs, n_blocks, n_table, n_index, _ = struct.unpack_from(_HEAD, view, 4)
    at = 4 + struct.calcsize(_HEAD)
    places = np.frombuffer(view, "<u8", n_blocks, at)
    at += 8 * n_blocks
    table = np.frombuffer(zlib.decompress(view[at : at + n_table]), "<u4")
    at += n_table
    lengths = np.frombuffer(zlib.decompress(view[at : at + n_index]), "<u4")
    at += n_index
    symbols, freq = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:].astype(np.uint64)
    start, slots = np.cumsum(freq) - freq, np.repeat(np.arange(n_symbols, dtype=np.uint32), table[n_symbols:])
    parts = [_decode_block(view[at + int(places[i]) :], slots, symbols, freq, start) for i in (only if only is not None else range(n_blocks))]
    return lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """The segments of all texts in ascending doc_id order (null first): (part, sequence, n_ids, doc_ids, data), in the order of part and sequence.

    One shuffle, by ranges of doc_id, of which each is a part. Null texts count as empty and give the
    end id alone; repeated rows are documents of their own, of equal ids the
    smaller text first; an empty table gives no segment. A worker holds the ids
    of one segment, and of one document if that is longer.
    """
    id_type = docs.schema["doc_id"].dataType
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names: list = []
        held: list[np.ndarray] = []
        size = sequence = 0

        def flush() -> dict:
            return {"part": [part], "sequence": [sequence], "n_ids": [size], "doc_ids": [names], "data": [encode_segment(held, sequence)]}

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i in range(0, len(ids), 256):
                for name, tokens in zip(ids[i : i + 256], encode_texts(texts.slice(i, 256).to_pylist(), path, end_id)):
                    if held and size + len(tokens) > SEGMENT_IDS:
                        yield flush()
                        names, held, size, sequence = [], [], 0, sequence + 1
                    names.append(name)
                    held.append(tokens)
                    size += len(tokens)
        if held:
            yield flush()

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("sequence", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("data", T.BinaryType())])
    return map_batches(ordered, body, schema)


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, decoded from the segments.

    start: ids of all documents before it, a running sum over the segments of
    a part and one over the parts, as many as the shuffle has partitions.
    """
    ids, first = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(first), F.lit(0)).alias("first"))
    places = segments.select("part", "sequence", ids.alias("ids")).join(parts, "part").select("part", "sequence", (F.col("first") + F.col("ids")).alias("before"))
    placed = segments.join(places, ["part", "sequence"]).select("before", "doc_ids", "data")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                lengths, ids = decode_segment(b.column("data")[i].as_buffer())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                data = memoryview(ids.astype("<u4").tobytes())
                yield {
                    "doc_id": b.column("doc_ids")[i].values,
                    "start": pa.array(starts + b.column("before")[i].as_py()),
                    "n_tokens": pa.array(lengths.astype(np.int64)),
                    "ids_crc32": [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())],
                }

    id_type = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    return map_batches(placed, body, schema)


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    return read_token_files(stage(write_token_files(docs, path, end_id), "tokens"))
