"""Operator 8: token ids in a binary file of patched frame-of-reference blocks.

File format (little endian). A file is a run of frames, each followed by ``FOOTER``:

    magic "PFR1" | part u32 | frame u32 | documents u32 | blocks u32 | exceptions u32 |
    ids u64 | body crc32 u32 | body
    body = document ids i64[documents] | id-is-null u8[documents] | token counts u32[documents]
         | block start in packed words u32[blocks] | block minimum u32[blocks]
         | block width u8[blocks] | exceptions per block u8[blocks]
         | exception positions u8[exceptions] | exception values u32[exceptions]
         | packed words u64[...]

A block holds 128 ids (the last one of a frame is filled up with its last id). It stores the
ids minus the block's minimum in ``width`` bits, where the width is the one that the 90th
percentile of the block needs; larger values go to the exception list. ``block start``
indexes the packed words, so any block can be decoded alone.

Writing: rows are range-partitioned by document id (ties by text hash), each task encodes
its rows and hands finished frames of a few MB to Spark's own file writer (so the commit
protocol decides which attempt's file counts). Reading: ``binaryFile``, frame by frame.

Defined results: null or empty text is its end id alone; null ids sort first; repeated ids
are kept, ordered by text hash; an empty table writes and returns no rows; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airmetrics.llm.common import stored, text_of
from airmetrics.llm.tokens import encoder

BLOCK = 128
PERCENTILE = 0.9
FOOTER = "\nPFR1END\n"
_HEAD = struct.Struct("<4sIIIIIQI")
_U64 = np.uint64


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits needed for each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _pack_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) values below 2^width -> (n, 2*width) packed 64-bit words."""
    cols = np.ascontiguousarray(rows.T).astype(_U64)
    out = np.zeros((2 * width, rows.shape[0]), _U64)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        out[word] |= cols[j] << _U64(bit)
        if bit + width > 64:
            out[word + 1] |= cols[j] >> _U64(64 - bit)
    return out.T


def _unpack_rows(words: np.ndarray, width: int) -> np.ndarray:
    cols = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, words.shape[0]), np.uint32)
    mask = _U64((1 << width) - 1)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        v = cols[word] >> _U64(bit)
        if bit + width > 64:
            v = v | (cols[word + 1] << _U64(64 - bit))
        out[j] = v & mask
    return out.T


def encode_ids(ids: np.ndarray) -> tuple[bytes, int, int]:
    """Blocks of a run of ids: (bytes, blocks, exceptions)."""
    n = -(-len(ids) // BLOCK)
    if n == 0:
        return b"", 0, 0
    full = np.empty(n * BLOCK, np.uint32)
    full[:len(ids)] = ids
    full[len(ids):] = ids[-1]
    rows = full.reshape(n, BLOCK)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    k = int(BLOCK * PERCENTILE)
    width = _widths(np.partition(delta, k, axis=1)[:, k])
    limit = np.left_shift(np.uint64(1), width.astype(_U64))
    odd = delta >= limit[:, None]
    per = odd.sum(axis=1).astype(np.uint8)
    where = np.nonzero(odd)
    start = np.zeros(n, np.uint32)
    start[1:] = np.cumsum(2 * width.astype(np.uint32))[:-1]
    words = np.zeros(int(2 * width.astype(np.int64).sum()), _U64)
    plain = np.where(odd, 0, delta)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            words[start[at][:, None] + np.arange(2 * int(w))] = _pack_rows(plain[at], int(w))
    parts = (start, low, width, per, where[1].astype(np.uint8), delta[where].astype("<u4"), words)
    return b"".join(p.tobytes() for p in parts), n, len(where[0])


class _Cursor:
    def __init__(self, raw: memoryview):
        self.raw, self.at = raw, 0

    def take(self, dtype: str, n: int) -> np.ndarray:
        size = np.dtype(dtype).itemsize * n
        out = np.frombuffer(self.raw[self.at:self.at + size], dtype)
        self.at += size
        return out


def decode_ids(raw: memoryview, n_ids: int, n: int, n_odd: int) -> np.ndarray:
    c = _Cursor(raw)
    start, low, width, per = c.take("<u4", n), c.take("<u4", n), c.take("u1", n), c.take("u1", n)
    position, value = c.take("u1", n_odd), c.take("<u4", n_odd)
    words = c.take("<u8", int(2 * width.astype(np.int64).sum()))
    rows = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            rows[at] = _unpack_rows(words[start[at][:, None].astype(np.int64) + np.arange(2 * int(w))], int(w))
    rows[np.repeat(np.arange(n), per), position] = value
    rows += low[:, None]
    return rows.reshape(-1)[:n_ids]


def frame(part: int, number: int, keys: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, n, odd = encode_ids(ids)
    body = b"".join([np.array([k or 0 for k in keys], "<i8").tobytes(),
                     np.array([k is None for k in keys], np.uint8).tobytes(), counts.astype("<u4").tobytes(), blocks])
    return _HEAD.pack(b"PFR1", part, number, len(keys), n, odd, len(ids), zlib.crc32(body)) + body


def frames(raw: bytes):
    """Yield (part, frame, document ids, token counts, ids) of a file; bad checks raise."""
    view, at, foot = memoryview(raw), 0, FOOTER.encode()
    while at < len(raw):
        magic, part, number, docs, n, odd, n_ids, crc = _HEAD.unpack_from(raw, at)
        if magic != b"PFR1":
            raise ValueError(f"no frame at byte {at}")
        c = _Cursor(view[at + _HEAD.size:])
        keys, null, counts = c.take("<i8", docs), c.take("u1", docs), c.take("<u4", docs)
        # sizes of the block section follow from its widths
        head = 10 * n
        width = np.frombuffer(c.raw[c.at + 8 * n:c.at + 9 * n], np.uint8)
        size = c.at + head + 5 * odd + 16 * int(width.astype(np.int64).sum())
        if zlib.crc32(c.raw[:size]) != crc:
            raise ValueError(f"frame {part}/{number}: checksum differs")
        ids = decode_ids(c.raw[c.at:size], n_ids, n, odd)
        yield part, number, [None if x else int(k) for k, x in zip(keys, null, strict=True)], counts, ids
        at += _HEAD.size + size
        if raw[at:at + len(foot)] != foot:
            raise ValueError(f"frame {part}/{number}: no footer")
        at += len(foot)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, frame_ids: int = 1 << 20,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write all ids in ascending document id order."""

    def run(batches):
        enc, part, number = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        keys, counts, held, size = [], [], [], 0

        def done():
            data = frame(part, number, keys, np.array(counts, np.int64), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, offsets in enc.batches(batch.column(1)):
                ends = offsets[1:] + np.arange(1, len(offsets))
                full = np.full(len(ids) + len(ends), end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[ends - 1] = False
                full[keep] = ids
                keys += doc_ids[first:first + len(ends)]
                counts += np.diff(offsets).__add__(1).tolist()
                held.append(full)
                size += len(full)
                if size >= frame_ids:
                    yield done()
                    number += 1
                    keys, counts, held, size = [], [], [], 0
        if keys:
            yield done()

    text = text_of(docs, text_col)
    ordered = (docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"))
               .repartitionByRange("id", F.xxhash64("text"))
               .sortWithinPartitions("id", F.xxhash64("text")))
    (ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", FOOTER).option("maxRecordsPerFile", 16).text(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and the ids themselves)."""
    schema = "part long, frame long, doc_id long, at long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<long>"

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                for part, number, keys, counts, ids in frames(raw.as_py()):
                    ends = np.cumsum(counts.astype(np.int64))
                    start = ends - counts
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(start, ends, strict=True)]
                    n = len(keys)
                    cols = [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(keys, pa.int64()),
                            pa.array(start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                    names = ["part", "frame", "doc_id", "at", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([ids[a:b].astype(np.int64).tolist()
                                              for a, b in zip(start, ends, strict=True)], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays([x.cast(pa.int64()) if not pa.types.is_list(x.type) else x
                                                      for x in cols], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = stored(files.mapInArrow(run, schema), "token-rows")
    # ids before a frame: one row per frame (a few MB of ids each), summed by part, then by frame within a part
    per = rows.groupBy("part", "frame").agg(F.sum("n_tokens").alias("n"))
    parts = per.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_base"))
    within = per.select("part", "frame", (F.sum("n").over(W.partitionBy("part").orderBy("frame")) - F.col("n"))
                        .alias("frame_base"))
    starts = within.join(base, "part").select("part", "frame", (F.col("part_base") + F.col("frame_base")).alias("base"))
    return rows.join(starts, ["part", "frame"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
