"""Operator 1: hierarchical multi-length packing.

``pack`` encodes documents where they are read (no shuffle) and packs the tokens of every
task's rows into sequences:

* Route: full windows of the longest context size leave at once as sequences of their
  own. What is left of a document (shorter than the longest window) is routed to the
  smallest tier that holds it (by default 128, 256, 512, 1024).
* Pack, long tiers first: a window is opened by a leftover of its own tier, and its gap is
  filled from the same and shorter tiers with the longest leftover that fits. When nothing
  fits whole, the gap takes the head of a shorter tier's leftover, and the tail of that
  leftover is routed again. So windows end full as long as any leftover remains; only the
  last windows of a task can hold padding.
* Balance: the sequences of a tier are dealt to step groups (``step_group``) in serpentine
  order of their attention cost (sum of squared piece lengths), so groups of a tier hold
  equal numbers of windows and about equal cost.

Leftovers are packed every ``buffer_docs`` documents, so a task holds at most that many
leftovers (each shorter than one window) however large its partition is.

Defined results: a null or empty text is its end id alone; rows that repeat or share a
``doc_id`` are packed independently, each with its own pieces; a null ``doc_id`` is kept;
an empty table gives no rows; other columns are ignored, whatever their names.
Identifiers: ``sequence_id`` = task partition * 2^32 + a running number, stable when a
lost task is run again because the rows of a scan partition and their order are fixed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import text_of
from airmetrics.llm.tokens import encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier long, sequence_tokens long, step_group long")


class _Leftovers:
    """Leftovers by exact length; the longest that fits a gap is found with one bit mask."""

    def __init__(self, window: int):
        self._by = [[] for _ in range(window + 1)]
        self._mask = 0
        self.count = 0

    def put(self, item: tuple) -> None:
        n = len(item[1])
        self._by[n].append(item)
        self._mask |= 1 << n
        self.count += 1

    def take(self, most: int, least: int = 1):
        """The longest leftover of ``least`` to ``most`` tokens, or None."""
        n = (self._mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < least:
            return None
        item = self._by[n].pop()
        if not self._by[n]:
            self._mask ^= 1 << n
        self.count -= 1
        return item

    def take_shortest(self, over: int):
        """The shortest leftover longer than ``over``, or None."""
        high = self._mask >> (over + 1)
        if not high:
            return None
        n = over + (high & -high).bit_length()
        return self.take(n, n)


class _Packer:
    def __init__(self, tiers: tuple[int, ...], step_tokens: int, partition: int):
        self.tiers, self.window, self.step = tuple(sorted(tiers)), max(tiers), step_tokens
        self.partition, self.sequences, self.groups = partition, 0, 0
        self.left = _Leftovers(self.window)
        self.open: dict[int, list[list[tuple]]] = {t: [] for t in self.tiers}

    def add(self, doc_id, ids: np.ndarray) -> None:
        """ids: the document's tokens with the end id."""
        n, w = len(ids), self.window
        full = n - n % w
        for at in range(0, full, w):
            self.open[w].append([(doc_id, ids[at:at + w], at, n)])
        if full < n:
            self.left.put((doc_id, ids[full:].copy(), full, n))

    def pack(self) -> None:
        for tier in reversed(self.tiers):
            lower = max((t for t in self.tiers if t < tier), default=0)
            while (first := self.left.take(tier, lower + 1)) is not None:
                pieces, gap = [first], tier - len(first[1])
                while gap:
                    nxt = self.left.take(gap)
                    if nxt is None:
                        nxt = self.left.take_shortest(gap)
                        if nxt is None:
                            break
                        doc_id, ids, at, n = nxt  # the head fills the gap, the tail is routed again
                        self.left.put((doc_id, ids[gap:], at + gap, n))
                        nxt = (doc_id, ids[:gap], at, n)
                    pieces.append(nxt)
                    gap -= len(nxt[1])
                self.open[tier].append(pieces)

    def rows(self):
        """Rows of all packed sequences, dealt to balanced step groups; empties the packer's windows."""
        for tier, packed in self.open.items():
            if not packed:
                continue
            n_groups = max(1, -(-len(packed) * tier // self.step))
            packed.sort(key=lambda ps: -sum(len(p[1]) ** 2 for p in ps))
            for i, pieces in enumerate(packed):
                lap, at = divmod(i, n_groups)
                group = (self.partition << 32) + self.groups + (at if lap % 2 == 0 else n_groups - 1 - at)
                sequence = (self.partition << 32) + self.sequences
                self.sequences += 1
                total, offset = sum(len(p[1]) for p in pieces), 0
                for doc_id, ids, at, n in pieces:
                    yield (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence,
                           offset, tier, total, group)
                    offset += len(ids)
            self.groups += n_groups
            self.open[tier] = []


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, tiers: tuple[int, ...] = (128, 256, 512, 1024),
         step_tokens: int = 1 << 16, buffer_docs: int = 4096, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pack every document into sequences; one row per piece (see the module's text)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        enc = encoder(tokenizer_path)
        packer = _Packer(tiers, step_tokens, TaskContext.get().partitionId())

        def table():
            cols = list(zip(*packer.rows(), strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, offsets in enc.batches(batch.column(1)):
                for k in range(len(offsets) - 1):
                    doc = np.append(ids[offsets[k]:offsets[k + 1]], np.uint32(end_id))
                    packer.add(keys[first + k], doc)
                if packer.left.count >= buffer_docs or len(packer.open[packer.window]) >= buffer_docs:
                    packer.pack()
                    yield table()
        packer.pack()
        yield table()

    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(text_of(docs, text_col)).alias("text")
                       ).mapInArrow(run, SCHEMA)
