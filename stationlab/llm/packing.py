"""Harmonic packing of whole documents into sequences of at most ``capacity`` tokens.

Each worker packs the documents it reads by itself, in one pass and without a shuffle.  A document
is its ids and an end id.  It is cut into full sequences, then its rest into halves, quarters ...
of the capacity down to ``smallest_part`` and one last remainder.  Pieces fall into reciprocal-
capacity classes: class k holds lengths in (capacity / (k + 1), capacity / k], and every bin of
class k is closed with exactly k pieces.  Halves, quarters and so on fill their bins without any
padding; only remainders, under ``smallest_part`` tokens, leave some.  A worker's last, unfilled
bins are run together and cut anew into full sequences; what is left of them fills sequences whose
lengths are powers of two, which need no padding.

A worker holds one batch of texts and one open bin per class (under ``capacity`` ids each).  Its
sequences are numbered from its partition's number, so that a task that is run again gives the same
rows.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are packed as
often as they occur; null ids pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import own_columns, ship, table
from .tokens import encoder

CAPACITY = 2048
SMALLEST_PART = 128
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def cuts(n_ids: int, capacity: int, smallest_part: int) -> list[int]:
    """Lengths of the pieces of a document of ``n_ids`` ids, in order."""
    out = [capacity] * (n_ids // capacity)
    rest, part = n_ids % capacity, capacity // 2
    while part >= smallest_part and rest:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] if rest else out


class Worker:
    """Open bins of one worker; ``rows`` collects finished pieces."""

    def __init__(self, partition: int, capacity: int, smallest_part: int):
        self.capacity, self.smallest_part = capacity, smallest_part
        self.next_sequence = partition << 33
        self.open: dict[int, list[tuple]] = {}  # class -> pieces (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        for n in cuts(len(ids), self.capacity, self.smallest_part):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, at, ids[at: at + n], len(ids)))
            at += n
            if len(bin_) == k:
                self.close(self.open.pop(k))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, self.next_sequence, offset, raw))
            offset += len(ids)
        self.next_sequence += 1

    def finish(self) -> None:
        """The unfilled bins, run together."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        lengths = cuts(sum(len(p[2]) for p in left), self.capacity, 1)
        for n in lengths:
            bin_ = []
            while n:
                doc_id, start, ids, total = left.pop(0)
                if len(ids) > n:
                    left.insert(0, (doc_id, start + n, ids[n:], total))
                    ids = ids[:n]
                bin_.append((doc_id, start, ids, total))
                n -= len(ids)
            self.close(bin_)

    def take(self, with_ids: bool) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * len(FIELDS)
        self.rows = []
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        arrays.append(pa.array(cols[7], pa.binary()) if with_ids else pa.nulls(len(cols[7]), pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, FIELDS)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
         capacity: int = CAPACITY, smallest_part: int = SMALLEST_PART, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    ``with_ids``, the ids themselves (little-endian unsigned 32-bit integers, else null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker(TaskContext.get().partitionId(), capacity, smallest_part)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                encoded = encoder(vocabulary).encode(texts.slice(lo, 256).to_pylist(), end_id)
                for doc_id, tokens in zip(ids[lo: lo + 256], encoded):
                    worker.add(doc_id, tokens)
                yield worker.take(with_ids)
        worker.finish()
        yield worker.take(with_ids)

    ship(docs.sparkSession)
    rows = own_columns(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return rows.mapInArrow(work, SCHEMA)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY), with_ids=False).drop("ids")
