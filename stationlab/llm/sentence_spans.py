"""Repeated passages: sliding runs of whole sentences, hashed and joined over all documents.

A text is cut into sentences after closing marks and bars, at line ends and where a small letter or
digit is followed by a capitalised word (so that a passage set into other text starts a sentence of its
own).  From every sentence a run goes on until it has ``sentences`` sentences and ``words`` words.
Passages that hold no such run (set mid-sentence, one long sentence, no marks) are found by anchors that
depend on the words alone: of each ``WINDOW`` consecutive runs of ``GRAM`` words the one with the smallest
hash is a run too, and two neighbours that leave words between them are joined by a run over both.  Two
occurrences of the same GRAM + WINDOW - 1 = 50 words pick the same run, so each repeat of 50 words or more
has a span; outside whole sentences up to 30 words at either end of a passage can stay.
Runs with equal words (A-Z lower-cased, white space ignored) are the same span; its first occurrence,
by document id, then place, stays, and every other occurrence is removed (where it overlaps the first
in the same document, only what lies after that).

Only (hash, check, document, start, end) of the runs is shuffled: the hashes alone are counted with map-side
aggregation, then the runs are joined with those that occur twice, so a passage that a third of all
documents hold is one row per task in the count, and its join partition can be split.  Runs are equal
if hash and check agree (96 bits).  The spans of a document are put together by a function of that
document's own list.

A document is its id together with its text: rows of one id with different texts, null ids among them,
are documents of their own, and their spans carry ``text_key`` (64 bits of the text) to tell them apart.

Defined results: null and empty texts have no runs; documents with null ids come first in the order;
rows with equal ids and texts are one document, whose copies lose nothing to each other; an empty
table gives an empty result; further columns are kept by ``remove_spans``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, packed, ship, table, text_key, written
from .features import hashed_words, lower_words, mixed

SENTENCES = 2
WORDS = 20
# words of an anchored run, and how many consecutive ones compete: GRAM + WINDOW - 1 = 50 equal words share one
GRAM = 20
WINDOW = 31
_BASE = np.uint64(0x9E3779B97F4A7C15)
CUT = re.compile(r"(?<=[.!?;:|])\s+|\n\s*|(?<=[a-z0-9ß-öø-ÿ])[ ]+(?=[A-ZÀ-ÖØ-Þ])")


def sentences(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, number of words, hash) of the sentences; code points, end exclusive."""
    out, at = [], 0
    for start, end in [m.span() for m in CUT.finditer(text)] + [(len(text), len(text))]:
        words = lower_words(text[at:start])
        if words:
            out.append((at, start, len(words), xxhash.xxh3_128_digest(b" ".join(words))))
        at = end
    return out


def _marks(key: bytes) -> tuple[int, int]:
    """64 bits and further 32 bits of a hash, as signed integers."""
    h = xxhash.xxh3_128_intdigest(key)
    return (h & ((1 << 64) - 1)) - (1 << 63), (h >> 96) - (1 << 31)


def runs(text: str | None, least_sentences: int = SENTENCES, least_words: int = WORDS) -> list[tuple[int, int, int, int]]:
    """(hash, check, start, end) of the shortest run from each sentence with enough sentences and words."""
    if not text:
        return []
    found, out = sentences(text), []
    last = total = 0
    for i in range(len(found)):
        while last < len(found) and (last - i < least_sentences or total < least_words):
            total += found[last][2]
            last += 1
        if last - i < least_sentences or total < least_words:
            break
        out.append((*_marks(b"".join([s[3] for s in found[i:last]])), found[i][0], found[last - 1][1]))
        total -= found[i][2]
    return out


def anchored_runs(text: str | None) -> list[tuple[int, int, int, int]]:
    """(hash, check, start, end) of the runs of GRAM words that are smallest in a window, and of the runs that
    join two neighbours with words between them; places in code points."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = hashed_words(data)
    n = len(words) - GRAM + 1
    if n < WINDOW:
        return []
    grams = words[:n].copy()
    for i in range(1, GRAM):
        grams = grams * _BASE + words[i: i + n]
    grams = mixed(grams)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    at = np.unique(np.arange(WINDOW - 1, n) - windows.argmin(axis=1))  # the last of equal ones
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    place = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    start, end = place[edge[::2]], place[edge[1::2]]
    pairs = [(i, i + GRAM) for i in at.tolist()] + [(int(at[k]), int(at[k + 1]) + GRAM) for k in np.flatnonzero(np.diff(at) > GRAM).tolist()]
    return [(*_marks(words[a:b].tobytes()), int(start[a]), int(end[b - 1])) for a, b in pairs]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = SENTENCES,
                   least_words: int = WORDS) -> DataFrame:
    """The spans to remove, one row each: doc_id, start, end (code points, end exclusive) and
    first_doc_ids, the documents that keep the passages."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(t, least_sentences, least_words) + anchored_runs(t) for t in batch.column(1).to_pylist()]
            row = pa.array([i for i, r in enumerate(found) for _ in r], pa.int64())
            flat = list(zip(*[x for r in found for x in r])) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int32()), batch.column(0).take(row), batch.column(2).take(row),
                 pa.array(flat[2], pa.int32()), pa.array(flat[3], pa.int32())], ["hash", "check", "doc_id", "text_key", "start", "end"])

    rows = own_columns(docs, id=id_col, text=text_col).select("id", "text", text_key(F.col("text")).alias("key"))
    id_type = rows.schema["id"].dataType.simpleString()
    spans = written(rows.mapInArrow(work, f"hash long, check int, doc_id {id_type}, text_key long, start int, end int"))
    # the hashes that occur more than once; the join is dealt by hash at every size
    often = written(spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    some = written(spans.join(often.hint("shuffle_merge"), "hash"))
    firsts = some.groupBy("hash", "check").agg(F.min(F.struct("doc_id", "text_key", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n"))
    # a table of its own: both sides of the join are plain shuffles, so a hot passage's rows can be split
    firsts = written(firsts.where("n > 1").select("hash", "check", "first"))
    again = some.join(firsts.hint("shuffle_merge"), ["hash", "check"])
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    again = again.where(~(own & (F.col("start") == F.col("first.start"))))
    again = again.withColumn("start", F.when(own, F.greatest("start", "first.end")).otherwise(F.col("start"))).where(F.col("start") < F.col("end"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's spans: overlapping and touching ones become one."""
        for batch in batches:
            row, starts, ends, firsts = [], [], [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                merged: list[list] = []
                for x in sorted(found, key=lambda x: (x["start"], x["end"])):
                    if not merged or x["start"] > merged[-1][1]:
                        merged.append([x["start"], x["end"], set()])
                    merged[-1][1] = max(merged[-1][1], x["end"])
                    merged[-1][2].add(x["first_doc_id"])
                row += [i] * len(merged)
                starts += [m[0] for m in merged]
                ends += [m[1] for m in merged]
                firsts += [sorted((f for f in m[2] if f is not None)) + [None] * (None in m[2]) for m in merged]
            row = pa.array(row, pa.int64())
            kind = pa.list_(batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                                              pa.array(firsts, kind)], ["doc_id", "text_key", "start", "end", "first_doc_ids"])

    # bounded by the document's own length; equal spans of one first document are one
    per_doc = again.select("doc_id", "text_key", F.struct("start", "end", F.col("first.doc_id").alias("first_doc_id")).alias("span")) \
        .groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))
    merged = per_doc.mapInArrow(merge, f"doc_id {id_type}, text_key long, start int, end int, first_doc_ids array<{id_type}>")
    return merged.select("doc_id", "start", "end", "first_doc_ids", "text_key")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the spans' text (all columns, all rows)."""
    ship(docs.sparkSession)
    per_doc = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, cuts in zip(text, spans):
            if t is not None and cuts is not None:
                parts, at = [], 0
                for c in cuts:
                    parts.append(t[at:c["start"]])
                    at = max(at, c["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = packed(docs)
    old = F.col(f"row.`{text_col}`")
    joined = rows.join(per_doc, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (text_key(old) == F.col("text_key")), "left")
    text = F.when(F.col("spans").isNull(), old).otherwise(cut(old, F.col("spans")))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
