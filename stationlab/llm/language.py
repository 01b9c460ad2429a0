"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone.  A run of ``n`` letters
is bound into one vector: the first letter's vector rotated by n - 1 places, the next by n - 2, and so
on, multiplied place by place.  A document's vector is the bundle (sum) of its n-gram vectors, a
language's prototype the bundle of its training documents' vectors.  A document gets the language
whose prototype has the largest cosine with the document's vector.

Text is lower-cased; what is not a letter is one blank per run, also before and after the text, so
n-grams carry word starts and ends.  All counts are whole numbers: the sums do not depend on
the order of tasks, and every rerun gives the same vectors.

Training reads every training row once.  A task adds up n-gram counts per language, turns them into
one vector per language (``dim`` numbers) and sends these; nothing else is shuffled, however many
rows a language has.  Scoring is a function of the text column, in blocks of documents: the n-grams of
a block are bound once and one matrix product bundles all its documents.  Prototypes (languages x dim
numbers) are the only thing broadcast; more than ``MAX_LANGUAGES`` languages are refused.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any training
row with a letter every text is ``und``; equal cosines go to the smaller name; a cosine below 0 scores
0; an empty text has no letter; repeated rows weigh as often as they occur and score alike; a null id
is in the training fold (it is not held out); training rows with a null language do not count; very
long texts are read in slices and added up; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, ship, table

DIM = 1024
N = 3
UNKNOWN = "und"
MAX_LANGUAGES = 10_000
# code points of a text read at once; texts and n-grams of a block bundled at once; n-grams that a
# training task holds before they become vectors
SLICE = 1 << 19
BLOCK_TEXTS = 128
BLOCK_GRAMS = 1 << 18
HELD_GRAMS = 1 << 21
# n-grams bound or multiplied at once
BIND_ROWS = 1 << 13
CODE_BITS = 21

_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter (built once per process)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def symbols(text: str) -> Iterator[np.ndarray]:
    """The text as letters' code points with one 0 per run of anything else, at both ends too, slice by slice."""
    letters, last = is_letter(), 0
    yield np.zeros(1, dtype=np.uint64)
    for i in range(0, len(text), SLICE):
        code = np.frombuffer(text[i: i + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where(letters[code], code, np.uint32(0)).astype(np.uint64)
        before = np.concatenate(([np.uint64(last)], code[:-1]))
        yield code[(code != 0) | (before != 0)]
        last = code[-1]
    if last:
        yield np.zeros(1, dtype=np.uint64)


def grams(text: str | None, n: int = N) -> Iterator[np.ndarray]:
    """The n-grams of a text as numbers (``CODE_BITS`` bits per symbol, the first one highest), slice by slice."""
    tail = np.empty(0, dtype=np.uint64)
    for part in symbols(text or ""):
        part = np.concatenate((tail, part))
        size = max(len(part) - n + 1, 0)
        out = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            out = (out << np.uint64(CODE_BITS)) | part[k: k + size]
        yield out
        tail = part[size:]


def merged(profiles: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts over several (n-grams, counts)."""
    keys, at = np.unique(np.concatenate([k for k, _ in profiles]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in profiles]), minlength=len(keys)).astype(np.int64)


def profile(text: str | None, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their counts; none if the text has no letter."""
    found, held = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)), []
    for part in grams(text, n):
        held.append(part)
        if len(part) >= SLICE // 2:
            found, held = merged([found, np.unique(np.concatenate(held), return_counts=True)]), []
    if held:
        last = np.unique(np.concatenate(held), return_counts=True)
        found = merged([found, last]) if len(found[0]) else last
    return found if found[0].any() else (found[0][:0], found[1][:0])


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of +1 and -1 (int8) per symbol: the bits of a 64-bit scramble of symbol and word number."""
    word = np.arange(dim // 64, dtype=np.uint64)
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + word[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (bits.astype(np.int8) << 1) - 1


def bound(keys: np.ndarray, n: int = N, dim: int = DIM) -> np.ndarray:
    """The vector (+1 and -1, int8) of each n-gram: rotated letter vectors, multiplied place by place."""
    out = None
    mask = np.uint64((1 << CODE_BITS) - 1)
    for i in range(n):
        turn = n - 1 - i
        codes, at = np.unique((keys >> np.uint64(CODE_BITS * turn)) & mask, return_inverse=True)
        rows = np.roll(letter_vectors(codes, dim), turn, axis=1)[at]
        out = rows if out is None else np.multiply(out, rows, out=out)
    return out


def blocks(texts: Iterable[str | None], n: int = N) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The profiles of consecutive texts, in lists of at most ``BLOCK_TEXTS`` texts and about
    ``BLOCK_GRAMS`` n-grams; a text with more n-grams than that is a list of its own."""
    held, size = [], 0
    for t in texts:
        p = profile(t, n)
        if held and (size + len(p[0]) > BLOCK_GRAMS or len(held) >= BLOCK_TEXTS):
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p[0])
    if held:
        yield held


def bundles(block: list[tuple[np.ndarray, np.ndarray]], n: int = N, dim: int = DIM) -> np.ndarray:
    """The vector of each profile of a block (profiles x dim)."""
    keys, at = np.unique(np.concatenate([k for k, _ in block]), return_inverse=True)
    row = np.repeat(np.arange(len(block)), [len(k) for k, _ in block])
    count = np.concatenate([c for _, c in block])
    # single precision is exact for whole numbers up to 2^24; beyond that, double
    kind = np.float32 if max(c.sum() for _, c in block) < 1 << 24 else np.float64
    out = np.zeros((len(block), dim))
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(0, len(keys) + BIND_ROWS, BIND_ROWS))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        mine, first = order[a:b], i * BIND_ROWS
        part = np.zeros((len(block), min(BIND_ROWS, len(keys) - first)), dtype=kind)
        part[row[mine], at[mine] - first] = count[mine]
        out += part @ bound(keys[first: first + BIND_ROWS], n, dim).astype(kind)
    return out


@dataclass
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # languages x dim, unit length
    n: int = N

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        at = 0
        for block in blocks(texts, self.n):
            vectors = bundles(block, self.n, self.vectors.shape[1])
            length = np.sqrt((vectors * vectors).sum(axis=1))
            cosine = vectors @ self.vectors.T / np.where(length > 0, length, 1.0)[:, None]
            best = cosine.argmax(axis=1)
            for i, (keys, _) in enumerate(block):
                if len(keys):
                    names[at + i] = self.languages[best[i]]
                    scores[at + i] = min(max(cosine[i, best[i]], 0.0), 1.0)
            at += len(block)
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        dim: int = DIM, n: int = N) -> Prototypes:
    """Prototypes of the languages, over all training rows (``held_out`` rows and null languages apart).
    ``n`` is 1 to 3 (an n-gram is one 64-bit number), ``dim`` a multiple of 64."""
    if not 1 <= n <= 64 // CODE_BITS or dim < 64 or dim % 64:
        raise ValueError(f"n must be 1 to {64 // CODE_BITS}, dim a multiple of 64")
    ship(docs.sparkSession)
    rows = own_columns(docs, id=id_col, text=text_col, lang=lang_col) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))) \
        .select("text", F.col("lang").cast("string").alias("lang"))
    few = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if few > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: {lang_col} is not a language column")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list] = {}
        size = 0

        def flush() -> None:
            for lang, profiles in held.items():
                vector = np.rint(bundles([merged(profiles)], n, dim)[0]).astype(np.int64)
                sums[lang] = sums[lang] + vector if lang in sums else vector
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = profile(text, n)
                if len(p[0]):
                    held.setdefault(lang, []).append(p)
                    size += len(p[0])
                if size >= HELD_GRAMS:
                    flush()
                    size = 0
        flush()
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim, dtype=np.int32)),
                                              pa.array(vector)], ["lang", "place", "total"])

    sums = rows.mapInArrow(bundle, "lang string, place int, total long") \
        .groupBy("lang", "place").agg(F.sum("total").cast("double").alias("total")).toPandas()
    languages = sorted(sums["lang"].unique())
    vectors = np.zeros((len(languages), dim))
    vectors[np.searchsorted(languages, sums["lang"]), sums["place"]] = sums["total"]
    length = np.sqrt((vectors * vectors).sum(axis=1))
    return Prototypes(languages, vectors / np.where(length > 0, length, 1.0)[:, None], n)


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def predictor(spark: SparkSession, prototypes: Prototypes):
    """A function of a text column: struct<lang_pred string, score double>."""
    ship(spark)
    shared = spark.sparkContext.broadcast(prototypes)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             dim: int = DIM, n: int = N) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    predict = predictor(docs.sparkSession, fit(docs, id_col, text_col, lang_col, dim, n))
    rows = own_columns(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("p")) \
        .select("doc_id", "held_out", "p.lang_pred", "p.score")


def op12_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
