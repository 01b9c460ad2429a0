"""Fill-in-middle: texts cut at token boundaries into prefix, middle and suffix and put in another order.

The token boundaries of a text form a compressed set of code-point offsets in the manner of Roaring
bitmaps: the offsets are dealt by their high 16 bits into containers, each held as the smallest of a
sorted array, a bitmap of 65,536 bits or a list of runs, with the cumulative cardinalities beside
them.  The k-th boundary is found by a search over the cumulative cardinalities and a local select
inside one container, so both cut offsets of a text come from two selects on one set.

Only the offsets are computed in Python (an Arrow function of the text's bytes, no shuffle); the
texts are cut and put together by Spark's own string functions.

Defined results: a null text is the empty text, which is always ``plain`` and has no token; a text
that holds one of the three marks is ``plain``, so an output can always be taken apart again; a null
id draws as the empty id; repeated rows give equal rows; equal draws give an empty middle; tokens of
one code point (digits, blanks, letters outside A-Z) are units like words; an empty table gives an
empty result; further columns are ignored, whatever their names.  Texts of any length are cut whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, ship, table
from .features import utf8_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# of 100 texts, from this draw on a text stays plain; below this draw the suffix comes first
PLAIN_FROM = 90
SUFFIX_FIRST_BELOW = 20

BLOCK = 1 << 16
BITMAP_BYTES = BLOCK // 8

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


class ArrayContainer:
    """The low 16 bits of few members, sorted."""

    kind = "array"

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def __len__(self) -> int:
        return len(self.low)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class BitmapContainer:
    """One bit for each of the 65,536 places, with the number of members before each 64-bit word."""

    kind = "bitmap"

    def __init__(self, member: np.ndarray):
        bits = np.zeros(BITMAP_BYTES, dtype=np.uint8)
        packed = np.packbits(member, bitorder="little")
        bits[: len(packed)] = packed
        self.words = bits.view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.upto, rank, side="right"))
        rest = rank - (int(self.upto[word - 1]) if word else 0)
        bits = int(self.words[word])
        for _ in range(rest):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1


class RunContainer:
    """First place of each run of neighbouring members, with the number of members up to its end."""

    kind = "run"

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.upto = np.cumsum(lengths, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.upto, rank, side="right"))
        return int(self.starts[run]) + rank - (int(self.upto[run - 1]) if run else 0)


def container(member: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form of one block's members, given as booleans (one at least is true)."""
    low = np.flatnonzero(member)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1] + 1)))
    if 4 * len(first) <= min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low[first], np.diff(np.append(first, len(low))))
    return ArrayContainer(low) if 2 * len(low) <= BITMAP_BYTES else BitmapContainer(member)


class BoundarySet:
    """A set of offsets as containers by their high bits, with cumulative cardinalities."""

    def __init__(self, member: np.ndarray):
        self.high, self.containers, sizes = [], [], []
        for high in range(-(-len(member) // BLOCK)):
            block = member[high * BLOCK: (high + 1) * BLOCK]
            if block.any():
                self.high.append(high)
                self.containers.append(container(block))
                sizes.append(len(self.containers[-1]))
        self.upto = np.cumsum(sizes, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, rank: int) -> int:
        """The member with ``rank`` smaller members."""
        at = int(np.searchsorted(self.upto, rank, side="right"))
        before = int(self.upto[at - 1]) if at else 0
        return self.high[at] * BLOCK + self.containers[at].select(rank - before)


def boundaries(text: np.ndarray) -> BoundarySet:
    """The cut offsets (code points) of a text given as UTF-8 bytes: 0 and the end of each token
    ``[A-Za-z]+|[^A-Za-z]``.  A code point counts by its first byte; only A-Z and a-z are letters."""
    letter = _LETTER[text[(text & 0xC0) != 0x80]]
    member = np.ones(len(letter) + 1, dtype=bool)
    # no cut between two letters
    member[1:-1] = ~(letter[:-1] & letter[1:])
    return BoundarySet(member)


def _cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    out = np.empty((3, len(text)), dtype=np.int64)
    for i, (t, a, b) in enumerate(zip(utf8_texts(text), one.to_pylist(), other.to_pylist())):
        offsets = boundaries(t)
        size = len(offsets)
        a, b = sorted((a % size, b % size))
        out[:, i] = size - 1, offsets.select(a), offsets.select(b)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "first", "second"])


def draw(doc_id: Column, group: int, salt: str = "1:") -> Column:
    """The ``group``-th (from 0) 8-digit group of the hex sha256 of salt and id, as an unsigned integer."""
    text = F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 8 * group + 1, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (tokens), form (plain, psm, spm), prefix_chars and middle_chars
    (null if plain) and output, the text as it is to be trained on."""
    ship(docs.sparkSession)
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    cuts = F.arrow_udf(_cuts, "struct<n:long,first:long,second:long>")
    rows = rows.select("doc_id", "text", cuts("text", draw(F.col("doc_id"), 0), draw(F.col("doc_id"), 1)).alias("c"))
    text, first, second = F.col("text"), F.col("c.first").cast("int"), F.col("c.second").cast("int")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (draw(F.col("doc_id"), 2) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(draw(F.col("doc_id"), 3) % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    p, m, s = F.substr(text, F.lit(1), first), F.substr(text, first + 1, second - first), F.substr(text, second + 1)
    output = F.when(F.col("form") == "plain", text) \
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)) \
        .otherwise(F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", F.col("c.n").alias("n"), "form", F.when(cut, F.col("c.first")).alias("prefix_chars"),
                       F.when(cut, F.col("c.second") - F.col("c.first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form alone: the parts between the marks, put in order again."""
    def parts(second_mark: str) -> tuple[Column, Column, Column]:
        width = len(PREFIX)
        body = F.substr(output, F.lit(width + 1))
        one = F.substring_index(body, second_mark, 1)
        body = F.substr(body, F.char_length(one) + width + 1)
        two = F.substring_index(body, MIDDLE, 1)
        return one, two, F.substr(body, F.char_length(two) + width + 1)

    p, s, m = parts(SUFFIX)
    s2, p2, m2 = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "spm", F.concat(p2, m2, s2)).otherwise(F.concat(p, m, s))


def op11_boundary_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens FROM documents),
c AS (
  SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[1:least(a, b)], '') AS pre,
         array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(tokens[greatest(a, b) + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                        ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
