"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Sources, in code point order with null last, weigh 5, 2, 1, repeating.  Their targets share 150 %
of all words by weight, none above twice its source's words (the excess is shared again by
weight).  Each source's documents, in a hash-shuffled order, form a stream that is read at most
twice and is cut into blocks of ``block_words`` words.  The schedule is a van der Corput sequence:
slot i has the bit-reversed number of i as its point, points run through the cumulative block
numbers of the sources, slots are ranked per source in slot order, and rank r takes block r of the
source's stream; the last block is cut at the target.  So every prefix of the schedule mixes the
sources near their shares, and each source gives its target to the word.

Scale: the texts are scanned once for their sizes.  Stream positions are sums in two levels (per
source and hash bucket, then within the bucket), slot ranks likewise (per chunk of slots), so a
source with a third of all rows is spread over all tasks; blocks hold equally many words, so the
join on (source, block) has no hot key.  Windows over one key run on such sums only.

Defined results: null or empty texts have size 0 and are never taken; null is a source of its own;
repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checked, own_columns, packed, table, unpacked, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
BUCKET_ROWS = 2048
CHUNK_SLOTS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per source: source_no, n_docs, source_size, target, quota (whole words), n_blocks and
    first_block (blocks of the sources before it).  One row per source."""
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("source_no") % len(WEIGHTS) + 1)
    everything = Window.partitionBy()
    sources = sources.withColumns({
        "weight": weight, "cap": F.col("source_size") * F.lit(MOST),
        "goal": F.sum("source_size").over(everything) * F.lit(SHARE)})
    # Water level, sources in the order in which they fill up: were the first k full, the rest would
    # share what is left at level k.  It rises while source k does fill, then falls: take the top.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.col("goal") - before) / rest)
    sources = sources.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    sources = sources.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * 2))
    sources = sources.withColumn("n_blocks", F.ceil(F.col("quota") / F.lit(block_words)).cast("long"))
    earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return sources.select("source", "source_no", "n_docs", "source_size", "target", "quota", "n_blocks",
                          F.coalesce(F.sum("n_blocks").over(earlier), F.lit(0)).alias("first_block"))


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """One row per slot of the mix: slot, source_no, block (its rank in the source).

    The number of slots is that of the blocks, rounded up to a power of two; points beyond the
    last block are idle slots and left out."""
    n = targets.agg(F.sum("n_blocks")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(n, 2))))
    reverse = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    slots = spark.range(1 << bits if n else 0).select(F.col("id").alias("slot")).withColumn("point", reverse) \
        .where(F.col("point") < n)
    # points through the cumulative weights: each source owns an interval of points, cut into chunks
    # so that the equality join has no key with many points
    width = F.lit(CHUNK_SLOTS)
    last = F.col("first_block") + F.col("n_blocks")
    owned = targets.where("n_blocks > 0").select(
        "source_no", F.col("first_block").alias("low"), last.alias("high"),
        F.explode(F.sequence(F.floor(F.col("first_block") / width), F.floor((last - 1) / width))).alias("part"))
    slots = slots.withColumn("part", F.floor(F.col("point") / width))
    slots = slots.join(owned, (slots["part"] == owned["part"]) & (F.col("point") >= F.col("low"))
                       & (F.col("point") < F.col("high"))).select("slot", "source_no")
    # ranks per source in two levels
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / width))
    counts = slots.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = slots.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(counts, ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("before") + F.col("rank")).alias("block"))


def stream_positions(sizes: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``start``: the words of the source's documents before this one in the shuffled order."""
    bits = min(24, max(0, math.ceil(math.log2(max(1, n_docs / BUCKET_ROWS)))))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.shiftright(F.conv(F.substring(digest, 1, 6), 16, 10).cast("int"), 24 - bits)
    rows = sizes.withColumns({"digest": digest, "bucket": bucket})
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("digest", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("before") + F.col("within")) \
        .drop("digest", "bucket", "before", "within")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block_words: int = BLOCK_WORDS) -> dict[str, DataFrame]:
    """The mix of ``docs``: ``targets`` (per source), ``schedule`` (per slot), ``pieces`` (the words
    of each document that a slot takes: doc_id, source_no, start, size, slot, block, first_word,
    words) and ``taken`` (per row of ``docs``: doc_id, size, source_size, target, taken)."""
    spark = docs.sparkSession
    sizes = written(own_columns(docs, doc_id=id_col, source=source_col, text=text_col)
                    .select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = written(source_targets(sizes, block_words))
    small = checked(targets.select(F.col("source").alias("name"), "source_no", "source_size", "target", "quota"))
    n_docs = targets.agg(F.sum("n_docs")).first()[0] or 0
    rows = sizes.join(small, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    placed = written(stream_positions(rows.where("size > 0"), n_docs))
    slots = written(schedule(spark, targets))
    # the stream is read up to twice: blocks overlapped by the document in either reading
    read_at = placed.withColumn("reading", F.explode(F.array(F.lit(0), F.lit(1)))) \
        .withColumn("low", F.col("start") + F.col("reading") * F.col("source_size")) \
        .withColumn("high", F.least(F.col("low") + F.col("size"), "quota")).where("low < high")
    b = F.lit(block_words)
    cut = read_at.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / b), F.floor((F.col("high") - 1) / b))))
    pieces = cut.join(slots, ["source_no", "block"]).withColumns({
        "first": F.greatest("low", F.col("block") * b), "last": F.least("high", (F.col("block") + 1) * b)})
    pieces = pieces.select("doc_id", "source_no", "start", "size", "slot", "block",
                           (F.col("first") - F.col("low")).alias("first_word"),
                           (F.col("last") - F.col("first")).alias("words"))
    per_doc = pieces.groupBy("source_no", "start").agg(F.sum("words").alias("words"))
    some = placed.join(per_doc, ["source_no", "start"], "left") \
        .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))
    none = rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return {"targets": targets, "schedule": slots, "pieces": pieces, "placed": placed, "taken": some.unionByName(none)}


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as the mix takes them (all columns): a row for each reading of the stream that reaches
    the document's first word, so 0, 1 or 2 rows.

    A reading takes a source's documents up to one place in the shuffled order; the places are one
    row per source, so the texts are filtered where they are read and never shuffled."""
    parts = mix(docs, id_col, text_col, source_col, block_words)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    place = F.struct(digest.alias("digest"), F.col("doc_id"), F.col("size"))
    cuts = parts["placed"].groupBy("source_no").agg(
        F.max(F.when(F.col("start") < F.col("quota"), place)).alias("first"),
        F.max(F.when(F.col("start") + F.col("source_size") < F.col("quota"), place)).alias("second"))
    cuts = written(parts["targets"].join(cuts, "source_no").select(
        F.col("source").alias("_name"), F.col("first").alias("_first"), F.col("second").alias("_second")))
    digest = F.md5(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")))
    own = packed(docs).withColumns({"digest": digest, "size": word_count(F.col(f"row.`{text_col}`"))})
    joined = own.join(checked(cuts), F.col(f"row.`{source_col}`").eqNullSafe(F.col("_name"))).where("size > 0")
    here = F.struct(F.col("digest"), F.col(f"row.`{id_col}`").alias("doc_id"), F.col("size"))
    times = F.when(here <= F.col("_first"), 1).otherwise(0) + F.when(here <= F.col("_second"), 1).otherwise(0)
    return unpacked(joined.withColumn("time", F.explode(F.array_repeat(F.lit(0), times))), docs)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))["taken"]


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS no
      FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS goal FROM s),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, max(level) OVER () * weight)::DOUBLE AS target FROM l),
q AS (SELECT *, least(round(target)::BIGINT, source_size * 2) AS quota FROM t),
p AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
             coalesce(sum(d.size) OVER (PARTITION BY q.no ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, quota) - start)
        + greatest(0, least(source_size + start + size, quota) - source_size - start))::BIGINT AS taken FROM p
"""
