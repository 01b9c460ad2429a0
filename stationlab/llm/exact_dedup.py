"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they agree after lower-casing A-Z; null counts as the empty text.  Level 1
counts rows per byte length, level 2 counts (length, hash of the first characters) among the
lengths that hold two rows or more, level 3 hashes the full text, only for rows whose (length,
prefix) survived.  Every level is a count with map-side partial aggregation over thin keys: a copy
group with a third of all rows sends one row per task and key, and no text is ever shuffled.

Defined results: null text = empty text (all of them one group); a group keeps its largest id,
null ids being smallest (all null: one of the null rows); repeated rows (same id and text) are one
document seen twice, so ``duplicate_table`` marks both as kept and ``drop_duplicates`` leaves one;
an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checked, own_columns, packed, table, unpacked, written

PREFIX_CHARS = 64


def full_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per text held by two rows or more: text_sha256, keep_id, group_size, keep_rows (the
    number of rows with the kept id).  Written to the shared folder."""
    rows = own_columns(docs, id=id_col, text=text_col) \
        .withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("len", F.octet_length("text"))
    lengths = checked(written(_repeated(rows, ["len"])))
    # computed before the joins, so a join that does shuffle moves keys and not texts
    prefixed = rows.withColumn("prefix", F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars))))
    prefixes = written(_repeated(prefixed.select("len", "prefix").join(lengths, "len", "left_semi"), ["len", "prefix"]))
    small = checked(prefixes)
    if small is prefixes:
        # too many surviving keys to broadcast: hash in the scan and shuffle (key, hash, id) instead of texts
        prefixed = prefixed.select("id", "len", "prefix", full_hash(F.col("text")).alias("sha"))
        survivors = prefixed.join(prefixes, ["len", "prefix"], "left_semi")
    else:
        survivors = prefixed.join(small, ["len", "prefix"], "left_semi") \
            .select("id", full_hash(F.col("text")).alias("sha"))
    per_id = survivors.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = per_id.groupBy("sha").agg(F.max(F.struct("id", "n")).alias("top"), F.sum("n").alias("group_size"))
    return written(groups.where("group_size > 1").select(
        F.col("sha").alias("text_sha256"), F.col("top.id").alias("keep_id"),
        "group_size", F.col("top.n").alias("keep_rows")))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def duplicate_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = checked(duplicate_groups(docs, id_col, text_col))
    rows = own_columns(docs, doc_id=id_col, text=text_col) \
        .select("doc_id", full_hash(F.col("text")).alias("text_sha256"))
    joined = rows.join(groups, "text_sha256", "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts (all columns kept)."""
    groups = checked(duplicate_groups(docs, id_col, text_col))
    keyed = packed(docs).withColumn("sha", full_hash(F.col(f"row.`{text_col}`")))
    joined = keyed.join(groups, F.col("sha") == F.col("text_sha256"), "left")
    stays = joined.where(F.col("group_size").isNull() | F.col(f"row.`{id_col}`").eqNullSafe(F.col("keep_id")))
    once = stays.where(F.col("group_size").isNull() | (F.col("keep_rows") == 1))
    # rows that repeat the kept id itself: any one of them, chosen task by task before the shuffle
    repeats = stays.where("keep_rows > 1").groupBy("sha").agg(F.first("row").alias("row"))
    return unpacked(once.select("row").unionByName(repeats.select("row")), docs)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_table(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
