"""Token ids of whole documents in binary blocks, compressed by a Re-Pair grammar per block.

Documents are encoded in ascending id order, shard by shard (range partitions).  A shard is a row
of blocks; a block holds whole documents, at least ``block_ids`` ids of them, and its own grammar:
in each round the frequent pairs of neighbouring symbols are replaced by new nonterminals, a pair
never spanning two documents.  A block's bytes (little-endian):

    8 bytes  magic "RPAIR01\\0"
    5 x u32  n_docs, n_literals, n_rules, n_symbols, bytes per symbol (2 or 4)
    i64[]    document ids (the smallest 64-bit integer stands for null)
    u32[]    symbols up to the end of each document; ids up to the end of each document
    u32[]    literals: the token ids that occur
    u32[2][] rules: left and right symbol of each nonterminal
    u32[]    expansion length of each nonterminal
    u16/32[] symbols: below n_literals a literal, else rule number + n_literals

The symbol ends give random access to a document, the expansion lengths to a place in it, without
expanding what stands before.  Blocks are rows of a Parquet table, written and committed by Spark
into any store that Spark can reach, next to the ranges of ids and token places they hold.

Defined results: a null or empty text is the end id alone; rows with equal ids stand in text order;
null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked, own_columns, ship, table, written
from .packing import vocabulary_path
from .tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 20
ROUNDS = 5
RULES_PER_ROUND = 4096
LEAST_COUNT = 16
MAGIC = b"RPAIR01\0"
NULL_ID = -(1 << 63)
HASH = np.uint64(0x9E3779B97F4A7C15)
BUCKET_BITS = 19
NONE = 1 << BUCKET_BITS
# symbols paired and hashed at a time: their arrays stay in a core's cache
STEP = 1 << 15
BLOCK_SCHEMA = "shard long, block long, first_id long, shard_start long, n_docs long, n_ids long, payload binary"


def grammar(ids: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS, rules_per_round: int = RULES_PER_ROUND,
            least_count: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ``ids`` (documents ending at ``ends``): literals, rules, expansion lengths, symbols,
    symbol ends."""
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    present[ids] = True
    literals = np.flatnonzero(present).astype(np.uint32)
    number = np.cumsum(present) - 1
    sym = number[ids].astype(np.uint32)
    is_end = np.zeros(len(sym), dtype=bool)
    is_end[ends - 1] = True
    rules, lengths = [], []
    n_symbols = len(literals)
    holder = np.zeros(NONE, dtype=np.uint64)
    for _ in range(rounds):
        if len(sym) < 2:
            break
        pair, bucket = np.empty(len(sym) - 1, dtype=np.uint64), np.empty(len(sym) - 1, dtype=np.intp)
        steps = [slice(lo, min(lo + STEP, len(pair))) for lo in range(0, len(pair), STEP)]
        # counts by hash bucket; a bucket counts only the pair that holds it
        for at in steps:
            code, hashed = pair[at], bucket[at].view(np.uint64)
            code[:] = sym[at]
            code <<= np.uint64(32)
            code |= sym[at.start + 1: at.stop + 1]
            np.multiply(code, HASH, out=hashed)
            hashed >>= np.uint64(64 - BUCKET_BITS)
            holder[bucket[at]] = code
        for at in steps:
            np.putmask(bucket[at], (np.take(holder, bucket[at], mode="clip") != pair[at]) | is_end[at], NONE)
        counts = np.bincount(bucket, minlength=NONE + 1)
        counts[NONE] = 0
        chosen = np.flatnonzero(counts >= least_count)
        if not len(chosen):
            break
        if len(chosen) > rules_per_round:
            chosen = chosen[np.argpartition(-counts[chosen], rules_per_round)[:rules_per_round]]
        # rank: the more frequent pair goes first where occurrences overlap
        chosen = chosen[np.argsort(counts[chosen], kind="stable")]
        ranks = np.zeros(NONE + 1, dtype=np.int32)
        ranks[chosen] = np.arange(1, len(chosen) + 1)
        r = np.zeros(len(pair) + 2, dtype=np.int32)
        before, own, after = r[:-2], r[1:-1], r[2:]
        np.take(ranks, bucket, out=own, mode="clip")
        take = (own > before) & (own >= after)
        # a run of one repeated pair (x x x x): every second place from its start
        flat = np.flatnonzero((own > 0) & (own == before))
        if len(flat):
            head = np.concatenate(([True], np.diff(flat) != 1))
            start = np.maximum.accumulate(np.where(head, flat - 1, 0))
            flat = flat[((flat - start) % 2 == 0) & (own[flat] >= after[flat]) & take[start]]
            take[flat] = True
        where = np.flatnonzero(take)
        if not len(where):
            break
        rank = own[where] - 1
        used = np.flatnonzero(np.bincount(rank))
        new = np.zeros(len(chosen), dtype=np.uint32)
        new[used] = np.arange(n_symbols, n_symbols + len(used), dtype=np.uint32)
        codes = holder[chosen]
        left, right = (codes[used] >> np.uint64(32)).astype(np.uint32), codes[used].astype(np.uint32)
        rules.append(np.stack([left, right], axis=1))
        so_far = np.concatenate([np.ones(len(literals), dtype=np.uint32), *lengths])
        lengths.append(so_far[left] + so_far[right])
        sym[where] = new[rank]
        keep = np.ones(len(sym), dtype=bool)
        keep[where + 1] = False
        is_end[where] = is_end[where + 1]
        sym, is_end = sym[keep], is_end[keep]
        n_symbols += len(used)
    rules_ = np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32)
    lengths_ = np.concatenate(lengths) if lengths else np.empty(0, dtype=np.uint32)
    return literals, rules_, lengths_, sym, np.flatnonzero(is_end) + 1


def pack_block(doc_ids: list[int | None], tokens: list[np.ndarray], **limits: int) -> bytes:
    ids = np.concatenate(tokens)
    ends = np.cumsum([len(t) for t in tokens])
    literals, rules, lengths, sym, sym_ends = grammar(ids, ends, **limits)
    width = 2 if len(literals) + len(rules) <= 0xFFFF else 4
    head = np.array([len(tokens), len(literals), len(rules), len(sym), width], dtype="<u4")
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), sym_ends.astype("<u4").tobytes(), ends.astype("<u4").tobytes(),
                     literals.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
                     sym.astype(f"<u{width}").tobytes()])


class Block:
    """A block's bytes, opened.  Nothing is expanded before it is asked for."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a Re-Pair block")
        n_docs, n_lit, n_rules, n_sym, width = np.frombuffer(payload, "<u4", 5, 8).tolist()
        at = 28
        parts = []
        for kind, n in (("<i8", n_docs), ("<u4", n_docs), ("<u4", n_docs), ("<u4", n_lit), ("<u4", 2 * n_rules),
                        ("<u4", n_rules), (f"<u{width}", n_sym)):
            parts.append(np.frombuffer(payload, kind, n, at))
            at += parts[-1].nbytes
        self.doc_ids, self.symbol_ends, self.ends, self.literals, rules, self.lengths, self.symbols = parts
        self.rules = rules.reshape(-1, 2)
        self.size = np.concatenate((np.ones(n_lit, dtype=np.int64), self.lengths))

    def expand(self, sym: np.ndarray) -> np.ndarray:
        n = len(self.literals)
        sym = sym.astype(np.int64)
        while len(deep := np.flatnonzero(sym >= n)):
            width = np.ones(len(sym), dtype=np.int64)
            width[deep] = 2
            to = np.cumsum(width) - width
            out = np.empty(len(sym) + len(deep), dtype=np.int64)
            out[to] = sym
            pair = self.rules[sym[deep] - n]
            out[to[deep]], out[to[deep] + 1] = pair[:, 0], pair[:, 1]
            sym = out
        return self.literals[sym]

    def document(self, i: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of document ``i``: expands only the symbols that hold them."""
        lo = int(self.symbol_ends[i - 1]) if i else 0
        sym = self.symbols[lo: int(self.symbol_ends[i])]
        ends = np.cumsum(self.size[sym])
        last = int(ends[-1]) if last is None else min(last, int(ends[-1]))
        if first >= last:
            return self.literals[:0]
        a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(sym[a:b])[first - before: last - before]


def write_blocks(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes ``docs`` in ascending id order and writes the blocks; the written table: shard, block,
    first_id, shard_start (ids before the block in its shard), n_docs, n_ids, payload."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            row = [shard, block, keys[0], start, len(keys), held, pack_block(keys, tokens)]
            block, start, held = block + 1, start + held, 0
            keys.clear()
            tokens.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                for key, ids_ in zip(ids[lo: lo + 256], encoder(vocabulary).encode(texts.slice(lo, 256).to_pylist(), end_id)):
                    keys.append(key)
                    tokens.append(ids_)
                    held += len(ids_)
                    if held >= block_ids:
                        yield flush()
        if keys:
            yield flush()

    ship(docs.sparkSession)
    rows = own_columns(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(work, BLOCK_SCHEMA))


def read_documents(blocks: DataFrame) -> DataFrame:
    """Reads written blocks back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, block."""
    ship(blocks.sparkSession)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = checked(shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    rows = blocks.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("shard_start")).alias("start"), "payload")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, start, payload in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                block = Block(payload)
                ids = block.expand(block.symbols).astype("<u4")
                ends = block.ends.astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                keys = pa.array([None if k == NULL_ID else k for k in block.doc_ids.tolist()], pa.int64())
                cols = [keys, pa.array(starts + start), pa.array(ends - starts), pa.array(crc, pa.int64()),
                        pa.array([shard] * n, pa.int64()), pa.array([number] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"])

    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, block long")


def op3_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = write_blocks(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
    return read_documents(blocks).select("doc_id", "start", "n_tokens", "ids_crc32")
