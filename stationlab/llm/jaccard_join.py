"""Jaccard join on word n-grams by signature trees.

Documents with equal n-gram sets form a class.  Linked classes share a token (n-gram hash) among the
first |s| - ceil(t |s|) + 1 tokens of each set in any one global order: tokens found in the prefixes
of many documents come last, else hashes decide.  Classes that share such a token form a block.

A block first loses the sets that sizes and places part from all others: a set of s tokens that has the
shared token at place p has at most s - p tokens in common with another from there on, which bounds the
size of the sets that it can be linked with; two sets are compared only if each one's size is within the
other's bound.  At the first token that linked sets share both are kept.  Only what is left of
a block ships signatures.  The block is then joined by a signature tree: leaves hold the sets' bitmaps, a node the OR of its children,
their range of set sizes, their largest number of tokens that share a bit and of tokens outside the
bitmap.  A pair of nodes can hold linked sets only if (common bits + these allowances) reaches the
overlap that their sizes need; the dual traversal drops other pairs, and pairs of nodes that lie in
one component already.  First the blocks are pruned with small bitmaps (of the tokens with a small
hash, a fixed eighth of all, so the bound stays exact), then with bitmaps of all tokens; the whole sets of what is left come
together, in blocks again, and leaves that meet are compared exactly.  Blocks are joined in two
rounds.  Round 1 takes each class's first token only and finds most links; round 2 takes all prefix
tokens, but only blocks that still span two components, and one block of those with the same
members.  No link between different components is lost, which is all that components need.

Scale: only hashes are shuffled, never texts.  Copies collapse before the join.  A block of more
than ``block_sets`` sets is dealt into chunks; chunk pairs are blocks of their own (each against
each), so no task holds more than two chunks.  Components of the links are found by rounds of
smallest-neighbour joins with pointer jumping, each round a written table.

Defined results: texts without words (and null) have no n-grams and are linked with nothing; a text
of fewer than n words is one n-gram; a component's id is its smallest id; rows with equal ids are
one document if their sets are equal, else each has its own set and both carry the id; null ids are
never the smallest of a component unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checked, own_columns, packed, ship, sole, table, text_key, unpacked, written
from .features import shingle_hashes, utf8_texts

N = 3
PERCENT = 90
BLOCK_SETS = 512
# sets of a block that are compared by size and place at once, as a multiple of the above (thin rows, in one sweep)
SWEEP = 16
BITS_PER_TOKEN = 4
# bitmap words compared at once in a traversal (8 MB)
BATCH_WORDS = 1 << 20
# nodes of a tree's top level, at most: their pairs are compared in one step
ROOTS = 32
SMALL_HASH = np.uint64(1 << 61)
# bits of the signatures per 2^size_class: of the tokens with a small hash, and of all tokens
SMALL_BITS = 2
FULL_BITS = 8
# a token is common if more than one in so many documents has it in its prefix; hence at most
# COMMON_ONE_IN * (mean prefix length) tokens are common, whatever the number of documents
COMMON_ONE_IN = 500
# members of blocks have seven columns: broadcast up to as many cells as a table of two columns has (without it a broadcast took 42 MB)
BROADCAST_MEMBERS = 2 * BROADCAST_ROWS // 7


def prefix_length(size: int, percent: int) -> int:
    return size - (-(-percent * size // 100)) + 1 if size else 0


def prefix_tokens(tokens: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first tokens of a sorted set in the global order (common tokens last, else by hash)."""
    n = prefix_length(len(tokens), percent)
    if not n or not len(common):
        return tokens[:n]
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    late = common[at] == tokens
    rare = tokens[~late]
    return rare[:n] if len(rare) >= n else np.concatenate((rare, tokens[late][: n - len(rare)]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class Tree:
    """Signature tree over sets in order of size: levels of nodes, each the union of two below, up to ``ROOTS`` nodes.
    ``extra``: tokens that share a bit with another; ``outside``: tokens that the bitmap leaves out."""

    def __init__(self, members: list[int], bitmaps: np.ndarray, extra: np.ndarray, outside: np.ndarray, sizes: np.ndarray):
        self.members = members
        self.levels = [(bitmaps, extra, outside, sizes, sizes)]
        while len(self.levels[-1][0]) > ROOTS:
            m, *rest = self.levels[-1]
            if len(m) % 2:
                m, rest = np.concatenate((m, m[-1:])), [np.append(x, x[-1]) for x in rest]
            e, o, lo, hi = rest
            self.levels.append((m[::2] | m[1::2], np.maximum(e[::2], e[1::2]), np.maximum(o[::2], o[1::2]),
                                np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))


def tree_of_sets(sets: list[np.ndarray], members: list[int], bits: int) -> Tree:
    """Tree with bitmaps of all tokens."""
    bitmaps = [bitmap(sets[i], bits) for i in members]
    sizes = np.array([len(sets[i]) for i in members], dtype=np.int64)
    held = np.array([int(np.bitwise_count(m).sum()) for m in bitmaps], dtype=np.int64)
    return Tree(members, np.array(bitmaps).reshape(-1, bits // 64), sizes - held, np.zeros(len(members), dtype=np.int64), sizes)


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def size_class(size: int) -> int:
    """log2 of the bits of a set's signature less 1: sizes from 2^c + 1 to 2^(c + 1) are of class c, small ones of class 6."""
    return max(6, (max(size, 2) - 1).bit_length() - 1)


def signature(tokens: np.ndarray) -> tuple[int, int, bytes]:
    """Size class, number of tokens with a small hash, and their bitmap."""
    c = size_class(len(tokens))
    inside = tokens[:np.searchsorted(tokens, SMALL_HASH)]
    return c, len(inside), bitmap(inside, SMALL_BITS << c).tobytes()


def full_signature(tokens: np.ndarray) -> tuple[int, int, bytes]:
    """Size, number of tokens and a bitmap of all of them."""
    return len(tokens), len(tokens), bitmap(tokens, FULL_BITS << size_class(len(tokens))).tobytes()


def tree_of_signatures(rows: list[tuple], members: list[int], c: int, factor: int) -> Tree:
    """Tree with the signatures (size, inside, bytes), those of the next class folded to class c."""
    words = (factor << c) // 64
    maps = np.zeros((len(members), words), dtype=np.uint64)
    for row, i in enumerate(members):
        own = np.frombuffer(rows[i][2], dtype=np.uint64).reshape(-1, words)
        maps[row] = np.bitwise_or.reduce(own, axis=0)
    sizes = np.array([rows[i][0] for i in members], dtype=np.int64)
    inside = np.array([rows[i][1] for i in members], dtype=np.int64)
    return Tree(members, maps, inside - np.bitwise_count(maps).sum(axis=1).astype(np.int64), sizes - inside, sizes)


def traverse(a: Tree, b: Tree, percent: int, done, leaf) -> None:
    """Dual traversal of two trees, or of one with itself (a is b), by batches of node pairs, deepest
    first: ``leaf`` gets the members (two arrays) that may be linked; ``done`` tells of arrays of
    ranges of leaves (first and end in a, first and end in b) which need no look."""
    tops = len(a.levels[-1][0]), len(b.levels[-1][0])
    first, second = np.triu_indices(tops[0]) if a is b else np.indices(tops).reshape(2, -1)
    stack = [(len(a.levels) - 1, len(b.levels) - 1, first, second)] if a.members and b.members else []
    batch = max(64, BATCH_WORDS // max(a.levels[0][0].shape[1], 1)) if stack else 0
    in_a, in_b = np.array(a.members, dtype=np.int64), np.array(b.members, dtype=np.int64)
    while stack:
        x, y, m, n = stack.pop()
        if len(m) > batch:
            stack.append((x, y, m[batch:], n[batch:]))
            m, n = m[:batch], n[:batch]
        alike = (m == n) if a is b and x == y else np.zeros(len(m), dtype=bool)
        look = ~done(m << x, np.minimum((m + 1) << x, len(in_a)), n << y, np.minimum((n + 1) << y, len(in_b)))
        m, n, alike = m[look], n[look], alike[look]
        possible = alike.copy()
        p, q = m[~alike], n[~alike]
        ea, oa, la, ha = (c[p] for c in a.levels[x][1:])
        eb, ob, lb, hb = (c[q] for c in b.levels[y][1:])
        # sizes: the smaller must reach percent of the larger
        near = (100 * ha >= percent * lb) & (100 * hb >= percent * la)
        # |A and B| <= common bits + tokens that share a bit + tokens outside the bitmaps, and a
        # link needs |A and B| * (100 + percent) >= percent * (|A| + |B|)
        most = np.minimum(ea, eb) + np.minimum(oa, ob)
        most[near] += np.bitwise_count(a.levels[x][0][p[near]] & b.levels[y][0][q[near]]).sum(axis=1, dtype=np.int64)
        possible[~alike] = near & (most * (100 + percent) >= percent * (la + lb))
        m, n, alike = m[possible], n[possible], alike[possible]
        if x == 0 and y == 0:
            if not alike.all():
                leaf(in_a[m[~alike]], in_b[n[~alike]])
            continue
        if alike.any():
            k = m[alike]
            both = k[2 * k + 1 < len(a.levels[x - 1][0])]
            own = np.concatenate((2 * k, 2 * both + 1))
            stack.append((x - 1, x - 1, np.concatenate((own, 2 * both)), np.concatenate((own, 2 * both + 1))))
        m, n = m[~alike], n[~alike]
        if len(m):
            split, other = (m, n) if x >= y else (n, m)
            kids = np.stack((2 * split, 2 * split + 1), axis=1).ravel()
            there = kids < len((a.levels[x - 1] if x >= y else b.levels[y - 1])[0])
            kids, other = kids[there], np.repeat(other, 2)[there]
            stack.append((x - 1, y, kids, other) if x >= y else (x, y - 1, other, kids))


def in_trees(sides: list[int], order: list[int], build) -> tuple[Tree, Tree]:
    """Sides 0 and 1: each of one against each of the other; side 2 (an undivided block or one
    chunk): each against each."""
    if sides[0] == 2:
        tree = build(order)
        return tree, tree
    return build([i for i in order if sides[i] == 0]), build([i for i in order if sides[i] == 1])


def grouped(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of a tree's leaves, and the number of changes of the group before each leaf."""
    changes = np.zeros(len(groups), dtype=np.int64)
    np.cumsum(groups[1:] != groups[:-1], out=changes[1:])
    return groups, changes


def one_group(of_a: tuple, of_b: tuple, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether all leaves of the ranges a0..a1 and b0..b1 are of one group (``of_a``, ``of_b``: see ``grouped``)."""
    return (of_a[0][a0] == of_b[0][b0]) & (of_a[1][a1 - 1] == of_a[1][a0]) & (of_b[1][b1 - 1] == of_b[1][b0])


def survivors(labels: list[int], sides: list[int], rows: list[tuple], c: int, percent: int, factor: int) -> list[int]:
    """The members of a block (rows: size, inside, signature) that may be linked to a member of another component."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], labels[i], rows[i][2]))
    a, b = in_trees(sides, order, lambda members: tree_of_signatures(rows, members, c, factor))
    label = np.array(labels, dtype=np.int64)
    kept = np.zeros(len(rows), dtype=bool)
    if not a.members or not b.members:
        return []
    of_a, of_b = grouped(label[a.members]), grouped(label[b.members])

    def done(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        alike = one_group(of_a, of_b, a0, a1, b0, b1)
        if not kept.any():
            return alike
        known_a, known_b = (np.concatenate(([0], np.cumsum(kept[t.members]))) for t in (a, b))
        return alike | (known_a[a1] - known_a[a0] == a1 - a0) & (known_b[b1] - known_b[b0] == b1 - b0)

    def leaf(i: np.ndarray, j: np.ndarray) -> None:
        apart = label[i] != label[j]
        kept[i[apart]] = True
        kept[j[apart]] = True

    traverse(a, b, percent, done, leaf)
    return np.flatnonzero(kept).tolist()


def within_reach(rows: list[tuple]) -> list[tuple]:
    """The rows (class, component, size, most, ...) with a row of another component whose size is at most their ``most`` and
    whose ``most`` is at least their size."""
    rows = sorted(rows, key=lambda r: r[2])
    sizes = [r[2] for r in rows]
    # over the rows up to each: the largest bound, its component, and the largest bound of any other component
    far: list[tuple] = []
    top, top_of, other = -1, None, -1
    for _, component, _, most, *_ in rows:
        if component == top_of:
            top = max(top, most)
        elif most > top:
            top, top_of, other = most, component, top
        else:
            other = max(other, most)
        far.append((top, top_of, other))
    kept = []
    for row in rows:
        upto = bisect_right(sizes, row[3])
        if upto:
            top, top_of, other = far[upto - 1]
            if (other if top_of == row[1] else top) >= row[2]:
                kept.append(row)
    return kept


def join_block(keys: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets of a block that join two components."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), labels[i], sets[i][0] if len(sets[i]) else 0))
    longest = max((len(s) for s in sets), default=1)
    bits = min(max(64, 1 << (BITS_PER_TOKEN * longest - 1).bit_length()), 1 << 16)
    a, b = in_trees(sides, order, lambda members: tree_of_sets(sets, members, bits))
    group = np.array(labels, dtype=np.int64)
    found: list[tuple[int, int]] = []

    def done(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        return one_group(grouped(group[a.members]), grouped(group[b.members]), a0, a1, b0, b1)

    def leaf(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            if linked(sets[i[0]], sets[j[0]], percent):
                found.append((keys[i[0]], keys[j[0]]))
                group[group == group[i[0]]] = group[j[0]]
                rest = group[i] != group[j]
                i, j = i[rest], j[rest]
            else:
                i, j = i[1:], j[1:]

    traverse(a, b, percent, done, leaf)
    return found


def set_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def shingle_table(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (hash of the set; null if empty), prefix (the first
    tokens by hash), signature and text_key (tells the texts of one id apart)."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("jaccard_join")
        for batch in batches:
            sizes, classes, prefixes, signatures = [], [], [], []
            for text in utf8_texts(batch.column(1)):
                tokens = shingle_hashes(text, n)
                sizes.append(len(tokens))
                classes.append(set_hash(tokens) if len(tokens) else None)
                prefixes.append(tokens[:prefix_length(len(tokens), percent)].view(np.int64))
                signatures.append(signature(tokens))
            c, inside, maps = zip(*signatures) if signatures else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(c, pa.int32()), pa.array(inside, pa.int32()), pa.array(maps, pa.binary()), batch.column(2)],
                ["doc_id", "n_shingles", "class_id", "prefix", "size_class", "inside", "signature", "text_key"])

    rows = own_columns(docs, id=id_col, text=text_col).select("id", "text", text_key(F.col("text")).alias("key"))
    return written(rows.mapInArrow(work, f"doc_id {rows.schema['id'].dataType.simpleString()}, n_shingles long, class_id long, "
                                     "prefix array<long>, size_class int, inside int, signature binary, text_key long"))


def reordered(texts: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """class_id, prefix and n_shingles of texts whose prefix holds common tokens: the first tokens with these last."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("jaccard_join")
        for batch in batches:
            sets = [s for s in (shingle_hashes(t, n) for t in utf8_texts(batch.column(0))) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(s) for s in sets], pa.int64()),
                 pa.array([prefix_tokens(s, percent, shared.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array([len(s) for s in sets], pa.int64())], ["class_id", "prefix", "n_shingles"])

    return texts.mapInArrow(work, "class_id long, prefix array<long>, n_shingles long")


def texts_of(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """The texts of the documents with an id in ``ids`` (column one_id)."""
    rows = own_columns(docs, id=id_col, text=text_col)
    return rows.join(checked(written(ids)), F.col("id").eqNullSafe(F.col("one_id")), "left_semi").select("text")


def by_block(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of the blocks of a partition that is sorted by its first ``n_keys`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def in_chunks(rows: DataFrame, limit: int) -> DataFrame:
    """Blocks above the limit: each set goes to the pairs of its chunk with every chunk.  Adds chunks, own and other."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_sets") / F.lit(limit))).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


def reachable(blocks: DataFrame, limit: int) -> DataFrame:
    """Of blocks (token, n_sets, class_id, component, size, most) the sets that sizes and places leave: token, n_sets, class_id,
    component; of blocks with the same sets, one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("jaccard_join")
        out: list[tuple] = []
        for block, held in by_block(batches, 3):
            if len(held) > 1:
                out.extend((block[0], r[0], r[1], r[4]) for r in within_reach(held))
            if len(out) >= 10_000:
                yield as_batch(out)
                out = []
        yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                                          ["token", "class_id", "component", "several"])

    key = ["token", "a", "b"]
    rows = in_chunks(blocks, limit).select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                                           "class_id", "component", "size", "most", (F.col("chunks") > 1).alias("several"))
    left = written(rows.repartition(*key).sortWithinPartitions(*key)
                   .mapInArrow(work, "token long, class_id long, component long, several boolean"))
    # a set may be left by several pairs of chunks
    left = left.where("not several").unionByName(left.where("several").dropDuplicates(["token", "class_id"])).drop("several")
    part = 1 << 40
    digests = left.groupBy("token").agg(F.count(F.lit(1)).alias("n_sets"), F.sum(F.pmod(F.xxhash64("class_id"), F.lit(part))).alias("x"),
                                        F.sum(F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(part))).alias("y"))
    chosen = written(digests.groupBy("n_sets", "x", "y").agg(F.min("token").alias("token")).select("token", "n_sets"))
    return left.join(checked(chosen), "token")


def block_links(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, blocks: DataFrame, one_each: DataFrame,
                block_sets: int) -> DataFrame:
    """Links (left, right) found in blocks: rows token, n_sets, class_id, component, size, most."""
    key = ["token", "size_class", "a", "b"]
    rows = reachable(blocks, SWEEP * block_sets).join(one_each.select(F.col("class_id").alias("of_class"), "n_shingles", "size_class", "inside", "signature"),
                       F.col("class_id") == F.col("of_class")).drop("of_class")
    # sets that may be linked to sets of the next smaller size class are in its block too
    c = F.col("size_class")
    below = (c > 6) & (percent * F.col("n_shingles") <= 100 * F.expr("shiftleft(1L, size_class)"))
    rows = rows.withColumn("size_class", F.explode(F.when(below, F.array(c, c - 1)).otherwise(F.array(c))))
    rows = in_chunks(rows, block_sets)
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("token", "size_class", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                       "class_id", "component", side.alias("side"), F.col("n_shingles").cast("int").alias("size"), "inside", "signature")

    def pruned(rows: DataFrame, factor: int) -> DataFrame:
        """The members that their blocks' signature trees cannot part; of blocks with the same ones, one."""

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole("jaccard_join")
            out: list[tuple] = []
            for block, held in by_block(batches, 4):
                # repeated rows of one document bring the set twice
                held = list({(r[0], r[2]): r for r in held}.values())
                labels = [r[1] for r in held]
                if len(set(labels)) > 1:
                    for i in survivors(labels, [r[2] for r in held], [r[3:] for r in held], block[1], percent, factor):
                        out.append((*block, *held[i][:3]))
                if len(out) >= 10_000:
                    yield as_batch(out)
                    out = []
            yield as_batch(out)

        left = written(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(
            prune, "token long, size_class int, a int, b int, class_id long, component long, side int"))
        part = 1 << 40
        per_block = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("class_id", "side"), F.lit(part))).alias("x"),
                                           F.sum(F.pmod(F.xxhash64("side", "class_id"), F.lit(part))).alias("y"))
        chosen = per_block.groupBy("n", "x", "y").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
        return written(left.join(checked(written(chosen)), key, "left_semi"))

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], [*key, "class_id", "component", "side"])

    def with_texts(left: DataFrame, work, columns: str) -> DataFrame:
        """``left`` with what ``work`` makes of the texts of its classes."""
        needed = checked(written(left.select("class_id").distinct()))
        texts = texts_of(docs, id_col, text_col, one_each.join(needed, "class_id", "left_semi").select("one_id"))
        made = texts.mapInArrow(work, f"set_id long, {columns}")
        return made.join(checked(left, BROADCAST_MEMBERS), F.col("class_id") == F.col("set_id"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_hash(s), *full_signature(s)) for s in (shingle_hashes(t, n) for t in utf8_texts(batch.column(0))) if len(s)]
            cols = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["set_id", "size", "inside", "signature"])

    left = pruned(rows, SMALL_BITS)
    left = pruned(with_texts(left, signatures, "size int, inside int, signature binary")
                  .select(*key, "class_id", "component", "side", "size", "inside", "signature"), FULL_BITS)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in (shingle_hashes(t, n) for t in utf8_texts(batch.column(0))) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                                             ["set_id", "tokens"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("jaccard_join")
        for _, held in by_block(batches, 4):
            # repeated rows of one document bring the set twice
            classes, labels, sides, raw = zip(*{(r[0], r[2]): r for r in held}.values())
            found = join_block(classes, labels, sides, [np.frombuffer(t, dtype=np.uint64) for t in raw], percent)
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["left", "right"])

    together = with_texts(left, sets, "tokens binary").select(*key, "class_id", "component", "side", "tokens")
    together = together.repartition(*key).sortWithinPartitions(*key)
    return written(together.mapInArrow(join, "left long, right long"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node with a link; rounds of written tables."""
    edges = written(links.select(F.least("left", "right").alias("u"), F.greatest("left", "right").alias("v")).where("u <> v").distinct())
    both = written(edges.select("u", "v").union(edges.select("v", "u")))
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        step = label.join(near, F.col("node") == F.col("u")).select("node", "component", F.least("component", "near").alias("new"))
        # pointer jumping: a node takes the label of the node that its label names
        names = label.select(F.col("node").alias("named"), F.col("component").alias("further"))
        step = step.join(names, F.col("new") == F.col("named"), "left") \
            .select("node", "component", F.least("new", F.coalesce("further", "new")).alias("new"))
        step = written(step)
        label = step.select("node", F.col("new").alias("component"))
        if not step.where("new <> component").limit(1).count():
            return label


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT,
                   block_sets: int = BLOCK_SETS) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_shingles, class_id) and links between classes (left, right) that
    connect all linked classes."""
    members = shingle_table(docs, id_col, text_col, n, percent)
    known = members.where("class_id is not null")
    alike = ("n_shingles", "size_class", "inside", "signature")  # equal in all rows of a class
    one_each = written(known.groupBy("class_id").agg(F.min("doc_id").alias("one_id"), *[F.first(c).alias(c) for c in alike]))
    limit = max(16, members.count() // COMMON_ONE_IN)
    tokens = known.select("class_id", F.explode("prefix").alias("token"))
    common = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("token"))
    values = np.sort(common.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))
    moved = checked(written(tokens.join(checked(common), "token", "left_semi").select("class_id").distinct()))
    again = texts_of(docs, id_col, text_col, one_each.join(moved, "class_id", "left_semi").select("one_id"))
    again = written(reordered(again, n, percent, values).join(moved, "class_id", "left_semi"))
    same = known.join(moved, "class_id", "left_anti").select("class_id", "prefix", "n_shingles")
    # most: the largest set that can be linked if no earlier token is shared
    prefixes = same.unionByName(again).select("class_id", F.col("n_shingles").cast("int").alias("size"), F.posexplode("prefix").alias("place", "token")) \
        .withColumn("most", F.expr(f"cast({100 + percent}L * (size - place) div {percent} - size as int)"))

    def blocks(rows: DataFrame) -> DataFrame:
        """Blocks that span components and have a set that may be the smaller one of a link, each set of a block once."""
        spans = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                          F.max(F.col("most") >= F.col("size")).alias("smaller"), F.count(F.lit(1)).alias("n_sets"))
        shared = checked(written(spans.where("low <> high and smaller").select("token", "n_sets")))
        return rows.join(shared, "token").dropDuplicates(["token", "class_id"])

    alone = prefixes.withColumn("component", F.col("class_id"))
    links1 = block_links(docs, id_col, text_col, n, percent, blocks(alone.where("place = 0")), one_each, block_sets)
    label = components(links1)
    known = prefixes.join(checked(label), F.col("class_id") == F.col("node"), "left") \
        .withColumn("component", F.coalesce("component", "class_id")).drop("node")
    links2 = block_links(docs, id_col, text_col, n, percent, blocks(known), one_each, block_sets)
    return members, links1.union(links2)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT,
                       block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    members, links = linked_classes(docs, id_col, text_col, n, percent, block_sets)
    label = components(links)
    smallest = members.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("low"))
    labelled = written(smallest.join(label, F.col("class_id") == F.col("node"), "left")
                       .select("class_id", "low", F.coalesce("component", "class_id").alias("component")))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    per_class = written(labelled.join(lowest, "component").select(F.col("class_id").alias("of_class"), "component_id"))
    # only classes that say something else than their own single member need the join
    joined = members.join(per_class, F.col("class_id") == F.col("of_class"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component (all columns, whatever their names): that of its smallest
    id, null ids last, and of one id that of the smallest ``text_key``.  Rows that share an id are told apart
    by their text; rows that repeat id and text are one document, of which one stays.  Documents without
    words all stay."""
    members, links = linked_classes(docs, id_col, text_col, n, percent)
    label = components(links)
    rows = written(members.where("class_id is not null").join(label, F.col("class_id") == F.col("node"), "left")
                   .select("doc_id", "text_key", F.coalesce("component", "class_id").alias("component")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    marked = rows.join(best, "component").groupBy("doc_id", "text_key").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = written(marked.where("not stays or n > 1"))
    keyed = packed(docs).withColumns({"id": F.col(f"row.`{id_col}`"), "key": text_key(F.col(f"row.`{text_col}`"))})
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    kept = keyed.join(marked, same, "left").where("stays is null or stays")
    once = kept.where("n is null").select("row")
    # repeated rows of one id and text: any one, chosen task by task before the shuffle
    repeats = kept.where("n > 1").groupBy("id", "key").agg(F.first("row").alias("row")).select("row")
    return unpacked(once.unionByName(repeats), docs)


def op9_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM d),
n AS (SELECT d.doc_id, count(s)::BIGINT AS n_shingles FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n_shingles + ny.n_shingles - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT n.doc_id, n.n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY 1, 2
"""
