"""Filter interaction audit: what every order of five filters keeps and removes, per part of the corpus.

Each document has a mask of the filters it fails.  Per part the masks are counted (32 at most, as
rows, as quality rows, as toxic rows), and the counts become a decision diagram: one level per filter,
a pass and a fail edge per node, equal subdiagrams shared, every node weighted with the documents
below it.  The 120 orders are visited so that each differs from the one before in two neighbouring
filters; the diagram follows by swapping two adjacent levels.  In each order the all-pass path from
the root gives the steps: a node's fail edge holds what that filter removes there, its pass edge what
stays.

No text is shuffled: a document becomes (text hash, id, part, mask) in the scan.  Copies are found by
two counts with map-side partial aggregation: equal rows are one row with a number, and the smallest
id per text hash is joined back on (hash, id), a key that no group of copies makes hot.  Labels join
on the id.  What remains per part has 32 rows at most.

Defined results: a null text is the empty text (no words: fails A; B, C and D pass); a null source is
the part '' (together with an empty source); a null id is never the smaller id and fails E if a row
with an id has its text; repeated rows (same id) do not fail E for each other and count each; a label
row counts where any of the id's label rows says 1, null ids have no label; an empty table gives no
row; further columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, own_columns, ship, table, written

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
MARKS = "[#$%&*|]"

STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, " \
        "good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < MIN_WORDS, distinct * 100 < n * MIN_DISTINCT_PERCENT,
             capitals * 100 > F.char_length(text) * MAX_CAPITAL_PERCENT, text.rlike(MARKS)]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "source", label_id: str = "doc_id", good_col: str = "quality",
                   toxic_col: str = "toxic") -> DataFrame:
    """part, mask (bit i: fails filter i), n, good, toxic: one row per part and mask that occurs."""
    rows = own_columns(docs, id=id_col, text=text_col, part=part_col)
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    rows = rows.select(F.sha2("text", 256).alias("sha"), "id", "part", text_mask(F.col("text")).alias("mask"))
    rows = written(rows.groupBy("sha", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = own_columns(labels, id=label_id, good=good_col, toxic=toxic_col) \
        .where("id is not null and (good = 1 or toxic = 1)") \
        .groupBy("id").agg(F.max((F.col("good") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id never meet a label; kept out of that join, they cannot be its hot key
    known = rows.where("id is not null")
    flagged = known.join(first.where("id is not null"), ["sha", "id"], "left").join(marks, "id", "left") \
        .select("part", "mask", "n", "good", "toxic", "first")
    # a hash whose smallest id is null has only rows without an id: all of them are first
    free = rows.where("id is null").join(first.where("id is null").select("sha", "first"), "sha", "left") \
        .select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"), "first")
    copy = F.when(F.col("first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    number = {c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")}
    return flagged.unionByName(free).groupBy("part", (F.col("mask") + copy).cast("int").alias("mask")) \
        .agg(F.sum("n").cast("long").alias("n"), number["good"], number["toxic"])


class Diagram:
    """A decision diagram over the failure masks of one part, weighted with counts (n, good, toxic).

    Nodes are numbers; ``passed`` and ``failed`` hold their edges, ``weight`` the counts below them.
    ``unique[level]`` finds the node with given edges, so equal subdiagrams are one node."""

    def __init__(self, counts: dict[int, tuple[int, int, int]], filters: str = FILTERS):
        self.order = list(filters)
        self.passed: list[int] = []
        self.failed: list[int] = []
        self.weight: list[tuple[int, int, int]] = []
        self.unique: list[dict] = [{} for _ in range(len(filters) + 1)]
        level = {mask: self._leaf(counts.get(mask, (0, 0, 0))) for mask in range(1 << len(filters))}
        for depth in reversed(range(len(filters))):
            # masks of the filters above this level: its own bit decides between the two edges
            level = {m: self._node(depth, level[m], level[m | 1 << depth]) for m in range(1 << depth)}
        self.root = level[0]

    def _add(self, passed: int, failed: int, weight: tuple[int, int, int]) -> int:
        self.passed.append(passed)
        self.failed.append(failed)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _leaf(self, counts: tuple[int, int, int]) -> int:
        known = self.unique[-1]
        if counts not in known:
            known[counts] = self._add(-1, -1, counts)
        return known[counts]

    def _node(self, depth: int, passed: int, failed: int) -> int:
        known = self.unique[depth]
        if (passed, failed) not in known:
            known[passed, failed] = self._add(passed, failed, tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed])))
        return known[passed, failed]

    def swap(self, depth: int) -> None:
        """Exchanges levels ``depth`` and ``depth + 1``.  The upper nodes keep their numbers (what they
        stand for is unchanged), so nothing above them is touched."""
        self.order[depth], self.order[depth + 1] = self.order[depth + 1], self.order[depth]
        upper = list(self.unique[depth].values())
        self.unique[depth], self.unique[depth + 1] = {}, {}
        for node in upper:
            p, f = self.passed[node], self.failed[node]
            low = self._node(depth + 1, self.passed[p], self.passed[f])
            high = self._node(depth + 1, self.failed[p], self.failed[f])
            self.passed[node], self.failed[node] = low, high
            self.unique[depth][low, high] = node

    def steps(self) -> Iterator[tuple[str, tuple, tuple]]:
        """Along the all-pass path: the filter, the counts that stay, the counts it removes."""
        node = self.root
        for name in self.order:
            yield name, self.weight[self.passed[node]], self.weight[self.failed[node]]
            node = self.passed[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions of neighbouring swaps that visit all n! orders from the first one: the last element
    walks to and fro, and at each turn the others make their next swap."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        # while the walker stands in front, the others are one place further back
        yield step + 1 if down else step
        down = not down


def audit_part(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    diagram = Diagram(counts, filters)
    fails = {f: sum(c[0] for m, c in counts.items() if m >> i & 1) for i, f in enumerate(filters)}
    alone = {f: counts.get(1 << i, (0, 0, 0))[0] for i, f in enumerate(filters)}
    shapley = dict.fromkeys(filters, 0)
    found = []

    def visit() -> None:
        order = "".join(diagram.order)
        for i, (f, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[f] += removed[0]
            found.append((f, order, i, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2]))

    visit()
    for depth in adjacent_swaps(len(filters)):
        diagram.swap(depth)
        visit()
    return [(*row[1:], shapley[row[0]]) for row in found]


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in STEPS.split(", ")]
    for batch in batches:
        for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = audit_part({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks})
            columns = [pa.array([part] * len(rows), pa.string())]
            for i, column in enumerate(zip(*rows)):
                columns.append(pa.array(column, (pa.string(), pa.int32())[i] if i < 2 else pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step (see ``STEPS``)."""
    ship(docs.sparkSession)
    # 32 masks at most
    parts = failure_counts(docs, labels, **columns).groupBy("part") \
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return parts.mapInArrow(_audit, STEPS)


def op13_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
             {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text),
                   doc_id IS NULL AND min(doc_id) OVER (PARTITION BY text) IS NOT NULL)} AS x
      FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, x.A::INT A, x.B::INT B, x.C::INT C, x.D::INT D, x.E::INT E, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM f GROUP BY ALL),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM v a, v b, v c, v d, v e
      WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS k,
             CASE filter_order[step] WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END AS own,
             (strpos(filter_order, 'A') < step AND A = 1) OR (strpos(filter_order, 'B') < step AND B = 1)
             OR (strpos(filter_order, 'C') < step AND C = 1) OR (strpos(filter_order, 'D') < step AND D = 1)
             OR (strpos(filter_order, 'E') < step AND E = 1) AS gone,
             A + B + C + D + E AS fails, n, good, toxic FROM m, s),
g AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT gone AND own = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN NOT gone AND own = 1 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND own = 1 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND own = 1 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN NOT gone AND own = 1 THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM g
"""
