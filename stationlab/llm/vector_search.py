"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are scaled to integers (floor(256 x)) and grouped into buckets by length.  Each query gets a
lower bound of its k-th best product from a bounded pilot set.  Against a bucket this bound is a
local cosine threshold t = bound / (query length * longest length of the bucket): above 1 the query
never goes to the bucket; above ``coordinate_from`` the bucket is pruned by coordinates (with cosine
t or more, a unit vector's value at a strong coordinate of the query lies in a narrow interval);
else by length (only vectors long enough for the bound are multiplied).  Products of what remains
are computed exactly and the k best per query kept.

Buckets are cut into cells of at most about ``cell_rows`` vectors, queries into blocks of as many,
so a task holds one cell and one block, however many vectors share a length.

Defined results: vectors that are null or hold null or non-finite values take no part, nor do rows
without an id; rows with the query's id are the query itself; vectors of another dimension than the
query's are no candidates; equal scores go to the smaller id; repeated rows count as often as they
occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, ship, table, written

SCALE = 256.0
BUCKET_ROWS = 8192
PILOT_ROWS = 1024
COORDINATE_FROM = 0.75
COORDINATES = 4


def dealt(query_id: int, blocks: int) -> int:
    """The block of a query, by a hash: the ids themselves may all be multiples of the number of blocks."""
    return xxhash.xxh3_64_intdigest(str(query_id)) % blocks


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """id, dim, length and the integers (little-endian 64 bit) of every usable vector."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key is None or v is None or None in v:
                    continue
                x = np.floor(np.array(v, dtype=np.float64) * scale)
                if np.isfinite(x).all():
                    out.append((key, len(x), float(np.sqrt(x @ x)), x.astype("<i8").tobytes()))
            cols = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "dim", "length", "ints"])

    chosen = own_columns(rows, id=id_col, v=vector_col).selectExpr("cast(id as long) id", "cast(v as array<double>) v")
    return chosen.mapInArrow(work, "id long, dim int, length double, ints binary")


def matrix(ints: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(ints), dtype="<i8").reshape(len(ints), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where they are exact, else in 64-bit integers."""
    if len(a) and len(b) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, then smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        where = np.flatnonzero(scores >= cut)
        return where[np.lexsort((ids[where], -scores[where]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_cell(queries: pd.DataFrame, rows: pd.DataFrame, dim: int, k: int, coordinate_from: float) -> list[tuple[int, int, int]]:
    """The k best of one cell for each query: (query id, vector id, score)."""
    rows = rows.sort_values("length", ascending=False, kind="stable")
    ids, length = rows["id"].to_numpy(), rows["length"].to_numpy()
    ints = matrix(rows["ints"], dim)
    wanted = matrix(queries["ints"], dim)
    unit = ints / np.maximum(length, 1e-300)[:, None]
    out: list[tuple[int, int, int]] = []
    by_length = []
    for n, (q, lq, bound) in enumerate(zip(queries["id"], queries["length"], queries["bound"])):
        t = bound / (lq * length[0]) if lq * length[0] > 0 else 0.0
        if t > 1 + 1e-9:
            continue
        if t < coordinate_from:
            by_length.append(n)
            continue
        u = wanted[n] / lq
        t = min(max(t - 1e-9, 0.0), 1.0)
        keep = np.arange(len(ids))
        for f in np.argsort(-np.abs(u))[:COORDINATES]:
            middle, around = u[f] * t, np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
            # over the cosines from t to 1 the interval's ends are those at t, unless an extreme lies inside
            low = -1.0 if u[f] <= -t else middle - around
            high = 1.0 if u[f] >= t else middle + around
            x = unit[keep, f]
            keep = keep[(x >= low) & (x <= high)]
        keep = keep[ids[keep] != q]
        score = products(wanted[n: n + 1], ints[keep])[0] if len(keep) else np.empty(0, dtype=np.int64)
        for i in best_of(ids[keep], score, k):
            out.append((int(q), int(ids[keep[i]]), int(score[i])))
    for lo in range(0, len(by_length), 256):
        block = by_length[lo: lo + 256]
        need = [queries["bound"].iloc[n] / queries["length"].iloc[n] if queries["length"].iloc[n] > 0 else -np.inf for n in block]
        reach = [int(np.searchsorted(-length, -(x - 1e-6 * max(1.0, abs(x))), "right")) if x > 0 else len(ids) for x in need]
        score = products(wanted[block], ints[: max(reach)])
        for row, n, m in zip(score, block, reach):
            q = queries["id"].iloc[n]
            keep = np.flatnonzero(ids[:m] != q)
            for i in best_of(ids[keep], row[keep], k):
                out.append((int(q), int(ids[keep[i]]), int(row[keep[i]])))
    return out


def top_products(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                 bucket_rows: int = BUCKET_ROWS, coordinate_from: float = COORDINATE_FROM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest products of each row with ``is_query``
    (a condition on ``id``) among all other rows."""
    spark = rows.sparkSession
    vectors = written(integer_vectors(rows, id_col, vector_col))
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    # lengths that cut the vectors into buckets: one per ``bucket_rows`` vectors, approximately
    n_buckets = max(1, -(-n // bucket_rows))
    edges = sorted(set(vectors.approxQuantile("length", [i / n_buckets for i in range(1, n_buckets)], 0.1 / n_buckets))) \
        if n_buckets > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("length"))) if edges else F.lit(0)
    placed = vectors.withColumn("bucket", bucket.cast("int"))
    cells = placed.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()
    parts = {(r["dim"], r["bucket"]): max(1, -(-r["n"] // bucket_rows)) for r in cells}
    longest = {(r["dim"], r["bucket"]): r["longest"] for r in cells}
    scale = 1 << 20
    share = min(scale, -(-scale * PILOT_ROWS // max(n, 1)))
    pilot_rows = vectors.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(scale)) < share).toPandas()
    pilots = {d: (g["id"].to_numpy(), matrix(g["ints"], d)) for d, g in pilot_rows.groupby("dim")}
    shared = spark.sparkContext.broadcast((pilots, parts, longest))
    query_blocks = max(1, -(-n_queries // bucket_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its bound, once for every cell that may hold a product that large."""
        pilots, parts, longest = shared.value
        for batch in batches:
            out = []
            for q, dim, lq, ints in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                bound = -np.inf
                if dim in pilots:
                    ids, m = pilots[dim]
                    s = np.sort(products(np.frombuffer(ints, "<i8")[None, :], m)[0][ids != q])
                    bound = float(s[-k]) if len(s) >= k else bound
                for (d, b), p in parts.items():
                    if d == dim and bound <= lq * longest[d, b] * (1 + 1e-9):
                        out += [(b, part, dealt(q, query_blocks), q, dim, lq, bound, ints) for part in range(p)]
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    names = ["bucket", "part", "block", "id", "dim", "length", "bound", "ints"]
    queries = vectors.where(is_query).select("id", "dim", "length", "ints").mapInArrow(
        route, "bucket int, part int, block int, id long, dim int, length double, bound double, ints binary")
    n_parts = F.element_at(F.create_map(*[F.lit(x) for kv in ((f"{d},{b}", p) for (d, b), p in parts.items()) for x in kv]),
                           F.concat_ws(",", "dim", "bucket")) if parts else F.lit(1)
    candidates = placed.withColumn("part", F.pmod(F.xxhash64("id", "ints"), n_parts).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def cell(key: tuple, q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = search_cell(q, rows, int(key[0]), k, coordinate_from) if len(q) and len(rows) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    by = ["dim", "bucket", "part", "block"]
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op4_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5
"""
