"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index.

A text's vector holds (1 + ln tf) * idf * (FLOOR + its toxic log-odds, if positive) of all its words, scaled
to length 1; document counts come from all labelled training rows, and no word of theirs is left out.
Words are hashed into 2^20 places.  (Plain TF-IDF without the log-odds finds toxic texts far worse, see the
README; with them the cosine is that of a supervised weighting.)  The index holds all labelled examples with a word, or about
``index_rows`` of them when there are more: every toxic one as long as these are at most half of
``index_rows``, the rest picked by id hash.  A query reads the index block by block from the largest
bound down, skips the blocks that cannot reach its k-th score, and compares the best exactly: the k
neighbours are exact.  Votes are weighted by 1 / (distance + 0.05); a logistic fit
on leave-one-out votes of the index, each class weighted by its share in the index, turns their share
into a probability.  A text without any training word scores the toxic share of the training rows.

Defined results: null and empty texts score as texts without words; without usable training rows
(none, or of one label only) every score is the toxic share of the training rows, 0 if there are none;
rows with null labels are not learned from; equal similarities go to the smaller id; repeated rows are
scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, give_back, held_out, own_columns, packed, ship, sole, table, unpacked, written

TERM = re.compile(r"\w+")
# other characters than letters, digits and underscores: beyond ASCII, and (as a table of bytes, which lower-cases too) in it
MARK = re.compile(r"[^\x00-\x7f\w]")
BYTES = bytes(ord(chr(b).lower()) if b > 127 or TERM.match(chr(b)) else 32 for b in range(128)) + bytes(range(128, 256))
PLACES = 1 << 20
# weight of a word that does not speak for toxicity, beside the log-odds of those that do
FLOOR = 0.1
INDEX_ROWS = 20_000
QUERIES = 128
# examples folded at a time
CHUNK = 1024
# texts scored at a time
TEXTS = 512
# blocks of like examples in the index: bounds of texts with some hundred known words skip next to nothing, see the README
BLOCKS = 1
CACHE_WORDS = 1 << 19
NEIGHBOURS = 15
# scores of which the largest is looked at first when the best are sought
COLUMN = 25
# places are first compared folded, in a table that stays in a core's cache
FOLDED = 1 << 16
MODEL_SEED = 11


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Training rows (id, text, label): labelled rows outside the held-out fold, one row per id and text."""
    y = own_columns(labels, label_id="doc_id", y=label).where(F.col("y").isin(0, 1))
    y = checked(written(y.groupBy("label_id").agg(F.max("y").alias("y"))))  # a broadcast keeps the texts where they are
    rows = own_columns(docs, id="doc_id", text="text").where(~held_out(F.col("id")))
    return rows.join(y, rows["id"] == y["label_id"]).select("id", F.coalesce("text", F.lit("")).alias("text"), "y")


class Places(dict):
    """word (its UTF-8 bytes) -> place, computed on first use.  Bounded: emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        at = self[word] = xxhash.xxh3_64_intdigest(word) & (PLACES - 1)
        return at


_PLACES = Places()


def hashed(counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the words and their counts."""
    places = np.fromiter((_PLACES[w.encode("utf-8", "surrogatepass")] for w in counts), dtype=np.int32, count=len(counts))
    tf = np.fromiter(counts.values(), dtype=np.int32, count=len(counts))
    order = np.argsort(places)
    places, tf = places[order], tf[order]
    new = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else np.empty(0, dtype=np.int64)
    return (places, tf) if len(new) == len(places) else (places[new], np.add.reduceat(tf, new).astype(np.int32))


def words_of(text: str | None) -> Counter:
    return Counter(TERM.findall((text or "").lower()))


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``hashed(words_of(text))``, without the words as strings."""
    text = text or ""
    if not text.isascii():
        text = MARK.sub(" ", text.lower())
    words = text.encode("utf-8", "surrogatepass").translate(BYTES).split()
    places = np.fromiter(map(_PLACES.__getitem__, words), dtype=np.int32, count=len(words))
    places.sort()
    new = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else np.empty(0, dtype=np.int64)
    return places[new], np.diff(np.append(new, len(places))).astype(np.int32)


def forget() -> None:
    """Empties what this process keeps for scoring."""
    _PLACES.clear()
    for index in list(_BUILT):
        index.release()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole("toxicity", forget)
    for batch in batches:
        found = [terms_of(t) for t in batch.column(1).to_pylist()]
        words, tf = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), words, tf, batch.column(2)], ["id", "words", "tf", "y"])


def clusters(starts: np.ndarray, places: np.ndarray, x: Callable[[int, int], np.ndarray], count: int = BLOCKS, width: int = 128, rounds: int = 8) -> np.ndarray:
    """A cluster for each unit vector: k-means by cosine on the vectors folded to ``width`` signed places; ``x``
    gives the components of some vectors.  Where a vector goes only decides how much a query can skip, never a result."""
    m = len(starts) - 1
    if count == 1:
        return np.zeros(m, dtype=np.int64)
    folded = np.zeros((m, width), dtype=np.float32)
    for lo in range(0, m, CHUNK):
        hi = min(lo + CHUNK, m)
        at = slice(starts[lo], starts[hi])
        mixed = places[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        place = np.repeat(np.arange(hi - lo), np.diff(starts[lo: hi + 1])) * width + (mixed >> np.uint64(50)).astype(np.int64) % width
        folded[lo:hi] = np.bincount(place, weights=x(lo, hi) * sign, minlength=(hi - lo) * width).reshape(hi - lo, width)
    center = folded[np.linspace(0, m - 1, min(count, m)).astype(int)]
    for _ in range(rounds):
        at = (folded @ center.T).argmax(axis=1)
        center = np.stack([folded[at == c].sum(axis=0) if (at == c).any() else center[c] for c in range(len(center))])
        center /= np.maximum(np.linalg.norm(center, axis=1), 1e-12)[:, None]
    return (folded @ center.T).argmax(axis=1)


# what an index builds from its counts
BUILT = ("slot", "dense_row", "dense", "most", "post", "post_x", "first", "there", "numbers")
_BUILT: list["Index"] = []


class Index:
    """Block-max inverted index over unit vectors of labelled examples, given as (id, places, counts, label).

    Examples lie in blocks of like vectors.  A place has its postings block by block, and per block the
    largest weight in it; the sum of these over a query's places, times the query's weights, bounds every
    cosine in the block.  Blocks are read from the largest bound down, and a block whose bound does not
    reach the query's k-th score so far is skipped with all its postings.
    Only the counts are pickled; postings are built where they are first asked for, and a process holds those of one
    index, the last one asked: Python workers outlive stages and keep the indexes that were sent to them."""

    def __init__(self, weights: np.ndarray, examples: list[tuple[int, np.ndarray, np.ndarray, int]], base: float,
                 rates: tuple[float, float] = (1.0, 1.0), k: int = NEIGHBOURS):
        self.weights, self.base, self.rates, self.k = weights, base, rates, k
        self.blocks = np.zeros(1, dtype=np.int64)
        self._set(examples)
        if len(examples):
            at = clusters(self.starts, self.places, self._unit)
            if at.any():
                self._set([examples[i] for i in np.argsort(at, kind="stable").tolist()])
            self.blocks = np.concatenate(([0], np.cumsum(np.bincount(at)[np.bincount(at) > 0]))).astype(np.int64)
        self.slope, self.shift = 1.0, 0.0

    def _set(self, examples: list[tuple[int, np.ndarray, np.ndarray, int]]) -> None:
        self.ids = np.array([e[0] for e in examples], dtype=np.int64)
        self.y = np.array([e[3] for e in examples], dtype=np.float64)
        self.starts = np.concatenate(([0], np.cumsum([len(e[1]) for e in examples]))).astype(np.int64)
        self.places = np.concatenate([np.empty(0, np.int32), *[e[1] for e in examples]]).astype(np.int32)
        self.tf = np.concatenate([np.empty(0, np.int32), *[e[2] for e in examples]])
        self.tf = self.tf.astype(np.uint16 if len(self.tf) and self.tf.max() <= 0xFFFF else np.int32)
        self._norms()

    def _norms(self) -> None:
        self.norm = np.ones(len(self.ids))
        for lo in range(0, len(self.ids), CHUNK):
            hi = min(lo + CHUNK, len(self.ids))
            x, of = self._unit(lo, hi), np.repeat(np.arange(hi - lo), np.diff(self.starts[lo: hi + 1]))
            self.norm[lo:hi] = np.sqrt(np.bincount(of, weights=x * x, minlength=hi - lo))

    def _unit(self, lo: int, hi: int) -> np.ndarray:
        """The components of the unit vectors of some examples, beside their ``places``."""
        at = slice(int(self.starts[lo]), int(self.starts[hi]))
        x = (1 + np.log(self.tf[at], dtype=np.float64)) * self.weights[self.places[at]]
        return x / np.repeat(self.norm[lo:hi], np.diff(self.starts[lo: hi + 1]))

    def _build(self) -> None:
        """The postings, some examples at a time, so that building takes little more memory than they do."""
        m, n = len(self.ids), len(self.blocks) - 1
        df = np.bincount(self.places, minlength=PLACES)
        used = np.flatnonzero(df)
        df = df[used]
        self.slot = np.full(PLACES, -1, dtype=np.int32)
        self.slot[used] = np.arange(len(used), dtype=np.int32)
        # postings of frequent words as full rows, those of the others as lists
        often = np.flatnonzero(df > max(m // 16, 1))
        self.dense_row = np.full(len(used) + 1, -1, dtype=np.int32)
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((m, len(often)), dtype=np.float32)
        # segments of one place and block: how many postings are in their lists, and their largest weight
        size = np.zeros(len(used) * n, dtype=np.int32)
        self.most = np.zeros((len(used), max(n, 1)), dtype=np.float32)
        df[often] = 0
        free = np.cumsum(df) - df
        self.post = np.empty(int(df.sum()), dtype=np.uint16 if m <= 0x10000 else np.int32)
        self.post_x = np.empty(len(self.post), dtype=np.float32)
        for block in range(n):
            for lo in range(int(self.blocks[block]), int(self.blocks[block + 1]), CHUNK):
                hi = min(lo + CHUNK, int(self.blocks[block + 1]))
                at = slice(int(self.starts[lo]), int(self.starts[hi]))
                of = np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(self.starts[lo: hi + 1]))
                slots = self.slot[self.places[at]]
                x = self._unit(lo, hi).astype(np.float32)
                order = np.argsort(slots, kind="stable")
                slots, of, x = slots[order], of[order], x[order]
                first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1]))) if len(slots) else np.empty(0, np.int64)
                here, count = slots[first], np.diff(np.append(first, len(slots)))
                if len(first):
                    # rounded up, so that a bound in single precision stays one
                    self.most[here, block] = np.maximum(self.most[here, block], np.maximum.reduceat(x, first) * np.float32(1.000001))
                row = self.dense_row[slots]
                full = row >= 0
                self.dense[of[full], row[full]] = x[full]
                listed = self.dense_row[here] < 0
                to = (np.repeat(free[here] - first, count) + np.arange(len(slots)))[~full]
                self.post[to], self.post_x[to] = of[~full], x[~full]
                here, count = here[listed], count[listed]
                free[here] += count
                size[here.astype(np.int64) * n + block] += count.astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        self.there, self.numbers = np.zeros(FOLDED, dtype=bool), np.arange(1)

    def __getattr__(self, name: str):
        if name == "x":  # the components of all unit vectors: made when asked for, which no score does
            self.x = self._unit(0, len(self.ids))
            return self.x
        if name not in BUILT:
            raise AttributeError(name)
        for other in _BUILT:
            other.release()
        _BUILT[:] = [self]
        self._build()
        return self.__dict__[name]

    def release(self) -> None:
        """Lets go of the postings; they are built again when they are asked for."""
        for name in BUILT:
            self.__dict__.pop(name, None)
        _BUILT[:] = [x for x in _BUILT if x is not self]

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("weights", "base", "rates", "k", "ids", "y", "starts", "places", "tf", "norm", "blocks", "slope", "shift")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def unit(self, places: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(tf)) * self.weights[places]
        places, x = places[x > 0], x[x > 0]
        return places, x / np.sqrt(x @ x) if len(x) else x

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        places, x = self.unit(*hashed(counts))
        return dict(zip(places.tolist(), x.tolist()))

    def counter(self, n: int) -> np.ndarray:
        """0 to ``n`` - 1."""
        if len(self.numbers) < n:
            self.numbers = np.arange(2 * n)
        return self.numbers[:n]

    def _bounds(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The queries over the index's own places, and a bound of their cosines per block (queries x blocks)."""
        known, bound = [], np.zeros((len(queries), len(self.blocks) - 1), dtype=np.float32)
        for r, (places, x) in enumerate(queries):
            slots = self.slot[places]
            x = x[slots >= 0].astype(np.float32)
            slots = slots[slots >= 0]
            bound[r] = x @ self.most[slots]
            known.append((slots, x))
        return known, bound + np.float32(1e-5)

    def _scores(self, known: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray, leave: list[int | None]) -> np.ndarray:
        """Cosines in single precision (queries x examples); 0 in blocks that a query skips."""
        q, n = len(known), len(self.blocks) - 1
        often = np.zeros((q, self.dense.shape[1]), dtype=np.float32)
        of, slots, x = np.repeat(np.arange(q), [len(s) for s, _ in known]), *[np.concatenate(z) for z in zip(*known)]
        row = self.dense_row[slots]
        often[of[row >= 0], row[row >= 0]] = x[row >= 0]
        of, slots, x = of[row < 0], slots[row < 0].astype(np.int64) * n, x[row < 0]
        ends = np.searchsorted(of, np.arange(q + 1))
        scores = np.zeros((q, len(self.ids)), dtype=np.float32) if n > 1 else None
        best = np.zeros((q, self.k), dtype=np.float32)
        turn = np.argsort(-bound.mean(axis=0)).tolist()
        for c in turn:
            # the bound against the k-th score so far
            some = np.flatnonzero(bound[:, c] > best.min(axis=1) - 1e-5)
            if not len(some):
                continue
            lo, hi = int(self.blocks[c]), int(self.blocks[c + 1])
            part = often[some] @ self.dense[lo:hi].T
            start, end = self.first[slots + c].astype(np.int64), self.first[slots + c + 1].astype(np.int64)
            count = end - start
            shift = start - (np.cumsum(count) - count)
            for i, r in enumerate(some.tolist()):
                a, b = ends[r], ends[r + 1]
                if a < b:
                    posting = np.repeat(shift[a:b] - shift[a] + start[a], count[a:b])
                    posting += self.counter(len(posting))
                    got = self.post_x.take(posting)
                    got *= np.repeat(x[a:b], count[a:b])
                    part[i] += np.bincount(self.post.take(posting), weights=got, minlength=hi)[lo:]
            for i, r in enumerate(some.tolist()):
                if leave[r] is not None and lo <= leave[r] < hi:
                    part[i, leave[r] - lo] = 0
            if n == 1:
                return part
            scores[some, lo:hi] = part
            if c == turn[-1]:
                break
            both = np.concatenate((best[some], part), axis=1)
            best[some] = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k:]
        return scores

    def _best(self, query: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> list[tuple[float, int, float]]:
        """The k best of ``query`` (its places ascending), from its scores in single precision."""
        # k examples reach the k-th largest of the columns' maxima, so the k-th score does
        width = len(scores) // COLUMN
        least = np.partition(scores[: COLUMN * width].reshape(COLUMN, width).max(axis=0), width - self.k)[width - self.k] \
            if width >= self.k else np.float32(0)
        # single precision leaves at most 1e-5: what can be among the k is compared exactly
        at = np.flatnonzero(scores >= least - 2e-5 if least > 3e-5 else scores > 0)
        if len(at) > self.k:
            near = scores[at]
            at = at[near >= np.partition(near, len(near) - self.k)[len(near) - self.k] - 2e-5]
        if not len(at):
            return []
        spans = [slice(*z) for z in zip(self.starts[at].tolist(), self.starts[at + 1].tolist())]
        places, tf = np.concatenate([self.places[z] for z in spans]), np.concatenate([self.tf[z] for z in spans])
        size = np.array([z.stop - z.start for z in spans])
        own, x = query
        self.there[own & (FOLDED - 1)] = True
        both = np.flatnonzero(self.there[places & (FOLDED - 1)])
        self.there[own & (FOLDED - 1)] = False
        # of these a few only share the folded place
        place = np.minimum(np.searchsorted(own, places[both]), len(own) - 1)
        both, place = (z[own[place] == places[both]] for z in (both, place))
        product = np.zeros(len(tf))
        product[both] = x[place] * ((1 + np.log(tf[both], dtype=np.float64)) * self.weights[own][place] / np.repeat(self.norm[at], size)[both])
        exact = np.add.reduceat(product, np.cumsum(size) - size).round(9)
        top = np.lexsort((self.ids[at], -exact))[:self.k]
        return [(float(exact[i]), int(self.ids[at[i]]), float(self.y[at[i]])) for i in top]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], leave: list[int] | None = None) -> list[list[tuple[float, int, float]]]:
        """For each unit vector the k examples of largest cosine (similarity, id, label), ties to the smaller id."""
        out: list[list[tuple[float, int, float]]] = [[] for _ in queries]
        if not len(self.ids) or not queries:
            return out
        known, bound = self._bounds(queries)
        # queries of like blocks go together
        order = np.argsort(bound.argmax(axis=1), kind="stable")
        for lo in range(0, len(order), QUERIES):
            some = order[lo: lo + QUERIES]
            scores = self._scores([known[i] for i in some], bound[some], [leave[i] if leave else None for i in some])
            for i, row in zip(some.tolist(), scores):
                out[i] = self._best(queries[i], row)
        return out

    def nearest(self, v: dict[int, float]) -> list[tuple[float, int, float]]:
        return self.nearest_of([(np.array(sorted(v), dtype=np.int32), np.array([v[p] for p in sorted(v)]))])[0]

    def share(self, near: list[tuple[float, int, float]]) -> float:
        """Distance-weighted toxic share of the votes, drawn to the base rate by one far vote."""
        w = np.array([1 / (1.05 - s) for s, _, _ in near])
        return float((w @ np.array([y for _, _, y in near]) + self.base) / (w.sum() + 1)) if near else self.base

    def calibrate(self, most: int = 1000) -> None:
        """Logistic fit of the leave-one-out shares of evenly spaced examples (at most ``most``)."""
        at = np.unique(np.linspace(0, len(self.ids) - 1, min(most, len(self.ids))).astype(int)).tolist() if len(self.ids) else []
        queries = [(self.places[self.starts[i]: self.starts[i + 1]], self._unit(i, i + 1)) for i in at]
        x = np.array([logit(self.share(near)) for near in self.nearest_of(queries, at)])
        y = self.y[at]
        if len(x) >= 20 and 0 < y.mean() < 1:
            self.slope, self.shift = platt(x, y, 1 / np.where(y > 0, self.rates[1], self.rates[0]))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int, float]]]]:
        once = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        found = []
        for near in self.nearest_of([self.unit(*terms_of(t)) for t in once]):
            p = 1 / (1 + np.exp(-(self.slope * logit(self.share(near)) + self.shift))) if near else self.base
            found.append((float(p), near))
        return [found[once[t]] for t in texts]

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int, float]]]:
        return self.scores([text])[0]


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 30) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps of weighted rows, with smoothed targets and a weak prior at (1, 0)."""
    weight = np.ones(len(y)) if weight is None else weight
    n1, n0 = weight @ y, weight @ (1 - y)
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    X = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ ab, -30, 30)))
        g = X.T @ (weight * (p - t)) + (ab - [1.0, 0.0])
        h = (X * (weight * p * (1 - p))[:, None]).T @ X + np.eye(2)
        step = np.linalg.solve(h, g)
        ab -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", index_rows: int = INDEX_ROWS) -> Index:
    """The index over the training rows.  Word counts cover all of them; the counts of the 2^20 places
    and the examples (about ``index_rows`` at most) come to the driver."""
    ship(docs.sparkSession)
    rows = written(labelled(docs, labels, label).selectExpr("id", "text", "cast(y as int) y")
                   .mapInArrow(_terms, "id long, words array<int>, tf array<int>, y int"))
    held = F.when(F.size("words") > 0, 1).otherwise(0)
    n, n1, m, m1 = [x or 0 for x in rows.agg(F.count(F.lit(1)), F.sum("y"), F.sum(held), F.sum(held * F.col("y"))).first()]
    weights = np.zeros(PLACES)
    if not n1 or n1 == n:
        return Index(weights, [], n1 / n if n else 0.0)
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word") \
        .agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).toArrow()
    place, c1, c = [counts.column(k).to_numpy() for k in range(3)]
    odds = np.log((c1 + 1) / (n1 + 2)) - np.log((c - c1 + 1) / (n - n1 + 2))
    weights[place] = (np.log((1 + n) / (1 + c)) + 1) * (FLOOR + np.maximum(odds, 0))
    m0 = m - m1
    keep1 = min(m1, max(index_rows // 2, index_rows - m0))
    rates = (min(1.0, (index_rows - keep1) / max(m0, 1)), keep1 / max(m1, 1))
    scale = 1 << 20
    part = F.pmod(F.xxhash64("id", F.lit(MODEL_SEED)), F.lit(scale))
    found = rows.where(F.size("words") > 0).where(part < F.when(F.col("y") == 1, int(scale * rates[1])).otherwise(int(scale * rates[0]))).toArrow()
    del counts, place, c1, c, odds
    examples = []
    for batch in found.to_batches():
        words, tf = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(k)] for k in (1, 2)]
        examples += zip(batch.column(0).to_pylist(), words, tf, batch.column(3).to_pylist())
    del found
    index = Index(weights, sorted(examples, key=lambda e: (e[0], len(e[1]))), (n1 - m1 + n1 / n) / (n - m + 1), rates)
    del examples
    index.calibrate()
    index.release()
    give_back()
    return index


def scorer(spark: SparkSession, index: Index, evidence: bool = True):
    """A function of a text column: struct of score and evidence (the neighbours), or the score alone."""
    ship(spark)
    shared = spark.sparkContext.broadcast(index)

    def slices(text: pa.Array) -> Iterator[tuple[float, list[tuple[float, int, float]]]]:
        sole("toxicity", forget)
        for i in range(0, len(text), TEXTS):
            yield from shared.value.scores(text.slice(i, TEXTS).to_pylist())

    def score(text: pa.Array) -> pa.Array:
        return pa.array([s for s, _ in slices(text)], pa.float64())

    def both(text: pa.Array) -> pa.Array:
        got = list(slices(text))
        near = [[{"similarity": a, "doc_id": i, "label": int(y)} for a, i, y in near] for _, near in got]
        kind = pa.list_(pa.struct([("similarity", pa.float64()), ("doc_id", pa.int64()), ("label", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array([s for s, _ in got], pa.float64()), pa.array(near, kind)], ["score", "evidence"])

    if not evidence:
        return F.arrow_udf(score, "double")
    return F.arrow_udf(both, "struct<score:double,evidence:array<struct<similarity:double,doc_id:bigint,label:int>>>")


def toxicity(docs: DataFrame, index: Index, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a further column ``out``: score and evidence.  A column of that name is a ValueError."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    return docs.withColumn(out, scorer(docs.sparkSession, index)(F.col(f"`{text_col}`")))


def below(docs: DataFrame, index: Index, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under ``limit`` (all columns, whatever their names)."""
    rows = packed(docs).withColumn("score", scorer(docs.sparkSession, index, evidence=False)(F.col(f"row.`{text_col}`")))
    return unpacked(rows.where(F.col("score") < limit), docs)


def op8_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity(docs.select("doc_id", "text"), index)
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                         F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
                         F.transform("toxicity.evidence", lambda e: e["doc_id"]).alias("evidence"))
