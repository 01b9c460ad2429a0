"""Personal data: base patterns, then a skip-chain conditional random field over each document.

Base spans are the contract's four patterns (email, ip, card, phone).  The field's nodes are the
words of a text that hold a digit or an @; every other word is no personal data.  Words in a base
span are observed.  Chain edges join nodes that are neighbouring words.  Skip edges join every mention
of a token, however far apart, to one hub per token.  A token is an address, or a string of
``suffix`` digits or more: those of a base span, of a word, or of up to ``MENTION_WORDS`` neighbouring
words that together are a base span's digits or end like them.  So a number has one hub however it is
split into words.  Each hub is joined to that of the longest other token that it ends with: a number
shares potentials with its long suffixes, and the edges grow with the words alone.

Unary and chain weights are learned by pseudo-likelihood from the base labels of a sample of at most
``sample_docs`` documents; other mentions of an observed token are hidden: they teach nothing, and their
own unary score is 0, so that their shapes, however many, do not outvote the observation.  The potential
of a skip edge is a parameter (``AGREE``); other unary scores are held to ``UNARY_LIMIT``.  Marginals come from loopy message passing with damping until the messages settle
(``ROUNDS`` rounds at most).  An unobserved word whose best kind reaches ``least`` becomes a span,
neighbours of one kind together.

All steps see whole texts and take time linear in them; a task holds the graphs of one Arrow batch.

Defined results: null and empty texts have no spans; repeated rows get the same rows; an empty table
gives an empty result; with nothing to learn from the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, ship, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4000
LEAST = 0.95
BITS = 12
ROUNDS = 1000
SETTLED = 1e-6
AGREE = 9.0
UNARY_LIMIT = 4.0
SUFFIX = 7
MENTION_WORDS = 6
# The contract's patterns (the email's local part is read backwards from its @)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
TRIM = ".,;:!?\"'<>[]{}|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        while at > free and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            out.append((0, at, m.end()))
            free = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def shape(word: str) -> str:
    """Classes of characters, runs of letters shortened, digits counted up to 20."""
    out = re.sub(r"[^\W\d_]+", "a", word[:200])
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 20)}", out)[:40]


def node_features(word: str, left: str, right: str) -> list[int]:
    core = word.strip(TRIM)
    digits = NOT_DIGIT.sub("", core)
    parts = core.split(".")
    names = [f"s={shape(core)}", f"n={min(len(digits), 20)}", f"at={'@' in core}", f"dots={min(core.count('.'), 5)}",
             f"l={shape(left)}", f"r={shape(right)}", f"sl={shape(core)}|{shape(left)}",
             f"luhn={13 <= len(digits) <= 19 and luhn(digits)}",
             f"ip={len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}", "bias"]
    return [xxhash.xxh3_64_intdigest(n) >> (64 - BITS) for n in names]


class Graph:
    """Nodes and edges of one text.  ``label`` is 0 for none, 1 + kind inside a base span."""

    def __init__(self, text: str):
        self.base = base_spans(text)
        words = [(m.start(), m.end(), bool(SIGN.search(m.group()))) for m in WORDS.finditer(text)]
        at = [i for i, w in enumerate(words) if w[2]]
        self.where = [words[i][:2] for i in at]
        spans = sorted((s, e, k) for k, s, e in self.base)
        self.label, j = [], 0
        for s, e in self.where:
            while j < len(spans) and spans[j][1] <= s:
                j += 1
            self.label.append(spans[j][2] + 1 if j < len(spans) and spans[j][0] < e else 0)

        def word(i: int) -> str:
            return text[words[i][0]:words[i][1]] if 0 <= i < len(words) else ""

        self.features = [node_features(word(i), word(i - 1), word(i + 1)) for i in at]
        self.chain = [(a, a + 1) for a in range(len(at) - 1) if at[a + 1] == at[a] + 1]
        self._tokens(text)

    def _tokens(self, text: str) -> None:
        """Hubs: ``links`` (hub, node), ``parents`` (hub, hub of its longest suffix), ``hidden`` nodes."""
        mentions: dict[str, list[list[int]]] = {}
        digits = [NOT_DIGIT.sub("", text[s:e]) for s, e in self.where]
        inside, j = [], 0  # base span of each node
        spans = sorted((s, e) for _, s, e in self.base)
        for s, e in self.where:
            while j < len(spans) and spans[j][1] <= s:
                j += 1
            inside.append(j if j < len(spans) and spans[j][0] < e else -1)
        of_span: dict[int, list[int]] = {}
        for n, (s, e) in enumerate(self.where):
            core = text[s:e].strip(TRIM).lower()
            if "@" in core:
                mentions.setdefault(core, []).append([n])
            elif inside[n] >= 0:
                of_span.setdefault(inside[n], []).append(n)
            elif len(digits[n]) >= SUFFIX:
                mentions.setdefault(digits[n], []).append([n])
        ends = set()
        for i, nodes in of_span.items():
            key = NOT_DIGIT.sub("", text[slice(*spans[i])])
            if len(key) >= SUFFIX:
                mentions.setdefault(key, []).append(nodes)
                ends.update(key[k:] for k in range(len(key) - SUFFIX + 1))
        if ends:
            chained = {b for _, b in self.chain}
            for n in range(len(digits)):
                key, last = digits[n], n
                while last + 1 in chained and last - n + 1 < MENTION_WORDS and inside[n] < 0 and inside[last + 1] < 0:
                    last += 1
                    key += digits[last]
                    if key in ends:
                        mentions.setdefault(key, []).append(list(range(n, last + 1)))
        parent = {}
        for key in mentions:
            if "@" not in key:
                parent[key] = next((key[k:] for k in range(1, len(key) - SUFFIX + 1) if key[k:] in mentions), None)
        shared = {k for k, m in mentions.items() if len(m) > 1} | {k for pair in parent.items() if pair[1] for k in pair}
        number = {k: i for i, k in enumerate(k for k in mentions if k in shared)}
        self.hubs = len(number)
        self.links = [(h, n) for k, h in number.items() for m in mentions[k] for n in m]
        self.parents = [(number[k], number[up]) for k, up in parent.items() if up]
        top = {}
        for k in number:
            at = k
            while parent.get(at):
                at = parent[at]
            top[number[k]] = at
        seen = {top[h] for h, n in self.links if self.label[n]}
        self.hidden = sorted({n for h, n in self.links if self.label[n] == 0 and top[h] in seen})


class Field:
    """Weights: unary (features x labels), chain (left x right label); ``agree`` on every skip edge."""

    def __init__(self, agree: float = AGREE):
        k = len(KINDS) + 1
        self.unary, self.chain, self.skip = np.zeros((1 << BITS, k)), np.zeros((k, k)), agree * np.eye(k)
        self.known = False

    def fit(self, features: np.ndarray, label: np.ndarray, chain: np.ndarray, hidden: np.ndarray, steps: int = 150) -> None:
        """Pseudo-likelihood: each node's label given its features and its neighbours' labels (Adagrad, L2);
        ``hidden`` nodes teach nothing."""
        k = self.chain.shape[0]
        one = np.eye(k)[label]
        n = len(label)
        one[hidden] = 0.0
        left, right = np.zeros((n, k)), np.zeros((n, k))
        if len(chain):
            np.add.at(left, chain[:, 1], one[chain[:, 0]])
            np.add.at(right, chain[:, 0], one[chain[:, 1]])
        grads = [np.full_like(w, 1e-8) for w in (self.unary, self.chain)]
        flat = features.ravel()
        for _ in range(steps):
            z = self.unary[features].sum(axis=1) + left @ self.chain + right @ self.chain.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - one) / n
            d[hidden] = 0.0
            gu = np.stack([np.bincount(flat, np.repeat(d[:, j], features.shape[1]), minlength=1 << BITS) for j in range(k)], axis=1)
            for w, g2, g in zip((self.unary, self.chain), grads, (gu, left.T @ d + (right.T @ d).T)):
                g = g + 1e-5 * w
                g2 += g * g
                w -= 0.5 * g / np.sqrt(g2)
        self.known = True

    def scores(self, features: np.ndarray, label: np.ndarray, hidden: np.ndarray | None = None) -> np.ndarray:
        """Unary scores against label 0, held to the limit; nodes with a label above 0 are observed, and
        hidden ones, from which no weight was learned, score 0."""
        node = self.unary[features].sum(axis=1)
        node = np.clip(node - node[:, :1], -UNARY_LIMIT, UNARY_LIMIT)
        if hidden is not None:
            node[hidden] = 0.0
        seen = label > 0
        node[seen] = -50.0
        node[seen, label[seen]] = 0.0
        return node

    def marginals(self, features: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, hubs: int = 0,
                  hidden: np.ndarray | None = None) -> np.ndarray:
        """Loopy message passing; variables from ``len(label)`` on are the hubs."""
        k = self.chain.shape[0]
        n = len(label)
        node = np.concatenate((self.scores(features, label, hidden), np.zeros((hubs, k))))
        edges = np.concatenate([chain.reshape(-1, 2), skip.reshape(-1, 2)]).astype(np.int64)
        belief = node
        if len(edges):
            kind = np.repeat([0, 1], [len(chain), len(skip)])
            psi = np.stack([np.exp(self.chain), np.exp(self.skip)])[kind]
            source = np.concatenate((edges[:, 0], edges[:, 1]))
            target = np.concatenate((edges[:, 1], edges[:, 0]))
            pot = np.concatenate((psi, psi.transpose(0, 2, 1)))
            back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
            message = np.zeros((len(source), k))

            def beliefs() -> np.ndarray:
                sums = [np.bincount(target, message[:, j], minlength=len(node)) for j in range(k)]
                return node + np.stack(sums, axis=1)

            for _ in range(ROUNDS):
                out = beliefs()[source] - message[back]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, pot) + 1e-300)
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - message).max()
                message = 0.5 * message + 0.5 * new
                if moved < SETTLED:
                    break
            belief = beliefs()
        p = np.exp(belief[:n] - belief[:n].max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def pairs(edges: list[tuple[int, int]]) -> np.ndarray:
    return np.array(edges, dtype=np.int64).reshape(-1, 2)


def joined(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """The disjoint union of graphs: features, labels, chain edges, skip edges, number of hubs, hidden nodes."""
    at = np.cumsum([0] + [len(g.label) for g in graphs])
    hub = at[-1] + np.cumsum([0] + [g.hubs for g in graphs])
    features = np.array([f for g in graphs for f in g.features], dtype=np.int64).reshape(-1, 10)
    label = np.array([x for g in graphs for x in g.label], dtype=np.int64)
    chain = np.concatenate([pairs([]), *[pairs(g.chain) + o for g, o in zip(graphs, at)]])
    links = np.concatenate([pairs([]), *[pairs(g.links) + (h, o) for g, h, o in zip(graphs, hub, at)]])
    parents = np.concatenate([pairs([]), *[pairs(g.parents) + h for g, h in zip(graphs, hub)]])
    hidden = np.array([n + o for g, o in zip(graphs, at.tolist()) for n in g.hidden], dtype=np.int64)
    return features, label, chain, np.concatenate((links, parents)), int(hub[-1] - at[-1]), hidden


def added_spans(graph: Graph, text: str, p: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Spans of unobserved nodes, neighbouring words of one kind as one."""
    best = p.argmax(axis=1)
    out: list[tuple[int, int, int]] = []
    chained = {b for _, b in graph.chain}
    open_kind = -1
    for n, (s, e) in enumerate(graph.where):
        kind = int(best[n]) - 1 if graph.label[n] == 0 and p[n].max() >= least else -1
        if kind < 0:
            open_kind = -1
            continue
        word = text[s:e]
        s2, e2 = s + len(word) - len(word.lstrip(TRIM)), e - (len(word) - len(word.rstrip(TRIM)))
        if kind == open_kind and n in chained:
            out[-1] = (kind, out[-1][1], e2)
        else:
            out.append((kind, s2, e2))
        open_kind = kind
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted on at most about ``sample_docs`` documents with a digit or an @, picked by id hash."""
    ship(docs.sparkSession)
    rows = own_columns(docs, id=id_col, text=text_col).where(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    if n > sample_docs:
        scale = 1 << 20
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(scale)) < max(1, int(scale * sample_docs / n)))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graphs = [Graph(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[x for f in g.features for x in f] for g in graphs], pa.list_(pa.int32())),
                *[pa.array(c, pa.list_(pa.int32())) for c in (
                    [g.label for g in graphs], [[x for e in g.chain for x in e] for g in graphs],
                    [g.hidden for g in graphs])]], ["id", "features", "label", "chain", "hidden"])

    got = rows.selectExpr("cast(id as string) id", "text") \
        .mapInArrow(nodes, "id string, features array<int>, label array<int>, chain array<int>, hidden array<int>").collect()
    field = Field()
    parts = sorted(got, key=lambda r: (str(r["id"]), r["label"]))
    at = np.cumsum([0] + [len(r["label"]) for r in parts])
    if at[-1]:
        chain, hidden = [np.array([x + o for r, o in zip(parts, at.tolist()) for x in r[c]], dtype=np.int64) for c in ("chain", "hidden")]
        field.fit(np.array([x for r in parts for x in r["features"]], dtype=np.int64).reshape(-1, 10),
                  np.array([x for r in parts for x in r["label"]], dtype=np.int64), chain.reshape(-1, 2), hidden)
    return field


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of kind, start, end; code points, end exclusive)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in spans], span)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            with_sign = [i for i, t in enumerate(texts) if t and SIGN.search(t)]
            graphs = {i: Graph(texts[i]) for i in with_sign}
            base = [graphs[i].base if i in graphs else [] for i in range(len(texts))]
            added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            field = shared.value
            open_ = [i for i in with_sign if 0 in graphs[i].label]
            if field.known and open_:
                p = field.marginals(*joined([graphs[i] for i in open_]))
                lo = 0
                for i in open_:
                    n = len(graphs[i].label)
                    added[i] = added_spans(graphs[i], texts[i], p[lo: lo + n], least)
                    lo += n
            yield pa.RecordBatch.from_arrays([batch.column(0), rows(base), rows(added)], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    chosen = own_columns(docs, doc_id=id_col, text=text_col)
    return chosen.mapInArrow(work, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, base {kind}, added {kind}")


def op1_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
        by_kind = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(by_kind, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.concat("base", "added")).alias("spans"))


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base_spans(text or "")).encode()).hexdigest()
