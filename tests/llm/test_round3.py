"""Operators 11 to 13 against brute force: nulls, empty and long texts, repeated rows, ties, clashing
column names, empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from stationlab.llm import exact_dedup, fill_middle, filter_audit, jaccard_join, language, mixing, sentence_spans, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, mask int, sha string, part string, first boolean, good int"


def frame(spark, rows):
    """(doc_id, text, lang, source) with further columns under names that the operators use inside."""
    return spark.createDataFrame([(*r, 7, "plain", 31, "x", "y", False, 1) for r in rows], SCHEMA)


# 11 ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("share, kinds", [(0.001, {"array"}), (0.3, {"bitmap"}), (0.9999, {"run"})])
def test_containers_select(share, kinds):
    r = np.random.RandomState(3)
    member = r.random_sample(200_000) < share
    member[70_000:131_072] = False
    s = fill_middle.BoundarySet(member)
    want = np.flatnonzero(member)
    assert len(s) == len(want) and {c.kind for c in s.containers} <= kinds | {"array", "run"}
    assert kinds <= {c.kind for c in s.containers}
    for k in [0, 1, len(want) // 2, len(want) - 1, *r.randint(0, len(want), 200).tolist()]:
        assert s.select(k) == want[k]


def test_a_block_without_members():
    member = np.zeros(3 * fill_middle.BLOCK, dtype=bool)
    member[[0, 5, 2 * fill_middle.BLOCK + 9]] = True
    s = fill_middle.BoundarySet(member)
    assert s.high == [0, 2] and [s.select(i) for i in range(3)] == [0, 5, 2 * fill_middle.BLOCK + 9]
    assert len(fill_middle.BoundarySet(np.zeros(4, dtype=bool))) == 0


def cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i: 8 * i + 8], 16) for i in range(4)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    r = random.Random(11)
    pieces = ["word", "Zwei", " ", "\n", "é", "中文", "\U0001f600", "12", "<", "P>", "<S", "<P", "\t"]
    texts = [None, "", "a", "é", "<P>", "x<M>y", "<<S<P", "\u0000\u001f", "word " * 40_000, "中" * 70_000 + "end", "1" * 66_000]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(12, texts[12], "en", "s"), (None, "no id here", "en", "s")]
    docs = frame(spark, rows)
    out = fill_middle.fill_middle(docs)
    got = sorted((str(x["doc_id"]), x["n"], x["form"], str(x["prefix_chars"]), str(x["middle_chars"]), x["output"]) for x in out.collect())
    want = []
    for i, t, *_ in rows:
        n, form, p, m, o = cut(i, t)
        want.append((str(i), n, form, str(p), str(m), o))
    assert got == sorted(want)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    again = {(x["doc_id"], x["t"]) for x in out.select("doc_id", fill_middle.restored(out["output"], out["form"]).alias("t")).collect()}
    assert again == {(i, t or "") for i, t, *_ in rows}
    assert fill_middle.fill_middle(frame(spark, [])).count() == 0


# 12 ------------------------------------------------------------------------------------------
def brute_grams(text, n=3):
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    if not s.strip():
        return []
    s = " " + " ".join(s.split()) + " "
    s += " " * (n - len(s))
    return [s[i: i + n] for i in range(len(s) - n + 1)]


def named(key, n=3):
    codes = [(int(key) >> (21 * (n - 1 - i))) & ((1 << 21) - 1) for i in range(n)]
    return "".join(chr(c) if c else " " for c in codes)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_grams(monkeypatch, n):
    monkeypatch.setattr(language, "SLICE", 7)
    r = random.Random(5)
    texts = ["", "a", "  ", "1", "Ab", " Ab ", "één  twee\n3drie", "中文 字", "x" * 15, "  " * 9 + "q" + "..." * 9]
    texts += ["".join(r.choice("ab É.中 ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    for t in texts:
        want = brute_grams(t, n)
        keys, counts = language.profile(t, n)
        assert {named(k, n): c for k, c in zip(keys, counts)} == collections.Counter(want), repr(t)
        if want:
            assert [named(k, n) for g in language.grams(t, n) for k in g] == want
    assert len(language.profile(None)[0]) == 0


def test_bound_and_bundled_by_hand(monkeypatch):
    words = ["abc", " ab", "bca", "aaa"]
    keys = np.array([sum(ord(c) * (c != " ") << (21 * (2 - i)) for i, c in enumerate(w)) for w in words], dtype=np.uint64)
    one = {c: language.letter_vectors(np.array([ord(c) * (c != " ")]), 128)[0] for c in "abc "}
    hand = np.array([np.roll(one[w[0]], 2) * np.roll(one[w[1]], 1) * one[w[2]] for w in words])
    assert (language.bound(keys, 3, 128) == hand).all() and set(np.unique(hand)) == {-1, 1}
    counts = np.array([[1, 0, 2, 5], [0, 0, 0, 0], [1 << 25, 3, 0, 1]])
    monkeypatch.setattr(language, "BIND_ROWS", 3)
    for some in (counts[:2], counts):
        assert (language.bundles([(keys[c > 0], c[c > 0]) for c in some], 3, 128) == some @ hand.astype(np.int64)).all()


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def test_longer_runs_are_refused(spark):
    with pytest.raises(ValueError, match="1 to 3"):
        language.fit(frame(spark, []), n=4)


def test_languages(spark):
    r = random.Random(2)
    bags = {"xx": ["thing", "with", "other", "north"], "yy": ["schön", "straße", "nicht", "ach"], "zz": ["que", "où", "été", "eaux"]}
    rows = [(i, sentence(r, bags[l], r.randint(1, 40)), l, None) for i, l in enumerate(random.Random(3).choices(list(bags), k=300))]
    rows += [(1000, None, "xx", None), (1001, "", "xx", None), (1002, "123 !?", "yy", None), (1003, "thing with other", None, None),
             (None, "nicht schön", "yy", None), (1005, sentence(r, bags["zz"], 60_000), "zz", None), (7, rows[7][1], rows[7][2], None)]
    out = language.identify(frame(spark, rows), dim=512).collect()
    assert len(out) == len(rows)
    held = {x["doc_id"]: x["held_out"] for x in out}
    assert all(v == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, v in held.items())
    pred = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in out}
    assert pred[1000] == pred[1001] == pred[1002] == ("und", 0.0) and pred[1003][0] == "xx" and pred[None][0] == "yy"
    assert all(pred[i][0] == l and 0 < pred[i][1] <= 1 for i, _, l, _ in rows[:300])
    # the same vectors by hand, all training rows of all partitions
    train = [(t, l) for i, t, l, _ in rows if t and l and not held[i]]
    model = language.fit(frame(spark, rows).repartition(7), dim=512)
    for name, vector in zip(model.languages, model.vectors):
        grams = collections.Counter(g for t, l in train if l == name for g in brute_grams(t))
        codes = np.array([sum(ord(c) * (c != " ") << (21 * (2 - i)) for i, c in enumerate(g)) for g in grams], dtype=np.uint64)
        total = np.array(list(grams.values())) @ language.bound(codes, 3, 512).astype(np.int64)
        assert np.allclose(vector, total / np.linalg.norm(total))
    assert language.identify(frame(spark, [])).count() == 0
    none = language.identify(frame(spark, [(1, "thing", None, None), (2, "ab", None, None)])).collect()
    assert {(x["lang_pred"], x["score"]) for x in none} == {("und", 0.0)}


def test_equal_cosines_go_to_the_smaller_name(spark):
    rows = [(i, "same words here", l, None) for i, l in zip((1, 2, 3, 4, 5, 6), "babcab")]
    got = language.identify(frame(spark, rows), dim=256).collect()
    assert {x["lang_pred"] for x in got} == {"a"}


def test_a_column_of_many_names_is_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="not a language column"):
        language.fit(frame(spark, [(i, "abc", f"l{i}", None) for i in range(40)]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert out.where("lang_pred = lang").count() >= 0.98 * out.count()


# 13 ------------------------------------------------------------------------------------------
def brute_audit(rows, labels):
    quality, toxic = {}, {}
    for i, q, t in labels:
        quality[i] = quality.get(i, False) or q == 1
        toxic[i] = toxic.get(i, False) or t == 1
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    facts = []
    for i, t, _, part in rows:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = text in first and (i is None or i > first[text])
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": copy}
        facts.append((part or "", fails, i is not None and quality.get(i, False), i is not None and toxic.get(i, False)))
    out = []
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(removed)
                found.append([part, "".join(order), step, len(left), len(removed), sum(x[1][f] for x in mine) - len(removed),
                              sum(x[1][f] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in removed), sum(x[3] for x in removed), f])
        out += [tuple([*r[:-1], shapley[r[-1]]]) for r in found]
    return sorted(out)


def audit_rows(r):
    texts = [None, "", " \t\n", "One #", sentence(r, ["aa", "bb"], 80), sentence(r, [f"w{i}" for i in range(900)], 70),
             sentence(r, [f"w{i}" for i in range(900)], 60) + " *", "ABC " + sentence(r, [f"w{i}" for i in range(900)], 60),
             sentence(r, ["UP", "aa", "$"], 51), sentence(r, [f"Ü{i}" for i in range(99_000)], 30_000), "a b"]
    rows = [(i, r.choice(texts), None, r.choice(["p", "q", "", None])) for i in range(150)]
    rows += [(i, texts[5], None, "hot") for i in range(200, 400)] + [rows[3], rows[3]]
    rows += [(5000, "same id", None, "p"), (5000, "same id", None, "q"), (5000, "other text", None, "q")]
    rows += [(None, texts[5], None, "p"), (None, "only here", None, "p"), (None, "only here", None, "q"), (None, None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_filter_audit(spark):
    rows, labels = audit_rows(random.Random(4))
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, n string")
    docs = frame(spark, rows)
    got = filter_audit.audit(docs, marks)
    assert sorted(tuple(x) for x in got.collect()) == brute_audit(rows, labels)
    assert got.columns == [f.split()[0] for f in filter_audit.STEPS.split(", ")]
    assert filter_audit.audit(frame(spark, []), marks).count() == 0
    bare = filter_audit.audit(docs, marks.where("false"))
    assert sorted(tuple(x) for x in bare.collect()) == brute_audit(rows, [])


def test_swaps_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for d in filter_audit.adjacent_swaps(n):
            order[d], order[d + 1] = order[d + 1], order[d]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_diagrams_share_nodes_and_keep_their_weights():
    r = random.Random(1)
    counts = {m: (r.randint(0, 1), 0, 0) for m in range(32)}
    d = filter_audit.Diagram(counts)
    assert sum(map(len, d.unique[:-1])) < 31 and len(d.unique[-1]) == 2
    for depth in list(filter_audit.adjacent_swaps(5)):
        d.swap(depth)
        assert d.weight[d.root][0] == sum(c[0] for c in counts.values())
        for mask, c in counts.items():
            node = d.root
            for f in d.order:
                node = (d.failed if mask >> "ABCDE".index(f) & 1 else d.passed)[node]
            assert d.weight[node] == c


# rows that share an id, clashing names -------------------------------------------------------
CLASH = "doc_id long, text string, source string, row string, sha string, _sha string, key string, id string, size string, _size string, " \
        "_digest string, spans string, stays string, best string, _score string, toxicity string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "s", *"abcdefghijklm") for i, t in rows], CLASH)


A, B = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")


def test_shared_and_null_ids_lose_no_document(spark):
    docs = clashing(spark, [(3, A), (7, A), (7, B), (7, B), (None, A), (None, "x " * 30 + B[:60]), (None, "x " * 30 + B[:60]), (8, None), (None, "")])
    kept = jaccard_join.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, A), (7, B), (None, "x " * 30 + B[:60]), (8, None), (None, "")], key=str)
    assert {tuple(r)[3:] for r in kept.collect()} == {tuple("abcdefghijklm")}


def test_spans_are_cut_only_in_their_own_text(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, "Start " + passage), (7, A + " " + passage), (7, B), (None, B[:90] + ". " + passage), (None, "Other. " + passage), (9, passage), (9, passage)]
    docs = clashing(spark, rows)
    spans = sentence_spans.repeated_spans(docs)
    out = sentence_spans.remove_spans(docs, spans)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {tuple("abcdefghijklm")}
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert (7, B) in got and sum("p40" in t for _, t in got) == 1
    assert len(got) == len(rows) and all(t.startswith(A) for i, t in got if i == 7 and t != B)
    # null ids come first: one of the two texts without an id keeps the passage
    assert any(i is None and "p40" in t for i, t in got)


def test_runs_by_brute_force(spark):
    """Every repeated run of the method, found by comparing all runs of all documents."""
    r = random.Random(21)
    pool = [sentence(r, [f"w{i}" for i in range(300)], r.randint(4, 16)).capitalize() + "." for _ in range(25)]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for i, t in sorted(rows):
        for h, c, a, b in sentence_spans.runs(t) + sentence_spans.anchored_runs(t):
            seen.setdefault(" ".join(t[a:b].lower().split()), []).append((i, a, b))
    want = {}
    for places in seen.values():
        first = min(places)
        for i, a, b in places:
            if (i, a) != first[:2]:
                a = max(a, first[2]) if i == first[0] else a
                want.setdefault(i, set()).update(range(a, b))
    got = {}
    for x in sentence_spans.repeated_spans(docs).collect():
        mine = set(range(x.start, x.end))
        assert not mine & got.get(x.doc_id, set())
        got.setdefault(x.doc_id, set()).update(mine)
    assert got == {i: m for i, m in want.items() if m} and len(got) > 5


def test_own_columns_survive_dedup_mix_and_toxicity(spark):
    docs = clashing(spark, [(1, A), (2, A.upper()), (2, A.upper()), (3, B)])
    out = exact_dedup.drop_duplicates(docs)
    assert sorted((r.doc_id, *tuple(r)[3:]) for r in out.collect()) == [(2, *"abcdefghijklm"), (3, *"abcdefghijklm")]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r)[3:] for r in mixed.collect()} == {tuple("abcdefghijklm")}


# block-max index -----------------------------------------------------------------------------
@pytest.mark.parametrize("blocks", [1, 4, 13])
def test_block_max_index_finds_the_nearest_of_all_pairs(monkeypatch, blocks):
    monkeypatch.setattr(toxicity, "BLOCKS", blocks)
    monkeypatch.setattr(toxicity.clusters, "__defaults__", (blocks, 128, 8))
    r = random.Random(31)
    bags = [[f"{c}{i}" for i in range(200)] for c in "xyz"]
    texts = [sentence(r, r.choice(bags) + ["the", "of"] * 20, r.randint(3, 90)) for _ in range(400)] + ["only here", "the"]
    feats = [(i, *toxicity.hashed(toxicity.words_of(t)), i % 3 // 2) for i, t in enumerate(texts)]
    weights = np.zeros(toxicity.PLACES)
    for _, places, _, _ in feats:
        weights[places] += 1
    weights = np.where(weights > 0, np.log(1 + len(texts) / np.maximum(weights, 1)), 0.0)
    index = toxicity.Index(weights, feats, 0.3)
    assert len(index.blocks) - 1 <= blocks and index.blocks[-1] == len(texts)
    vectors = [dict(zip(*map(np.ndarray.tolist, index.unit(p, t)))) for _, p, t, _ in feats]
    queries = texts[:40] + texts[-2:] + ["", "unknown words", sentence(r, bags[0] + bags[1], 120)]
    got = index.nearest_of([index.unit(*toxicity.hashed(toxicity.words_of(q))) for q in queries])
    for q, near in zip(queries, got):
        v = index.vector(toxicity.words_of(q))
        want = sorted(((-round(sum(x * d.get(p, 0.0) for p, x in v.items()), 9), i) for i, d in enumerate(vectors)))
        want = [(-s, i) for s, i in want if s < 0][: index.k]
        assert [i for _, i, _ in near] == [i for _, i in want]
        assert [s for s, *_ in near] == pytest.approx([s for s, _ in want], abs=2e-9)
    known, bound = index._bounds([index.unit(*toxicity.hashed(toxicity.words_of(q))) for q in queries])
    for (slots, x), b, q in zip(known, bound, queries):
        v = index.vector(toxicity.words_of(q))
        for c in range(len(index.blocks) - 1):
            real = max(sum(x * dict(zip(index.places[a:e].tolist(), index.x[a:e].tolist())).get(p, 0.0) for p, x in v.items())
                       for a, e in zip(index.starts[index.blocks[c]:index.blocks[c + 1]], index.starts[index.blocks[c] + 1:index.blocks[c + 1] + 1]))
            assert real <= b[c]


def test_toxicity_keeps_own_columns(spark):
    index = toxicity.Index(np.ones(toxicity.PLACES), [(1, *toxicity.hashed({"bad": 1}), 1), (2, *toxicity.hashed({"good": 1}), 0)], 0.5)
    docs = clashing(spark, [(1, "bad"), (2, "good"), (3, None)])
    out = toxicity.below(docs, index, 0.6)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, 3}
    with pytest.raises(ValueError):
        toxicity.toxicity(docs, index)
