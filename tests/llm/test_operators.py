"""The training-data operators against brute force on small tables with nulls, empty and long texts,
repeated rows, clashing column names, and empty tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from stationlab.llm import exact_dedup, jaccard_join, mixing, packing, personal, quality, sentence_spans, token_files, toxicity, vector_search
from stationlab.llm.packing import vocabulary_path
from stationlab.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, start long, id string, sha string"


def words(seed, n, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, pool)}" for _ in range(n))


TEXTS = [
    (1, None, "a"), (2, "", None), (3, "One Two", "a"), (4, "one two", "b"), (5, words(5, 60), "b"), (6, words(5, 60) + " end", "b"),
    (7, words(5, 60).upper(), None), (8, words(8, 9000, 5000), "c"), (9, "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111", "c"),
    (10, "É ﬁ 中 \U0001f600 \n\n  tab\tend ", "c"), (10, "É ﬁ 中 \U0001f600 \n\n  tab\tend ", "c"), (None, "no id", "a"), (12, words(5, 60), "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y") for i, t, s in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_exact_dedup(docs, nothing):
    groups = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        groups[lower(t)].append(i)
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.duplicate_table(docs).collect())
    want = []
    for i, t, _ in TEXTS:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=-1)
        want.append((i or -1, keep, len(ids), (i or -1) == keep))
    assert got == sorted(want)
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len(groups)
    assert exact_dedup.duplicate_table(nothing).count() == exact_dedup.drop_duplicates(nothing).count() == 0


def test_source_targets_by_repeated_sharing(docs, nothing):
    rows = mixing.mix(docs, block_words=16)
    got = rows["targets"].collect()
    size = {r["source"]: r["source_size"] for r in got}
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = [s for s in share if share[s] > 2 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * size[s]
            full.add(s)
            left -= target[s]
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
    taken = rows["taken"].collect()
    assert len(taken) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in taken)
    assert sum(r["taken"] for r in taken) == sum(r["quota"] for r in got)
    slots = rows["schedule"].collect()
    per_source = collections.Counter(s["source_no"] for s in slots)
    assert all(per_source[r["source_no"]] == r["n_blocks"] for r in got)
    assert len({(s["source_no"], s["block"]) for s in slots}) == len(slots)
    assert mixing.mixed_documents(docs, block_words=16).columns == docs.columns
    assert mixing.mix(nothing)["taken"].count() == mixing.mixed_documents(nothing).count() == 0


def test_token_files_round_trip(docs, nothing):
    path = vocabulary_path(token_files.VOCABULARY)
    plain = encoder(path).plain
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, at = [], 0
    for i, t, _ in order:
        raw = plain([t or ""])[0] + b"\0\0\0\0"
        want.append((at, i, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    blocks = token_files.write_blocks(docs, path, block_ids=500)
    got = token_files.read_documents(blocks).collect()
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_files.read_documents(token_files.write_blocks(nothing, path)).count() == 0


def test_repair_random_access():
    r = np.random.RandomState(0)
    for case in range(20):
        tokens = [np.append(r.choice([0, 5, 7, 7, 9], r.randint(1, 200)), 0).astype("<u4") for _ in range(r.randint(1, 12))]
        block = token_files.Block(token_files.pack_block(list(range(len(tokens))), tokens, least_count=2))
        assert len(block.rules) and block.expand(block.symbols).tolist() == np.concatenate(tokens).tolist()
        for i, t in enumerate(tokens):
            a, b = sorted(r.randint(0, len(t) + 1, 2).tolist())
            assert block.document(i, a, b).tolist() == t[a:b].tolist()


def test_packing(docs, nothing):
    path = vocabulary_path(packing.VOCABULARY)
    rows = packing.pack(docs.repartition(3), path).collect()
    ids = collections.Counter((i, encoder(path).plain([t or ""])[0] + b"\1\0\0\0") for i, t, _ in TEXTS)
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for (i, raw), n in ids.items():
        got = sorted((r["start"], bytes(r["ids"])) for r in pieces[i])
        assert b"".join(x for _, x in got[::n]) == raw
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(nothing, path).count() == 0


def test_top_products(spark):
    r = np.random.RandomState(1)
    rows = [(i, (r.randn(8) * (1 + 5 * (i % 7 == 0))).tolist(), "x", 0) for i in range(300)]
    rows += [(300, None, "x", 0), (301, [None] * 8, "x", 0), (302, [float("nan")] * 8, "x", 0), (303, rows[0][1], "x", 0), (304, [0.0] * 8, "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, bucket int")
    from pyspark.sql import functions as F

    ints = {i: np.floor(256 * np.array(v, dtype=float)).astype(int) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in [i for i in ints if i % 10 == 0]:
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for start in (0.0, 0.5, 2.0):
        got = vector_search.top_products(df, F.col("id") % 10 == 0, bucket_rows=40, coordinate_from=start).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert vector_search.top_products(df.limit(0), F.col("id") % 10 == 0).count() == 0


def brute_sets(rows, n):
    out = {}
    for k, (_, t, _) in enumerate(rows):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        out[k] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def test_jaccard_components(spark, docs, nothing, monkeypatch):
    r = random.Random(4)
    rows = list(TEXTS)
    for g in range(6):
        base = words(100 + g, 120).split()
        for m in range(9):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = f"n{r.randint(0, 99)}"
            rows.append((1000 + 10 * g + m, " ".join(copy), "a"))
    df = spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y") for i, t, s in rows], SCHEMA)
    sets = brute_sets(rows, 3)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        low[find(k)].append(i)
    want = sorted((i or -1, len(sets[k]), min((x for x in low[find(k)] if x is not None), default=-1)) for k, (i, _, _) in enumerate(rows))
    for limit, sweep in ((512, jaccard_join.SWEEP), (4, 1)):
        monkeypatch.setattr(jaccard_join, "SWEEP", sweep)
        got = jaccard_join.jaccard_components(df, block_sets=limit).collect()
        assert sorted((x["doc_id"] or -1, x["n_shingles"], x["component_id"] if x["component_id"] is not None else -1) for x in got) == want
    kept = jaccard_join.one_per_component(df)
    assert kept.columns == df.columns and kept.count() == len({find(k) for k in sets if sets[k]} | {k for k in sets if not sets[k]}) \
        - 0
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_repeated_passages(spark, docs, nothing):
    passage = "The " + words(77, 30) + ". Then " + words(78, 30) + "."
    rows = [(1, words(1, 40) + " " + passage + " Tail " + words(2, 30), "a"), (2, "Own " + words(3, 50) + " " + passage, "a"), (3, words(4, 80), "a"),
            (4, None, "a"), (5, "", "a")]
    df = spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y") for i, t, s in rows], SCHEMA)
    spans = sentence_spans.repeated_spans(df)
    got = spans.collect()
    assert [(r["doc_id"], r["first_doc_ids"]) for r in got] == [(2, [1])]
    assert rows[1][1][got[0]["start"]:got[0]["end"]].endswith(passage[4:])
    texts = {r["doc_id"]: r["text"] for r in sentence_spans.remove_spans(df, spans).collect()}
    assert texts[1] == rows[0][1] and texts[3] == rows[2][1] and texts[4] is None and words(77, 30) not in texts[2]
    assert sentence_spans.repeated_spans(nothing).count() == 0


def test_passages_without_whole_sentences(spark):
    r = random.Random(9)
    rows, placed = [], {}
    for k in range(12):
        # 50 to 94 words: no mark at all, one long sentence, or short sentences; set mid-sentence
        passage = words(2000 + k, 50 + 4 * k).split()
        if k % 3 == 1:
            passage[2] += "."
            passage[-3] += "."
        if k % 3 == 2:
            for i in range(6, len(passage), 7):
                passage[i] += "."
        for doc in (100 + k, 200 + k):
            text = words(doc * 7, r.randint(0, 40), 5000) + " "
            placed[doc] = len(text)
            rows.append((doc, text + (" " if doc < 200 else "\n\t").join(passage) + " " + words(doc * 11, r.randint(0, 40), 5000), "a"))
    rows.append((300, "again " * 120, "a"))
    df = spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y") for i, t, s in rows], SCHEMA)
    spans = sentence_spans.repeated_spans(df).collect()
    assert {x["doc_id"] for x in spans} == {200 + k for k in range(12)} | {300}
    texts = {i: t.lower() for i, t, _ in rows}
    for x in spans:
        part = texts[x["doc_id"]][x["start"]:x["end"]]
        if x["doc_id"] < 300:
            assert x["first_doc_ids"] == [x["doc_id"] - 100] and part.split()
            assert " ".join(part.split()) in texts[x["doc_id"] - 100] and x["start"] >= placed[x["doc_id"]]
        else:  # a text that repeats itself keeps its first run
            assert x["start"] >= 20 * 6 - 1


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_base_spans_as_the_patterns():
    r = random.Random(3)
    for alphabet in ("a@.-1 2é", "0123. -+()4567", "ab@c.d-@.@", "1234 -"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 45)))
            want = []
            for k, p in enumerate(PATTERNS):
                for m in re.finditer(p, t):
                    d = re.sub("[^0-9]", "", m.group())
                    check = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
                    if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 13 <= len(d) <= 19 and check
                            or k == 3 and 9 <= len(d) <= 15):
                        want.append((k, m.start(), m.end()))
            assert personal.base_spans(t) == want


def test_skip_chain_labels_other_mentions(spark, docs, nothing):
    rows = [(i, f"{words(i, 8)} call +1 (017) 555-{7000 + i} now {words(i + 1, 5)} year 19{i % 90 + 10}", "a") for i in range(200)]
    rows.append((900, "call +1 (017) 555-7713 today and again 555-7713 tomorrow in 1999", "a"))
    df = spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y") for i, t, s in rows], SCHEMA)
    field = personal.learn(df)
    found = {r["doc_id"]: r for r in personal.find(df, field).collect()}
    text = rows[-1][1]
    assert [text[s["start"]:s["end"]] for s in found[900]["added"]] == ["555-7713"]
    assert all(not found[i]["added"] for i in range(200))
    assert sum(len(r["base"]) for r in personal.find(docs, field).collect()) == 3
    assert personal.find(nothing, personal.learn(nothing)).count() == 0


def labelled_texts(spark, mark):
    rows = [(i, words(i, 30) + (f" {mark} {mark}" if i % 4 == 0 else ""), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i, _, _ in rows[:300]] + [(399, None, None)],
                                   "doc_id long, quality int, toxic int")
    return rows, spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y") for i, t, s in rows + [(None, None, None), (500, "", "a")]], SCHEMA), labels


def test_nearest_toxic(spark, nothing):
    rows, df, labels = labelled_texts(spark, "vile")
    index = toxicity.fit(df, labels)
    scored = toxicity.toxicity(df, index).collect()
    assert all((r["toxicity"]["score"] >= 0.5) == ("vile" in (r["text"] or "")) for r in scored)
    texts = {i: t for i, t, _ in rows}
    vector = {i: index.vector(collections.Counter(toxicity.TERM.findall(texts[i]))) for i in index.ids.tolist()}
    q = vector[int(index.ids[0])]
    brute = sorted(((-round(sum(x * v.get(t, 0) for t, x in q.items()), 9), i) for i, v in vector.items()))[: index.k]
    assert [(-s, i) for s, i, _ in index.nearest(q)] == brute
    assert toxicity.fit(nothing, labels).score("vile")[0] == 0.0
    assert toxicity.toxicity(nothing, index).count() == 0


def test_copies_of_toxic_rows_find_them(spark):
    # toxic words with ever other suffixes: none is in a second toxic row
    rows = [(i, words(i, 30) + (f" vile{i}ness" if i % 8 == 0 else ""), "a") for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y") for i, t, s in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i % 8 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    toxic = [(i, t) for i, t, _ in rows if i % 8 == 0 and zlib.crc32(str(i).encode()) % 5]
    for size in (20_000, 100):
        index = toxicity.fit(df, labels, index_rows=size)
        assert (len(index.ids) < 200) == (size == 100)
        for i, t in toxic:
            score, near = index.score(t)
            assert near[0] == (1.0, i, 1.0) and score != index.base
    copies = spark.createDataFrame([(1000 + i, t) for i, t in toxic], "doc_id long, text string")
    assert all(r["toxicity"]["evidence"][0]["doc_id"] == r["doc_id"] - 1000 for r in toxicity.toxicity(copies, index).collect())


def test_quality(spark, nothing):
    _, df, labels = labelled_texts(spark, "fine")
    model = quality.fit(df, labels)
    got = [(("fine" in (r["text"] or "")), r["p"]) for r in df.select("text", quality.scorer(spark, model)("text").alias("p")).collect()]
    assert all((p >= 0.5) == y for y, p in got) and all(0 <= p <= 1 for _, p in got)
    assert quality.fit(nothing, labels).score(None) == pytest.approx(0.5)


def test_block_join_against_all_pairs():
    rng = np.random.default_rng(1)

    def near(base, share):
        keep = rng.random(len(base)) > share
        return np.unique(np.concatenate((base[keep], rng.integers(0, 2**63, int((~keep).sum())).astype(np.uint64))))

    def merged(labels, links):
        up = list(labels)
        for i, j in links:
            up = [up[j] if u == up[i] else u for u in up]
        return [up.index(u) for u in up]

    for trial in range(30):
        sets = []
        for _ in range(rng.integers(1, 9)):
            base = np.unique(rng.integers(0, 2**64 - 1, rng.integers(1, 200), dtype=np.uint64))
            sets += [near(base, rng.choice([0, 0.02, 0.04, 0.2])) for _ in range(rng.integers(1, 25))]
        n = len(sets)
        labels = [int(x) for x in rng.integers(0, n, n)] if trial % 2 else list(range(n))
        sides = [2] * n if trial % 3 else [int(x) for x in rng.integers(0, 2, n)]
        links = [(i, j) for i in range(n) for j in range(i)
                 if (sides[i] == 2 or sides[i] != sides[j]) and jaccard_join.linked(sets[i], sets[j], 90)]
        found = jaccard_join.join_block(list(range(n)), labels, sides, sets, 90)
        assert all(jaccard_join.linked(sets[i], sets[j], 90) for i, j in found)
        assert merged(labels, found) == merged(labels, links)
        c = max(jaccard_join.size_class(len(s)) for s in sets)
        at = {i: k for k, i in enumerate(i for i in range(n) if jaccard_join.size_class(len(sets[i])) == c)}
        kept = jaccard_join.survivors([labels[i] for i in at], [sides[i] for i in at],
                                      [jaccard_join.full_signature(sets[i]) for i in at], c, 90, jaccard_join.FULL_BITS)
        needed = {at[k] for i, j in links if labels[i] != labels[j] and i in at and j in at for k in (i, j)}
        assert needed <= set(kept)


def test_size_and_place_sweep_against_all_pairs():
    rng = random.Random(7)
    for case in range(300):
        rows = []
        for i in range(rng.randint(0, 12)):
            size = rng.choice([1, 9, 10, 11, 100, 105, rng.randint(1, 130)])
            place = rng.randint(0, jaccard_join.prefix_length(size, 90) - 1)
            rows.append((i, rng.randint(0, 3), size, 190 * (size - place) // 90 - size))
        expected = {x[0] for x in rows for y in rows if x[1] != y[1] and y[2] <= x[3] and x[2] <= y[3]}
        kept = {r[0] for r in jaccard_join.within_reach(rows)}
        assert kept >= expected
        # what is kept beyond has a row of another component that is small enough and reaches far enough
        assert kept == {x[0] for x in rows if any(x[1] != y[1] and y[2] <= x[3] and y[3] >= x[2] for y in rows)}


def test_linked_sets_are_kept_at_their_first_shared_token():
    rng = random.Random(8)
    for case in range(300):
        percent = rng.choice([80, 90])
        base = rng.sample(range(1000), rng.randint(1, 60))
        a, b = ({t for t in base if rng.random() > 0.06} | {rng.randrange(1000) for _ in range(rng.randint(0, 2))} for _ in range(2))
        if not a or not b or 100 * len(a & b) < percent * len(a | b):
            continue
        first = min(a & b)
        rows = [(i, i, len(s), (100 + percent) * (len(s) - sorted(s).index(first)) // percent - len(s)) for i, s in enumerate((a, b))]
        assert len(jaccard_join.within_reach(rows)) == 2
        assert any(most >= size for _, _, size, most in rows)
