"""The skip-chain field: other mentions of a number however split, exact marginals, hidden training mentions."""

import itertools
import random

import numpy as np
import pytest

from stationlab.llm import personal

SCHEMA = "doc_id long, text string"
PHONE = "+1 (017) 555-7714"


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(5)
    rows = [(i, f"{filler(rng, 8)} call +1 (0{i % 80 + 10}) 555-{1000 + i} now {filler(rng, 5)} in 19{i % 90 + 10}, item {rng.randint(1000000, 9999999)} "
                f"and {rng.randint(10, 999)} {rng.randint(10, 999)} pages, lot {rng.randint(100, 999)}-{rng.randint(1000, 9999)}") for i in range(300)]
    return personal.learn(spark.createDataFrame(rows, SCHEMA))


def added(spark, field, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r for r in personal.find(df, field).collect()}
    return [[(s["kind"], t[s["start"]:s["end"]]) for s in got[i]["added"]] for i, t in enumerate(texts)]


def test_mentions_however_often_and_split(spark, field):
    rng = random.Random(1)
    forms = ["555-7714", "0175557714", "017-555-7714", "555 7714", "017 555 7714", "(017) 5557714", "10175557714", "017.555.7714"]
    texts = [f"{filler(rng, 6)} {PHONE} {filler(rng, 9)} {form} {filler(rng, 4)}" for form in forms]
    for got, form in zip(added(spark, field, texts), forms):
        assert got == [("phone", form)]
    counts = [1, 2, 3, 5, 12, 40, 300]
    texts = [f"{filler(rng, 6)} {PHONE} " + " ".join(f"{filler(rng, 3)} 555-7714" for _ in range(n)) + " end" for n in counts]
    for got, n in zip(added(spark, field, texts), counts):
        assert got == [("phone", "555-7714")] * n


def test_other_numbers_stay(spark, field):
    rng = random.Random(2)
    texts = [f"{filler(rng, 6)} {PHONE} in 1999 {filler(rng, 3)} 555-7715 and 4445557 {filler(rng, 2)} 12 345 6789 {filler(rng, 3)} item 1234567",
             "1234567 and 1234567 again 1234567", f"{PHONE} 1999 twice {PHONE} 1999", "no number", "", "555-7714 alone"]
    assert added(spark, field, texts) == [[]] * len(texts)


def test_many_documents_do_not_share(spark, field):
    rng = random.Random(3)
    texts = [f"{filler(rng, 4)} {PHONE}", f"{filler(rng, 4)} 0175557714"] * 20
    assert added(spark, field, texts) == [[]] * 40


def test_planted_precision_and_recall(spark, field):
    rng = random.Random(4)
    texts, want = [], []
    for i in range(150):
        area, a, b = f"{rng.randint(100, 999)}", f"{rng.randint(100, 999)}", f"{rng.randint(1000, 9999)}"
        forms = [f"{a}-{b}", f"{area}{a}{b}", f"{area}-{a}-{b}", f"{area} {a} {b}", f"({area}) {a}-{b}"]
        planted = [rng.choice(forms) for _ in range(rng.randint(1, 6))]
        noise = [f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}" for _ in range(4)]
        parts = planted + noise
        rng.shuffle(parts)
        texts.append(f"{filler(rng, 3)} +1 ({area}) {a}-{b} " + " ".join(f"{filler(rng, 2)} {p}" for p in parts) + " end")
        want.append([p for p in parts if p in planted])
    got = added(spark, field, texts)
    right = sum(sum(1 for _, s in g if s in w) for g, w in zip(got, want))
    assert right >= 0.9 * sum(map(len, want))
    assert right >= 0.9 * sum(map(len, got))


def brute(field, features, label, chain, skip, hubs):
    k, n = field.chain.shape[0], len(label)
    node = np.concatenate((field.scores(features, label), np.zeros((hubs, k))))
    total = np.zeros((n + hubs, k))
    for x in itertools.product(range(k), repeat=n + hubs):
        s = sum(node[i, v] for i, v in enumerate(x)) + sum(field.chain[x[a], x[b]] for a, b in chain) + sum(field.skip[x[a], x[b]] for a, b in skip)
        for i, v in enumerate(x):
            total[i, v] += np.exp(s)
    return (total / total.sum(axis=1, keepdims=True))[:n]


def test_marginals_are_exact_on_trees():
    r = np.random.default_rng(7)
    for agree in (1.0, 3.0):
        field = personal.Field(agree)
        field.unary = r.normal(size=field.unary.shape) * 0.3
        field.chain = r.normal(size=field.chain.shape)
        features = r.integers(0, 1 << personal.BITS, (4, 10))
        label = np.array([4, 0, 0, 0])
        chain, skip = np.array([[1, 2]]), np.array([[4, 0], [4, 1], [5, 3], [4, 5]])
        got = field.marginals(features, label, chain, skip, 2)
        assert np.allclose(got, brute(field, features, label, chain, skip, 2), atol=1e-4)


def test_hubs_grow_with_the_words():
    text = f"{PHONE} " + " ".join(["x 555-7714 y 0175557714"] * 2000)
    g = personal.Graph(text)
    assert g.hubs == 3 and len(g.links) == 4003 and len(g.parents) == 2
    assert len(g.hidden) == 4000
