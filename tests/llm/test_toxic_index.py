"""The toxicity index keeps each posting once, in small arrays, and finds the same neighbours after a round trip."""

import pickle
import random

import numpy as np

from stationlab.llm import toxicity


def test_index_keeps_each_posting_once():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(["often"] * r.randint(1, 3) + r.choices(words, k=r.randint(1, 30))) for _ in range(300)]
    examples = [(i, *toxicity.hashed(toxicity.words_of(t)), i % 4 // 3) for i, t in enumerate(texts)]
    weights = np.random.default_rng(1).uniform(0.1, 3, toxicity.PLACES)
    index = toxicity.Index(weights, examples, 0.25)
    full = int((index.dense > 0).sum())
    assert full >= 300 and len(index.post) == len(index.post_x) == len(index.places) - full
    assert index.post.itemsize == index.tf.itemsize == 2
    other = pickle.loads(pickle.dumps(index))
    for q in texts[:40] + ["often", "w1 unknown", ""]:
        v = index.vector(toxicity.words_of(q))
        near = index.nearest(v)
        assert near == other.nearest(v)
        cosines = []
        for i, a, b in zip(index.ids.tolist(), index.starts[:-1], index.starts[1:]):
            e = dict(zip(index.places[a:b].tolist(), index.x[a:b].tolist()))
            cosines.append((round(sum(x * e.get(p, 0.0) for p, x in v.items()), 9), -i))
        want = sorted((c for c in cosines if c[0] > 0), reverse=True)[:toxicity.NEIGHBOURS]
        assert [(i, c) for c, i, _ in near] == [(-i, c) for c, i in want]


def test_large_counts_and_many_terms_stay_exact():
    many = toxicity.hashed({"a": 70_000, "b": 1})
    index = toxicity.Index(np.ones(toxicity.PLACES), [(1, *many, 1), (2, *toxicity.hashed({"b": 1}), 0)], 0.5)
    assert index.tf.max() == 70_000
    assert [i for _, i, _ in index.nearest(index.vector({"a": 70_000, "b": 1}))] == [1, 2]
