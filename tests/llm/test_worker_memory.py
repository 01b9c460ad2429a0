"""What Python workers hold: one operator's caches, the postings of one index; and the fast paths give the plain ones' results."""

import random

import numpy as np

from stationlab.llm import common, token_files, toxicity
from stationlab.llm.packing import vocabulary_path
from stationlab.llm.tokens import _ENCODERS, Encoder, encoder

ODD = list("abXY_09 .,\n\t\x1c\x85 é ßÖİ—“日²٣́\ud800ſK")


def test_a_worker_holds_one_operators_caches():
    list(encoder(vocabulary_path(token_files.VOCABULARY)).encode(["some words"], 0))
    assert _ENCODERS
    common.sole("toxicity", toxicity.forget)
    assert not _ENCODERS
    index = toxicity.Index(np.ones(toxicity.PLACES), [(1, *toxicity.terms_of("some words"), 1)], 0.5)
    index.nearest(index.vector({"some": 1}))
    encoder(vocabulary_path(token_files.VOCABULARY))
    assert not toxicity._PLACES and "post" not in index.__dict__


def test_a_process_holds_the_postings_of_one_index():
    def index(word):
        return toxicity.Index(np.ones(toxicity.PLACES), [(1, *toxicity.terms_of(word), 1), (2, *toxicity.terms_of("both"), 0)], 0.5)

    one, two = index("one both"), index("two both")
    first = one.nearest(one.vector({"one": 1}))
    assert "post" in one.__dict__ and "x" not in one.__dict__
    assert [i for _, i, _ in two.nearest(two.vector({"two": 1}))] == [1]
    assert "post" in two.__dict__ and "post" not in one.__dict__ and "dense" not in one.__dict__
    assert one.nearest(one.vector({"one": 1})) == first


def test_terms_are_the_words():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choices(ODD, k=r.randint(0, 40)))
        places, tf = toxicity.hashed(toxicity.words_of(text))
        got = toxicity.terms_of(text)
        assert (got[0].tolist(), got[1].tolist()) == (places.tolist(), tf.tolist()), text
    assert [len(z) for z in toxicity.terms_of(None)] == [0, 0]


def test_cached_ids_are_the_librarys():
    r = random.Random(3)
    chars = [c for c in ODD if c != "\ud800"] + list("ab '<>/w!")
    texts = ["".join(r.choices(chars, k=r.randint(0, 60))) for _ in range(800)] + ["x</w> Ġa Ġ don't, stop. Größe (so) it."]
    for name in (token_files.VOCABULARY, "word_bpe_49k.json"):
        e = Encoder(vocabulary_path(name))
        for lo in range(0, len(texts), 200):
            some = texts[lo: lo + 200]
            for text, got in zip(some, e.encode(some, 7)):
                want = e.tokenizer.encode(text, add_special_tokens=False).ids
                assert got.tolist() == [*want, 7], text
