"""Whole-text token ids of the ``tokenizers`` library, with a bounded cache of part ids per worker.

Both vocabularies used here cut a text before every blank that stands between two characters that
are no white space, and encode the parts alone: joining the parts' ids gives the text's ids.  Parts
repeat, so each worker keeps the ids of the parts it has met (as bytes); unknown parts go through
the library together.  A text in which some blank has white space beside it is cut only at its
other blanks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

from .common import sole

CACHE_PARTS = 1_500_000
JOINED = 128
# a blank with a character on each side that no definition of white space contains
CUT = re.compile(r"(?<=\S) (?=\S)")
# runs of plain letters, runs of marks (no apostrophe) and single line ends are always encoded apart
PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+|\n")
# marks that often end a part
POINTS = frozenset(".,;:!?")
# how byte-level vocabularies write a blank
BLANK = "\u0120"
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This worker's encoder of the vocabulary file."""
    sole("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # whether a head's tokens are told by the mark in their first one or by the ending of their last one
        ending = self.tokenizer.model.end_of_word_suffix
        self.after = 1 if ending else 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith(ending) if ending else t.startswith(BLANK))]] = True
        self.cache: dict[str, bytes] = {}  # part without its leading blank -> ids with it
        self.uncut: set[str] = set()  # parts that no text may be cut around
        self.bare: dict[str, bytes] = {}  # piece of a part -> ids without a blank

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str | None], end: int) -> list[np.ndarray]:
        """Ids (uint32) of each text followed by ``end``; null counts as empty."""
        if len(self.cache) >= CACHE_PARTS:
            self.cache.clear()
            self.bare.clear()
            self.uncut.clear()
        texts = [t or "" for t in texts]
        cuts = [t.split(" ") for t in texts]
        odd = [c[0] == "" or c[0][0].isspace() or c[0][-1].isspace() for c in cuts]
        firsts = self.plain([c.pop(0) for c in cuts])
        known = [[*map(self.cache.get, cut)] for cut in cuts]
        missing = [[i for i, ids in enumerate(found) if ids is None] for found in known]
        self._learn({cut[i] for cut, at in zip(cuts, missing) for i in at})
        tail, out = np.array([end], dtype="<u4").tobytes(), []
        for text, cut, first, at_edge, found, at in zip(texts, cuts, firsts, odd, known, missing):
            for i in at:
                found[i] = self.cache[cut[i]]
            if at_edge or (self.uncut and not self.uncut.isdisjoint(cut)):
                whole = CUT.split(text)
                first, found = b"", self.plain([whole[0], *[" " + p for p in whole[1:]]])
            out.append(np.frombuffer(b"".join([first, *found, tail]), dtype="<u4"))
        return out

    def _learn(self, new: set[str]) -> None:
        cache, bare, pieces, heads, later, other = self.cache, self.bare, {}, set(), set(), []
        for part in new:
            if part.isascii():
                if part.isalpha():
                    heads.add(part)
                    continue
                if part[-1:] in POINTS and part[:-1].isalpha():
                    heads.add(part[:-1])
                    later.add(part[-1])
                    pieces[part] = (part[:-1], part[-1])
                    continue
            if not part or part[0].isspace() or part[-1].isspace():
                cache[part] = b""
                self.uncut.add(part)
                continue
            found = PIECE.findall(part)
            if "\n\n" in part or "".join(found) != part:
                other.append(part)
                continue
            heads.add(found[0])
            if len(found) > 1:
                later.update(found[1:])
                pieces[part] = found
        cache.update(zip(other, self.plain([" " + p for p in other])))
        later = [p for p in later if p not in bare]
        bare.update(zip(later, self.plain(later)))
        heads = [h for h in heads if h not in cache]
        groups = [heads[i: i + JOINED] for i in range(0, len(heads), JOINED)]
        joined = self.tokenizer.encode_batch_fast(["".join([" " + h for h in g]) for g in groups], add_special_tokens=False)
        for group, got in zip(groups, joined):
            ids = np.array(got.ids, dtype="<u4")
            at = ((np.flatnonzero(self.edge[ids]) + self.after) * 4).tolist()
            at, ids = [*at, 4 * len(ids)] if not self.after else [0, *at], ids.tobytes()
            if len(at) == len(group) + 1 and at[0] == 0 and at[-1] == len(ids):
                cache.update(zip(group, [ids[a:b] for a, b in zip(at, at[1:])]))
            else:
                cache.update(zip(group, self.plain([" " + h for h in group])))
        for part, found in pieces.items():
            cache[part] = cache[found[0]] + (bare[found[1]] if len(found) == 2 else b"".join([bare[p] for p in found[1:]]))
