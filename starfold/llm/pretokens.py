"""Cut whole chunks of text into pre-tokens with numpy, and keep what is known of each distinct one.

The rule is the pattern of the byte-level vocabularies, ``public_tokenizers.PATTERN``: contractions, runs of
letters, numbers or other characters with one space before them, and white space.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd

from starfold.llm.arrow import gather
from starfold.llm.hashing import RangeHash, mix

LETTER, NUMBER, OTHER, SPACE, END = range(5)
# The characters with Unicode's White_Space property.
_WHITE_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_MEMO_LIMIT = 500_000


def character_classes(joins: Callable[[str, list[str]], list[bool]] | None = None) -> np.ndarray:
    """The class of every code point, by the regex library's tables.

    Libraries differ in the Unicode version that they know. ``joins(before, characters)`` says of each character
    whether a library's pattern keeps it together with the letter or digit ``before``; what it does not is no letter
    or number there.
    """
    import regex

    points = np.array([c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF])
    every = "".join(map(chr, points))
    found = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern, before in ((LETTER, r"\p{L}", "a"), (NUMBER, r"\p{N}", "1")):
        of_kind = regex.findall(pattern, every)
        known = joins(before, of_kind) if joins else [True] * len(of_kind)
        found[[ord(c) for c, ok in zip(of_kind, known) if ok]] = kind
    for low, high in _WHITE_SPACE:
        found[low:high + 1] = SPACE
    return found


def tiktoken_joins(pattern: str) -> Callable[[str, list[str]], list[bool]]:
    """``joins`` for tiktoken: with a vocabulary that merges a letter or digit with any byte after it."""
    import tiktoken

    tokens = [bytes([b]) for b in range(256)] + [a + bytes([b]) for a in (b"a", b"1") for b in range(128, 256)]
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)},
                              special_tokens={})
    return lambda before, characters: [
        ord(c) < 128 or len(probe.encode_ordinary(before + c)) == len(c.encode()) for c in characters]


def tokenizers_joins(definition: str) -> Callable[[str, list[str]], list[bool]]:
    """``joins`` for a definition of the tokenizers library."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
    return lambda before, characters: [len(split(before + c)) == 1 for c in characters]


@dataclass
class PreTokens:
    joined: str  # all texts, one separator after each
    points: np.ndarray  # its code points
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # number of the first pre-token of each text, and the number of all
    hashes: np.ndarray


class Splitter:
    """Cuts texts at the borders that the pattern's matches have. ``classes`` comes from ``character_classes``."""

    def __init__(self, classes: np.ndarray) -> None:
        self.classes, self.range_hash = classes, RangeHash()

    def __call__(self, texts: Sequence[str]) -> PreTokens:
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds = self.classes[points]
        kinds[text_ends] = END
        n = len(points)
        run = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        run_end, kind = np.append(run[1:], n), kinds[run]
        border = np.zeros(n + 1, bool)
        border[text_ends] = True
        border[run[kind == SPACE]] = True
        # The last of several white characters stands alone, unless it is a space, which joins what follows.
        last = run_end[:-1][(kind[:-1] == SPACE) & (kind[1:] != END)] - 1
        border[last[points[last] != 32]] = True
        word = np.flatnonzero(kind < SPACE)
        led = (run[word] > 0) & (points[run[word] - 1] == 32) & (kinds[run[word] - 1] == SPACE)
        border[run[word] - led] = True
        self._contractions(points, run, run_end, kind, border, word[~led])
        edges = np.flatnonzero(border)
        edges = np.append(edges, n) if edges[-1] != n else edges
        keep = kinds[edges[:-1]] != END
        starts, ends = edges[:-1][keep], edges[1:][keep]
        first = np.searchsorted(starts, np.concatenate([[0], text_ends + 1]))
        hashes = self.range_hash(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)
        return PreTokens(joined, points, starts, ends, first, hashes)

    @staticmethod
    def _contractions(points, run, run_end, kind, border, bare) -> None:
        """An apostrophe that starts a match takes s, t, m, d, re, ve or ll with it."""
        single = bare[(kind[bare] == OTHER) & (run_end[bare] - run[bare] == 1) & (points[run[bare]] == ord("'"))]
        single = single[single + 1 < len(run)]
        single = single[kind[single + 1] == LETTER]
        at, stop = run[single], run_end[single + 1]
        one = points[at + 1]
        two = np.where(at + 2 < stop, points[np.minimum(at + 2, len(points) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        taken = np.where(short, 1, np.where(long, 2, 0))
        at, stop, taken = at[taken > 0], stop[taken > 0], taken[taken > 0]
        border[at + 1] = False
        rest = at + 1 + taken
        border[rest[rest < stop]] = True


class Memo:
    """The symbols of each distinct pre-token, found once by ``encode`` for as many texts as a worker reads.

    Pre-tokens are looked up by hash, and each is then compared with the text that the hash stands for; those that only
    share it are kept by their text. It is emptied when it holds ``limit`` entries, so its memory is bounded; nothing
    depends on what it holds.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], limit: int = _MEMO_LIMIT) -> None:
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot_of = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in order, and their slots
        self.flat, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.texts, self.text_starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.by_text: dict[str, int] = {}

    def _add(self, found: PreTokens, place: np.ndarray) -> np.ndarray:
        """New slots for the pre-tokens at ``place``."""
        joined, starts, ends = found.joined, found.starts[place], found.ends[place]
        lists = self.encode([joined[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
        counts, sizes = np.fromiter(map(len, lists), np.int64, len(lists)), ends - starts
        slots = len(self.counts) + np.arange(len(place))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))])
        self.text_starts = np.concatenate([self.text_starts, len(self.texts) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.texts = np.concatenate([self.texts, found.points[gather(starts, sizes)]])
        return slots

    def look_up(self, found: PreTokens) -> np.ndarray:
        """The slot of each pre-token."""
        if len(self.known) > self.limit:
            self._clear()
        codes, distinct = pd.factorize(found.hashes)
        if not len(codes):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.known, distinct)
        here = np.flatnonzero(at < len(self.known))
        fresh = np.ones(len(distinct), bool)
        fresh[here] = self.known[at[here]] != distinct[here]
        new = np.flatnonzero(fresh)
        if len(new):
            where = np.empty(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            slots = self._add(found, where[new])
            self.known = np.concatenate([self.known, distinct[new]])
            self.slot_of = np.concatenate([self.slot_of, slots])
            order = np.argsort(self.known, kind="stable")
            self.known, self.slot_of = self.known[order], self.slot_of[order]
            at = np.searchsorted(self.known, distinct)
        slots = self.slot_of[at][codes]
        for i in self._unlike(found, slots).tolist():
            text = found.joined[found.starts[i]:found.ends[i]]
            if text not in self.by_text:
                self.by_text[text] = int(self._add(found, np.array([i]))[0])
            slots[i] = self.by_text[text]
        return slots

    def _unlike(self, found: PreTokens, slots: np.ndarray) -> np.ndarray:
        """Pre-tokens whose text is not that of their slot."""
        sizes = found.ends - found.starts
        like = sizes == self.sizes[slots]
        some = np.flatnonzero(like)
        sizes = sizes[some]
        other = found.points[gather(found.starts[some], sizes)] != self.texts[gather(self.text_starts[slots[some]], sizes)]
        like[some[np.repeat(np.arange(len(some)), sizes)[other]]] = False
        return np.flatnonzero(~like)

    def symbols(self, slots: np.ndarray) -> np.ndarray:
        return self.flat[gather(self.starts[slots], self.counts[slots])]
