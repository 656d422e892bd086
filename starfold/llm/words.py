"""Words of whole chunks of text as 64-bit hashes, with numpy.

A word is a run of ASCII letters and digits and of characters beyond ASCII, in lower case. So case, punctuation
and spacing make no difference.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starfold.llm.hashing import RangeHash, mix

_BYTES = np.arange(256)
_IN_WORD = ((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90))
            | ((_BYTES >= 97) & (_BYTES <= 122)))
_VALUE = mix(_BYTES.astype(np.uint64) + np.uint64(1))


@dataclass
class Words:
    hashes: np.ndarray
    first: np.ndarray  # number of each text's first word, and the number of all
    starts: np.ndarray  # bytes from the start of all texts
    ends: np.ndarray
    text_starts: np.ndarray
    raw: np.ndarray  # the bytes of all texts, in lower case

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts, and their end. Null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    places = np.frombuffer(places, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[places[0]:places[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, places - places[0]


def word_places(raw: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word goes past the end of its text."""
    inside = _IN_WORD[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[text_starts] = True
    before = np.concatenate([[False], inside[:-1]]) & ~border[:-1] if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) & ~border[1:] if len(raw) else inside
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class WordSplitter:
    def __init__(self) -> None:
        self.range_hash = RangeHash()

    @staticmethod
    def values(raw: np.ndarray) -> np.ndarray:
        """What the bytes count as in a range hash."""
        return _VALUE[raw]

    def __call__(self, texts: pa.Array) -> Words:
        raw, text_starts = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
        starts, ends = word_places(raw, text_starts)
        hashes = self.range_hash(_VALUE[raw], starts, ends)
        return Words(hashes, np.searchsorted(starts, text_starts), starts, ends, text_starts, raw)


def places_in(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of one text as it is, and the start and end of each of its words in them."""
    raw = text.encode()
    starts, ends = word_places(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))
    return raw, starts, ends


def shingles(words: Words, k: int, range_hash: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``k`` words; a text of fewer words is one run."""
    sizes = np.diff(words.first)
    runs = np.where(sizes == 0, 0, np.maximum(sizes - k + 1, 1))
    owner = np.repeat(np.arange(len(sizes)), runs)
    before = np.cumsum(runs) - runs
    starts = words.first[:-1][owner] + np.arange(len(owner)) - before[owner]
    ends = np.minimum(starts + k, words.first[1:][owner])
    return range_hash(words.hashes, starts, ends), owner
