"""Word shingles of whole texts as 64-bit numbers, a batch of texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: A-Z become a-z; the six white-space bytes become a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x20 or 9 <= b <= 13 else b for b in range(256))
#: Bytes of text in hand at once: the numbers of so many stay in a core's cache.
CHUNK = 1 << 18
MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = mix((np.arange(1, 257, dtype=np.uint64)) * MUL)
    values[0x20] = 0
    return values


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, MUL | np.uint64(1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a folded text: a polynomial of its bytes, mixed."""
    raw = np.frombuffer(text, np.uint8)
    inside = raw != 0x20
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    powers = _powers(1 << max(6, int(place.max()).bit_length()))
    values = _byte_values()[raw[starts[0] :]] * powers[place]
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _long_text(text: bytes) -> np.ndarray:
    """Word hashes of one text that may be longer than memory should hold at eight bytes a byte."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and text[end] != 0x20:
            end += 1
        parts.append(word_hashes(text[at:end])[1])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def text_words(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    folded = [(t or b"").translate(FOLD) for t in texts]
    for _, some in _chunks(folded):
        if len(some) == 1:
            yield _long_text(some[0])
            continue
        starts, hashes = word_hashes(b" ".join(some))
        begins = np.cumsum([0] + [len(t) + 1 for t in some])
        yield from np.split(hashes, np.searchsorted(starts, begins[1:-1]))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of `size` words as signed numbers, ascending; a shorter text is one shingle of its own kind; none without words."""
    if not len(words):
        return words.view(np.int64)
    most = min(size, len(words))
    out = np.full(len(words) - most + 1, most, dtype=np.uint64)
    for k in range(most):
        out = mix(out * MUL + words[k : len(words) - most + 1 + k])
    return np.unique(out.view(np.int64))
