"""Cutting texts: at blanks that no tokenizer crosses, and into word and shingle hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import xxhash

#: Entries of a task's memory of encoded chunks; it is emptied beyond that, so memory stays bounded.
REMEMBERED = 600_000
#: Chunks that are given to an encoder at a time.
AT_ONCE = 2_000

UNSAFE = re.compile(r" (?=\s|\Z)")
SAFE = re.compile(r"(?= \S)")

MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(text: str) -> list[str]:
    """``text`` cut before every blank that a non-blank follows.

    The byte-level pattern never matches across such a place (a run of white space gives up its last
    blank to what follows), so chunks are tokenized apart with the same result.
    """
    if UNSAFE.search(text):
        return SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]]


def remember(texts: Iterable[list[str]], encode: Callable[[list[str]], list], known: dict) -> None:
    """Add what ``encode`` gives for the chunks of ``texts`` that ``known`` lacks."""
    if len(known) > REMEMBERED:
        known.clear()
    new = list({c for parts in texts for c in parts if c not in known})
    for i in range(0, len(new), AT_ONCE):
        known.update(zip(new[i:i + AT_ONCE], encode(new[i:i + AT_ONCE])))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; empty for null."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words each; fewer words are one shingle, no words none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    made = words[:n].copy()
    for i in range(1, min(size, len(words))):
        made = (made ^ (made >> np.uint64(29))) * MIX + words[i:n + i]
    if len(words) < size:
        made = made * MIX + np.uint64(len(words))
    return np.unique(made)
