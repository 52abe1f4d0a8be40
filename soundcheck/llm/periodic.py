"""Periodic runs of words: found by splitting texts at words that are too rare, and collapsed.

A run of period q is a stretch of words in which words q apart are equal. One of at least ``repeats``
periods holds each of its words that often, so a word that is rarer than that within its segment lies in
no run of the segment and splits it. The pieces are counted anew, until no piece has such a word. Only
the largest piece keeps its parent's counts, less those of the others, so a word is counted anew at most
log2(n) times. What survives is scanned for lags.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_WORDS = 6
REPEATS = 4
TEXTS_AT_ONCE = 256
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SHORT = 64  # segments up to this many words are scanned lag by lag


def segments(words: list[bytes], min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """[start, end) of the pieces that are left when no piece has a word that is too rare for a run of that piece."""
    stable, todo, places = [], [(0, len(words), None, None)], {}
    while todo:
        start, end, counts, changed = todo.pop()
        if end - start < min_words:
            continue
        if counts is None:
            changed = counts = Counter(words[start:end])
        rare = {w for w in changed if 0 < counts[w] < repeats}
        if not rare:
            stable.append((start, end))
            continue
        if changed is not counts:  # a large piece that has lost a little: only its rare words are looked up
            if not places:
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
            cuts = sorted(i for w in rare for i in places[w][bisect_left(places[w], start):bisect_left(places[w], end)])
        else:
            cuts = [i for i in range(start, end) if words[i] in rare]
        pieces = [(a + 1, b) for a, b in zip([start - 1, *cuts], [*cuts, end]) if b > a + 1]
        largest = max(pieces, key=lambda p: p[1] - p[0], default=(start, start))
        lost = Counter()
        if 2 * (largest[1] - largest[0]) > end - start:  # cheaper to take away what it has lost
            lost = Counter(words[start:largest[0]])
            lost.update(words[largest[1]:end])
            for w, n in lost.items():
                counts[w] -= n
        todo.extend((*p, counts, lost) if lost and p == largest else (*p, None, None) for p in pieces)
    return sorted(stable)


def scan_each_lag(ids: np.ndarray, min_words: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs, from one comparison with itself for every lag."""
    found = set()
    for q in range(1, len(ids) // repeats + 1):
        for start, matches in stretches(ids[q:] == ids[:-q]):
            run = (start, matches + q)
            if run[1] >= max(min_words, repeats * q) and run not in found:  # else a smaller lag has made the same stretch
                found.add(run)
                yield *run, q


def scan_windows(ids: np.ndarray, min_words: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """The same runs from about n log n steps, for long segments.

    For lags q in (w / 2, w], windows of w words are named, equal ones alike. A window inside a run of at
    least three periods comes again first after exactly q words: if it came sooner, the run would have a
    smaller period. So consecutive windows with that lag to their next equal are a run, all of it.
    """
    n, w, names = len(ids), 1, ids
    while w // 2 < n // repeats:
        order = np.argsort(names, kind="stable")
        again = names[order][1:] == names[order][:-1]
        lag = np.zeros(len(names), np.int64)
        lag[order[:-1][again]] = (order[1:] - order[:-1])[again]
        lag[(lag <= w // 2) | (lag > w)] = 0
        edges = np.flatnonzero(np.diff(lag, prepend=0, append=0))
        for start, end in zip(edges, edges[1:]):
            q = int(lag[start])
            length = int(end - start) - 1 + w + q
            if q and length >= max(min_words, repeats * q):
                yield int(start), length, q
        if len(names) <= w:
            return
        _, names = np.unique(names[:-w] * (n + 1) + names[w:], return_inverse=True)  # names of windows twice as long
        w *= 2


def stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs, by start, then period."""
    runs = []
    for start, end in segments(words, min_words, repeats):
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words[start:end]], np.int64)
        scan = scan_each_lag if end - start <= SHORT else scan_windows
        runs.extend((start + s, length, q) for s, length, q in scan(ids, min_words, repeats))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        dropped[start + q] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped)) if not d]


def collapse_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_words: int = MIN_WORDS,
                  repeats: int = REPEATS, key_col: str | None = None,
                  prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of the columns in ``keep``, by default all, so names never clash), n_words, runs, collapsed.

    ``runs`` has every run of the whole text that is at least ``min_words`` and ``repeats`` (four or
    more) periods long, with its smallest period, by start, then period. ``collapsed`` is the words that
    no run holds after its first period, joined by single blanks. Words are [^\\x20\\x09-\\x0D]+. A null
    text, like an empty one, has no words, no runs and an empty ``collapsed``. Texts of any length are
    searched whole. Repeated rows are each answered; an empty table gives no rows. ``prepare`` may change
    the words of a text first, given the value of ``key_col`` (which may be null).
    """
    if repeats < REPEATS:  # the proof of scan_windows needs three periods and a window
        raise ValueError(f"repeats must be at least {REPEATS}")
    names = ["n_words", "runs", "collapsed"]

    @F.arrow_udf(f"struct<n_words: bigint, runs: {RUNS}, collapsed: string>")
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for texts, keys in batches:
            counts, found, collapsed = [], [], []
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                part = zip(texts[i:i + TEXTS_AT_ONCE].to_pylist(), keys[i:i + TEXTS_AT_ONCE].to_pylist())
                for text, key in part:
                    words = (text or "").encode().split()
                    if prepare:
                        words = prepare(key, words)
                    runs = find_runs(words, min_words, repeats)
                    counts.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    collapsed.append(b" ".join(kept_words(words, runs)).decode())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.string())], names)

    key = F.col(f"`{key_col}`") if key_col else F.lit(None).cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
                       each(F.col(f"`{text_col}`"), key).alias("found")).select("row", "found.*")
