"""Token counts under a unigram model, by dynamic programming on a trie of distinct pre-tokens.

The forward score of a prefix is the best sum of token scores that spells it. Pre-tokens with a common
prefix share the trie nodes, and so the scores, of that prefix; a node that ends a pre-token keeps the
number of tokens of its best spelling. Every task holds a trie of its own texts, of bounded size.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from soundcheck.llm.text import chunks, remember

MAX_NODES = 600_000  # the trie is begun anew beyond that
LONG_WORD = 4096  # bytes; longer pre-tokens share no prefix with others
TEXTS_AT_ONCE = 128
ZIPF_OFFSET = 2.7


class UnigramTrie:
    """Scores come from the ranks of a vocabulary file: log probability -log(rank + ZIPF_OFFSET), up to a constant."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.scores = {base64.b64decode(a): -math.log(int(b) + ZIPF_OFFSET) for a, b in map(bytes.split, lines)}
        # Every end of a token, with its score if it is one itself: a stretch that is none ends the search for longer ones.
        self.tails = {token[i:]: None for token in self.scores for i in range(len(token))} | self.scores
        self.longest = max(map(len, self.scores))
        self.pattern = regex.compile(pattern)
        self.clear()

    def clear(self) -> None:
        # A node is a number; (node, byte) leads to the next one. Of each: best score, tokens of the best spelling (fewest on a tie).
        self.edges, self.best, self.tokens = {}, [0.0], [0]

    @property
    def nodes(self) -> int:
        return len(self.best)

    def count(self, word: bytes) -> int:
        """Tokens of the best spelling of ``word``."""
        if len(word) > LONG_WORD:
            return self.count_long(word)
        if self.nodes > MAX_NODES:
            self.clear()
        edges, best, tokens, tails = self.edges, self.best, self.tokens, self.tails
        node, path = 0, [0]
        for end, byte in enumerate(word, 1):
            at = node << 8 | byte
            node = edges.get(at)
            if node is None:
                top, fewest = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    score = tails.get(word[start:end], 0)
                    if not score:
                        if score is None:
                            continue
                        break  # scores are below 0, so this is no end of any token
                    before = path[start]
                    score += best[before]
                    if score > top or score == top and tokens[before] + 1 < fewest:
                        top, fewest = score, tokens[before] + 1
                node = edges[at] = len(best)
                best.append(top)
                tokens.append(fewest)
            path.append(node)
        return tokens[node]

    def count_long(self, word: bytes) -> int:
        """The same without the trie, which such words would fill: only the last ``longest`` scores are held."""
        held, tails = [(0.0, 0)] * (self.longest + 1), self.tails
        size = len(held)
        for end in range(1, len(word) + 1):
            best, tokens = -math.inf, 0
            for start in range(end - 1, max(-1, end - size), -1):
                score = tails.get(word[start:end], 0)
                if score is None:
                    continue
                if not score:
                    break
                so_far, n = held[start % size]
                if so_far + score > best or so_far + score == best and n + 1 < tokens:
                    best, tokens = so_far + score, n + 1
            held[end % size] = best, tokens
        return held[len(word) % size][1]

    def count_text(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        pieces = self.pattern.findall(text)
        return len(pieces), sum(self.count(p.encode()) for p in pieces)


def counter(path: str, pattern: str):
    @F.arrow_udf("struct<n_pretokens: bigint, n_tokens: bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, known = UnigramTrie(path, pattern), {}
        for texts in batches:
            pretokens, tokens = [], []
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                cut = [chunks(t or "") for t in texts[i:i + TEXTS_AT_ONCE].to_pylist()]
                remember(cut, lambda parts: [trie.count_text(p) for p in parts], known)
                for parts in cut:
                    found = [known[p] for p in parts]
                    pretokens.append(sum(f[0] for f in found))
                    tokens.append(sum(f[1] for f in found))
            yield pa.StructArray.from_arrays([pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())],
                                             ["n_pretokens", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of the columns in ``keep``, by default all, so names never clash), n_pretokens, n_tokens.

    Null and empty texts have none of either. Among spellings with equal scores the one with fewer
    tokens counts. Texts of any length are counted whole; an empty table gives no rows.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
                       counter(path, pattern)(F.col(text_col)).alias("n")).select("row", "n.*")
