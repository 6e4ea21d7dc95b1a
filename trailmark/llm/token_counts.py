"""Token counts under a unigram model, by dynamic programming shared in a trie.

The best segmentation of a pre-token is built left to right: the forward score of
a prefix is the best sum of piece scores that ends there.  It depends on the
prefix alone, so distinct pre-tokens are put into a trie (walked in byte order,
where neighbours share their path) and each prefix is scored once; a word's end
stores its number of tokens and score.  Documents then add up the terminal counts
of their pre-tokens, found with the class arrays of ``byte_bpe``.

Pieces and ranks come from a public vocabulary file; a piece of rank r has the
score -round(1000 ln(r + 1)), Zipf's law in thousandths, so sums are exact.  Of
equally good segmentations the one with fewer tokens counts.

Each worker keeps the counts of up to 120,000 distinct pre-tokens or so.  Defined cases:
null and empty texts count 0; rows are treated one by one, so repeated rows and
null ids change nothing; a pre-token of any length is scored whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_small_batches, slices, tidied
from .byte_bpe import CHUNK_CHARS, Cache, load_ranks, pretokenise


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    return {piece: -round(1000 * math.log(rank + 1)) for piece, rank in ranks.items()}


class Counter:
    """Counts tokens of pre-tokens; a worker keeps one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.scores = piece_scores(ranks)
        self.longest = max(map(len, self.scores))
        self.cache = Cache()

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(tokens, score) at the end of each word; words are in byte order."""
        scores, longest = self.scores, self.longest
        score, count = [0], [0]  # of each prefix on the path from the root
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, fewest = None, 0
                for start in range(max(0, end - longest), end):
                    piece = scores.get(word[start:end])
                    if piece is not None:
                        total, n = score[start] + piece, count[start] + 1
                        if best is None or total > best or (total == best and n < fewest):
                            best, fewest = total, n
                score.append(best)
                count.append(fewest)
            yield count[-1], score[-1]
            before = word

    def lookup(self, words: list[bytes]) -> np.ndarray:
        cache, before = self.cache.turn()
        cache.update((w, before[w]) for w in words if w not in cache and w in before)
        new = sorted(w for w in words if w not in cache)
        cache.update(zip(new, self.walk(new)))
        return np.array([cache[w] for w in words], np.int64).reshape(-1, 2)

    def count(self, texts: list[str]) -> np.ndarray:
        """Pre-tokens, tokens and score of each text."""
        sliced = pretokenise(texts)
        found = self.lookup(sliced.distinct)[sliced.which]
        out = np.zeros((len(texts), 3), np.int64)
        out[:, 0] = np.bincount(sliced.text, minlength=len(texts))
        for k in (0, 1):
            np.add.at(out[:, k + 1], sliced.text, found[:, k])
        return out


@lru_cache(1)
def _counter(path: str, held) -> Counter:
    return Counter(held.value)


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score."""
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))  # of the vocabulary's size
    picked = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema["doc_id"], *T.StructType.fromDDL("n_pretokens long, n_tokens long, score long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks_path, held)
        for batch in batches:
            for part in slices(batch, CHUNK_CHARS):
                found = counter.count(part.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[:, k]) for k in range(3))], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return picked.mapInArrow(tidied(run), schema)
