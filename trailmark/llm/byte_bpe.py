"""Byte-level BPE encoding and decoding of whole texts.

Texts become arrays of codepoint classes (letter, number, other, kinds of white
space, quotes that begin a contraction); a class looks at most two codepoints
ahead.  The pre-token pattern is an automaton over these classes: each class is a
function from state to state.  These functions and all their compositions form a
small set, so a function is a number and composing two is a table lookup; an
associative scan over the numbers gives the state before every codepoint, and with
it the pre-token boundaries.  No regular expression runs.  (Over any four
codepoints a composition is constant, so the scan ends after two doublings.)

Distinct slices between boundaries are merged once, all short ones of a batch side
by side, and kept in a cache.  Encoding also returns where in the text's bytes each
id ends; decoding lays ids out by these offsets.

The merge ranks are read on the driver from a file of ``base64 rank`` lines and
broadcast; their size is that of the vocabulary and does not grow with the data.

Defined cases: null and empty texts have no tokens; special tokens are ordinary
text; rows are treated one by one, so repeated rows, null ids and other columns
change nothing (``carry`` columns travel along in ``rest``); an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as A
from .batches import in_small_batches, slices, tidied

LETTER, NUMBER, OTHER, SPACE, END, LAST, BLANK, QUOTE1, QUOTE2 = range(9)
"""Classes.  LAST and BLANK: white space before something else, BLANK if it is 0x20; QUOTE1 and QUOTE2: a quote before that many letters of a contraction."""
#: Fixed values of the pattern: white space besides the ASCII kinds, and the contractions' letters.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: Letters and numbers that came with Unicode 16, which the pattern knows (first and last of each run).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
SHORT = 48  # longer pre-tokens are merged with a heap
CACHE = 60_000  # distinct pre-tokens in each generation of a worker's cache
CHUNK_CHARS = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every codepoint."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    for kind, runs in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in runs:
            table[first : last + 1] = kind
    table[list(WHITE)] = SPACE
    return table


class Automaton:
    """The pattern's states after a codepoint, and all functions that runs of classes have on them.

    FREE: whatever comes begins a pre-token.  WORD, DIGITS, SIGNS, WHITES: inside such a
    run.  JOIN: after a blank that belongs to what follows.  ONE, TWO: so many letters of a
    contraction are to come.
    """

    FREE, WORD, DIGITS, SIGNS, WHITES, JOIN, ONE, TWO = STATES = range(8)

    def __init__(self):
        go = np.empty((9, 8), np.int64)  # the state after each class, by the state before
        begins = np.ones((9, 8), bool)  # whether the codepoint begins a pre-token
        for kind, run in ((LETTER, self.WORD), (NUMBER, self.DIGITS), (OTHER, self.SIGNS), (SPACE, self.WHITES)):
            go[kind], begins[kind, run] = run, False
        go[[LAST, END]], go[BLANK] = self.FREE, self.JOIN
        for kind, state in ((QUOTE1, self.ONE), (QUOTE2, self.TWO)):
            go[kind] = state
            go[kind, [self.SIGNS, self.JOIN]], begins[kind, [self.SIGNS, self.JOIN]] = self.SIGNS, False
        begins[[LETTER, NUMBER, OTHER], self.JOIN] = False
        go[LETTER, [self.ONE, self.TWO]], begins[LETTER, [self.ONE, self.TWO]] = (self.FREE, self.ONE), False
        self.begins = begins
        known = {tuple(f): i for i, f in enumerate(dict.fromkeys(map(tuple, [*go.tolist(), *([s] * 8 for s in self.STATES)])))}
        while True:  # close under composition
            new = {tuple(g[x] for x in f) for f in known for g in known} - known.keys()
            if not new:
                break
            known |= {f: len(known) + i for i, f in enumerate(sorted(new))}
        functions = list(known)
        self.of_class = np.array([known[tuple(f)] for f in go.tolist()], np.int32)
        self.constant = np.array([known[(s,) * 8] for s in self.STATES], np.int32)
        self.after = np.array(functions, np.int8)  # by function and state
        self.is_constant = (self.after == self.after[:, :1]).all(axis=1)
        self.n = len(functions)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.int32).ravel()

    def states_before(self, kind: np.ndarray) -> np.ndarray:
        """The state before each place; the text begins in FREE."""
        scan = self.of_class[kind]
        scan[0] = self.constant[self.after[scan[0], self.FREE]]
        reach = 1
        while reach < len(scan) and not self.is_constant[scan].all():
            scan[reach:] = self.then[scan[:-reach] * self.n + scan[reach:]]
            reach *= 2
        out = np.full(len(kind), self.FREE, np.int8)
        out[1:] = self.after[scan[:-1], 0]
        return out


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


def look_ahead(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Classes that depend on what follows: the last white space of a run, quotes of contractions."""
    kind = kind.copy()
    white = np.flatnonzero(kind[:-1] == SPACE)
    last = white[(kind[white + 1] != SPACE) & (kind[white + 1] != END)]
    kind[last] = np.where(cp[last] == 0x20, BLANK, LAST)
    quote = np.flatnonzero(cp[:-1] == 0x27)
    one, two = cp[quote + 1], cp[np.minimum(quote + 2, len(cp) - 1)]
    kind[quote[np.isin(one, [ord(c) for c in ONE_LETTER])]] = QUOTE1
    for a, b in TWO_LETTERS:
        kind[quote[(one == ord(a)) & (two == ord(b))]] = QUOTE2
    return kind


def pretokens(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin.  ``kind`` is END at the places between texts, and at the end."""
    kind = look_ahead(cp, kind)
    return np.flatnonzero(automaton().begins[kind, automaton().states_before(kind)])


class Sliced(NamedTuple):
    """The pre-tokens of some texts: each one's text and place among the distinct ones, and those."""

    text: np.ndarray
    which: np.ndarray
    distinct: list[bytes]


def pretokenise(texts: list[str]) -> Sliced:
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[cp]
    kind[np.cumsum([len(t) + 1 for t in texts]) - 1] = END
    start = pretokens(cp, kind)
    stop = np.append(start[1:], len(cp))
    real = kind[start] != END
    text = np.cumsum(kind == END)[start][real]  # END itself counts to the next
    start, stop = start[real], stop[real]
    first, which = A.distinct_slices(cp, start, stop)
    return Sliced(text, which, [joined[a:b].encode() for a, b in zip(start[first].tolist(), stop[first].tolist())])


class Cache:
    """Two generations of results: what is not asked for while one fills is forgotten."""

    def __init__(self, size: int = CACHE):
        self.size, self.now, self.before = size, {}, {}

    def turn(self) -> tuple[dict, dict]:
        if len(self.now) > self.size:
            self.now, self.before = {}, self.now
        return self.now, self.before


class Encoder:
    """Merges pre-tokens by rank; a worker keeps one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, Cache()
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.length = token_lengths(ranks)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.size) if len(self.keys) else np.full(len(key), self.size)

    def merge_short(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many short pieces, one merge in each of them at a time."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        ids = np.zeros((len(pieces), width), np.int64)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), self.size)
        if width > 1:
            r = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
            rank[:, :-1] = np.where(inside[:, 1:], r, self.size)
        live = np.arange(len(pieces))
        while len(live):
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            live, at, best = (x[best < self.size] for x in (live, at, best))
            if not len(live):
                break
            ids[live, at] = best
            move = np.arange(width)[None, :-1] > at[:, None]  # everything behind the pair moves up by one
            for held in (ids, rank):
                rows = held[live]
                rows[:, :-1] = np.where(move, rows[:, 1:], rows[:, :-1])
                if held is rank:
                    rows[:, -1] = self.size
                held[live] = rows
            sizes[live] -= 1
            last = at + 1 < sizes[live]
            rank[live, at] = self.size
            rank[live[last], at[last]] = self._pair_ranks(ids[live[last], at[last]], ids[live[last], at[last] + 1])
            first = at > 0
            rank[live[first], at[first] - 1] = self._pair_ranks(ids[live[first], at[first] - 1], ids[live[first], at[first]])
        return [tuple(row[:n]) for row, n in zip(ids.tolist(), sizes.tolist())]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one long piece: pairs wait in a heap, neighbours in linked lists."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def rank(i: int) -> int | None:
            return self.pairs.get(ids[i] * self.size + ids[after[i]]) if after[i] >= 0 else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = r, 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
        return tuple(x for x, dead in zip(ids, gone) if not dead)

    def lookup(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of distinct pre-tokens, from the cache where they are in it."""
        cache, before = self.cache.turn()
        short = []
        for piece in pieces:
            if piece not in cache:
                found = before.get(piece)
                if found is None and (whole := self.ranks.get(piece)) is not None:
                    found = (whole,)
                if found is None and len(piece) > SHORT:
                    found = self.merge_long(piece)
                if found is None:
                    short.append(piece)
                else:
                    cache[piece] = found
        short.sort(key=len)
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            cache.update(zip(part, self.merge_short(part)))
        return [cache[piece] for piece in pieces]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, and where in its bytes each of them ends."""
        sliced = pretokenise(texts)
        ids = self.lookup(sliced.distinct)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))
        own = count[sliced.which]
        out = flat[A.each((np.cumsum(count) - count)[sliced.which], own)]
        cut = np.cumsum(np.bincount(sliced.text, weights=own, minlength=len(texts)).astype(np.int64))[:-1]
        return [(x, np.cumsum(self.length[x], dtype=np.uint32)) for x in np.split(out, cut)] if texts else []


def token_lengths(ranks: dict[bytes, int]) -> np.ndarray:
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return length


class Decoder:
    """The bytes of every id, end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        length = token_lengths(ranks)
        self.at = np.cumsum(length) - length
        self.length = length
        body = bytearray(int(length.sum()))
        for token, rank in ranks.items():
            body[self.at[rank] : self.at[rank] + len(token)] = token
        self.body = np.frombuffer(bytes(body), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of ids that end where ``ends`` says."""
        own = np.diff(ends.astype(np.int64), prepend=0)
        if (own != self.length[ids]).any():
            raise ValueError("ids and offsets do not belong together")
        return self.body[A.each(self.at[ids], own)].tobytes()


@lru_cache(1)
def _encoder(key: tuple[int, int], held) -> Encoder:
    return Encoder(held.value)


@lru_cache(1)
def _decoder(key: tuple[int, int], held) -> Decoder:
    return Decoder(held.value)


def _shared(spark, path: str):
    ranks = load_ranks(path)
    return (len(ranks), hash(path)), spark.sparkContext.broadcast(ranks)


def _encoded(texts: list[str], encoder: Encoder, decoder: Decoder | None) -> Iterator[tuple]:
    for ids, ends in encoder.encode(texts):
        yield len(ids), ids.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), *([decoder.decode(ids, ends)] if decoder else [])


def encode(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, decoded: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids and ends (unsigned 32-bit little-endian integers), rest (the carried columns).

    With ``decoded`` also what ``decode`` makes of them, in the same pass.
    """
    key, held = _shared(docs.sparkSession, ranks_path)
    picked = in_small_batches(docs).select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.lit(None).cast("int").alias("rest"),
    )
    made = T.StructType.fromDDL("n_tokens long, ids binary, ends binary" + (", decoded binary" if decoded else ""))
    schema = T.StructType([picked.schema["doc_id"], *made.fields, picked.schema["rest"]])
    types = [pa.int64(), *[pa.binary()] * (len(made) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(key, held), _decoder(key, held) if decoded else None
        for batch in batches:
            for part in slices(batch, CHUNK_CHARS):
                rows = list(_encoded(part.column("text").fill_null("").to_pylist(), encoder, decoder))
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, part.column("rest")], names=schema.names)

    return picked.mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The same rows with ``decoded``, the bytes that their ids stand for, laid out by ``ends``."""
    key, held = _shared(encoded.sparkSession, ranks_path)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(key, held)
        for batch in batches:
            pairs = zip(batch.column("ids"), batch.column("ends"))
            decoded = [decoder.decode(*(np.frombuffer(x.as_py() or b"", "<u4") for x in pair)) for pair in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(tidied(run), schema)
