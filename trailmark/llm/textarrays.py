"""Numpy views of Arrow string columns, and rolling hashes over them.

These helpers run inside Spark tasks, on one block of documents at a time.

Two kinds of hash are used.  Polynomial ones (Rabin-Karp, modulo 2**64) come from
prefix sums, so the hash of any slice costs one subtraction and one multiplication;
as strings can be built that collide under every base, they only choose what is
compared, and bytes decide.  Chained ones mix in one symbol after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
WORD_BASE = 0xD6E8FEB86659FD93
CHUNK_BYTES = 1_000_000
LONG_WORD = 256
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # the first k bytes of eight

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        held = _powers[base] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i; slice_hash() reads slices from them."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(base, len(sums))[1][start]


def window_hash(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U64)
    return mix((sums[width:] - sums[:n]) * powers(base, len(sums))[1][:n])


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``size`` bytes: (first document, bytes, offsets)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run without white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = IS_SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = space[:-1] | first[1:]
    starts = np.flatnonzero(~space & edge)
    edge[-1] = True
    edge[:-1] = space[1:] | first[1:]
    ends = np.flatnonzero(~space & edge) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A chained hash of each slice, eight bytes a step; slices above LONG_WORD bytes by blake2b."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    start, size = starts[order], size[order]
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    n_long = int(np.searchsorted(-size, -LONG_WORD))
    held = size.astype(U64) * U64(BYTE_BASE)
    for step in range(-(-int(size[n_long]) // 8) if n_long < len(size) else 0):
        to = int(np.searchsorted(-size, -8 * step))
        part = slice(n_long, to)
        word = eight[start[part] + 8 * step] & TAIL[np.minimum(size[part] - 8 * step, 8)]
        held[part] = mix(held[part] ^ word)
    for i in range(n_long):
        digest = blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest()
        held[i] = int.from_bytes(digest, "little")
    out = np.empty(len(size), U64)
    out[order] = held
    return out


def chained(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values, one value mixed in after the other."""
    n = max(0, len(values) - width + 1)
    out = np.full(n, seed, U64)
    for k in range(width if n else 0):
        out ^= values[k : k + n]
        out *= U64(BYTE_BASE)
        out ^= out >> U64(29)
    return mix(out)


def in_order(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by (hash, check), ties as they come, and where a new pair begins."""
    order = np.argsort(hashes, kind="stable")
    for _ in range(2):
        h, c = hashes[order], checks[order]
        new = np.ones(len(order), bool)
        same = h[1:] == h[:-1]
        new[1:] = ~same | (c[1:] != c[:-1])
        if not (same & new[1:]).any():
            break
        order = np.lexsort((checks, hashes))  # one hash with several checks
    return order, new


def each(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges [first, first + size)."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def distinct_slices(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct slice, and each slice's place in that list.

    Slices are sorted by a polynomial hash and then compared with the first of their
    hash; those that differ are told apart by their bytes.
    """
    size = stop - start
    sums = prefix(values.astype(U64) + U64(1), BYTE_BASE)
    hashes = mix(slice_hash(sums, start, stop, BYTE_BASE) + size.astype(U64))
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    head = first[inverse]
    like = np.where(size == size[head], size, 0)
    differs = np.concatenate(([0], np.cumsum(values[each(start, like)] != values[each(start[head], like)])))
    end = np.cumsum(like)
    other = np.flatnonzero((like != size) | (differs[end] != differs[end - like]))
    if len(other):
        found: dict[bytes, int] = {}
        more = []
        for i in other.tolist():
            piece = values[start[i] : stop[i]].tobytes()
            if piece not in found:
                found[piece] = len(first) + len(more)
                more.append(i)
            inverse[i] = found[piece]
        first = np.concatenate((first, more))
    return first, inverse


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for any of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ordered (sorting is faster than hashing here)."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def repeated(values: np.ndarray) -> np.ndarray:
    """The values that occur more than once, ordered."""
    values = np.sort(values)
    return distinct(values[1:][values[1:] == values[:-1]])


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    """A shard from the high bits, so that ordered hashes have ordered shards."""
    return ((hashes >> U64(32)) * U64(n_shards)) >> U64(32)
