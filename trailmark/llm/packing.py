"""Token-ID output: documents packed into rows of equal length.

Documents are encoded, split into pieces of at most ``length`` ids (nothing is
lost), dealt into groups by a hash, and packed group by group: best fit
decreasing, where a segment tree over the remaining capacities finds the fullest
row that still takes a piece.  A group holds about ``GROUP_BYTES`` of text, so it
fits a task at any size of the corpus; a row wasted at a group's end is the price.

A packed row has its ids (padded), the cumulative segment lengths, and positions
that start again at 0 with each segment.  ``write_binary`` writes the matrices.

Defined cases: null and empty texts have no ids and appear in no row; special
tokens are ordinary text; rows with a null id are packed like others; repeated
rows are packed as often as they occur; ties are broken by id, text and piece, so
reruns agree as long as the input is split alike; an empty table gives an empty
result; other columns are ignored.  Copies of one text under one id (or none) are
dealt over groups, so no group grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_small_batches, slices, tidied
from .byte_bpe import load_ranks

GROUP_BYTES = 8_000_000
COPIES = 16
SCHEMA = (
    "group long, row long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, pieces array<int>"
)


class CapacityTree:
    """How many open rows have each remaining capacity; the least one of at least n is found by descent."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, by: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def least_at_or_above(self, n: int) -> int:
        """The smallest capacity >= n that a row has, or -1."""
        at = self.base + n
        if self.count[at]:
            return n
        while at > 1:  # up to the first ancestor with something to its right, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Which pieces go to which row; sizes are descending."""
    tree, open_, rows = CapacityTree(length), [[] for _ in range(length + 1)], []
    for piece, size in enumerate(sizes.tolist()):
        capacity = tree.least_at_or_above(size)
        if capacity < 0:
            row, capacity = len(rows), length
            rows.append([])
        else:
            row = open_[capacity].pop()
            tree.add(capacity, -1)
        rows[row].append(piece)
        left = capacity - size
        if left:
            open_[left].append(row)
            tree.add(left, 1)
    return rows


@lru_cache(1)
def _encoding(path: str, pattern: str, held):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=held.value, special_tokens={})


def token_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian) by the tokenizer's own library, and salt.

    The salt is 0 for the first COPIES rows of an id and text in a split of the input,
    then another for each COPIES more.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern, held)
        split, seen = TaskContext.get().partitionId(), {}

        def salt(doc: int | None, ids: bytes) -> int:
            key = (doc, blake2b(ids, digest_size=12).digest())
            seen[key] = seen.get(key, -1) + 1
            return (split << 32) + seen[key] // COPIES if seen[key] >= COPIES else 0

        for batch in batches:
            for part in slices(batch, 1_000_000):
                ids = [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in part.column("text").fill_null("").to_pylist()]
                salts = list(map(salt, part.column("doc_id").to_pylist(), ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(salts, pa.int64())], names=["doc_id", "ids", "salt"])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, ids binary, salt long")


def pack(encoded: DataFrame, n_groups: int, length: int = 2048, pad: int = 0) -> DataFrame:
    """Packed rows of (doc_id, ids, salt)."""

    def run(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()
        docs = table["doc_id"].to_pylist()
        raw = [x.as_py() for x in table["ids"]]
        ids = [np.frombuffer(x, "<u4") for x in raw]
        pieces = [(min(length, len(x) - at), k, i, at) for i, x in enumerate(ids) for k, at in enumerate(range(0, len(x), length))]
        pieces.sort(key=lambda p: (-p[0], docs[p[2]] is not None, docs[p[2]] or 0, raw[p[2]], p[1]))
        out = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        for row, members in enumerate(best_fit_decreasing(np.array([p[0] for p in pieces], np.int64), length)):
            own = [pieces[m] for m in members]
            size = np.array([p[0] for p in own])
            line = np.full(length, pad, "<u4")
            line[: size.sum()] = np.concatenate([ids[i][at : at + n] for n, _, i, at in own])
            place = np.zeros(length, "<u4")
            place[: size.sum()] = np.concatenate([np.arange(n) for n in size])
            values = (group, row, int(size.sum()), len(own), line.tobytes(), np.concatenate(([0], np.cumsum(size))).tolist(), place.tobytes(), [docs[p[2]] for p in own], [p[1] for p in own])
            for name, value in zip(out, values):
                out[name].append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table(out, pa.schema(list(zip(out, types))))

    dealt = encoded.filter(F.length("ids") > 0).select("doc_id", "ids", F.pmod(F.xxhash64("doc_id", "ids", "salt"), F.lit(n_groups)).cast("long").alias("group"))
    return dealt.groupBy("group").applyInArrow(tidied(run), SCHEMA)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and packs; the number of groups follows the bytes of text."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("b")).first()["b"] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pack(token_ids(docs, ranks_path, pattern, id_col, text_col), max(1, min(parts, -(-total // 500_000)), -(-total // GROUP_BYTES)), length)


def write_binary(packed: DataFrame, path: str) -> None:
    """The rows as Parquet, one matrix row a record; ids and positions are fixed-width binaries."""
    packed.sortWithinPartitions("group", "row").write.mode("overwrite").parquet(path)
