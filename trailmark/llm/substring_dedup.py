"""Removal of repeated word windows across documents (Rabin-Karp).

Every window of ``width`` consecutive words is hashed; Spark deals the hashes to
shards, which count them; windows that also start in a document with a smaller id are merged
into maximal intervals and cut out.

Plan: documents are dealt into blocks of ascending ids (one shuffle of the
texts, reused).  A block sends its distinct window hashes to shards, ordered, so
that differences are enough; a shard counts which of them an earlier block holds
and replies with one bit for each.  A window that very many documents share counts
once per block, so no shard grows with one passage.

Windows are told apart by 88 bits: 64 of a chained hash (``textarrays``; strings
that collide by construction under a polynomial do not collide here) and 24 of a
second, independent one.  Among the 10**13 windows of 100 TB a wrong match is to be
expected with a chance of some 15 %, at 30 GB of one in 10**8.

Defined cases: a null or empty text has no words and loses none; rows with a
null id are returned whole and remove nothing; rows that share an id do not
remove each other's words (the id must be smaller); texts shorter than a window
lose nothing; an empty table gives an empty result; columns beside id and text
are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import textarrays as A
from .batches import tidied

SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SEEDS = (0x8CB92BA72F3D8DD7, 0x3C6EF372FE94F82B)


class Windows(NamedTuple):
    hashes: np.ndarray
    checks: np.ndarray  # 24 bits of a second hash
    rows: np.ndarray  # the document of each window
    places: np.ndarray  # its first word there
    counts: np.ndarray  # words of each document


def _windows(column: pa.ChunkedArray, width: int) -> Windows:
    """Every window of a block, document by document."""
    data, offsets = A.buffers(column)
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for at, part, offs in A.chunks(data, offsets):
        starts, ends, doc = A.words(part, offs)
        n = np.bincount(doc, minlength=len(offs) - 1)
        counts[at : at + len(n)] = n
        words = A.word_hashes(part, starts, ends)
        row = doc[: max(0, len(words) - width + 1)]
        ok = row == doc[width - 1 :] if len(row) else np.zeros(0, bool)
        first_word = np.cumsum(n) - n
        row = row[ok]
        found.append((A.chained(words, width, SEEDS[0])[ok], (A.chained(words, width, SEEDS[1])[ok] >> A.U64(40)).astype(np.uint32), row + at, np.flatnonzero(ok) - first_word[row]))
    none = (np.zeros(0, A.U64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Windows(*(np.concatenate([none[k], *(x[k] for x in found)]) for k in range(4)), counts)


def _low_bytes(values: np.ndarray, k: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].tobytes()


def _from_low_bytes(raw: bytes, k: int) -> np.ndarray:
    out = np.zeros((len(raw) // k, 8), np.uint8)
    out[:, :k] = np.frombuffer(raw, np.uint8).reshape(-1, k)
    return out.view("<u8").ravel()


def _messages(hashes: np.ndarray, checks: np.ndarray, n_shards: int) -> Iterator[tuple[int, int, bytes]]:
    """Ordered pairs as (shard, place of the first, the first and then differences and checks).

    A message names the bytes that its largest difference takes: 6 in a full block.
    """
    if len(hashes):
        shard, step = A.shard_of(hashes, n_shards), np.diff(hashes)
        edges = np.flatnonzero(np.diff(shard) != 0) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(hashes)]):
            steps = np.concatenate((np.zeros(1, A.U64), step[a : b - 1]))
            k = max(1, -(-int(steps.max()).bit_length() // 8))
            yield int(shard[a]), a, bytes([k]) + hashes[a : a + 1].tobytes() + _low_bytes(steps, k) + _low_bytes(checks[a:b], 3)


def _read(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, message = message[0], message[1:]
    n = (len(message) - 8) // (k + 3)
    steps = _from_low_bytes(message[8 : 8 + k * n], k)
    steps[0] = np.frombuffer(message, A.U64, 1)[0]
    return np.cumsum(steps, dtype=A.U64), _from_low_bytes(message[8 + k * n :], 3).astype(np.uint32)


def remove_repeated_windows(
    docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans (word ranges), rest (the carried columns)."""
    laid = B.lay_out(docs, id_col, text_col, carry)
    n_shards = laid.n_shards

    @tidied
    def tell(table: pa.Table) -> pa.Table:
        out = {"shard": [], "block": [], "at": [], "hashes": []}
        if not B.is_loose(table):
            found = _windows(table["text"], width)
            order, new = A.in_order(found.hashes, found.checks)
            head = order[new]
            for shard, at, message in _messages(found.hashes[head], found.checks[head], n_shards):
                for name, value in zip(out, (shard, table["block"][0].as_py(), at, message)):
                    out[name].append(value)
        return pa.table(out, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("at", pa.int32()), ("hashes", pa.binary())]))

    @tidied
    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("at", "ascending")])
        parts = [_read(x.as_py()) for x in table["hashes"]]
        order, new = A.in_order(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        again = np.empty(len(order), bool)
        again[order] = ~new  # a block holds a window once, and the first block comes first
        out, begin = {"block": [], "at": [], "hits": []}, 0
        for block, at, (part, _) in zip(table["block"].to_pylist(), table["at"].to_pylist(), parts):
            if (hit := again[begin : begin + len(part)]).any():
                for name, value in zip(out, (block, at, np.packbits(hit).tobytes())):
                    out[name].append(value)
            begin += len(part)
        return pa.table(out, pa.schema([("block", pa.int32()), ("at", pa.int32()), ("hits", pa.binary())]))

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", SPANS)])

    @tidied
    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        table = B.by_id(table)
        found = _windows(table["text"], width)
        gone = np.zeros(len(found.hashes), bool)
        if not B.is_loose(table) and len(gone):
            ids = table["doc_id"].to_numpy()
            order, new = A.in_order(found.hashes, found.checks)  # ties stay in the order of ids
            run = np.cumsum(new) - 1
            earlier = np.zeros(int(run[-1]) + 9, bool)
            for at, hits in zip(reply["at"].to_pylist(), reply["hits"]):
                bits = np.unpackbits(np.frombuffer(hits.as_py(), np.uint8)).astype(bool)
                earlier[at : at + len(bits)] |= bits[: len(earlier) - at]
            owner = ids[found.rows[order]]
            gone[order] = (owner > owner[new][run]) | earlier[run]
        first = np.concatenate(([0], np.cumsum(found.counts)))
        lost = A.covered(int(first[-1]), first[found.rows[gone]] + found.places[gone], width)
        kept, removed, spans = [], np.zeros(table.num_rows, np.int64), []
        for i, text in enumerate(table["text"]):
            own = lost[first[i] : first[i + 1]]
            parts = (text.as_py() or "").encode().split()
            removed[i] = int(own.sum())
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(*A.runs(own))] if removed[i] else [])
            kept.append(b" ".join(compress(parts, ~own) if removed[i] else parts).decode())
        out = pa.table({"doc_id": table["doc_id"], "n_words": found.counts, "n_removed": removed, "kept_text": kept, "spans": pa.array(spans, SPANS)}, schema)
        return out.append_column("rest", table["rest"])

    told = laid.docs.groupBy("block").applyInArrow(tell, "shard int, block int, at int, hashes binary")
    replies = told.groupBy("shard").applyInArrow(count, "block int, at int, hits binary")
    return (
        laid.docs.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(cut, B.returned("doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>", laid))
    )
