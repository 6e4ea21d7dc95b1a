"""Removal of byte passages that an earlier document holds (suffix arrays).

A byte goes if a ``width``-byte string covering it also starts in a document
with a smaller id.  Whether it does is read from a longest-previous-factor
array: suffixes are put in suffix order; the previous and the next place in that
order whose document is smaller, with the least common prefix on the way, give
each suffix its longest match in an earlier document.  Later copies go, the first
stays.  Only matches of ``width`` bytes or more count, so suffixes are ordered and
compared by their first ``width`` bytes, factors are cut at that length, and
shorter ones are reported as 0.

Ordering all suffixes of a corpus at once is neither possible in one task nor
needed.  Each window of ``width`` bytes has an anchor, the smallest hash of its
``GRAM``-byte substrings.  Equal windows have equal anchors, so

1. blocks of documents send their distinct anchors to shards, which reply with
   the anchors that several blocks hold (a thirteenth of all positions);
2. blocks build the array over windows whose anchor occurs in two documents,
   mark what an earlier document of the block holds, and send the remaining
   windows with a shared anchor, as stretches of text, to the anchor's shard;
3. shards build the array over these and reply with the spans to remove;
4. blocks merge spans and cut.

No window is left out of the comparison, and windows are compared byte by byte.
A passage shared by very many documents reaches a shard once per block.

Defined cases: null and empty texts have no bytes; rows with a null id are
returned whole and remove nothing; rows that share an id do not remove each
other's bytes; texts below ``width`` bytes lose nothing; an empty table gives an
empty result; other columns travel untouched in ``rest``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import textarrays as A
from .batches import tidied

GRAM = 24
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])  # ``doc``: the row in its block


def _anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, each inside one document and of one anchor: first start, length, anchor.

    Anchors have 48 bits: they only choose what is compared.
    """
    n = len(data) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, A.U64)
    low = A.window_hash(A.prefix(data.astype(A.U64) + A.U64(1), A.BYTE_BASE), GRAM, A.BYTE_BASE)
    reach, span = 1, width - GRAM + 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    low = low[:n]
    inside = np.ones(n + 1, bool)
    inside[n] = False
    edge = np.ones(n + 1, bool)
    edge[1:n] = low[1:] != low[:-1]
    for end in offsets[1:-1].tolist():  # windows that would cross a document's end
        inside[max(0, end - width + 1) : end] = False
        edge[max(0, min(n, end - width + 1))] = edge[min(n, end)] = True
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, n + 1))
    keep = inside[first]
    return first[keep], size[keep], low[first[keep]] >> A.U64(16)


def _runs(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a whole block; starts count from its first byte."""
    data, offsets = A.buffers(column)
    parts = [(first + offsets[at], size, low) for at, part, offs in A.chunks(data, offsets) for first, size, low in [_anchors(part, offs, width)]]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([x[k] for x in parts] or [none.astype(A.U64) if k == 2 else none]) for k in range(3))


def _six(anchors: np.ndarray) -> bytes:
    return anchors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b""


def _unpack(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True) if raw else b""


def _recurring(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of the ascending starts have a window that may occur again (by its hash)."""
    parts = [np.zeros(0, A.U64)]
    for at in range(0, len(data), A.CHUNK_BYTES):
        own = starts[slice(*np.searchsorted(starts, [at, at + A.CHUNK_BYTES]))] - at
        sums = A.prefix(data[at : at + A.CHUNK_BYTES + width].astype(A.U64) + A.U64(1), A.BYTE_BASE)
        parts.append(A.slice_hash(sums, own, own + width, A.BYTE_BASE))
    hashes = np.concatenate(parts)
    return A.member(hashes, A.repeated(hashes))


def _common(suffix: np.ndarray, width: int) -> np.ndarray:
    """Bytes that each ordered suffix shares with the one before it, up to ``width``; 0 for the first."""
    out = np.zeros(len(suffix), np.int64)
    view = suffix.view(np.uint8).reshape(len(suffix), width)
    for at in range(1, len(suffix), 100_000):
        part = view[at - 1 : at + 100_000]
        differs = part[1:] != part[:-1]
        out[at : at + len(differs)] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return out


def _smaller_before(owner: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place the common prefix with the nearest earlier place of a smaller owner, 0 if below ``least``.

    ``common`` is shared with the place before.  A place hops over those that are not
    smaller by their own hops, all places at once; what it shares is the least of the way.
    """
    n = len(owner)
    hop, shared = np.arange(-1, n - 1), common.copy()
    live = np.flatnonzero(shared >= least)
    while len(live):
        live = live[owner[hop[live]] >= owner[live]]
        over = hop[live]
        shared[live], hop[live] = np.minimum(shared[live], shared[over]), hop[over]
        live = live[shared[live] >= least]
    return np.where(shared >= least, shared, 0)


def longest_previous(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """The longest previous factor at each start, cut at ``width`` and 0 below it.

    Starts are ascending; a factor is previous if it starts under a smaller owner.
    Suffixes whose first ``width`` bytes occur once cannot reach that length and stay
    out of the order.
    """
    factor = np.zeros(len(starts), np.int64)
    again = np.flatnonzero(_recurring(data, starts, width)) if len(starts) else starts
    if not len(again):
        return factor
    suffix = np.ndarray(len(data) - width + 1, f"S{width}", np.ascontiguousarray(data), strides=(1,))[starts[again]]
    order = np.argsort(suffix, kind="stable")  # suffix order
    common = _common(suffix[order], width)
    own = owner[again][order]
    previous = _smaller_before(own, common, width)
    following = _smaller_before(own[::-1], np.concatenate((common[1:], [0]))[::-1], width)[::-1]
    factor[again[order]] = np.maximum(previous, following)
    return factor


def _shard(anchors: np.ndarray, n_shards: int) -> np.ndarray:
    """Anchors are minima, so small; mixing them again deals them evenly."""
    return A.shard_of(A.mix(anchors + A.U64(A.WORD_BASE)), n_shards).astype(np.int64)


def _spans(doc: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Maximal spans covered by windows, which come in order of document and place."""
    if not len(at):
        return np.zeros(0, SPAN)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + width)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    out = np.empty(len(first), SPAN)
    out["doc"], out["start"], out["end"] = doc[first], at[first], at[last] + width
    return out


def _multi(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The anchors that occur in two rows or more, ordered; rows are ascending."""
    keep = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])))
    a, r = anchors[keep], rows[keep]
    order = np.argsort(a, kind="stable")
    a, r = a[order], r[order]
    return A.distinct(a[1:][(a[1:] == a[:-1]) & (r[1:] != r[:-1])])


def _on_characters(body: bytes, start: int, end: int) -> list[int]:
    inner = lambda i: i < len(body) and body[i] & 0xC0 == 0x80
    while start < end and inner(start):
        start += 1
    while end > start and inner(end):
        end -= 1
    return [start, end]


def remove_repeated_bytes(
    docs: DataFrame,
    width: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    whole_characters: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (binary), spans (byte ranges), rest (the carried columns).

    With ``whole_characters`` a span gives back the characters that it would cut in
    two, so that what is kept is UTF-8 again.
    """
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} or more")
    laid = B.lay_out(docs, id_col, text_col, carry)
    n_shards = laid.n_shards

    @tidied
    def tell(table: pa.Table) -> pa.Table:
        out = {"shard": [], "block": [], "hashes": []}
        if not B.is_loose(table):
            found = A.distinct(_runs(table["text"], width)[2])
            shard = _shard(found, n_shards)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order])) + 1
            for at in np.split(order, edges) if len(found) else []:
                piece = found[at]
                out["shard"].append(int(shard[at[0]]))
                out["block"].append(table["block"][0].as_py())
                out["hashes"].append(_six(piece))
        return pa.table(out, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary())]))

    @tidied
    def shared(table: pa.Table) -> pa.Table:
        parts = [_from_six(x.as_py()) for x in table["hashes"]]
        held = np.concatenate(parts)
        twice = A.repeated(held)
        out = {"block": [], "hashes": []}
        for block, part in zip(table["block"].to_pylist(), parts):
            if len(hit := part[A.member(part, twice)]):
                out["block"].append(block)
                out["hashes"].append(_six(hit))
        return pa.table(out, pa.schema([("block", pa.int32()), ("hashes", pa.binary())]))

    wire = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("body", pa.binary()), ("segments", pa.binary()), ("spans", pa.binary())])

    @tidied
    def compare(table: pa.Table, reply: pa.Table) -> pa.Table:
        out = {k: [] for k in wire.names}
        if table.num_rows and not B.is_loose(table):
            block = table["block"][0].as_py()
            table = B.by_id(table)
            ids = table["doc_id"].to_numpy()
            rank = np.cumsum(np.concatenate(([False], ids[1:] != ids[:-1])))
            data, offsets = A.buffers(table["text"])
            far = np.sort(np.concatenate([_from_six(x.as_py()) for x in reply["hashes"]] or [np.zeros(0, A.U64)]))
            start, size, low = _runs(table["text"], width)
            row = np.searchsorted(offsets, start, side="right") - 1
            hit = A.member(low, A.distinct(np.concatenate((_multi(low, rank[row]), far)))) if len(low) else np.zeros(0, bool)
            start, size, low, row = start[hit], size[hit], low[hit], row[hit]
            window = A.each(start, size)
            doc = np.repeat(row, size)
            gone = longest_previous(data, window, rank[doc], width) >= width
            local = _spans(doc[gone], (window - offsets[doc])[gone], width)
            for name, value in zip(wire.names, (block % n_shards, block, b"", b"", _pack(local.tobytes()))):
                out[name].append(value)
            send = ~gone & np.repeat(A.member(low, far), size)
            run = np.repeat(np.arange(len(low)), size)[send]
            window = window[send]
            if len(window):
                cut = np.concatenate(([True], (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)))
                first = np.flatnonzero(cut)
                begin, run = window[first], run[first]
                size = np.diff(np.append(first, len(window))) + width - 1
                shard = _shard(low[run], n_shards)
                order = np.argsort(shard, kind="stable")
                for piece in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    own = row[run[piece]]
                    segments = b"".join(x.tobytes() for x in (own, (begin[piece] - offsets[own]).astype("<i4"), size[piece].astype("<i4")))
                    body = data[A.each(begin[piece], size[piece])].tobytes()
                    for name, value in zip(wire.names, (int(shard[piece[0]]), block, _pack(body), _pack(segments), b"")):
                        out[name].append(value)
        return pa.table(out, wire)

    @tidied
    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out = {"block": [], "spans": []}
        blocks = table["block"].to_pylist()
        for block, own in zip(blocks, table["spans"]):
            if len(own.as_py()):
                out["block"].append(block)
                out["spans"].append(_unpack(own.as_py()))
        docs, ats, sizes = [], [], []
        for raw in table["segments"]:
            raw = _unpack(raw.as_py())
            n = len(raw) // 16
            docs.append(np.frombuffer(raw, "<i8", n))
            ats.append(np.frombuffer(raw, "<i4", n, 8 * n))
            sizes.append(np.frombuffer(raw, "<i4", n, 12 * n))
        owner = np.repeat(blocks, [len(x) for x in docs])  # ascending: the table is ordered by block
        seg_doc, seg_at, seg_n = (np.concatenate(x).astype(np.int64) for x in (docs, ats, sizes))
        if len(seg_doc):
            data = np.frombuffer(b"".join(_unpack(x.as_py()) for x in table["body"]), np.uint8)
            size = seg_n - width + 1
            which = np.repeat(np.arange(len(size)), size)
            inner = A.each(np.zeros_like(size), size)
            gone = longest_previous(data, (np.cumsum(seg_n) - seg_n)[which] + inner, owner[which], width) >= width
            which, inner = which[gone], inner[gone]
            doc, at, blk = seg_doc[which], seg_at[which] + inner, owner[which]
            order = np.lexsort([at, doc, blk])
            doc, at, blk = doc[order], at[order], blk[order]
            for piece in np.split(np.arange(len(blk)), np.flatnonzero(np.diff(blk)) + 1) if len(blk) else []:
                out["block"].append(int(blk[piece[0]]))
                out["spans"].append(_spans(doc[piece], at[piece], width).tobytes())
        return pa.table(out, pa.schema([("block", pa.int32()), ("spans", pa.binary())]))

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", SPANS)])

    @tidied
    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        spans = np.concatenate([np.frombuffer(x.as_py(), SPAN) for x in reply["spans"]] or [np.zeros(0, SPAN)])
        spans = spans[np.lexsort([spans["start"], spans["doc"]])]
        out = {k: [] for k in schema.names}
        table = B.by_id(table)
        for row, (doc, text) in enumerate(zip(table["doc_id"].to_pylist(), table["text"])):
            body = (text.as_py() or "").encode()
            own = spans[slice(*np.searchsorted(spans["doc"], [row, row + 1]))]
            merged: list[list[int]] = []
            for start, end in zip(own["start"].tolist(), own["end"].tolist()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            if whole_characters:
                merged = [pair for pair in (_on_characters(body, *x) for x in merged) if pair[0] < pair[1]]
            edges = [0, *(x for pair in merged for x in pair), len(body)]
            out["doc_id"].append(doc)
            out["n_bytes"].append(len(body))
            out["n_removed"].append(sum(b - a for a, b in merged))
            out["kept"].append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else body)
            out["spans"].append([{"start": a, "end": b} for a, b in merged])
        return pa.table(out, schema).append_column("rest", table["rest"])

    told = laid.docs.groupBy("block").applyInArrow(tell, "shard int, block int, hashes binary")
    replies = told.groupBy("shard").applyInArrow(shared, "block int, hashes binary")
    sent = (
        laid.docs.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(compare, "shard int, block int, body binary, segments binary, spans binary")
    )
    found = sent.groupBy("shard").applyInArrow(settle, "block int, spans binary")
    return (
        laid.docs.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(cut, B.returned("doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:int,end:int>>", laid))
    )
