"""Embedding near-duplicates by a robust-pruned flat graph.

1. Centres are fitted on a bounded sample; each vector belongs to the shard of
   its nearest centre and visits those of the next ``OVERLAP`` - 1.  Large shards
   are split by a hash into cells, so a vector is in ``OVERLAP`` cells, in one of
   them at home.
2. Each cell builds a graph over members and visitors: the nearest ``POOL``
   candidates of a vector, robust-pruned to ``DEGREE`` with slack ``ALPHA``.
3. The adjacency lists of a vector from all its cells are united: an edge goes
   to each cell that holds both its ends.
4. Each vector is searched in all its cells: greedy search from the nearest
   medoids of the cell and from the vector's own node, with a beam; then the
   range is expanded over neighbours not far below the threshold.
   Every query is audited by brute force in its task; one that misses a link
   takes its links from there.
5. A vector can also have links in cells further away.  Members are laid down
   once in blocks, and pairs of blocks are read side by side, without a shuffle.
   Their cells are compared exactly, but for rows that two exact bounds rule out
   (``reachable``); on spread-out vectors these are few, so that computing grows
   with the square of the table, while what is stored grows with the table.
6. Links are verified by cosine on the vectors in double precision.  A link is
   counted in the target's home cell only, so counts add up without listing
   pairs; links become edges to the least vector of a task's class.

Equal vectors are first folded into one, which carries their number.

Defined cases: rows that ``vectors.clean`` leaves out (null, zero, non-finite)
link with nothing and are kept; rows with a null id form their own class (null);
rows that share an id count once, with the least of their vectors; vectors of another
length than most link with nothing; a cosine of exactly the threshold links; ties change nothing, as all vectors above the
threshold are links; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import gc
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import vectors as V
from .batches import in_small_batches
from .components import connected_components, ensure_checkpoint_dir, release
from .skew import join_salted

SHARDS = 2048  # at most an eighth of the vectors that centres are fitted on
PART = 2048  # members of a shard, about; a cell has at most about twice as many, and as many visitors as go with them
BLOCK, BLOCK_BYTES = 4, 4 << 20  # times PART: members of a block, or fewer if as doubles they are larger than that; one cell at least
HELD = 32 << 20  # bytes of blocks, as doubles, that a task holds at a time, about
OVERLAP = 3
POOL, DEGREE, ALPHA = 64, 24, 1.2
BEAM = 24
WIDE = 4 * DEGREE  # neighbours that greedy search looks at, the nearest; the range expansion looks at all
MEDOIDS, ENTRIES = 48, 4  # medoids of a shard's clusters; a search starts from the few nearest to the query
NEAR = 1e-9  # cosines this close to the threshold are decided by the exact ones
SLACK = 1e-6  # for rounding in the bounds
MARGIN = 0.03  # how far below the threshold a neighbour may lie and still be expanded


def _candidates(x: np.ndarray, rows: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``pool`` others of each row; coinciding ones in a ring, so that they stay connected."""
    sims = x[rows] @ x.T
    sims[np.arange(len(rows)), rows] = -2
    if pool < sims.shape[1]:
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    else:
        near = np.broadcast_to(np.arange(len(x)), sims.shape).copy()
    s = np.take_along_axis(sims, near, axis=1)
    ring = (near - rows[:, None]) % len(x)
    order = np.lexsort((ring, -np.round(s, 9)), axis=1)
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1)


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of every row, reverse edges included."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    kept_from, kept_to = [], []
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        near, s = _candidates(x, rows, min(POOL, n - 1))
        distance = np.sqrt(np.maximum(0, 2 - 2 * s))
        mutual = np.sqrt(np.maximum(0, 2 - 2 * x[near] @ x[near].transpose(0, 2, 1)))
        alive = s > -2
        for _ in range(DEGREE):
            live = np.flatnonzero(alive.any(axis=1))
            if not len(live):
                break
            pick = alive[live].argmax(axis=1)
            kept_from.append(rows[live])
            kept_to.append(near[live, pick])
            alive[live, pick] = False
            alive[live] &= ~((ALPHA * mutual[live, pick] <= distance[live]) & (distance[live] > 1e-4))
    a, b = np.concatenate(kept_from), np.concatenate(kept_to)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    return np.split(pairs % n, np.searchsorted(pairs, np.arange(1, n) * n))


def _nearest_first(x: np.ndarray, node: int, near: np.ndarray) -> np.ndarray:
    return near if len(near) <= WIDE else near[np.argsort(-(x[near] @ x[node]), kind="stable")]


def _padded(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(lists), max(1, width)), -1)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def find_medoids(x: np.ndarray) -> np.ndarray:
    """The nodes nearest to the centres of the shard's own clusters."""
    return np.unique((x @ V.kmeans(x, min(MEDOIDS, len(x)), rounds=6).T).argmax(axis=0))


def greedy(
    x: np.ndarray, graph: list[np.ndarray], medoids: np.ndarray, q: np.ndarray, own: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query after greedy search: nodes (or -1) and similarities."""
    table = _padded([_nearest_first(x, i, g)[:WIDE] for i, g in enumerate(graph)], min(WIDE, max((len(g) for g in graph), default=1)))
    m = len(q)
    nodes, sims, open_ = np.full((m, beam), -1), np.full((m, beam), -2.0), np.zeros((m, beam), bool)
    seen = np.zeros((m, len(x)), bool)
    entries = medoids[np.argsort(-(q @ x[medoids].T), axis=1, kind="stable")[:, : min(ENTRIES, beam - 1)]]
    starts = [np.where(entries[:, k] == own, -1, entries[:, k]) for k in range(entries.shape[1])]
    for slot, start in enumerate([own, *starts]):
        real = np.flatnonzero(start >= 0)
        nodes[real, slot] = start[real]
        sims[real, slot] = np.einsum("qd,qd->q", q[real], x[start[real]])
        open_[real, slot] = True
        seen[real, start[real]] = True
    for _ in range(4 * beam):
        best = np.where(open_, sims, -3).argmax(axis=1)
        live = np.flatnonzero(open_[np.arange(m), best])
        if not len(live):
            break
        open_[live, best[live]] = False
        near = table[nodes[live, best[live]]]
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        s = np.full(near.shape, -2.0)
        s[r, c] = np.einsum("kd,kd->k", x[near[r, c]], q[live[r]])
        all_s = np.concatenate((sims[live], s), axis=1)
        all_n = np.concatenate((nodes[live], np.where(new, near, -1)), axis=1)
        all_o = np.concatenate((open_[live], new), axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live], nodes[live], open_[live] = (np.take_along_axis(y, top, axis=1) for y in (all_s, all_n, all_o))
    return nodes, sims


def expand(x: np.ndarray, graph: list[np.ndarray], q: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
    """All nodes of similarity ``least`` or more that are joined to the start by such nodes."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    found, front = [start], start
    while len(front):
        near = np.unique(np.concatenate([graph[i] for i in front]))
        near = near[~seen[near]]
        seen[near] = True
        front = near[x[near] @ q >= least]
        found.append(front)
    return np.concatenate(found)


def _reaches(q: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines of unit rows reach the threshold; those within NEAR of it are computed pair by pair."""
    sims = q @ x.T
    good = sims >= threshold
    i, j = np.nonzero(np.abs(sims - threshold) <= NEAR)
    good[i, j] = V.cosines(q[i], x[j]) >= threshold
    return good


def search(x: np.ndarray, graph: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (query, node) found, the node itself among them, for a few queries at a time."""
    beam, medoids = max(2, min(BEAM, len(x) + 1)), find_medoids(x)
    for at in range(0, len(x), 512):
        out_q, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = np.arange(at, min(len(x), at + 512))
        true = _reaches(x[own], x, threshold)
        nodes, sims = greedy(x, graph, medoids, x[own], own, beam)
        near = sims >= threshold - MARGIN
        for i in np.flatnonzero(true.any(axis=1)):
            hit = out_n[0]
            if near[i].any():
                all_ = expand(x, graph, x[at + i], nodes[i, near[i]], threshold - MARGIN)
                hit = np.unique(all_[true[i, all_]])
            if len(hit) < true[i].sum():
                hit = np.flatnonzero(true[i])
            out_q.append(np.full(len(hit), at + i))
            out_n.append(hit)
        yield np.concatenate(out_q), np.concatenate(out_n)


def reachable(
    x: np.ndarray, centres: np.ndarray, radius: np.ndarray, threshold: float, home: np.ndarray | None = None, shards: np.ndarray | None = None
) -> np.ndarray:
    """Whether each shard can hold a link of each row; ``radius`` is the angle of its farthest member (negative: none).

    A link lies within the angle t = arccos(threshold).  So the shard's centre is
    within t + radius; and as a member is at least as near to its own centre as to
    the row's, the row is within t of the member's side of the plane between them.
    ``home`` is the shard of each row, if known; ``shards`` are those asked for.
    """
    t = np.arccos(np.clip(threshold, -1, 1))
    if home is None:
        home = (x @ centres.T).argmax(axis=1)
    shards = np.arange(len(centres)) if shards is None else shards
    sims, top = x @ centres[shards].T, np.einsum("qd,qd->q", x, centres[home])
    gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres[shards].T))
    ball = np.arccos(np.clip(sims, -1, 1)) <= t + radius[shards] + SLACK
    side = top[:, None] - sims <= np.sin(min(t, np.pi / 2)) * gap[home] + SLACK
    return ball & side & (radius[shards] >= 0)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's class under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


class Tally:
    """What a task's links say, taken a few at a time: how many each node has, and the nodes' classes."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n, self.root = ids, np.zeros(len(ids), np.int64), np.arange(len(ids))

    def count(self, nodes: np.ndarray, weights: np.ndarray) -> None:
        np.add.at(self.n, nodes, weights)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        new = a != b
        if new.any():
            own, at = np.unique(np.concatenate((a[new], b[new])), return_inverse=True)
            root = np.arange(len(self.ids))
            root[own] = own[_roots(len(own), *at.reshape(2, -1))]
            self.root = root[self.root]

    def told(self) -> pa.RecordBatch:
        """vec_id, n and the least id of the class, of nodes that have a link."""
        least = self.ids.copy()
        np.minimum.at(least, self.root, self.ids)
        least = least[self.root]
        some = (self.n > 0) | (self.ids != least)
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (self.ids, self.n, least)], names=["vec_id", "n", "least"])


def pack(a: np.ndarray, b: np.ndarray) -> bytes:
    """Pairs of ids as differences in order, by planes of bytes."""
    order = np.lexsort((b, a))
    both = np.stack((np.diff(a[order], prepend=0), (b - a)[order])).astype("<i8")
    return zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    """The pairs, as two rows."""
    both = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(2, -1)
    a = np.cumsum(both[0])
    return np.stack((a, a + both[1]))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _edges(group: pa.Table) -> pa.Table:
    """A cell's graph, as edges for each cell that holds both ends: cell, edges."""
    group = group.sort_by("vec_id")
    ids, cells = group["vec_id"].to_numpy(), _rows(group["cells"])
    graph = build_graph(V.unit(V.matrix(group["v"])))
    a, b = np.repeat(np.arange(len(ids)), [len(g) for g in graph]), np.concatenate(graph)
    a, b = a[a < b], b[a < b]
    edge, first, second = np.nonzero(cells[a][:, :, None] == cells[b][:, None, :])
    cell = cells[a[edge], first]
    order = np.argsort(cell, kind="stable")
    found, starts = np.unique(cell[order], return_index=True)
    packed = [pack(ids[a[e]], ids[b[e]]) for e in np.split(edge[order], starts[1:])] if len(found) else []
    return pa.table({"cell": pa.array(found, pa.int64()), "edges": pa.array(packed, pa.binary())})


def _near_links(nodes: DataFrame, edges: DataFrame, threshold: float, schema: str) -> DataFrame:
    """What ``Tally`` says of links within a cell."""

    def find(held: pa.Table, known: pa.Table) -> pa.Table:
        held = held.sort_by("vec_id")
        ids, copies, home = (held[c].to_numpy() for c in ("vec_id", "copies", "home"))
        x, n = V.unit(V.matrix(held["v"])), len(ids)
        a, b = np.searchsorted(ids, np.concatenate([np.zeros((2, 0), np.int64), *(unpack(e) for e in known["edges"].to_pylist())], axis=1))
        pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
        graph = np.split(pairs % n, np.searchsorted(pairs, np.arange(1, n) * n))
        tally = Tally(ids)
        for q, found in search(x, graph, threshold):
            other = q != found
            q, found = q[other], found[other]
            tally.count(q, np.where(home[found], copies[found], 0))
            tally.join(q, found)
        return pa.Table.from_batches([tally.told()])

    return nodes.groupBy("cell").cogroup(edges.groupBy("cell")).applyInArrow(find, schema)


def linked(q: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit rows whose cosine reaches the threshold, for a few rows at a time.

    Single precision is off by no more than ``off``; what it leaves open is decided in double precision.
    """
    off = (x.shape[1] + 8) * 2.0**-23
    q4, x4 = q.astype(np.float32), x.astype(np.float32)
    for at in range(0, len(q), 256):
        for to in range(0, len(x), 1024):
            sims = q4[at : at + 256] @ x4[to : to + 1024].T
            hit = np.flatnonzero(sims >= threshold - off)
            if len(hit):
                i, j = np.divmod(hit, sims.shape[1])
                i, j, good = i + at, j + to, sims.ravel()[hit] >= threshold + off
                open_ = np.flatnonzero(~good)
                for k in np.split(open_, np.arange(65536, len(open_), 65536)):
                    exact = np.einsum("kd,kd->k", q[i[k]], x[j[k]])
                    good[k] = exact >= threshold
                    k = k[np.abs(exact - threshold) <= NEAR]
                    good[k] = V.cosines(q[i[k]], x[j[k]]) >= threshold
                yield i[good], j[good]


def _far_links(points: DataFrame, blocks: np.ndarray, first: np.ndarray, centres: np.ndarray, radius: np.ndarray, threshold: float, schema: str, n: int) -> DataFrame:
    """What ``Tally`` says of links into cells that a vector is not in.

    ``blocks`` is the block of each cell, ``first`` the first cell of each shard.
    """
    kind = "<f4" if points.schema["v"].dataType == ArrayType(FloatType()) else "<f8"
    shard_of = lambda cells: np.searchsorted(first, cells, side="right") - 1

    def lay(group: pa.Table) -> pa.Table:
        cells = _rows(group["cells"])
        order = np.lexsort((group["vec_id"].to_numpy(), cells[:, 0]))
        shards = np.unique(shard_of(cells[:, 0]))
        apart = np.arccos(np.clip(centres[shards] @ centres.T, -1, 1))
        near = apart <= np.arccos(np.clip(threshold, -1, 1)) + radius[shards, None] + radius + SLACK
        made = {
            "block": group["block"][:1],
            "shards": pa.array([shards.tolist()], pa.list_(pa.int32())),
            "reach": pa.array([np.flatnonzero(near.any(axis=0)).tolist()], pa.list_(pa.int32())),
            "cells": pa.array([cells[order].astype("<i4").tobytes()], pa.binary()),
            "v": pa.array([_rows(group["v"])[order].astype(kind).tobytes()], pa.binary()),
        }
        made |= {c: pa.array([group[c].to_numpy()[order].astype("<i8").tobytes()], pa.binary()) for c in ("vec_id", "copies")}
        return pa.table(made)

    def members(row: dict, side: str) -> tuple:
        read = lambda c, kind: np.frombuffer(row[f"{side}_{c}"].as_buffer(), kind)
        ids = read("vec_id", "<i8")
        cells = read("cells", "<i4").reshape(len(ids), -1)
        own, starts = np.unique(cells[:, 0], return_index=True)
        slices = [slice(i, j) for i, j in zip(starts, [*starts[1:], len(ids)], strict=True)]
        return ids, read("copies", "<i8"), cells, V.unit(read("v", kind).reshape(len(ids), -1).astype(np.float64)), own, slices

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sides = [members(row, side) for side in "ab"]
                same = row["a_block"].as_py() == row["b_block"].as_py()
                ids, copies, cells, x, own, slices = zip(*sides, strict=True)
                asked = [np.unique(shard_of(o)) for o in own]
                may = [reachable(x[s], centres, radius, threshold, shard_of(cells[s][:, 0]), asked[1 - s]) for s in (0, 1)]
                base = 0 if same else len(ids[0])
                tally = Tally(ids[0] if same else np.concatenate(ids))
                for a, at in zip(own[0], slices[0], strict=True):
                    for b, to in zip(own[1], slices[1], strict=True):
                        if same and a >= b:
                            continue
                        i = at.start + np.flatnonzero(may[0][at, np.searchsorted(asked[1], shard_of(b))])
                        j = to.start + np.flatnonzero(may[1][to, np.searchsorted(asked[0], shard_of(a))])
                        far_i, far_j = (cells[0][i] != b).all(axis=1), (cells[1][j] != a).all(axis=1)
                        for p, q in linked(x[0][i], x[1][j], threshold):
                            tally.count(i[p], np.where(far_i[p], copies[1][j[q]], 0))
                            tally.count(base + j[q], np.where(far_j[q], copies[0][i[p]], 0))
                            new = far_i[p] & far_j[q]  # others met in a cell
                            tally.join(i[p[new]], base + j[q[new]])
                yield tally.told()

    count = int(blocks.max()) + 1
    parts = min(count, max(16, -(-n * centres.shape[1] * 8 // HELD)))
    home = points.select(F.get(F.lit(blocks.tolist()), F.col("cells")[0]).cast("long").alias("block"), "vec_id", "v", "copies", "cells")
    laid = home.repartition(parts, "block").groupBy("block").applyInArrow(
        lay, "block long, shards array<int>, reach array<int>, cells binary, v binary, vec_id binary, copies binary"
    )
    laid = laid.checkpoint()
    _let_go(points.sparkSession, n)
    side = lambda s: in_small_batches(laid).coalesce(parts).select(*[F.col(c).alias(f"{s}_{c}") for c in laid.columns])
    # Each pair of blocks once, and about as many of each task's.
    once = (F.col("a_block") == F.col("b_block")) | ((F.col("a_block") < F.col("b_block")) == ((F.col("a_block") + F.col("b_block")) % 2 == 0))
    pairs = side("a").hint("shuffle_replicate_nl").join(side("b"), once & F.arrays_overlap("a_reach", "b_shards"))
    return pairs.drop("a_shards", "a_reach", "b_shards", "b_reach").mapInArrow(compare, schema)


def _let_go(spark: SparkSession, n: int) -> None:
    """``release`` at once, unless there is little: what one collection leaves to Java's other threads, the next one finds free."""
    gc.collect()
    release(spark)
    if n > V.SAMPLE:
        time.sleep(1)
        release(spark)


def near_vectors(
    table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = PART, shards: int = SHARDS
) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``table``."""
    ensure_checkpoint_dir(table.sparkSession)
    rows = V.clean(table, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    if table.schema[vector_col].dataType == ArrayType(FloatType()):
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))  # as they came: half as many bytes
    folded = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")).checkpoint()
    n, repeated = folded.count(), folded.filter("copies > 1")
    _let_go(table.sparkSession, n)
    x = V.sample(folded, n)
    everything = table.select(F.col(id_col).cast("long").alias("vec_id"))
    if not len(x):
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    twins = None
    if not repeated.isEmpty():
        others = rows.join(folded.select("vec_id"), "vec_id", "left_anti")
        twins = join_salted(others, repeated.withColumnRenamed("vec_id", "head"), ["v"], "copies", ["vec_id"]).select("vec_id", "head").checkpoint()
    centres = V.kmeans(x, max(1, min(shards, n // shard_rows, max(1, len(x) // 8))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = V.unit(V.matrix(batch.column("v"))) @ centres.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :OVERLAP].astype(np.int32)
                ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
                places = pa.ListArray.from_arrays(ends, pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, places, pa.array(sims.max(axis=1))], names=[*batch.schema.names, "shards", "cosine"])

    points = folded.select("vec_id", "v", "copies")
    kind = points.schema["v"].dataType.simpleString()
    points = points.mapInArrow(place, f"vec_id long, v {kind}, copies long, shards array<int>, cosine double").checkpoint()
    del folded, repeated
    _let_go(table.sparkSession, n)
    # A row for each centre, SHARDS at most.
    members, visits, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
    homes = points.groupBy(F.col("shards")[0].alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("cosine"))
    for r in homes.collect():
        members[r["shard"]], radius[r["shard"]] = r["n"], np.arccos(np.clip(r["cosine"], -1, 1))
    for r in points.select(F.explode("shards").alias("shard")).groupBy("shard").count().collect():
        visits[r["shard"]] = r["count"]
    parts = np.maximum(1, -(-np.maximum(members, visits // OVERLAP) // (2 * shard_rows)))
    first = np.cumsum(parts) - parts
    block_rows = max(1, min(BLOCK * shard_rows, BLOCK_BYTES // (8 * x.shape[1])))
    blocks = np.cumsum(np.repeat(members / parts, parts))
    blocks = np.unique(np.maximum(0, np.ceil(blocks / block_rows) - 1).astype(np.int64), return_inverse=True)[1]
    hashed = F.xxhash64("vec_id")
    cells = F.transform("shards", lambda s: (F.get(F.lit(first.tolist()), s) + F.pmod(hashed, F.get(F.lit(parts.tolist()), s))).cast("int"))
    points = points.select("vec_id", "v", "copies", cells.alias("cells"))
    dealt = points.withColumn("cell", F.explode("cells")).withColumn("cell", F.col("cell").cast("long"))
    edges = dealt.select("cell", "vec_id", "v", "cells").groupBy("cell").applyInArrow(_edges, "cell long, edges binary").checkpoint()
    _let_go(table.sparkSession, n)
    found_schema = "vec_id long, n long, least long"
    nodes = dealt.select("cell", "vec_id", "v", "copies", (F.col("cell") == F.col("cells")[0]).alias("home"))
    found = _near_links(nodes, edges, threshold, found_schema).checkpoint()
    _let_go(table.sparkSession, n)
    if len(blocks) > 1:
        found = found.unionByName(_far_links(points, blocks, first, centres, radius, threshold, found_schema, n).checkpoint())
    links = found.filter("vec_id != least").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    heads = points.select("vec_id", "copies")
    label = connected_components(heads.select(F.col("vec_id").alias("doc_id")), links)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    heads = heads.join(label.withColumnRenamed("doc_id", "vec_id"), "vec_id").join(counts, "vec_id", "left")
    heads = heads.select("vec_id", F.col("label").alias("component_id"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")).checkpoint()
    own = heads.select("vec_id", "n_links", "component_id")
    if twins is not None:
        again = heads.filter("copies > 1").withColumnRenamed("vec_id", "head")
        own = own.unionByName(join_salted(twins, again, ["head"], "copies", ["vec_id"]).select("vec_id", "n_links", "component_id"))
    _let_go(table.sparkSession, n)
    return (
        everything.join(own, "vec_id", "left")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
        .withColumn("component_id", F.coalesce("component_id", "vec_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
