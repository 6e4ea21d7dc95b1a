"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample on the driver (``SAMPLE`` rows, at most
``LEAVES`` leaves, so shipping it is bounded too); every row is then assigned to
its leaf.  A query walks the tree best bin first: a priority queue holds open
nodes by similarity of their centre, and leaves are visited as they come up.

How many leaves to visit is calibrated, not assumed: for up to ``AUDIT`` queries
the true neighbours are found by brute force over all rows (in blocks), and the
visits are widened until the share of true neighbours whose leaf was visited
reaches ``recall``.  The same count then holds for all queries; a query goes on
until it has seen k candidates at least.

Queries meet the rows of a leaf in blocks of at most about ``part`` rows and
``part`` queries a task, however large a leaf is; blocks follow from the queries
that visit a leaf, so rows of leaves that none visits go nowhere.  Scores are
computed on the original vectors, pair by pair in one order of operations, so equal
vectors get equal scores however the blocks are cut.

Defined cases: rows that ``vectors.clean`` leaves out take no part; a query is
never its own neighbour (rows that share its id neither); repeated vectors are
neighbours of score 1, ties go to the smaller id, also among more than k; vectors
of another length than most take no part; with fewer than k candidates
all are returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V

BRANCH = 16
LEAVES = 4096
LEAF_ROWS = 256
AUDIT = 200
PART = 4096
NEAR = 1e-9  # scores this close are decided by the exact ones


class Tree:
    """Nodes of a k-means tree: centres, children (none for leaves)."""

    def __init__(self, x: np.ndarray, n: int, leaf_rows: int = LEAF_ROWS):
        self.centres, self.children, self.leaf, self.n_leaves = [], [], [], 0
        wanted = max(1, min(LEAVES, n // leaf_rows, len(x) // 8))
        self.top = self._grow(x, wanted)

    def _grow(self, x: np.ndarray, leaves: int) -> list[int]:
        """Children for these points; about ``leaves`` leaves below them."""
        centres = V.kmeans(x, min(BRANCH, leaves)) if leaves > 1 else x.mean(axis=0, keepdims=True)
        own = (x @ centres.T).argmax(axis=1)
        nodes = []
        for k in range(len(centres)):
            node = len(self.centres)
            nodes.append(node)
            self.centres.append(centres[k])
            self.children.append([])
            self.leaf.append(-1)
            part = x[own == k]
            below = round(leaves * len(part) / max(1, len(x)))
            if leaves > BRANCH and 1 < below and 1 < len(part) < len(x):
                self.children[node] = self._grow(part, below)
            else:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
        return nodes

    def freeze(self) -> "Tree":
        self.centres = np.array(self.centres)
        return self

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the most similar child at every level."""
        out = np.zeros(len(x), np.int64)
        stack = [(self.top, np.arange(len(x)))]
        while stack:
            nodes, rows = stack.pop()
            own = (x[rows] @ self.centres[nodes].T).argmax(axis=1)
            for k, node in enumerate(nodes):
                part = rows[own == k]
                if len(part):
                    if self.children[node]:
                        stack.append((self.children[node], part))
                    else:
                        out[part] = self.leaf[node]
        return out

    def visits(self, sims: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order, given a query's similarity to all centres."""
        heap = [(-sims[n], n) for n in self.top]
        heapq.heapify(heap)
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-sims[child], child))
            else:
                yield self.leaf[node]


def _top(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """For each query its k best rows by (score, smaller id): query index, row index, score."""
    sims = V.unit(q) @ V.unit(v).T
    sims[query_ids[:, None] == ids[None, :]] = -np.inf
    take = min(k, len(ids))
    cut = -np.partition(-sims, take - 1, axis=1)[:, take - 1 : take]
    qi, ri = np.nonzero((sims >= cut - NEAR) & np.isfinite(sims))
    score = np.concatenate([np.zeros(0), *(V.cosines(q[qi[at : at + 65536]], v[ri[at : at + 65536]]) for at in range(0, len(qi), 65536))])
    order = np.lexsort((ids[ri], -score, qi))
    qi = qi[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[best], ri[order][best], score[order][best]


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _audit(leafed: DataFrame, probes: pa.Table, k: int) -> list[tuple[int, int]]:
    """(query_id, leaf of a true neighbour), by brute force over all rows."""
    ids, q = probes["vec_id"].to_numpy(), V.matrix(probes["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            if len(own):
                qi, ri, s = _top(own, V.matrix(batch.column("v")), ids, q, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[qi]), pa.array(own[ri]), pa.array(leaf[ri]), pa.array(s)], names=["query_id", "vec_id", "leaf", "score"]
                )

    found = leafed.mapInArrow(run, "query_id long, vec_id long, leaf long, score double").dropDuplicates(["query_id", "vec_id"])
    return [(r["query_id"], r["leaf"]) for r in _nearest(found, k).select("query_id", "leaf").collect()]


def nearest_neighbours(
    table: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", leaf_rows: int = LEAF_ROWS, part: int = PART
) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a predicate on vec_id."""
    rows = V.clean(table, id_col, vector_col)
    n = rows.count()
    found_schema = "query_id long, vec_id long, score double"
    x = V.sample(rows, n)
    tree = Tree(x, n, leaf_rows).freeze() if len(x) else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(V.unit(V.matrix(batch.column("v")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    if tree is None:
        empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return empty.filter(F.lit(False))
    leafed = rows.mapInArrow(assign, "vec_id long, v array<double>, leaf long")
    # One row for each leaf, LEAVES at most.
    count = np.zeros(tree.n_leaves, np.int64)
    for r in leafed.groupBy("leaf").count().collect():
        count[r["leaf"]] = r["count"]
    asked = rows.filter(is_query)
    n_asked = asked.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    probes = asked.filter(draw < AUDIT / max(n_asked, 1)).orderBy("vec_id").limit(2 * AUDIT).toArrow()
    place = {}
    for query, v in zip(probes["vec_id"].to_pylist(), V.unit(V.matrix(probes["v"])) if probes.num_rows else []):
        place[query] = {leaf: i for i, leaf in enumerate(tree.visits(tree.centres @ v))}
    ranks = sorted(place[query][leaf] for query, leaf in _audit(leafed, probes, k)) if place else []
    width = ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else tree.n_leaves

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.unit(V.matrix(batch.column("v"))) if batch.num_rows else None
            at, leaves = [], []
            for i in range(batch.num_rows):
                seen = 0
                for step, leaf in enumerate(tree.visits(tree.centres @ x[i])):
                    if step >= width and seen > k:
                        break
                    seen += int(count[leaf])
                    at.append(i), leaves.append(leaf)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(leaves, pa.int64())], names=["vec_id", "v", "leaf"])

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asked.num_rows or not held.num_rows:
            return out
        ids, v = held["vec_id"].to_numpy(), V.matrix(held["v"])
        query_ids, q = asked["vec_id"].to_numpy(), V.matrix(asked["v"])
        pieces = [out]
        for at in range(0, len(query_ids), 512):
            qi, ri, s = _top(ids, v, query_ids[at : at + 512], q[at : at + 512], k)
            pieces.append(pa.table({"query_id": query_ids[at : at + 512][qi], "vec_id": ids[ri], "score": np.clip(s, -1.0, 1.0)}))
        return pa.concat_tables(pieces)

    # One row for each visited leaf, LEAVES at most: how its rows and its queries are dealt.
    routed = asked.mapInArrow(route, "vec_id long, v array<double>, leaf long")
    per = lambda column: F.greatest(F.lit(1), F.ceil(F.col(column) / part)).cast("int")
    visited = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("asked"))
    sizes = F.broadcast(
        visited.join(leafed.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")), "leaf").select("leaf", per("held").alias("parts"), per("asked").alias("chunks"))
    )
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    copy = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = routed.join(sizes, "leaf").withColumn("chunk", deal("chunks", 1)).withColumn("part", copy("parts"))
    members = leafed.join(sizes, "leaf").withColumn("part", deal("parts", 2)).withColumn("chunk", copy("chunks"))
    keys = ["leaf", "part", "chunk"]
    queries, members = (x.select(*keys, "vec_id", "v").groupBy(keys) for x in (queries, members))
    return _nearest(queries.cogroup(members).applyInArrow(search, found_schema), k).select("query_id", "rank", "vec_id", "score")
