"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set is its distinct five-word shingles.  Its signature has
``COORDS`` coordinates; two sets of similarity s agree in each with chance s.
At or above the threshold a pair agrees in fewer than ``least`` coordinates with
chance below 1e-9, so pairs that agree in fewer are left out.

1. Documents with equal sets become one representative (grouped by a 128-bit
   digest of the set and its size).
2. Representatives are posted under each coordinate-value pair.  Values that one
   document holds are dropped, and documents with fewer than ``least`` shared
   values with them (skip).  Each document keeps the rarest of its m values, up to
   m - least + 1 of them: two documents that agree in ``least`` values meet
   under one of those (prefix).
3. Meetings are turned into links without emitting the pairs of a group.  In
   each of ``ROUNDS`` rounds a posting list names one hub, drawn by a hash; members
   count how often they collide with a hub of another class, the pairs with the best
   few hubs are retained if they agree in ``least`` coordinates of the whole
   signature and confirmed on full sets, and linked documents share a class from then on.
4. What remains is exact: documents whose classes still meet under a value post
   their shingles, rarest first, as far as the threshold asks; classes that meet
   there are paired once, and the smaller class of a pair is compared with the
   larger in blocks of about ``BLOCK`` documents, on full sets, in one task a
   block.  Documents of one class need no comparison, since only classes are
   asked for.

Components come from min-label propagation with pointer jumping over the links,
cut by checkpoint() each round.

Defined cases: null and empty texts have an empty set, link with nothing and are
kept; fewer than five words are one shingle; rows with a null id are returned as
their own class (null) and kept; rows that share an id are one document, linked
by what links any of them, be they equal (folded before anything else) or not (each
text has a set of its own); an empty table gives an empty result; other columns
are ignored.  Shingles are compared as 64-bit hashes, chained word by word
(``textarrays``), so a wrong match needs two of a pair's few hundred to collide by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as A
from .batches import in_small_batches, slices, tidied
from .components import connected_components, ensure_checkpoint_dir, release
from .skew import join_salted

COORDS = 64
ROUNDS = 3
HUBS = 2
BLOCK = 512
TEXT = 1_000_000  # bytes of text, or of shingle sets, that a task holds at once
SEED = 0xA24BAED4963EE407
MANY = 20_000_000  # so many small rows are no burden to a task, even if one key holds them all; beyond, joins are salted
SMALL = 64  # products of class sizes up to which pairs are compared one by one


def least_matches(threshold: float, coords: int = COORDS, miss: float = 1e-9) -> int:
    """The largest T such that a pair at the threshold agrees in fewer with chance below ``miss``."""
    below, t = 0.0, 0
    while True:
        below += math.comb(coords, t) * threshold**t * (1 - threshold) ** (coords - t)
        if below > miss:
            return max(t, 1)
        t += 1


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ordered within each, and offsets."""
    data, offsets = A.buffers(column)
    sets, sizes = [], []
    for _, part, offs in A.chunks(A.lower_ascii(data), offsets):
        starts, ends, doc = A.words(part, offs)
        words = A.word_hashes(part, starts, ends)
        n = np.bincount(doc, minlength=len(offs) - 1)
        h = A.chained(words, size, SEED)
        ok = doc[: len(h)] == doc[size - 1 :] if len(h) else np.zeros(0, bool)
        few = np.flatnonzero((n > 0) & (n < size))
        first = np.cumsum(n) - n
        whole = A.mix(n[few].astype(A.U64) + A.U64(SEED))
        for k in range(size - 1):
            more = n[few] > k
            whole[more] = A.mix(whole[more] ^ words[first[few[more]] + k])
        h = np.concatenate((h[ok], whole))
        row = np.concatenate((doc[: len(ok)][ok], few))
        order = np.lexsort([h, row])
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        sets.append(h[new])
        sizes.append(np.bincount(row[new], minlength=len(offs) - 1))
    flat = np.concatenate(sets or [np.zeros(0, A.U64)])
    return flat, np.concatenate(([0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)])))).astype(np.int64)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = A.mix(np.arange(1, 2 * COORDS + 1, dtype=A.U64) * A.U64(A.BYTE_BASE))
    return seeds[:COORDS] | A.U64(1), seeds[COORDS:]


def signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COORDS minima of 32 bits for each non-empty set."""
    times, plus = _multipliers()
    out = np.empty((len(offsets) - 1, COORDS), np.uint32)
    for k in range(COORDS):
        h = flat * times[k] + plus[k]
        h ^= h >> A.U64(29)
        out[:, k] = np.minimum.reduceat(((h * A.U64(0xBF58476D1CE4E5B9)) >> A.U64(32)).astype(np.uint32), offsets[:-1])
    return out


def digests(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits for each set, from sums over its items."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, 2), A.U64)
    if len(full):
        out[full, 0] = np.add.reduceat(A.mix(flat ^ A.U64(0x5851F42D4C957F2D)), offsets[:-1][full])
        out[full, 1] = np.add.reduceat(A.mix(flat + A.U64(0x14057B7EF767814F)), offsets[:-1][full])
    return pa.array([d.tobytes() for d in out], pa.binary())


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest, values (coordinate-value pairs) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT, 500):
                flat, offsets = shingle_sets(part.column("text"), size)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                values = np.zeros((len(n), COORDS), np.int64)
                if len(full):
                    sig = signatures(flat, np.append(offsets[:-1][full], len(flat)))
                    values[full] = sig.astype(np.int64) | (np.arange(COORDS, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        digests(flat, offsets),
                        pa.array([v if k else [] for v, k in zip(values, n)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "digest", "values"],
                )

    return docs.mapInArrow(tidied(run), "doc_id long, n long, digest binary, values array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest and items: the set as ordered 64-bit hashes; equal rows of a batch are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(np.arange(batch.num_rows))
            first = pa.table([batch.column("doc_id"), batch.column("text"), place], ["doc_id", "text", "at"]).group_by(["doc_id", "text"]).aggregate([("at", "min")])
            if first.num_rows < batch.num_rows:
                batch = batch.take(first["at_min"].combine_chunks())
            for part in slices(batch, TEXT, 500):
                flat, offsets = shingle_sets(part.column("text"), size)
                raw = flat.tobytes()
                items = pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), digests(flat, offsets), items], names=["doc_id", "n", "digest", "items"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, digest binary, items binary")


def _similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, least: int, many: bool) -> DataFrame:
    """The pairs (a, b) that agree in ``least`` coordinates or more and whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"), F.col("signature").alias("xs"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"), F.col("signature").alias("ys"))
    collisions = F.aggregate(F.zip_with("xs", "ys", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), A.U64) for v in (x, y))
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    good[i] = _similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    if many:  # a hub may stand in the pairs of a third of all documents
        pairs = pairs.select("a", "b").checkpoint()
        popular = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("w"))
        met = join_salted(pairs.join(left, "a"), popular.join(right, "b"), ["b"], "w", ["a"], pairs.count())
    else:
        met = pairs.select("a", "b").join(left, "a").join(right, "b")
    matched = met.filter(collisions >= least)
    return matched.select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def _hub_pairs(now: DataFrame, turn: int, posted: int) -> DataFrame:
    """Pairs (a, b): each document with the hubs of other classes that it collides with most."""
    # First the documents that agree with most others, later any.
    rank = F.struct(-F.col("fame"), "head", "doc_id") if turn == 0 else F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id")
    hubs = (
        now.groupBy("value")
        .agg(F.min_by(F.struct("doc_id", "label"), rank).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("w"))
        .filter("lo < hi")
        .select("value", "hub", "w")
    )
    met = (join_salted(now, hubs.checkpoint(), ["value"], "w", ["doc_id"], posted) if posted > MANY else now.join(hubs, "value")).filter("label != hub.label").groupBy("doc_id", F.col("hub.doc_id").alias("b")).count()
    best = Window.partitionBy("doc_id").orderBy(F.col("count").desc(), "b")
    return met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= HUBS).select(F.col("doc_id").alias("a"), "b")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Linked documents join the class of their hub, and classes that of their first document.

    Two documents of one class stay connected; classes may still be parted.
    """
    of_hub = links.join(label.select(F.col("doc_id").alias("b"), F.col("label").alias("to")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("to").alias("to"))
    moved = label.join(of_hub, "doc_id", "left").select("doc_id", F.coalesce("to", "label").alias("label"))
    ahead = moved.select(F.col("doc_id").alias("label"), F.col("label").alias("next"))
    return moved.join(ahead, "label", "left").select("doc_id", F.coalesce("next", "label").alias("label"))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for part in slices(batch, TEXT, 500, "items"):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
            n = np.array([len(x) for x in sets])
            row = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), part.column("label").take(pa.array(row)), pa.array(n[row]), pa.array(np.concatenate(sets))],
                names=["doc_id", "label", "n", "item"],
            )


def _rest(lists: DataFrame, label: DataFrame, sets: DataFrame, percent: int, least: int, many: bool) -> DataFrame:
    """Links between classes that still meet under a value, all of them compared.

    The documents of such classes post their shingles themselves.  A document of n
    shingles has a link into another class only if that class's documents hold
    percent * n / 100 of them or more; of the c that any other class holds, it is
    enough to meet under the rarest c - percent * n / 100 + 1.
    """
    classes = lists.join(label, "doc_id").select("value", "label").distinct()
    values = classes.groupBy("value").count().filter("count > 1").select("value")
    meeting = classes.join(values, "value").select("label").distinct()
    open_ = label.join(meeting, "label").join(sets, "doc_id").select("doc_id", "label", "items", "signature").checkpoint()
    posts = open_.drop("signature").mapInArrow(tidied(_explode), "doc_id long, label long, n long, item long")
    held = posts.groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("df"))
    between = held.filter("lo < hi").select("item", "df", F.col("df").alias("w"))
    ranked = (
        (join_salted(posts, between.checkpoint(), ["item"], "w", ["doc_id"]) if many else posts.join(between, "item"))
        .groupBy("doc_id", "label", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("held"))
    )
    needed = F.ceil(F.col("n") * percent / 100).cast("int")
    rare = F.slice("held", 1, F.size("held") - needed + 1)
    prefix = ranked.filter(F.size("held") >= needed).select("label", "n", F.size("held").alias("c"), F.explode(rare).alias("p"))
    # What a class's documents under an item have at best: the fewest shingles, the most shared ones.
    under = prefix.groupBy(F.col("p.item").alias("item"), "label").agg(F.min("n").alias("n"), F.max("c").alias("c")).checkpoint()
    side = lambda x: under.select("item", F.col("label").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"))
    # A link shares percent / (100 + percent) of both sizes, and no more than either side shares with others.
    possible = (100 + percent) * F.least("cp", "cq") >= percent * (F.col("np") + F.col("nq"))
    met = side("p").join(side("q"), "item").filter((F.col("p") < F.col("q")) & possible).select("p", "q").distinct()
    count = label.groupBy("label").count()
    sized = met.join(count.select(F.col("label").alias("p"), F.col("count").alias("np")), "p").join(
        count.select(F.col("label").alias("q"), F.col("count").alias("nq")), "q"
    )
    swap = F.col("np") > F.col("nq")
    tests = sized.select(
        F.when(swap, F.col("q")).otherwise(F.col("p")).alias("small"),
        F.when(swap, F.col("p")).otherwise(F.col("q")).alias("large"),
        F.least("np", "nq").alias("few"),
        F.greatest("np", "nq").alias("many"),
    ).checkpoint()
    # Small classes are compared pair by pair.
    a, b = (label.select(F.col("doc_id").alias(x), F.col("label").alias(y)) for x, y in (("a", "small"), ("b", "large")))
    little = F.col("few") * F.col("many") <= SMALL
    direct = _verified(tests.filter(little).join(a, "small").join(b, "large").select("a", "b"), open_, percent, least, many)
    # The documents of the smaller class, in chunks, against a larger one, in blocks.
    tests = tests.filter(~little)
    per = tests.groupBy("large").agg(F.sum("few").alias("asked"), F.max("many").alias("size"))
    per = per.select("large", F.ceil(F.col("asked") / BLOCK).cast("int").alias("chunks"), F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    full = open_.drop("signature")
    queries = (
        tests.select("small", "large")
        .join(per, "large")
        .join(full.withColumnRenamed("label", "small"), "small")
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("large", "part", "chunk", F.lit(0).alias("side"), "doc_id", "items")
    )
    members = (
        per.join(full.withColumnRenamed("label", "large"), "large")
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("large", "part", "chunk", F.lit(1).alias("side"), "doc_id", "items")
    )
    blocks = queries.unionByName(members).groupBy("large", "part", "chunk").applyInPandas(tidied(_compare_blocks(percent)), "a long, b long")
    return direct.unionByName(blocks).checkpoint()


def _compare_blocks(percent: int):
    """One task a block: queries (side 0) against members (side 1), on full sets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group["side"] == s] for s in (0, 1)]
        ids = [s["doc_id"].to_numpy() for s in sides]
        sets = [[np.frombuffer(x, A.U64) for x in s["items"]] for s in sides]
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(ids[0]) or not len(ids[1]):
            return none
        size = [np.array([len(x) for x in s]) for s in sets]
        held = np.concatenate(sets[1])
        owner = np.repeat(np.arange(len(sets[1])), size[1])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        out = []
        for i, own in enumerate(sets[0]):
            lo, hi = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            k = hi - lo
            at = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            inter = np.bincount(owner[at], minlength=len(sets[1]))
            good = np.flatnonzero(_similar(inter, size[0][i], size[1], percent) & (ids[1] != ids[0][i]))
            out.append(pd.DataFrame({"a": np.full(len(good), ids[0][i]), "b": ids[1][good]}))
        # Links of one query to one block are as good as one: the block's documents share a class.
        found = pd.concat(out)
        return found.groupby("a", as_index=False)["b"].min() if len(found) else none

    return run


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    ensure_checkpoint_dir(docs.sparkSession)
    least = least_matches(percent / 100)
    picked = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = _sketch(picked, size).checkpoint()
    # One row for each id and set; repeated rows are folded before they meet anything.
    named = sketched.filter("doc_id is not null and n > 0")
    folded = named.select("doc_id", "digest", "n").distinct()
    # Representatives of equal sets: the smallest id stands for all.  An id with several texts has several sets,
    # so sets get numbers of their own, which the checkpoint fixes.
    heads = folded.groupBy("digest", "n").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    member = join_salted(folded, heads.drop("node"), ["digest", "n"], "copies", ["doc_id"])
    copies = member.filter("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    key = ["head", "digest", "n"]
    chosen = heads.select(*key, "node")
    reps = named.withColumnRenamed("doc_id", "head").dropDuplicates(key).join(chosen, key).select(*key, F.col("node").alias("doc_id"), "values")
    posts = reps.select("doc_id", "head", F.explode("values").alias("value"))
    shared = posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumn("w", F.col("df"))
    # Rarest first; documents with too few shared values cannot reach ``least`` matches.
    met = join_salted(posts, shared.checkpoint(), ["value"], "w", ["doc_id"]) if heads.count() * COORDS > MANY else posts.join(shared, "value")
    held = met.groupBy("doc_id", "head").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    rare = F.slice("held", 1, F.size("held") - (least - 1))
    fame = F.aggregate("held", F.lit(0).cast("long"), lambda total, x: total + x["df"]).alias("fame")
    prefix = held.filter(F.size("held") >= least).select("doc_id", "head", fame, F.explode(rare).alias("p"))
    lists = prefix.select("doc_id", "head", "fame", F.col("p.value").alias("value")).checkpoint()
    posted = lists.count()
    many = posted > MANY
    wanted = lists.select("doc_id").distinct()
    short = F.transform("values", lambda x: x.bitwiseAND(F.lit(127)).cast("byte"))  # enough to count agreement from above
    asked = chosen.join(wanted.withColumnRenamed("doc_id", "node"), "node", "left_semi").select(F.col("head").alias("doc_id")).distinct()
    full = _sets(picked.join(asked, "doc_id"), size).withColumnRenamed("doc_id", "head").dropDuplicates(key)
    sets = full.join(reps.select(*key, "doc_id", short.alias("signature")), key).select("doc_id", "items", "signature").checkpoint()
    label = wanted.select("doc_id", F.col("doc_id").alias("label")).checkpoint()
    release(docs.sparkSession)
    links = None
    for turn in range(ROUNDS):
        found = _verified(_hub_pairs(lists.join(label, "doc_id"), turn, posted), sets, percent, least, many).checkpoint()
        links = found if links is None else links.unionByName(found)
        label = _joined(label, found).checkpoint()
        release(docs.sparkSession)
    label = connected_components(wanted, links).checkpoint()
    links = links.unionByName(_rest(lists, label, sets, percent, least, many))
    release(docs.sparkSession)
    side = lambda x: chosen.select(F.col("node").alias(x), F.col("head").alias(f"of_{x}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    component = connected_components(folded.select("doc_id").distinct(), between.unionByName(copies))
    return (
        sketched.select("doc_id", F.col("n").alias("n_shingles"))
        .join(component.withColumnRenamed("label", "component_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
