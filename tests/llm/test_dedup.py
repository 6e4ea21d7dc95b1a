import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import substring_dedup
from trailmark.llm.components import connected_components, ensure_checkpoint_dir
from trailmark.llm import minhash
from trailmark.llm.minhash import least_matches, near_duplicates
from trailmark.llm.skew import join_salted
from trailmark.llm.substring_dedup import remove_repeated_windows
from trailmark.llm.suffix_dedup import longest_previous, remove_repeated_bytes
from trailmark.llm.textarrays import in_order

from . import brute

SCHEMA = "doc_id long, text string, block int, rest string, shard string"


def make_docs(seed=1):
    """Copies, near copies, shared passages, periodic texts, nulls, empties, one long text."""
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefgé漢") * rng.randint(1, 3) + str(rng.randint(0, 60)) for _ in range(150)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = line(20), line(60)
    docs = [line(rng.randint(0, 40)) for _ in range(20)]
    docs += [f"{line(8)} {passage}\n{line(5)}\t {passage} {line(3)}" for _ in range(6)]
    docs += [base] * 4
    for k in (1, 2, 3, 6, 10, 25):
        words = base.split()
        for i in rng.sample(range(60), k):
            words[i] = "edit" + str(rng.random())
        docs.append(" ".join(words))
    docs += ["x y. " * 60, "x y. " * 75, "", None, " \t\n", "one", "one two", "ONE Two", line(4000), "a" * 30, "é" * 80, "é" * 81]
    rng.shuffle(docs)
    return list(enumerate(docs, start=3))


@pytest.fixture(scope="module")
def docs():
    return make_docs()


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 7, "kept", "clash") for d, t in docs], SCHEMA).repartition(3)


def test_windows(spark, docs):
    got = remove_repeated_windows(frame(spark, docs), 13, carry=["block", "rest"]).collect()
    want = brute.cut_windows(docs, 13)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    assert all((r.rest.block, r.rest.rest) == (7, "kept") for r in got)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert sum(r.n_removed > 0 for r in got) > 5


def test_bytes(spark, docs):
    got = remove_repeated_bytes(frame(spark, docs), 50, carry=["shard"]).collect()
    want = brute.cut_bytes(docs, 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want
    assert sum(r.n_removed > 0 for r in got) > 5


def test_bytes_on_characters(spark, docs):
    for r in remove_repeated_bytes(frame(spark, docs), 50, whole_characters=True).collect():
        bytes(r.kept).decode()


def thue_morse(n):
    """Two words of n letters that collide under every polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_under_polynomials(spark, n):
    one, other = thue_morse(n)
    line = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{one} {line}"), (2, f"{other} {line}"), (3, f"{one} {line}"), (4, f"{one} {other} {one} {other} {one} {other}")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = remove_repeated_windows(rows, 13).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute.cut_windows(docs, 13)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows).collect()} == brute.near(docs)
    got = remove_repeated_bytes(rows, 50).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == brute.cut_bytes(docs, 50)


def test_messages():
    """Hashes survive their wire form, gaps of any size and equal hashes with two checks included."""
    rng = np.random.default_rng(2)
    h = np.concatenate((rng.integers(0, 1 << 63, 50, dtype=np.uint64), np.arange(5, dtype=np.uint64), np.zeros(2, np.uint64))) * np.uint64(2)
    c = np.concatenate((rng.integers(0, 1 << 24, 55).astype(np.uint32), np.array([7, 9], np.uint32)))
    order, new = in_order(h, c)
    pairs = sorted(zip(h.tolist(), c.tolist()))
    assert [(int(h[i]), int(c[i])) for i in order] == pairs and new.sum() == len(set(pairs))
    read = [substring_dedup._read(m) for _, _, m in substring_dedup._messages(h[order], c[order], 3)]
    assert [(int(a), int(b)) for hs, cs in read for a, b in zip(hs, cs)] == pairs


def test_longest_previous():
    rng = random.Random(6)
    for width in (3, 5):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(30)]
        data = "".join(texts).encode()
        starts, owner, at = [], [], 0
        for i, t in enumerate(texts):
            for k in range(len(t) - width + 1):
                starts.append(at + k), owner.append(i // 2)  # two texts of one owner
            at += len(t)
        got = longest_previous(np.frombuffer(data, np.uint8), np.array(starts), np.array(owner), width)
        window = lambda s: data[s : s + width]
        want = [width if any(o < own and window(t) == window(s) for t, o in zip(starts, owner)) else 0 for s, own in zip(starts, owner)]
        assert got.tolist() == want


def test_rows_of_one_id_keep_their_own_spans(spark):
    first, second = (" ".join(f"{w}{i}" for i in range(40)) for w in ("left", "right"))
    rows = [(1, first), (1, second), (7, first + " tail of seven"), (7, "head " + second), (7, "nothing shared")]
    got = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50).collect()
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got) == sorted([(1, first), (1, second), (7, " tail of seven"), (7, "head "), (7, "nothing shared")])


@pytest.mark.parametrize("few", [0, 1000])
def test_components_with_a_hub(spark, few):
    rng = random.Random(1)
    links = [(1000, i) for i in range(200)] + [(i, i + 1) for i in range(300, 340)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(40)]
    nodes = spark.range(1001).withColumnRenamed("id", "doc_id")
    ensure_checkpoint_dir(spark)
    got = connected_components(nodes, spark.createDataFrame(links, "a long, b long"), few)
    assert {r.doc_id: r.label for r in got.collect()} == brute.classes(range(1001), links)


def test_salted_join(spark):
    rows = spark.createDataFrame([(7, i) for i in range(900)] + [(i % 50 + 100, i) for i in range(100)], "k long, i long")
    keyed = rows.groupBy("k").agg(F.count("*").alias("w"), F.min("i").alias("least"))
    got = join_salted(rows, keyed, ["k"], "w", ["i"])
    assert got.columns == ["k", "i", "least"]
    assert got.exceptAll(rows.join(keyed.drop("w"), "k")).count() == 0 and got.count() == 1000


@pytest.mark.parametrize("cut", [remove_repeated_windows, remove_repeated_bytes])
def test_rows_without_or_with_equal_ids(spark, cut):
    text = " ".join(f"word{i}" for i in range(40))
    rows = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (9, text)], "doc_id long, text string")
    lost = sorted((r.doc_id or 0, r.n_removed > 0) for r in cut(rows).collect())
    assert lost == [(0, False), (0, False), (5, False), (5, False), (9, True)]
    assert cut(rows.limit(0)).count() == 0


def test_least_matches():
    assert least_matches(1.0) == 64 and 20 < least_matches(0.75) < 36


def test_near_duplicates(spark, docs):
    rows = frame(spark, docs).unionByName(spark.createDataFrame([(None, docs[0][1], 1, "", "")], SCHEMA))
    got = near_duplicates(rows).collect()
    named = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert named == brute.near(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert len({c for _, c in named.values()}) < len(named) - 5


def test_near_duplicates_in_a_varied_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for d in range(120):  # from hardly to heavily edited: links are not transitive here
        words = list(base)
        for i in rng.sample(range(80), rng.randint(0, 9)):
            words[i] = f"e{rng.randint(0, 10 ** 6)}"
        docs.append((d, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(docs)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in alone] == [(0, 1, True), (0, 2, True)]


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(4, text), (4, text), (6, text), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows).collect())
    assert got == [(4, 4, True), (4, 4, True), (6, 4, False), (8, 8, True)]
    assert near_duplicates(rows).agg(F.max("n_shingles")).first()[0] == 26


def test_near_duplicates_of_repeated_rows_and_of_an_id_with_many_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MANY", 0)  # joins of few rows are salted too
    text = " ".join(f"w{i}" for i in range(60))
    words = [[f"v{i}x{j}" for j in range(40)] for i in range(1000)]
    rows = [(17, text)] * 10_000 + [(19, text.replace("w59", "other")), (13, "nothing like it at all here")]
    rows += [(5, " ".join(w)) for w in words] + [(8, " ".join(words[700][:-1] + ["end"])), (9, " ".join(words[3])), (10, " ".join(reversed(words[3])))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(5, 5, True, 1000), (8, 5, False, 1), (9, 5, False, 1), (10, 10, True, 1), (13, 13, True, 1), (17, 17, True, 10_000), (19, 17, False, 1)]
