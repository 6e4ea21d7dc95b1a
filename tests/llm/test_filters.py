"""Filter interaction audit and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.llm import fill_in_middle as M
from trailmark.llm import filter_audit as A
from trailmark.llm import textarrays

DOCS = "doc_id long, text string, lang string, failed int, h string"
LABELS = "doc_id long, quality int, toxic int"


def plain_letters(rows):
    """The letters that each row fails, in the order of the rows."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "A" if len(words) < 100 else ""
        failed += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        failed += "D" if re.search(r"[#$%&*|]", text) else ""
        failed += "E" if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows) else ""
        out.append(failed)
    return out


def plain_audit(rows, labels):
    letters = plain_letters(rows)
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, letters) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == letter for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(shapley[letter])
    return out


def odd_rows():
    rng = random.Random(3)
    words = ["a", "B", "CC", "d#", "é", "\x85", "x\xa0y", "漢字", "%", "zz"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 10, 310])]) for _ in range(rng.choice([0, 1, 5, 99, 100, 130]))) for _ in range(60)]
    texts += [None, "", " \t\n", "\x0b".join(f"k{i}" for i in range(100)), "AB" * 50_000, "word " * 30_000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(400)]
    rows += [(None, texts[3], "en"), (None, texts[3], "en"), (7, rows[7][1], "de"), (7, rows[7][1], "de"), (-5, texts[0], None), (8, "another text of 8", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c) % 3])
def test_failures_also_where_hashes_collide(spark, digest):
    rows, _ = odd_rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS)
    want = sorted((repr((i, lang or "", f)) for (i, _, lang), f in zip(rows, plain_letters(rows))))
    got = [repr((r.doc_id, r.part, r.failed)) for r in A.failures(docs, digest=digest).collect() for _ in range(r.n)]
    assert sorted(got) == want


def test_audit_of_every_order(spark):
    rows, labels = odd_rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, LABELS)
    got = A.audit(A.combinations(A.failures(docs), marks)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == plain_audit(rows, labels)
    assert A.audit(A.combinations(A.failures(docs.limit(0)), marks)).count() == 0
    assert A.audit(A.combinations(A.failures(docs), marks.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_a_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    got = A.failures(docs).groupBy("failed").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in got} == {"A": 4001, "AE": 1999}
    assert A.exact_copies(docs.withColumn("h", F.length("text")).withColumn("part", F.lit(""))).count() == 1999


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text)


def test_marks_of_units():
    rng = random.Random(1)
    letters = list("aZz{[@` 0é漢😀\n\x7f\x80ÿ\0")
    for _ in range(150):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        data, offsets = textarrays.buffers(pa.array(texts))
        ends, starts = M.unit_ends(data, offsets)
        for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
            own, first = units(text), ends.rank(np.array([a]))
            assert ends.rank(np.array([b])) - first == len(own)
            for k in range(len(own) + 1):
                place = M._place(ends, np.array([a]), first, np.array([k]))
                assert data[a : place[0]].tobytes().decode() == "".join(own[:k])
                assert starts.rank(place) - starts.rank(np.array([a])) == len("".join(own[:k]))


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    own = units(text)
    a, b = sorted(x % (len(own) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(own), "plain", None, None, text
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    if h[3] % 100 < 20:
        return len(own), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(own), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_rows(spark):
    rng = random.Random(5)
    letters = list("abcXYZ  \n.,é漢😀\0") + ["<P", "P>", "<X>", "word "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += ["", None, "a", "é", "<M>", "x<P>y", "a" * 100_000, "é" * 40_000, "ab " * 500_000]
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(texts)] + [(None, "some text", "x", 0.0), (3, texts[3], "clash", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, h1 double")
    got = M.transform(docs.repartition(3), carry=["output", "h1"]).withColumn("restored", M.restore()).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, by_id[r.doc_id])
        assert r.restored == (by_id[r.doc_id] or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.transform(docs.limit(0)).count() == 0
