"""The toxicity network against a plain version, its gradients, and its accuracy on texts that it has not seen."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trailmark.llm import queries as Q
from trailmark.llm import toxicity as X

TEXTS = ["the idiot went home", "a bc THE the zz", "x", "", "Home bc, went; the a idiot x q", "é漢字 " * 45, "w" * 70 + " tail", "one two " * 40 + "idiot"]


def words_of(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(x) for x in raw])
    return X.read_words(np.frombuffer(b"".join(raw), np.uint8), offsets), offsets


def some_model(words, n=6, seed=1):
    return X.Model(np.sort(words.hashes[:n]), X.blank(min(n, len(words.hashes)), seed))


def plain_words(text):
    folded = re.sub(rb"[^a-z0-9\x80-\xff]", b" ", text.encode().lower())
    return [w[i : i + X.LETTERS] for w in folded.split() for i in range(0, len(w), X.LETTERS)]


def plain_pool(w, name, inputs):
    """One sequence, one step at a time; ``inputs`` are the rows of both directions."""
    if not inputs:
        return np.zeros(2 * X.STATES)
    h, squash, states = X.STATES, lambda x: 1 / (1 + np.exp(-x)), []
    for k, order in (("0", range(len(inputs))), ("1", range(len(inputs) - 1, -1, -1))):
        state, seen = np.zeros(h), {}
        for t in order:
            x, own = inputs[t][int(k)].astype(float), state @ w[f"{name}_u{k}"].astype(float)
            z, r = squash(x[:h] + own[:h]), squash(x[h : 2 * h] + own[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * own[2 * h :])
            state = seen[t] = (1 - z) * new + z * state
        states.append([seen[t] for t in range(len(inputs))])
    both = np.concatenate(states, axis=1)
    share = np.exp(4 * np.tanh(both @ w[f"{name}_v"]))
    return (share / share.sum()) @ both


def plain_score(model, words, text):
    """Every window of a text by itself."""
    w = model.weights
    known = {words.data[a : a + n].tobytes(): int(r) for a, n, r in zip(words.start, words.length, X.rows_of(model.vocabulary, words.hashes))}

    def vector(word):
        codes = []
        for t in range(len(word)):
            code = word[t]
            for back, times in ((1, 0x9E3779B1), (2, 0x85EBCA77)):
                code += (word[t - back] + 1) * times if t >= back else 0
            codes.append((code * 0xC2B2AE3D % 2**32) >> 18)
        spelt = plain_pool(w, "char", [(w["char_t0"][c], w["char_t1"][c]) for c in codes])
        return tuple(w[f"word_t{k}"][known.get(word, 0)] + spelt @ w[f"spell{k}"] for k in "01")

    own, scores, at = [vector(x) for x in plain_words(text)], [], 0
    while True:
        pooled = plain_pool(w, "word", own[at : at + X.WIDTH])
        scores.append(1 / (1 + np.exp(-(pooled @ w["out"] + w["bias"][0]))))
        if at + X.WIDTH >= len(own):
            return max(scores)
        at += X.STRIDE


def test_scores_as_one_window_at_a_time(monkeypatch):
    words, _ = words_of(TEXTS)
    model = some_model(words)
    want = [plain_score(model, words, t) for t in TEXTS]
    assert np.allclose(X.text_scores(model, pa.array([*TEXTS, None])), [*want, want[3]], atol=1e-5)
    monkeypatch.setattr(X, "AT_ONCE", 3)
    monkeypatch.setattr(X, "TEXT", 50)
    assert np.allclose(X.text_scores(model, pa.array(TEXTS)), want, atol=1e-5)


def test_gradients():
    words, offsets = words_of([t + " " for t in TEXTS[:6]])
    length = np.bincount(words.doc, minlength=6)
    first, label, weight = np.cumsum(length) - length, np.array([1, 0, 0, 1, 1, 0], np.float32), np.full(6, 1 / 6, np.float32)
    model = some_model(words)
    grads = X.gradients(model, words, first, length, label, weight)

    def loss():
        s = X.window_scores(model, words, first, length).astype(float)
        return float((-(label * np.log(s) + (1 - label) * np.log(1 - s)) * weight).sum())

    for name, w in model.weights.items():
        for i in np.argsort(-np.abs(grads[name]).ravel())[:3]:
            at = np.unravel_index(i, w.shape)
            old, losses = w[at], []
            for step in (0.01, -0.01):
                w[at] = old + np.float32(step)
                losses.append(loss())
            w[at] = old
            assert abs((losses[0] - losses[1]) / 0.02 - grads[name][at]) < 1e-4 + 0.02 * abs(grads[name][at]), name


def test_windows_cover_every_word():
    n = np.array([0, 1, 31, 32, 33, 48, 49, 200])
    doc, first, length = X.cut_windows(n)
    for i, (size, begin) in enumerate(zip(n, np.cumsum(n) - n)):
        own = [(a - begin, a - begin + k) for a, k in zip(first[doc == i], length[doc == i])]
        assert set().union(*(range(a, b) for a, b in own)) == set(range(size)) and own[0][0] == 0
        assert all(b[0] - a[0] == X.STRIDE for a, b in zip(own, own[1:])) and all(b - a <= X.WIDTH for a, b in own)


def made_texts(n, seed):
    """Every fifth text is toxic: a few of its words are of a list, or have one of two stems."""
    rng = random.Random(seed)
    parts = "an be con da el fi go hu in jo ka le mo ne or pa qui ra se ti u ve wo".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(30, 400))]
        for _ in range(max(2, len(text) // 40) if i % 5 == 0 else 0):
            text[rng.randrange(len(text))] = rng.choice(["Gruk", "BLARN!", "zyx" + word(), "kweff" + word()])
        out.append((i, " ".join(text), int(i % 5 == 0)))
    return out


def test_learns_what_makes_a_text_toxic(spark):
    rows = made_texts(900, 4)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, "gruk blarn gruk", ""), (1, rows[1][1], ""), (9000, None, ""), (9001, " .,\n", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows if i < 600] + [(None, 1, 1), (5, None, 1), (0, 0, 1)], "doc_id long, toxic int, quality int")
    model = X.fit(docs, labels, F.col("doc_id") < 600)
    again = X.fit(docs.repartition(3), labels, F.col("doc_id") < 600)
    assert all(np.array_equal(a, b) for a, b in zip(model.weights.values(), again.weights.values()))
    scored = X.score(docs, model, carry=["score"]).collect()
    assert len(scored) == 904 and all(0 <= r.score <= 1 for r in scored)
    score = {r.doc_id: r.score for r in scored}
    unseen = [(score[i] >= 0.7, y) for i, _, y in rows if i >= 600]
    assert sum(hit == (y == 1) for hit, y in unseen) >= 0.97 * len(unseen)
    assert all(hit for hit, y in unseen if y)
    assert score[9000] == score[9001] < 0.7 and len({r.score for r in scored if r.doc_id == 1}) == 1
    assert X.fit(docs, labels.limit(0), F.lit(True)) is None and X.fit(docs, labels.filter("toxic = 1"), F.lit(True)) is None
    assert X.score(docs, None).agg(F.max("score")).first()[0] == 0 and X.score(docs.limit(0), model).count() == 0


def test_toxicity_query(spark, sf_dir):
    rows = Q.op11_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows) and {r.held_out for r in rows} == {True, False}
