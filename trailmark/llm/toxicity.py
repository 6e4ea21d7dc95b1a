"""Toxicity of whole texts: a bidirectional gated recurrent network over overlapping windows.

A text is a list of words: runs of letters, digits and non-ASCII bytes with A-Z
lower-cased; a word of more than ``LETTERS`` bytes counts as several.  A word's input to
the network has two parts: a vector of its own, if it is one of at most ``VOCABULARY``
words that a share of ``COMMON`` of the sample's texts hold, and what a character network
(bidirectional, with attention pooling, over bytes with the two before them) makes of
its spelling.  A word network of the same kind reads windows
of ``WIDTH`` words, one every ``STRIDE``, and its pooled states give a logit.  A text's score
is the highest of all its windows.

Labels belong to texts, not to windows.  At first all windows of a toxic text count as
toxic; a network trained on that tells which of them stand out from the windows of
clean texts, and a new one is trained on these, and on the clean windows that scored
highest, ``len(ABOVE)`` times.  At last the bias is moved so that the texts of the sample
part at a score of ``CUT``.

Scoring runs in Spark tasks, for every window of every text.  Training takes a bounded
sample to the driver, drawn by a hash of the id: about ``rows`` labelled documents, a
quarter of them toxic if there are as many, and up to ``WINDOWS`` windows, spread evenly, of each.

Defined cases: null texts and texts without a word have one empty window; labels that
are null teach nothing; a document is toxic if any of its labels says so; without
both classes every score is 0; rows with a null id are scored and never learned from;
repeated rows score alike; an empty table gives an empty result; other columns are
ignored unless carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as A
from .batches import in_small_batches, slices, tidied, tidy
from .gru import F32, Layer, sigmoid, summed

WIDTH, STRIDE = 32, 16
LETTERS = 24
VOCABULARY = 4096
CHARACTERS = 1 << 14
COMMON = 0.02  # of the sample's texts hold a word of the vocabulary
WINDOWS = 16
ABOVE = (0.95, 0.99, 0.998)  # of the clean windows score less than those that pass for toxic, turn by turn
HARD = 3000
LEAST_STEPS = 24
CUT = 0.7  # the score half-way between clean and toxic texts of the sample
STATES = 8  # of a direction, in both networks
TEXT = 2_000_000  # bytes of text that a task works on at once
AT_ONCE = 1024  # sequences


def _fold() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[48:58] = np.arange(48, 58)
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table


FOLD = _fold()


class Words(NamedTuple):
    """The words of some texts, and those that are distinct."""

    data: np.ndarray
    start: np.ndarray  # of the distinct words
    length: np.ndarray
    hashes: np.ndarray
    which: np.ndarray  # the distinct word of each word
    doc: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    folded = FOLD[data]
    start, end, doc = A.words(folded, offsets)
    pieces = -(-(end - start) // LETTERS)
    if (pieces > 1).any():
        piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end, doc = (np.repeat(x, pieces) for x in (start, end, doc))
        start = start + piece * LETTERS
        end = np.minimum(end, start + LETTERS)
    hashes, first, which = np.unique(A.word_hashes(folded, start, end), return_index=True, return_inverse=True)
    return Words(folded, start[first], (end - start)[first], hashes, which, doc)


def cut_windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of each window; the words of texts lie end to end."""
    n = 1 + np.maximum(0, -(-(n_words - WIDTH) // STRIDE))
    doc = np.repeat(np.arange(len(n)), n)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return doc, (np.cumsum(n_words) - n_words)[doc] + at, np.minimum(WIDTH, n_words[doc] - at)


class Model(NamedTuple):
    vocabulary: np.ndarray  # hashes, ordered; row 0 of word_t is for all other words
    weights: dict[str, np.ndarray]


def blank(words: int, seed: int) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), STATES
    draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(F32)
    w = {"out": draw(0.3, 2 * h), "bias": np.zeros(1, F32)}
    for name, rows, scale in (("char", CHARACTERS, 0.1), ("word", words + 1, 0.1)):
        w[f"{name}_v"] = draw(0.3, 2 * h)
        for k in "01":
            w[f"{name}_u{k}"] = draw(h**-0.5, h, 3 * h)
            w[f"{name}_t{k}"] = draw(scale, rows, 3 * h)
    for k in "01":
        w[f"spell{k}"] = draw(0.3, 2 * h, 3 * h)
    return w


def rows_of(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _letters(words: Words, order: np.ndarray) -> np.ndarray:
    """The characters of some words, [place, word]: each byte with the two before it, hashed to ``CHARACTERS`` rows."""
    step = np.arange(int(words.length[order[0]]))[:, None]
    place = np.minimum(words.start[order][None, :] + step, len(words.data) - 1)
    out = words.data[place].astype(np.uint32)
    byte = out.copy()
    for back, times in ((1, 0x9E3779B1), (2, 0x85EBCA77)):
        out[back:] += (byte[:-back] + np.uint32(1)) * np.uint32(times)
    return ((out * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - CHARACTERS.bit_length() + 1)).astype(np.int64)


def word_tables(model: Model, words: Words) -> list[np.ndarray]:
    """The input of each distinct word to both directions of the word network."""
    w, layer = model.weights, Layer(model.weights, "char")
    spelt = np.zeros((len(words.start), 2 * STATES), F32)
    order = np.argsort(-words.length, kind="stable")
    for at in range(0, len(order), AT_ONCE):
        part = order[at : at + AT_ONCE]
        spelt[part] = layer.pool([w["char_t0"], w["char_t1"]], _letters(words, part), words.length[part])
    row = rows_of(model.vocabulary, words.hashes)
    return [w[f"word_t{k}"][row] + spelt @ w[f"spell{k}"] for k in "01"]


def _sequences(words: Words, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    place = first[None, :] + np.arange(int(length[0]))[:, None]
    return words.which[np.minimum(place, max(0, len(words.which) - 1))] if len(words.which) else np.zeros(place.shape, np.int64)


def window_scores(model: Model, words: Words, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    tables = word_tables(model, words)
    layer, out = Layer(model.weights, "word"), np.empty(len(first), F32)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), AT_ONCE):
        part = order[at : at + AT_ONCE]
        pooled = layer.pool(tables, _sequences(words, first[part], length[part]), length[part])
        out[part] = sigmoid(pooled @ model.weights["out"] + model.weights["bias"])
    return out


def text_scores(model: Model, column: pa.Array) -> np.ndarray:
    """The highest score of each text's windows."""
    data, offsets = A.buffers(column)
    out = np.zeros(len(offsets) - 1)
    for at, part, offs in A.chunks(data, offsets, TEXT):
        words = read_words(part, offs)
        doc, first, length = cut_windows(np.bincount(words.doc, minlength=len(offs) - 1))
        begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        out[at : at + len(offs) - 1] = np.maximum.reduceat(window_scores(model, words, first, length), begins)
    return out


def gradients(model: Model, words: Words, first: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy of some windows."""
    w = model.weights
    grads = {name: np.zeros_like(x) for name, x in w.items()}
    used, inverse = np.unique(np.concatenate([words.which[a : a + n] for a, n in zip(first, length)] or [words.which[:0]]), return_inverse=True)
    own = words._replace(start=words.start[used], length=words.length[used], hashes=words.hashes[used], which=inverse)
    by_length = np.argsort(-own.length, kind="stable")
    char, word, kept_char, kept_word = Layer(w, "char"), Layer(w, "word"), {}, {}
    spelt = np.zeros((len(used), 2 * STATES), F32)
    if len(used):
        spelt[by_length] = char.pool([w["char_t0"], w["char_t1"]], _letters(own, by_length), own.length[by_length], kept_char)
    row = rows_of(model.vocabulary, own.hashes)
    tables = [w[f"word_t{k}"][row] + spelt @ w[f"spell{k}"] for k in "01"]
    begin = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    pooled = word.pool(tables, _sequences(own, begin[order], length[order]), length[order], kept_word)
    d = ((sigmoid(pooled @ w["out"] + w["bias"]) - label[order]) * weight[order]).astype(F32)
    grads["out"] += pooled.T @ d
    grads["bias"] += d.sum()
    d_tables = word.back(d[:, None] * w["out"], kept_word, [len(used)] * 2, grads)
    d_spelt = np.zeros_like(spelt)
    for k, dt in zip("01", d_tables):
        grads[f"word_t{k}"] += summed(dt, row, len(w[f"word_t{k}"]))
        grads[f"spell{k}"] += spelt.T @ dt
        d_spelt += dt @ w[f"spell{k}"].T
    if len(used):
        for k, dt in zip("01", char.back(d_spelt[by_length], kept_char, [CHARACTERS] * 2, grads)):
            grads[f"char_t{k}"] += dt
    return grads


def train(windows: list[bytes], bag: np.ndarray, toxic: np.ndarray, batch: int = 256, rate: float = 0.02, seed: int = 11) -> Model:
    """A model from windows (words with blanks between), the text that each is of, and that text's label."""
    offsets = np.cumsum([0] + [len(x) for x in windows])
    words = read_words(np.frombuffer(b"".join(windows), np.uint8), offsets)
    length = np.bincount(words.doc, minlength=len(windows))
    first = np.cumsum(length) - length
    held = Counter(which for _, which in set(zip(bag[words.doc].tolist(), words.which.tolist())))
    least = max(2, int(COMMON * (bag.max() + 1)))
    common = sorted((x for x in held if held[x] >= least), key=lambda x: (-held[x], words.hashes[x]))[:VOCABULARY]
    vocabulary = np.sort(words.hashes[np.array(common, np.int64)])
    rng, clean, dirty = np.random.default_rng(seed), np.flatnonzero(~toxic), np.flatnonzero(toxic)
    positive, negative = dirty, rng.choice(clean, min(len(clean), len(dirty)), replace=False)
    for turn, above in enumerate((*ABOVE, None)):
        model = Model(vocabulary, blank(len(vocabulary), seed + turn))
        use = np.concatenate((positive, negative))
        label = np.repeat(np.array([1, 0], F32), (len(positive), len(negative)))
        weight = np.repeat(np.array([0.5 / len(positive), 0.5 / len(negative)], F32), (len(positive), len(negative)))
        epochs = max(1 if above else 2, -(-LEAST_STEPS * batch // len(use)))
        descend(model, words, first[use], length[use], label, weight, epochs, batch, rate, rng)
        scores = window_scores(model, words, first, length)
        if above:
            # Windows of toxic texts that stand out from those of clean ones; clean ones that are hardest, and any.
            sure = dirty[scores[dirty] > np.quantile(scores[clean], above)]
            positive = sure if len(sure) else dirty[[scores[dirty].argmax()]]
            hardest = clean[np.argsort(-scores[clean], kind="stable")[:HARD]]
            negative = np.union1d(hardest, rng.choice(clean, min(len(clean), HARD), replace=False))
    best = np.zeros(int(bag.max()) + 1, F32)
    np.maximum.at(best, bag, scores)
    is_toxic = np.zeros(len(best), bool)
    is_toxic[bag] = toxic
    logit = lambda p: np.log(p / (1 - p))
    low, high = (logit(np.clip(np.quantile(best[part], q), 1e-6, 1 - 1e-6)) for part, q in ((~is_toxic, 0.995), (is_toxic, 0.05)))
    model.weights["bias"] += F32(logit(CUT) - (low + high) / 2)
    return model


def descend(
    model: Model, words: Words, first: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int, batch: int, rate: float, rng: np.random.Generator
) -> None:
    """Changes the weights by Adam's rule, in shuffled batches, at a falling rate."""
    mean, spread = ({n: np.zeros_like(x) for n, x in model.weights.items()} for _ in range(2))
    some = [x for _ in range(epochs) for x in np.array_split(rng.permutation(len(first)), -(-len(first) // batch))]
    for step, part in enumerate(some, 1):
        slow = rate * (1.05 - step / len(some))
        grads = gradients(model, words, first[part], length[part], label[part], weight[part] * F32(len(first) / len(part)))
        for n, g in grads.items():
            mean[n] += F32(0.1) * (g - mean[n])
            spread[n] += F32(0.002) * (g * g - spread[n])
            model.weights[n] -= (F32(slow / (1 - 0.9**step)) * mean[n] / (np.sqrt(spread[n] / F32(1 - 0.998**step)) + F32(1e-6))).astype(F32)


def fit(
    docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 2000, seed: int = 11
) -> Model | None:
    """A model from a sample of about ``rows`` labelled documents whose id satisfies ``teaches``; None without both classes."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & teaches).groupBy(F.col(id_col).alias("of")).agg((F.max(label_col) == 1).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    few = min(counts[True], rows // 4)
    shares = (few / counts[True], min(1.0, (rows - few) / counts[False]))
    draw = F.xxhash64("of", F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    texts = in_small_batches(docs).select(F.col(id_col).alias("of"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Ids are drawn on both sides, so only the sample's texts are shuffled.
    drawn = known.filter(draw < F.when(F.col("toxic"), shares[0]).otherwise(shares[1]))
    picked = texts.filter(draw < max(shares)).join(drawn, "of").select("text", "toxic")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT):
                data, offsets = A.buffers(part.column("text"))
                words = read_words(data, offsets)
                doc, first, length = cut_windows(np.bincount(words.doc, minlength=part.num_rows))
                out = []
                for i in range(part.num_rows):
                    own = np.flatnonzero(doc == i)
                    chosen = own[np.unique(np.linspace(0, len(own) - 1, min(WINDOWS, len(own))).astype(int))]
                    spelt = [[words.data[words.start[x] : words.start[x] + words.length[x]].tobytes() for x in words.which[first[k] : first[k] + length[k]]] for k in chosen]
                    out.append([b" ".join(x) for x in spelt])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())), part.column("toxic")], names=["windows", "toxic"])

    taken = picked.mapInArrow(tidied(cut), "windows array<binary>, toxic boolean").toArrow().to_pylist()
    taken.sort(key=lambda r: (r["windows"], r["toxic"]))  # the same however rows arrive
    if len({r["toxic"] for r in taken}) < 2:
        return None
    size = [len(r["windows"]) for r in taken]
    bag = np.repeat(np.arange(len(taken)), size)
    model = train([x for r in taken for x in r["windows"]], bag, np.repeat(np.array([r["toxic"] for r in taken], bool), size))
    del taken
    tidy()
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1), rest (the carried columns)."""
    picked = in_small_batches(docs).select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.lit(None).cast("int").alias("rest"),
    )
    schema = T.StructType([picked.schema["doc_id"], T.StructField("score", T.DoubleType()), picked.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT):
                found = text_scores(model, part.column("text")) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.astype(np.float64)), part.column("rest")], names=["doc_id", "score", "rest"])

    return picked.mapInArrow(tidied(run), schema)
