"""Language identification: the family first, then the language within it.

A text is described by the hashed two- and three-byte substrings of its letters
(A-Z lower-cased, runs of other ASCII bytes as one blank), counted over the whole text,
square-rooted and scaled to length 1.  Linear support vector machines, one
against the rest, pick the language family; within a family, one machine for
each pair of languages votes.

Counting runs in Spark tasks, for every document.  Training takes a bounded
sample of labelled rows to the driver, drawn by a hash of id and text, whole texts
each: ``per_language`` rows of a language on average, fewer where all languages
together would exceed ``rows``, but never fewer than ``LEAST_ROWS``.  Every language
with a labelled row is learned.  Languages whose code is not in ``FAMILIES`` are
grouped by how alike their texts are, into families of ``KIN`` at most, so the number
of machines grows with the number of languages, not with its square.  The model has
``DIM`` weights a machine and is shipped with the tasks.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language teach nothing; with no labelled row every text is
``und``; repeated rows are predicted alike; ids may be null; an empty table
gives an empty result; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as A
from .batches import in_small_batches, slices, tidied, tidy

DIM = 4096
TEXT = 500_000  # bytes of text that a task holds at once
LEAST_ROWS = 10
KIN = 8
CHUNK = 64  # texts counted at once; each takes DIM numbers several times over
#: The family of each language code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn mr ur pa gu ne si",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


class Model(NamedTuple):
    families: list[str]
    family_weights: np.ndarray  # families x (DIM + 1)
    languages: dict[str, list[str]]  # by family
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]  # by family: a positive margin speaks for the first


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table


FOLD = _fold()


def features(column: pa.Array) -> np.ndarray:
    """A row of DIM + 1 numbers for each text, the last one 1."""
    data, offsets = A.buffers(column)
    out = np.zeros((len(offsets) - 1, DIM + 1), np.float32)
    for at, part, offs in A.chunks(data, offsets, 500_000):
        body = FOLD[part].astype(np.uint32)
        row = np.repeat(np.arange(len(offs) - 1, dtype=np.int64), np.diff(offs))
        keep = np.ones(len(body), bool)  # one blank for a run of blanks
        keep[1:] = (body[1:] != 32) | (body[:-1] != 32) | (row[1:] != row[:-1])
        body, row = body[keep], row[keep]
        places = [np.zeros(0, np.int64)]
        for size in (2, 3):
            n = max(0, len(body) - size + 1)
            gram = np.zeros(n, np.uint32)
            for k in range(size):
                gram = gram * np.uint32(257) + body[k : n + k]
            gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - 12)
            same = row[:n] == row[size - 1 : size - 1 + n]
            places.append(row[:n][same] * DIM + gram[same])
        place = np.concatenate(places)
        for first in range(0, len(offs) - 1, CHUNK):
            n = min(CHUNK, len(offs) - 1 - first)
            own = place[(place >= first * DIM) & (place < (first + n) * DIM)] - first * DIM
            x = np.sqrt(np.bincount(own, minlength=n * DIM).reshape(n, DIM).astype(np.float32))
            out[at + first : at + first + n, :DIM] = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    out[:, DIM] = 1
    return out


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, c: float = 20.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; y is 1 or -1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, lead, before = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    step = 1 / (1 / c + 2 * 2.0)  # rows have length sqrt(2)
    for _ in range(rounds):  # accelerated gradient descent
        slack = np.maximum(0, 1 - y * (x @ lead.astype(x.dtype)))
        new = lead - step * (lead / c - 2 * ((weight * y * slack).astype(x.dtype) @ x))
        after = (1 + np.sqrt(1 + 4 * before * before)) / 2
        lead = new + (before - 1) / after * (new - w)
        w, before = new, after
    return w.astype(np.float32)


def kin(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Groups of at most KIN languages: halved along the direction in which their mean texts differ most."""
    names = sorted(means)
    if len(names) <= KIN:
        return [names] if names else []
    x = np.array([means[n] for n in names], np.float64)
    direction = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    order = np.argsort((x - x.mean(axis=0)) @ (direction * np.sign(direction[np.abs(direction).argmax()])), kind="stable")
    half = len(names) // 2
    return [group for part in (order[:half], order[half:]) for group in kin({names[i]: means[names[i]] for i in part})]


def families_of(x: np.ndarray, names: np.ndarray) -> dict[str, str]:
    """The family of every language in ``names``, the languages of the rows of x."""
    known = {lang: FAMILY[lang] for lang in set(names.tolist()) if lang in FAMILY}
    rest = {lang: x[names == lang].mean(axis=0) for lang in set(names.tolist()) - known.keys()}
    return known | {lang: f"other{i}" for i, group in enumerate(kin(rest)) for lang in group}


def train(x: np.ndarray, langs: list[str]) -> Model:
    names = np.array(langs)
    of = families_of(x, names)
    family = np.array([of[lang] for lang in langs])
    families = sorted(set(family.tolist()))
    weights = [train_svm(x, np.where(family == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1], np.float32) for f in families]
    languages = {f: sorted(set(names[family == f].tolist())) for f in families}
    pairs = {}
    for f in families:
        pairs[f] = []
        for i, j in combinations(range(len(languages[f])), 2):
            own = (names == languages[f][i]) | (names == languages[f][j])
            pairs[f].append((i, j, train_svm(x[own], np.where(names[own] == languages[f][i], 1.0, -1.0))))
    return Model(families, np.array(weights), languages, pairs)


def predict(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row, and a score between 0 and 1."""
    squash = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
    margins = x @ model.family_weights.T
    chosen = margins.argmax(axis=1)
    score = squash(margins[np.arange(len(x)), chosen]) if len(model.families) > 1 else np.ones(len(x))
    out = np.empty(len(x), object)
    for k, f in enumerate(model.families):
        rows = np.flatnonzero(chosen == k)
        names = model.languages[f]
        votes = np.zeros((len(rows), len(names)))
        sure = np.zeros((len(rows), len(names)))
        for i, j, w in model.pairs[f]:
            p = squash(x[rows] @ w)
            first = p >= 0.5
            votes[:, i] += first
            votes[:, j] += ~first
            sure[:, i] += p
            sure[:, j] += 1 - p
        best = (votes + sure / (len(names) + 1)).argmax(axis=1)
        out[rows] = np.array(names, object)[best]
        if len(names) > 1:
            score[rows] *= sure[np.arange(len(rows)), best] / (len(names) - 1)
    return out, score


_MAP = "features array<float>"


def fit(
    docs: DataFrame, teaches: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 600, rows: int = 8000, seed: int = 5
) -> Model | None:
    """A model from a sample of about ``rows`` rows where ``teaches`` holds; None without any."""
    named = in_small_batches(docs).filter(teaches & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counts = named.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return None
    wanted = max(LEAST_ROWS, min(per_language, rows // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, wanted / r["count"]))])
    draw = F.xxhash64("id", "text", F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    # The row with the least draw is always in, so no language is lost to chance.
    least = {r["lang"]: r["d"] for r in named.groupBy("lang").agg(F.min(draw).alias("d")).collect()} if wanted < 40 else {}
    first = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang")) if least else F.lit(-1.0)
    picked = named.filter((draw < F.element_at(share, F.col("lang"))) | (draw == first)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT, 500):
                counted = features(part.column("text"))
                flat = pa.array(counted.ravel(), pa.float32())
                offsets = pa.array(np.arange(0, (len(counted) + 1) * (DIM + 1), DIM + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.ListArray.from_arrays(offsets, flat)], names=["lang", "features"])

    table = picked.mapInArrow(tidied(count), f"lang string, {_MAP}").toArrow()
    if not table.num_rows:
        return None
    x = table["features"].combine_chunks().flatten().to_numpy().reshape(-1, DIM + 1)
    langs = table["lang"].to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], x[i, :64].tobytes()))  # the same however rows arrive
    model = train(x[order], [langs[i] for i in order])
    del table, x
    tidy()
    return model


def identify(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False
) -> DataFrame:
    """doc_id, lang_pred, score, rest (the carried columns), and text if it is to be kept."""
    picked = in_small_batches(docs).select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.lit(None).cast("int").alias("rest"),
    )
    out = ["doc_id", "lang_pred", "score", "rest", *(["text"] if keep_text else [])]
    made = T.StructType.fromDDL("lang_pred string, score double")
    schema = T.StructType([made[c] if c in made.names else picked.schema[c] for c in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT, 4 * CHUNK):
                names, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if model:
                    found, sure = predict(model, features(part.column("text")))
                    lettered = part.column("lettered").to_numpy(zero_copy_only=False)
                    names, score = np.where(lettered, found, "und"), np.where(lettered, sure, 0.0)
                told = {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score.astype(np.float64))}
                yield pa.RecordBatch.from_arrays([told[c] if c in told else part.column(c) for c in out], names=out)

    return picked.mapInArrow(tidied(run), schema)
