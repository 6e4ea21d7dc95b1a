"""Fill-in-the-middle: a text is cut into prefix, middle and suffix and laid out anew.

Units are runs of ASCII letters and single other code points.  Cuts and form come from
the SHA-256 of ``seed:id``, so reruns agree wherever a row is worked on.  Units are
never listed: the UTF-8 bytes of a batch are viewed as 64-bit words, the bytes that end
a unit are marked by arithmetic on whole words, marks are counted a word at a time,
and a cut is found by searching the running counts for its word and selecting the
mark within that word.

``restore`` rebuilds the text from output and form alone, with DataFrame functions.

Defined cases: a null text is the empty text and stays plain, with n 0; so does a text that
contains a marker; a null id draws as if it were the text ``null``; repeated rows come
out alike; an empty table gives an empty result; other columns are ignored unless
carried.  Texts are whole UTF-8; a text longer than a batch is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as A
from .batches import in_small_batches, slices, tidied

U64 = np.uint64
TEXT = 1_000_000  # bytes of text that a task works on at once
MARKERS = ("<P>", "<S>", "<M>")

ONES = U64(0x0101010101010101)
HIGH = U64(0x8080808080808080)
LOW7 = U64(0x7F7F7F7F7F7F7F7F)


def _words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, zeros behind the last, and one more word of zeros."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def _followers(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark replaced by that of the byte behind it."""
    out = marks >> U64(8)
    out[:-1] |= marks[1:] << U64(56)
    return out


def _letters(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is an ASCII letter."""
    low = (words | (ONES * U64(0x20))) & LOW7
    from_a = low + ONES * U64(0x80 - ord("a"))
    past_z = low + ONES * U64(0x80 - ord("z") - 1)
    return from_a & ~past_z & ~words & HIGH


def _inner(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that continues a code point (10xxxxxx)."""
    return words & ~(words << U64(1)) & HIGH


class Marks:
    """Marked bytes of a text, counted by words: how many before a place, and where the k-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """The number of marks in bytes before each place."""
        word = place >> 3
        below = (U64(1) << (U64(8) * (place & 7).astype(U64))) - U64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th mark, from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        wanted = (k - self.before[word]).astype(U64)
        # Running counts of the word's bytes; those that are still below the wanted one keep their high bit.
        counts = (self.marks[word] >> U64(7)) * ONES
        below = (((wanted - U64(1)) * ONES) | HIGH) - counts
        return word * 8 + np.bitwise_count(below & HIGH)


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """Bytes that end a unit, and bytes that begin a code point, of texts that lie end to end."""
    words = _words(data)
    letter, inner = _letters(words), _inner(words)
    ends = HIGH & ~(letter & _followers(letter)) & ~_followers(inner)
    last = offsets[1:][np.diff(offsets) > 0] - 1  # a text's last byte ends a unit, whatever follows
    np.bitwise_or.at(ends, last >> 3, U64(0x80) << (U64(8) * (last & 7).astype(U64)))
    starts = HIGH & ~inner
    full, rest = divmod(len(data), 8)  # nothing is marked behind the last byte
    for marks in (ends, starts):
        marks[full] &= (U64(1) << U64(8 * rest)) - U64(1)
        marks[full + 1 :] = 0
    return Marks(ends), Marks(starts)


def _hash(id_col: str, seed: int, group: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * group + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame,
    percent: int = 90,
    percent_spm: int = 20,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output, rest (the carried columns).

    ``percent`` of the texts are laid out anew, ``percent_spm`` of those with the suffix first.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.contains(F.col("text"), F.lit(marker))
    picked = (
        in_small_batches(docs)
        .select(
            F.col(id_col).alias("doc_id"),
            text.alias("text"),
            *[_hash(id_col, seed, k).alias(f"h{k + 1}") for k in range(4)],
            F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.lit(None).cast("int").alias("rest"),
        )
        .withColumn("form", F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain").otherwise(F.when(F.col("h4") % 100 < percent_spm, "spm").otherwise("psm")))
    )
    out = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "rest"]
    made = T.StructType.fromDDL("n long, prefix_chars long, middle_chars long, output string")
    schema = T.StructType([made[c] if c in made.names else picked.schema[c] for c in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT):
                laid = _lay_out(part)
                yield pa.RecordBatch.from_arrays([laid[c] if c in laid else part.column(c) for c in out], names=out)

    return picked.mapInArrow(tidied(run), schema)


def _lay_out(part: pa.RecordBatch) -> dict[str, pa.Array]:
    data, offsets = A.buffers(part.column("text"))
    ends, starts = unit_ends(data, offsets)
    first = ends.rank(offsets[:-1])
    n = ends.rank(offsets[1:]) - first
    draws = np.stack([part.column(c).to_numpy(zero_copy_only=False) % (n + 1) for c in ("h1", "h2")])
    cuts = [_place(ends, offsets[:-1], first, units) for units in (draws.min(axis=0), draws.max(axis=0))]
    at = [starts.rank(place) for place in (offsets[:-1], *cuts)]
    forms = part.column("form").to_pylist()
    plain = np.array([f == "plain" for f in forms], bool)
    whole = data.tobytes()
    p, s, m = (x.encode() for x in MARKERS)
    output = []
    for form, a, b, c, d in zip(forms, offsets[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), offsets[1:].tolist()):
        if form == "plain":
            output.append(whole[a:d])
        elif form == "psm":
            output.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
        else:
            output.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
    return {
        "n": pa.array(n.astype(np.int64)),
        "prefix_chars": pa.array((at[1] - at[0]).astype(np.int64), mask=plain),
        "middle_chars": pa.array((at[2] - at[1]).astype(np.int64), mask=plain),
        "output": pa.array(output, pa.binary()).cast(pa.string()),
    }


def _place(ends: Marks, begin: np.ndarray, first: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The place behind each text's first ``units`` units."""
    out = begin.copy()
    some = np.flatnonzero(units > 0)
    out[some] = ends.select(first[some] + units[some]) + 1
    return out


def restore(output_col: str = "output", form_col: str = "form") -> Column:
    """The text, from output and form alone; null for a null output."""
    parts = F.split(F.col(output_col), "<[PSM]>")
    first, second, middle = (F.element_at(parts, k) for k in (2, 3, 4))
    return (
        F.when(F.col(form_col) == "plain", F.col(output_col))
        .when(F.col(form_col) == "psm", F.concat(first, middle, second))
        .when(F.col(form_col) == "spm", F.concat(second, middle, first))
    )
