"""Which document filter removes what, in every order in which filters can be applied.

A document is described by the letters of the filters that it fails.  Four filters
look at a document alone; the fifth, E, fails texts that a smaller id has too.
It is an existential self-join: rows whose text's hash recurs meet, by a left-semi join on
hash, exact text and smaller id, one row for each distinct text of the hash.  The ids
that it marks are united with the other failures, and documents are counted by
combination of letters.  Orders and steps are worked out on these counts: for each
part at most 2**filters rows, whatever the size of the corpus.

Texts are shuffled once, to meet the hashes that recur; those that do are shuffled again.
Both joins sort and merge at every size, so cost is in proportion.  Rows of a hot hash
are dealt over all tasks by their id, and the row that they look for is copied to
each.  Equal texts are folded within each task before the smallest id is sought.

Defined cases: null texts are empty (they fail A only, and E behind the first); white
space other than ``[\\x20\\x09-\\x0D]`` belongs to words; a null part is the empty one; a
row with a null id is counted, has no label, and neither fails E nor makes others
fail it; repeated rows are counted each and do not make each other fail E, as no id
is smaller than itself; labels repeated for an id are united; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import ensure_checkpoint_dir
from .skew import HOT

SPACE = r"[\x20\x09-\x0D]+"
COPY = "E"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which a text fails each filter; ``words`` are its words."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(
    docs: DataFrame,
    filters: Callable[[Column, Column], dict[str, Column]] = text_filters,
    digest: Callable[[str], Column] = F.xxhash64,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """doc_id, part, failed (letters in order) and n, the number of such rows with one id and text."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = texts.withColumn("h", digest("text").cast("long"))
    split = hashed.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    letters = F.concat(*[F.when(fails, letter).otherwise("") for letter, fails in filters(F.col("text"), F.col("words")).items()])
    others = split.select("doc_id", "h", "part", letters.alias("failed"), F.lit(0).alias("copy"), F.lit(1).cast("long").alias("n"))
    copies = exact_copies(hashed).select("doc_id", "h", "part", F.lit("").alias("failed"), F.lit(1).alias("copy"), F.lit(0).cast("long").alias("n"))
    united = others.unionByName(copies).groupBy("doc_id", "h", "part", "copy", "failed").agg(F.sum("n").alias("n"))
    by_row = united.groupBy("doc_id", "h", "part").agg(F.max("failed").alias("failed"), F.max("copy").alias("copy"), F.sum("n").alias("n"))
    return by_row.select("doc_id", "part", F.concat("failed", F.when(F.col("copy") == 1, COPY).otherwise("")).alias("failed"), "n")


def exact_copies(texts: DataFrame) -> DataFrame:
    """The rows (doc_id, h, part, text) whose text a smaller id has; ``h`` is any hash of the text."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = texts.filter(F.col("doc_id").isNotNull())
    recurs = named.groupBy("h").agg(F.count(F.lit(1)).alias("w"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    recurs = recurs.filter("least < most").select("h", "w").checkpoint()
    total = recurs.agg(F.sum("w").alias("n")).first()["n"] or 0
    is_hot = F.col("w") * HOT > F.lit(total)  # fewer than HOT hashes
    hot = recurs.filter(is_hot).select("h", F.lit(True).alias("hot"))
    lane = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array(F.lit(0)))).alias("lane")
    dealt = named.join(F.broadcast(hot), "h", "left").withColumn("lane", lane)
    known = recurs.select("h", is_hot.alias("hot")).select("h", every)
    again = dealt.join(known.hint("merge"), ["h", "lane"], "left_semi").checkpoint()
    least = again.groupBy("h", "text").agg(F.min("doc_id").alias("least"), F.max("hot").alias("hot"))
    first = least.select("h", every, F.col("text").alias("same"), "least")
    a, b = again.alias("a"), first.alias("b")
    on = (F.col("a.h") == F.col("b.h")) & (F.col("a.lane") == F.col("b.lane")) & (F.col("a.text") == F.col("b.same")) & (F.col("b.least") < F.col("a.doc_id"))
    return a.join(b.hint("merge"), on, "left_semi").select("doc_id", "h", "part")


def combinations(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents, good and toxic ones by part and letters failed."""
    known = labels.groupBy(F.col(id_col).alias("labelled")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")
    )
    met = failed.join(known, F.col("doc_id") == F.col("labelled"), "left")
    counted = {"n": F.col("n"), "good": F.col("n") * F.coalesce("good", F.lit(0)), "toxic": F.col("n") * F.coalesce("toxic", F.lit(0))}
    return met.groupBy("part", "failed").agg(*[F.sum(c).alias(name) for name, c in counted.items()])


def audit(combined: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step; see the module's text.

    ``combined`` has part, failed, n, good, toxic.  An order's step removes the documents that
    fail its filter and none before it.
    """
    orders = ["".join(p) for p in permutations(letters)]
    steps = (
        combined.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
        .withColumn("filter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("earlier", F.expr("length(translate(failed, substring(filter_order, 1, step - 1), '')) < length(failed)"))
        .withColumn("fails", F.expr("contains(failed, filter)"))
    )
    over = lambda condition, column="n": F.sum(F.when(condition, F.col(column)).otherwise(0))
    removed = F.col("fails") & ~F.col("earlier")
    told = steps.groupBy("part", "filter_order", "step", "filter").agg(
        over(~F.col("fails") & ~F.col("earlier")).alias("kept"),
        over(removed).alias("removed"),
        over(F.col("fails") & F.col("earlier")).alias("redundant"),
        over(F.col("failed") == F.col("filter")).alias("unique_fails"),
        over(removed, "good").alias("good_lost"),
        over(removed, "toxic").alias("toxic_lost"),
    )
    shares = told.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return told.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter"
    )
