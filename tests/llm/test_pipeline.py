import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from . import brute

pytest.importorskip("public_tokenizers")


def test_stages_and_plain_version(spark, tmp_path):
    """The pipeline on a small corpus against plain Python, stage by stage."""
    line = lambda k, n: " ".join(f"{w}{(k * 7 + i) % 97}" for i, w in zip(range(n), ["the", "and", "cat", "house", "river"] * n))
    passage = "this passage of more than fifty bytes is found in several documents of the corpus"
    docs = [(i, line(i * 13, 30), "en", f"s{i % 3}") for i in range(30)]
    docs += [(30 + i, f"{line(900 + 31 * i, 12)} {passage} {line(500 + 17 * i, 9)}", "en", "s1") for i in range(4)]
    docs += [(40, docs[3][1], "en", "s0"), (41, docs[3][1] + " more", "en", "s2"), (42, "12 34 !!", "en", "s0"), (43, None, None, "s1")]
    rows = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))

    texts = {d: t for d, t, _, _ in docs if t and any(c.isalpha() for c in t)}
    labels = brute.near(list(texts.items()))
    texts = {d: t for d, t in texts.items() if labels[d][1] == d}
    texts = {d: kept.decode() for d, (_, _, _, kept) in brute.cut_bytes(list(texts.items()), 50).items() if kept.split()}
    source = {d: s for d, _, _, s in docs}
    copies = brute.mixed_copies([(d, t, source[d]) for d, t in texts.items()])

    got = P.run(spark, str(tmp_path))
    counted = {r.doc_id: (r.n, r.sha) for r in got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("decoded_sha256").alias("sha")).collect()}
    assert counted == {d: (n, brute.sha(texts[d])) for d, n in copies.items() if n}
    assert [n for n, _ in P.STAGES] == ["language_id", "minhash_dedup", "suffix_dedup", "mixing", "byte_bpe"]
