import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from trailmark.llm import byte_bpe, language_id, mixing, token_counts
from trailmark.llm import queries as Q

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Q.tokenizer_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(2)
    alphabet = list(" \n\t'abcdlvermst 12é漢字ß 　!?.,\r\0😀½") + ["'s", "'re", "'ll", "  ", "\n\n", " '"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return texts + ["", None, "a" * 3000, "ab'" * 500, " " * 300, "word " * 20000, "<|endoftext|>", "the the"]


def test_bpe_as_tiktoken(spark, reference):
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "x", "", 1)], "doc_id long, text string, ids string, rest int")
    path = Q.tokenizer_path()
    encoded = byte_bpe.encode(rows, path, carry=["ids"], decoded=True)
    again = byte_bpe.decode(encoded.withColumnRenamed("decoded", "at_once"), path)
    assert again.filter("decoded <> at_once or decoded is null").count() == 0
    got = encoded.collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            want = reference.encode_ordinary(text)
            assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in want)
            assert r.n_tokens == len(want) and bytes(r.decoded) == text.encode()
    assert byte_bpe.encode(rows.limit(0), path).count() == 0


def test_boundaries_as_the_pattern(reference):
    """The automaton against the pattern itself, and the offsets of ids in the bytes."""
    import regex

    texts = [t or "" for t in odd_texts()]
    encoder = byte_bpe.Encoder(byte_bpe.load_ranks(Q.tokenizer_path()))
    sliced = byte_bpe.pretokenise(texts)
    words = [[] for _ in texts]
    for text, which in zip(sliced.text.tolist(), sliced.which.tolist()):
        words[text].append(sliced.distinct[which].decode())
    assert words == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    for text, (ids, ends) in zip(texts, encoder.encode(texts)):
        cuts = [0, *ends.tolist()]
        assert [text.encode()[a:b] for a, b in zip(cuts, cuts[1:])] == [reference.decode_single_token_bytes(i) for i in ids.tolist()]


@pytest.mark.parametrize("n", [1024, 2048])
def test_bpe_of_words_that_collide_under_polynomials(reference, n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    pair = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    texts = [pair[0], pair[1], f"{pair[1]} {pair[0]} {pair[1]}", pair[0]]
    ranks = byte_bpe.load_ranks(Q.tokenizer_path())
    assert [x.tolist() for x, _ in byte_bpe.Encoder(ranks).encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    one, other, both, _ = token_counts.Counter(ranks).count(texts).tolist()
    alone = [token_counts.Counter(ranks).count([t]).tolist()[0] for t in pair]
    assert [one, other] == alone and both[0] == 3


def test_cache_forgets_what_is_not_asked_for():
    cache = byte_bpe.Cache(2)
    for i in range(9):
        now, before = cache.turn()
        now[i] = i
    assert len(cache.now) + len(cache.before) <= 6 and 8 in cache.now and 0 not in cache.before


def test_decoding_checks_its_offsets():
    decoder = byte_bpe.Decoder({b"a": 0, b"bc": 1})
    ids = np.array([1, 0, 1], np.uint32)
    assert decoder.decode(ids, np.array([2, 3, 5], np.uint32)) == b"bcabc"
    with pytest.raises(ValueError):
        decoder.decode(ids, np.array([1, 3, 5], np.uint32))


def test_bpe_query(spark, sf_dir, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op10_byte_bpe(spark, sf_dir).collect():
        want = b"".join(x.to_bytes(4, "little") for x in reference.encode_ordinary(texts[r.doc_id]))
        assert r.ids_sha256 == hashlib.sha256(want).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_mixing_targets(spark):
    sizes = [("a", 100), ("b", 1000), (None, 50), ("c", 10), ("é", 400), ("z", 0)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight = dict(zip(["a", "b", "c", "z", "é", None], [3, 1, 2, 3, 1, 2]))
    left, target, open_ = 1.5 * 1560, {}, set(weight)
    while True:  # shares by weight; those above their cap stop there and the rest share again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * dict(sizes)[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * dict(sizes)[s]
            left -= target[s]
        open_ -= full
    assert {s: round(r.target, 6) for s, r in got.items()} == {s: round(t, 6) for s, t in target.items()}


def test_mixing_rows(spark):
    rng = random.Random(8)
    docs = [(i, " w" * rng.randint(0, 9), rng.choice(["hot"] * 3 + ["b", "c", None]), "clash") for i in range(3000)] + [(None, None, "b", "x"), (7, "w w", "b", "x")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string, size string")
    got = mixing.mix_sources(rows, carry=["size"]).cache()
    again = mixing.mix_sources(rows.repartition(7)).select("doc_id", "size", "taken")
    assert got.select("doc_id", "size", "taken").exceptAll(again).count() == 0
    assert got.count() == len(docs) and got.filter("taken > 2 * size").count() == 0
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect():
        assert abs(r.t - r.target) < 0.06 * r.target
    assert mixing.emit(got).count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(rows.limit(0)).count() == 0


def test_language_on_the_table(spark, sf_dir):
    rows = Q.op5_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def plain_features(text):
    """Counts of hashed pairs and triples of folded bytes, square-rooted, scaled, and a 1."""
    body = []
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
        if b != 32 or body[-1:] != [32]:
            body.append(b)
    x = [0] * language_id.DIM
    for size in (2, 3):
        for i in range(len(body) - size + 1):
            code = 0
            for b in body[i : i + size]:
                code = code * 257 + b
            x[(code * 2654435761 % (1 << 32)) >> 20] += 1
    x = np.sqrt(x)
    return np.append(x / max(np.sqrt((x * x).sum()), 1e-12), 1)


def plain_machine(rows, sides, c=20.0):
    """The squared hinge loss, classes weighing alike, by gradient steps from the previous two points."""
    w = lead = np.zeros(rows.shape[1])
    k = 1.0
    for _ in range(300):
        slope = lead / c
        for x, y in zip(rows, sides):
            slope = slope - 2 * max(0, 1 - y * (x @ lead)) * y * x * 0.5 / sides.count(y)
        new = lead - slope / (1 / c + 4)
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        lead, w, k = new + (k - 1) / after * (new - w), new, after
    return w


def test_language_against_a_plain_version(spark):
    """Features, both kinds of machine and the votes in plain Python, on texts of four languages in three families."""
    rng = random.Random(12)
    words = {"en": "the of and house water", "de": "der die und haus wasser", "fr": "le la et maison eau", "pl": "i w dom woda rzeka"}
    text = lambda lang: " ".join(rng.choice(words[lang].split() + ["radio", "x"]) for _ in range(rng.randint(4, 12)))
    taught = [(i, text(lang), lang) for i, lang in enumerate(list(words) * 6)]
    asked = [(100 + i, text(lang), None) for i, lang in enumerate(list(words) * 4)] + [(200, "water haus eau", None), (201, "DOM und!", None)]
    rows = spark.createDataFrame(taught + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(rows, language_id.fit(rows, F.lit(True))).collect()}

    x, langs = np.array([plain_features(t) for _, t, _ in taught]), [lang for _, _, lang in taught]
    family = [language_id.FAMILY[lang] for lang in langs]
    machines = {f: plain_machine(x, [1 if f == g else -1 for g in family]) for f in sorted(set(family))}
    own = [i for i, lang in enumerate(langs) if lang in ("de", "en")]
    pair = plain_machine(x[own], [1 if langs[i] == "de" else -1 for i in own])
    p = lambda margin: 1 / (1 + np.exp(-4 * margin))
    for doc, t, _ in taught + asked:
        f = plain_features(t)
        best = max(machines, key=lambda name: machines[name] @ f)
        lang = {"romance": "fr", "slavic": "pl"}.get(best) or ("de" if pair @ f >= 0 else "en")
        score = p(machines[best] @ f) * (max(p(pair @ f), 1 - p(pair @ f)) if best == "germanic" else 1)
        assert got[doc][0] == lang and abs(got[doc][1] - score) < 1e-3


def test_many_languages(spark):
    """130 languages, most of them of no known family: each is learned and told apart."""
    rng = random.Random(3)
    stock = {f"q{k:02x}": [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))) for _ in range(6)] for k in range(126)}
    stock |= {"en": ["the", "and", "house"], "de": ["der", "und", "haus"], "fr": ["le", "et", "maison"], "zz": ["zz", "yy", "xx"]}
    text = lambda lang: " ".join(rng.choice(stock[lang]) for _ in range(14))
    taught = [(i, text(lang), lang) for i, lang in enumerate(list(stock) * 4)]
    rows = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    model = language_id.fit(rows, F.lit(True), rows=300)
    learned = [lang for group in model.languages.values() for lang in group]
    assert sorted(learned) == sorted(stock) and max(map(len, model.languages.values())) <= language_id.KIN
    asked = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(stock)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()}
    assert sum(found[i] == lang for i, lang in enumerate(stock)) >= 0.9 * len(stock)


def test_language_edges(spark):
    docs = [(i, t * 3, lang, "clash") for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("le chat et le chien ", "fr")] * 5)]
    odd = [(100, None, "en", ""), (101, "12 !? 漢", None, ""), (102, "12 !?", "en", ""), (None, "the dog", None, ""), (103, "the dog " * 40000, None, "")]
    rows = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score string")
    model = language_id.fit(rows, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(rows, model, carry=["score"]).collect()}
    assert got[100] == got[102] == ("und", 0.0)
    assert got[101][0] != "und" and got[None][0] == got[103][0] == "en"
    assert all(got[i][0] == lang for i, _, lang, _ in docs)
    nothing = language_id.fit(rows.limit(0), F.lit(True))
    assert nothing is None and {r.lang_pred for r in language_id.identify(rows, nothing).collect()} == {"und"}
