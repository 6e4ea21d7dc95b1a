import base64
import random
import sys

import numpy as np
import pytest
import tiktoken

from trailmark.llm import packing, token_counts
from trailmark.llm import queries as Q
from trailmark.llm.byte_bpe import LETTER, NUMBER, SPACE, classes, load_ranks

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Q.tokenizer_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_classes_of_all_codepoints():
    """A vocabulary that joins 'a' and '1' with any first byte tells whether the library's pattern splits between them."""
    ranks = {bytes([b]): b for b in range(256)}
    for head in b"a1":
        ranks |= {bytes([head, b]): len(ranks) + b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = classes()
    joins = lambda head, c: probe.encode_ordinary(head + chr(c))[0] > 255
    wrong = [
        hex(c)
        for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c < 0xE000 and (joins("a", c), joins("1", c)) != (table[c] == LETTER, table[c] == NUMBER)
    ]
    assert not wrong
    assert [c for c in range(sys.maxunicode + 1) if chr(c).isspace() and not 0x1C <= c <= 0x1F] == np.flatnonzero(table == SPACE).tolist()


def test_best_fit_decreasing():
    rng = random.Random(1)
    for length in (1, 7, 16, 100):
        sizes = sorted((rng.randint(1, length) for _ in range(rng.randint(0, 300))), reverse=True)
        left, rows = [], []
        for i, n in enumerate(sizes):  # plain: the fullest row that takes the piece
            fits = [k for k, c in enumerate(left) if c >= n]
            k = min(fits, key=lambda k: left[k]) if fits else len(left)
            if k == len(left):
                left.append(length)
                rows.append([])
            left[k] -= n
            rows[k].append(i)
        got = packing.best_fit_decreasing(np.array(sizes, np.int64), length)
        assert sorted(i for row in got for i in row) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in row) <= length for row in got)
        assert len(got) == len(rows) and sorted(sum(sizes[i] for i in row) for row in got) == sorted(sum(sizes[i] for i in row) for row in rows)


def test_packing_loses_nothing(spark, reference, tmp_path):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["the", "cat", "漢字", "x1"]) for _ in range(rng.randint(0, 40))) for i in range(200)}
    texts |= {7: "the cat x1", 300: None, 301: "", 302: "word " * 3000}
    rows = spark.createDataFrame([(i, t, 0, "clash") for i, t in texts.items()] + [(7, texts[7], 0, ""), (None, "the end", 0, "")], "doc_id long, text string, row int, ids string")
    packed = packing.pack_documents(rows, Q.tokenizer_path(), public_tokenizers.PATTERN, length=64)
    packing.write_binary(packed, str(tmp_path / "packed"))
    found = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, places = (np.frombuffer(bytes(x), "<u4") for x in (r.ids, r.positions))
        assert len(ids) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert len(r.doc_ids) == len(r.pieces) == r.n_segments == len(r.cu_seqlens) - 1
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(d, []).append((k, ids[a:b].tolist()))
    assert sorted(x for x in found[7]) == sorted(2 * [(0, reference.encode_ordinary(texts[7]))])
    del found[7]
    assert [x for _, piece in found.pop(None) for x in piece] == reference.encode_ordinary("the end")
    for d, pieces in found.items():
        assert [x for _, piece in sorted(pieces) for x in piece] == reference.encode_ordinary(texts[d])
    assert set(found) == {d for d, t in texts.items() if t and d != 7}
    assert packing.pack_documents(rows.limit(0), Q.tokenizer_path(), public_tokenizers.PATTERN).count() == 0


def test_packing_ties_and_copies(spark):
    """Texts of one id and length are placed alike however rows arrive; copies of one text fill several groups."""
    rows = [(5, [k, k + 1]) for k in range(40)] + [(None, [9, 9])] * 3
    ids = lambda x: np.array(x, "<u4").tobytes()
    frame = lambda order: spark.createDataFrame([(d, ids(x), 0) for d, x in order], "doc_id long, ids binary, salt long")
    packed = [packing.pack(frame(order), 3, 8).orderBy("group", "row").collect() for order in (rows, rows[::-1])]
    assert packed[0] == packed[1]
    copies = spark.createDataFrame([(None, "the cat")] * 400, "doc_id long, text string").coalesce(1)
    salts = packing.token_ids(copies, Q.tokenizer_path(), public_tokenizers.PATTERN).groupBy("salt").count().collect()
    assert {r["count"] for r in salts} == {packing.COPIES} and len(salts) == 400 // packing.COPIES


def plain_count(word, scores):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        best.append(max(options))
    return -best[-1][1], best[-1][0]


def test_token_counts(spark, reference):
    import regex

    rng = random.Random(3)
    texts = ["".join(rng.choice(list("abcdetion é漢'12 \n") + ["the ", "tion"]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", "a" * 2000, "the the"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the the", 1)], "doc_id long, text string, score int")
    scores = {p: s for p, s in token_counts.piece_scores(load_ranks(Q.tokenizer_path())).items()}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens, r.score) for r in token_counts.count_tokens(rows, Q.tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        words = [w.encode() for w in regex.findall(public_tokenizers.PATTERN, t or "")]
        each = [plain_count(w, scores) for w in words]
        assert got[i] == (len(words), sum(n for n, _ in each), sum(s for _, s in each))
    assert got[None] == got[len(texts) - 1]
    assert token_counts.count_tokens(rows.limit(0), Q.tokenizer_path()).count() == 0


def test_token_counts_of_the_longest_pieces(spark):
    """The longest pieces that are texts, against the full vocabulary."""
    import regex

    scores = token_counts.piece_scores(load_ranks(Q.tokenizer_path()))
    texts = []
    for piece in sorted(scores, key=len, reverse=True)[:200]:
        try:
            texts += [piece.decode(), "the " + piece.decode() + piece.decode()]
        except UnicodeDecodeError:
            pass
    assert max(len(t.encode()) for t in texts[::2]) > 32
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens, r.score) for r in token_counts.count_tokens(rows, Q.tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        words = [w.encode() for w in regex.findall(public_tokenizers.PATTERN, t)]
        each = [plain_count(w, scores) for w in words]
        assert got[i] == (len(words), sum(n for n, _ in each), sum(s for _, s in each))
