import base64
import os
import random
from collections import Counter

import numpy as np
import pytest

from quernel.llm import pack as P
from quernel.llm import repetition as R
from quernel.llm import split as S
from quernel.llm import tokenize as T
from quernel.llm.catalog import BYTE_BPE, TOKENIZERS
from quernel.llm.text import word_hashes, words

needs_vocabulary = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no vocabulary file")
ODD = ["", " ", "\n\n  x", "don't WON'T it's", "a\x1c\x1d b\x85c\xa0d", "ünïcödé Ω≈ç 漢字かな 😀👍🏽", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "0123456789" * 50, "<|endoftext|> plain", "tab\t\ttabs  \r\n end ", "Zürich straße — “quoted” …", "é́ combining"]


@needs_vocabulary
def test_encoding_is_exact():
    import tiktoken

    v = T.Vocabulary(open(BYTE_BPE, "rb").read())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdefgh ehtrnsäß\n'.,12😀") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    for t in texts:
        ids = v.encode(t)
        assert ids == other.encode_ordinary(t), t
        assert v.decode(ids) == t
    assert all(v.encode_piece(b) == [i] for b, i in list(v.id_of.items())[::37])
    assert v.encode(None) == []


@needs_vocabulary
def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "  ", "z")], "doc_id long, text string, ids string")
    got = T.encode(df, BYTE_BPE)
    assert [(r.doc_id, len(r.ids)) for r in got.orderBy("doc_id").collect()] == [(1, 2), (2, 0), (3, 0), (3, 0), (4, 2)]
    assert {r.doc_id: r.text for r in T.decode(got, BYTE_BPE).collect()} == {1: "Hello world", 2: "", 3: "", 4: "  "}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df, BYTE_BPE).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    assert T.encode(df.where("false"), BYTE_BPE).count() == 0


def test_repetition(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d e f Über 12".split()) for _ in range(rng.randrange(0, 200))) for _ in range(60)] + [None, "", "\n \t", "x " * 5000, "Same line here.\n" * 30]
    n_words, n_runs, again, share, lines, paragraphs, sentences, top, failed = R.measure(texts)
    for i, t in enumerate(texts):
        w = words(t)
        g = list(zip(*(w[k:] for k in range(5))))
        assert (n_words[i], n_runs[i], again[i]) == (len(w), len(g), len(g) - len(set(g)))
        c = Counter(zip(*(w[k:] for k in range(3))))
        m = max(c.values(), default=0)
        assert top[i] == pytest.approx(min(1, m * 3 / len(w)) if m > 1 else 0)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, failed int")
    led = R.ledger(df)
    assert led.count() == len(texts) and R.ledger(df.where("false")).count() == 0
    want = {i for i in range(len(texts)) if n_words[i] >= 50 and 10 * again[i] >= 3 * n_runs[i]}
    assert {r.doc_id for r in R.marked(led, R.POLICIES[0]).collect()} == want
    abl = {(r.policy, r.version, r.without): r.n_marked for r in R.ablations(led).collect()}
    assert abl["repeated_runs", 1, ""] == len(want) and abl["repeated_runs", 1, "runs"] == 0
    assert lines[-1] > 0.9 and failed[-1] & R.BITS["lines"]


def whole(t, how):
    index, out, begin = S.StrongestCut(S.strengths(S.code_points(t))), [], 0
    while len(t) - begin > how.size:
        end, k = index.query(max(begin + how.overlap + 1, begin + how.size // 2), begin + how.size)
        if k == S.NONE:
            end, k = index.query(begin + how.overlap + 1, begin + how.size)
        out.append((begin, end, k))
        begin = end - how.overlap
    return [*out, (begin, len(t), S.PARAGRAPH)]


def test_split():
    rng = random.Random(5)
    how = S.Limits(200, 20)
    for _ in range(150):
        t = "".join(rng.choice(["word ", "lang, ", "Ende. ", "x", "\n", "\n\n", "y" * 70, "z" * 230, "漢字。"]) for _ in range(rng.randrange(1, 90)))
        cuts = S.cuts(t, how)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(t) and all(0 < b - a <= 200 for a, b, _ in cuts)
        assert all(y[0] == x[1] - 20 for x, y in zip(cuts, cuts[1:]))
        s = S.strengths(S.code_points(t))
        for a, b, k in cuts[:-1]:  # the strongest boundary of its window, the rightmost of equals
            low = max(a + 21, a + 100) if s[a + 100 : a + 201].max() > 0 else a + 21
            window = s[low : a + 201]
            assert k == window.max() and b == low + int(np.flatnonzero(window == window.max())[-1])
        assert S.longest_unbroken(t) == max(map(len, t.replace("\t", " ").replace("\n", " ").split(" ")))
    for stretch in (1, 3):  # tables over short stretches give the same cuts
        S._STRETCH = stretch
        try:
            assert S.cuts(t * 4, how) == whole(t * 4, how)
        finally:
            S._STRETCH = 64
    assert S.cuts("") == [] and S.cuts("a" * 2000) == [(0, 2000, S.PARAGRAPH)]
    with pytest.raises(ValueError):
        S.Limits(100, 100)


def test_split_frame(spark):
    rows = [(1, "w " * 1500, "1"), (1, "w " * 1500, "1"), (2, "x" * 5000, None), (3, None, "3"), (4, "", "4"), (5, "short", "5")]
    df = spark.createDataFrame(rows, "id long, text string, page_range string")
    got = S.pieces(df.distinct(), keep=("page_range",)).collect()
    assert {r.id for r in got} == {1, 2, 5} and all(len(r.text) == r.char_count <= 2000 for r in got)
    assert {r.page_range for r in got if r.id == 1} == {"1"} and S.pieces(df.where("false")).count() == 0
    assert {r.id for r in S.pieces(df, only_long=True).collect()} == {1, 2}
    import hashlib

    assert {r.id: (r.md5, r.within) for r in S.stitched(S.pieces(df.distinct())).collect()} == {i: (hashlib.md5(t.encode()).hexdigest(), True) for i, t, _ in rows if t}
    assert S.longest_unbroken("a" * 3_000_000 + " b") == 3_000_000 and S.longest_unbroken("a b" + "c" * 2_000_000) == 2_000_001


def test_packing(spark):
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 2049, 3000)
    small = rng.integers(1, 600, 3000)
    bin_of, lengths = P.pack(small)
    used = np.bincount(bin_of, weights=small)
    assert (used <= lengths).all() and used.sum() / sum(lengths) > 0.99 and set(lengths) <= {256, 512, 1024, 2048}
    # lengths are chosen by what is still to come: 700s waste nothing in 700s, and no mix costs more than the greatest alone
    how = P.Containers((700, 1024, 2048))
    bin_of, lengths = P.pack(np.full(500, 700), how)
    assert set(lengths) == {700} and len(lengths) == 500
    for mix in (rng.choice([300, 700, 1000], 800), rng.integers(400, 760, 800), np.concatenate([np.full(300, 1025), rng.integers(1, 900, 300)])):
        got = P.pack(mix, how)
        alone = P._packed(mix, how, [2048])
        assert P.total_cost(got[1], how) <= P.total_cost(alone[1], how) and (np.bincount(got[0], weights=mix) <= got[1]).all()
    mixed = rng.choice([700, 690, 1020], 900)
    assert P.total_cost(P.pack(mixed, how)[1], how) < 0.85 * P.total_cost(P._packed(mixed, how, [2048])[1], how)
    rows = [(i, int(n)) for i, n in enumerate(sizes[:200])] + [(900, 5000), (901, 0), (902, None), (903, 4096)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = P.containers(df).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == Counter({i: n for i, n in rows if n})
    assert Counter(r.doc_id for r in got if r.doc_id >= 900) == {900: 3, 903: 2} and all(v == 1 for k, v in Counter(r.doc_id for r in got).items() if k < 900)
    bins = Counter()
    for r in got:
        bins[r.bin] += r.n_tokens
    assert all(bins[r.bin] == r.bin_used <= r.bin_length <= 2048 for r in got)
    assert P.containers(df.where("false")).count() == 0


def test_word_hashes_do_not_depend_on_the_way_a_text_is_read():
    a, n = word_hashes(["Größe Ärger 12", "größe — ärger 12", None, ""])
    assert n.tolist() == [3, 3, 0, 0] and a[:3].tolist() == a[3:].tolist()
