import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from planarlake.llm import langid as L


def cuts(w, index):
    """All segmentations of w into pieces; single characters always are."""
    if not w:
        yield []
    for b in range(1, len(w) + 1):
        if w[:b] in index or b == 1:
            for rest in cuts(w[b:], index):
                yield [index.get(w[:b], -1), *rest]


def test_sums_equal_enumeration():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    index = {p: i for i, p in enumerate(pieces)}
    rng = np.random.default_rng(1)
    prob = rng.random((len(pieces) + 1, 2))
    words = ["▁", "▁a", "▁abab", "▁bbaab", "▁xabax", "ababa"]
    for logs, p in ((True, np.log(prob)), (False, prob)):
        like = L.Lattice(words, L.Pieces(pieces)).forward(p, logs)[0]
        for i, w in enumerate(words):
            want = sum(np.prod([prob[p] for p in c], axis=0) for c in cuts(w, index))
            assert np.allclose(np.exp(like[i]), want)
    n = np.array([3.0, 1, 2, 5, 1, 4])
    got = L.Lattice(words, L.Pieces(pieces)).expected(np.log(prob[:, 0]), n)
    want = np.zeros(len(pieces) + 1)
    for w, k in zip(words, n):
        all_of = [(c, np.prod([prob[p, 0] for p in c])) for c in cuts(w, index)]
        total = sum(x for _, x in all_of)
        for c, x in all_of:
            for p, m in Counter(c).items():
                want[p] += k * m * x / total if p >= 0 else 0
    assert np.allclose(got, want)


def test_held_out_accuracy_and_odd_rows(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.op6_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("hit")).first()
    assert row.hit > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !", "x"), (None, "the and of", "x"), (4, "é" * 5000, "x"), (4, "é" * 5000, "x")], "doc_id long, text string, score string")
    train = docs.select("text", "lang")
    out = L.language_id(odd, train, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 3, None)} == {1: "und", 2: "und", 3: "und", None: "en"}
    assert {r.lang_pred for r in L.language_id(odd, train.limit(0), model).collect()} == {"und"}
    assert L.language_id(odd.limit(0), train, model).count() == 0


def summed(w, index, column):
    """Log of the sum over all segmentations, place by place."""
    sums = [0.0]
    for e in range(1, len(w) + 1):
        arcs = [sums[b] + column[index.get(w[b:e], -1)] for b in range(max(0, e - 20), e) if w[b:e] in index or e - b == 1]
        sums.append(np.logaddexp.reduce(arcs))
    return sums[-1]


def test_long_words_are_summed_whole(monkeypatch):
    pieces = L.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 12
    index, rng = {p: i for i, p in enumerate(pieces)}, random.Random(3)
    k = np.repeat(np.arange(3), 500)
    table = L.Table(list("abc"), len(pieces), k, np.concatenate([np.random.default_rng(i).choice(len(pieces), 500, replace=False) for i in range(3)]), np.random.default_rng(9).random(1500) * 50)
    words = ["".join(rng.choice(pieces).replace(L.MARK, "") + rng.choice(["", "ж", "漢"]) for _ in range(n)) for n in (1, 3, 9, 30, 300)]
    monkeypatch.setattr(L, "CHARS", 100)
    scorer = L.Scorer(pieces, table)
    got = scorer.texts([" ".join(words), words[-1]])
    want = np.array([[summed(L.MARK + w, index, np.log(table.column(j))) for j in range(3)] for w in words])
    assert np.allclose(got[1], want[-1]) and np.allclose(got[0], want.sum(0))


def test_long_words_are_learned_whole(monkeypatch):
    """Expected uses of a word in parts are those of one lattice over all of it."""
    pieces = ["a", "b", "c", "ab", "ca", L.MARK, L.MARK + "a", "bc", "abca"]
    index, rng = L.Pieces(pieces), random.Random(5)
    prob = np.log(np.append(np.random.default_rng(2).dirichlet(np.ones(len(pieces))), L.UNKNOWN))
    for chars in (3, 7, 20):
        monkeypatch.setattr(L, "CHARS", chars)
        for n in (4, 20, 21, 60, 203):
            word = L.MARK + "".join(rng.choice("aabcd") for _ in range(n))
            whole = L.Lattice([word], index).expected(prob, np.array([3.0]))
            assert np.allclose(L.expected_long(word, index, prob, 3.0), whole), (chars, n)


def test_learning_takes_long_words_whole(spark):
    """What Spark learns is what sums over whole words give."""
    pieces, rng = ["a", "b", "ab", L.MARK, L.MARK + "a", "ba"], random.Random(6)
    train = [(" ".join("".join(rng.choice("aabc") for _ in range(n)) for n in (2, 30, 400, more)), x) for x, more in zip("xxyyy", (7, 70_000, 1, 1, 1))]
    df = spark.createDataFrame([*train, (None, "x"), ("", "y")], "text string, lang string").where("text is not null")
    whole = L.learn(df, pieces)
    words = [L.MARK + w for t, lang in train if lang == "x" for w in t.split()]
    none = np.zeros(0, np.int64)
    table = L.Table(["x", "y"], len(pieces), none, none, np.zeros(0))
    for _ in range(2):
        uses = sum(L.expected_long(w, L.Pieces(pieces), np.log(table.column(0)), 1.0) for w in words)
        at = np.flatnonzero(uses)
        table = L.Table(["x", "y"], len(pieces), np.zeros(len(at), np.int64), at, uses[at])
    assert np.allclose(table.column(0), whole.column(0), rtol=1e-4)


def test_texts_against_brute_force(spark, monkeypatch):
    """Learning by enumeration of all segmentations, and texts' languages and scores from it."""
    pieces = ["a", "b", "c", "ab", "ca", L.MARK, L.MARK + "a", "bc"]
    index = {p: i for i, p in enumerate(pieces)}
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6)))
    train = [(make("aab"), "x") for _ in range(20)] + [(make("bcc"), "y") for _ in range(20)] + [(make("abcd"), "z") for _ in range(5)]
    langs = ["x", "y", "z"]
    prob = {x: np.append(np.full(len(pieces), 1 / len(pieces)), L.UNKNOWN) for x in langs}
    for _ in range(2):
        new = {}
        for x in langs:
            uses = np.zeros(len(pieces) + 1)
            for t, lang in train:
                for w in t.split() if lang == x else ():
                    all_of = [(c, np.prod(prob[x][c])) for c in cuts(L.MARK + w, index)]
                    for c, p in all_of:
                        for i in c:
                            uses[i] += p / sum(q for _, q in all_of)
            known = uses[:-1] + L.SMOOTH
            new[x] = np.append(known / known.sum(), L.UNKNOWN)
        prob = new
    monkeypatch.setattr(L, "pieces_of", lambda model: pieces)
    texts = [make("abcd") for _ in range(30)] + ["", "1 2", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.language_id(df, spark.createDataFrame(train, "text string, lang string"), "").collect()}
    for i, t in enumerate(texts):
        if not t or t == "1 2":
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        like = [np.prod([sum(np.prod(prob[x][c]) for c in cuts(L.MARK + w, index)) for w in t.split()]) for x in langs]
        assert got[i].lang_pred == langs[int(np.argmax(like))]
        assert abs(got[i].score - max(like) / sum(like)) < 1e-4
