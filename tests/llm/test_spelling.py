import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from planarlake.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(docs, drop=199):
    out = Counter()
    for d, t in docs:
        for w in RUN.findall(t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                out[w] += 1
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least=5):
    n = {w: c for w, c in counts.items() if c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(5, 9))) for _ in range(60)] + ["A" * 70, "àÀéÉ×÷ÿz", "straße", "Straßen", "strassen"]
    pool = []
    for w in base:
        v = w
        for k in range(5):
            pool += [v] * 7 ** max(0, 3 - k)
            i, c = rnd.randrange(len(v)), rnd.choice("abcxÿ")
            v = rnd.choice([v[:i] + c + v[i:], v[:i] + v[i + 1 :] or v, v[:i] + c + v[i + 1 :]])
    rnd.shuffle(pool)
    docs = [(rnd.randint(0, 999), rnd.choice([" ", "-", "\n1", "中", "Ā"]).join(pool[i : i + 40])) for i in range(0, len(pool), 40)]
    return docs + [docs[0]] * 3 + [(None, docs[1][1]), (None, None), (5, ""), (6, "1 2")]


def test_query(spark, tmp_path):
    docs = corpus(1)
    spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, word string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in S.op13_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(words_of(docs))
    assert Counter(got) == Counter(want)
    assert sum(r[1] is not None for r in want) > 30 and any(r[2] != r[1] for r in want if r[1])


def test_handing_on_early_changes_nothing(spark, monkeypatch):
    docs = corpus(2)
    monkeypatch.setattr(S, "CHARS", 100)
    monkeypatch.setattr(S, "TABLED", 7)
    got = {r.word: r.n for r in S.word_counts(spark.createDataFrame(docs, "doc_id long, text string"), drop=3).collect()}
    assert got == dict(words_of(docs, 3))


def test_all_near_pairs(spark):
    """Every pair of a dense set of words, whatever the edit and the letters' shared bits."""
    rnd = random.Random(3)
    letters = "etazéÿÀ"
    words = sorted({"".join(rnd.choice(letters[: rnd.choice((2, 7))]) for _ in range(rnd.randint(6, 8))) for _ in range(700)})
    got = {tuple(r) for r in S.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}
    bit = S.bit_of()
    assert len(bit) == 90 and max(bit.values()) < 63


def test_checksums_are_carried():
    rnd = np.random.default_rng(1)
    heads = [f"{i}:".encode() for i in rnd.integers(0, 10**12, 200)]
    tails = [bytes(rnd.integers(0, 256, n).astype(np.uint8)) for n in rnd.integers(0, 60, 200)]
    crc = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    got = S.Carry().join(crc(heads), crc(tails), np.array([len(t) for t in tails]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails)]


def test_runs():
    coded, n = S.runs_of(pa.array(["Ab1Éc ×Āzz", None, "", "中x"]))
    assert n.tolist() == [4, 0, 0, 1]
    assert [coded.dictionary[i].as_py().decode() for i in coded.indices.to_pylist()] == ["ab", "Éc", "×", "zz", "x"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_groups(S.word_counts(df)).count() == 0
