import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from planarlake.llm import lexical as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(d, Counter(w)) for d, t in docs if (w := words(t))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "naïve", "中文", "A1", "a1", "x"]
    text = lambda: rnd.choice(" -_\n").join(rnd.choice(vocabulary[: rnd.choice((5, 40, 206))]) for _ in range(rnd.randint(0, 30)))
    docs = [(rnd.randint(0, n), text()) for _ in range(n)]
    return docs + [docs[3]] * 60 + [(None, docs[5][1]), (None, None), (7, ""), (8, "..."), (9, "w1 " * 5000)], [(i, text()) for i in range(25)] + [(3, "w1 w1 w2"), (50, None), (51, "unheard of")]


@pytest.mark.parametrize("docs_a_shard", [7, 1 << 14])
def test_search(spark, tmp_path, monkeypatch, docs_a_shard):
    """Against all scores, with shards of a few documents and of all."""
    monkeypatch.setattr(L, "DOCS", docs_a_shard)
    docs, items = corpus(docs_a_shard, 300)
    spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, word string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in L.op12_lexical_search(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(brute(docs, items))


def test_blocks(spark, monkeypatch):
    """Items searched a few at a time give what they give together."""
    docs, items = corpus(4, 120)
    index = L.search_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    whole = Counter(tuple(r) for r in L.ranked(index, asked, 5).collect())
    monkeypatch.setattr(L, "BLOCK", 600)
    assert Counter(tuple(r) for r in L.ranked(index, asked, 5).collect()) == whole == Counter(brute(docs, items, 5))


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.ranked(L.search_index(docs), items).count() == 0
    assert L.ranked(L.search_index(docs), items.limit(0)).count() == 0


def test_tree_maps_lists_to_nodes():
    """Each node's stretch of a list has the documents below it, by falling impact; bounds are the largest impacts."""
    rnd = np.random.default_rng(1)
    sizes = [40, 1, 0, 333]
    doc = np.concatenate([rnd.permutation(500)[:n] for n in sizes])
    start = np.concatenate(([0], np.cumsum(sizes)))
    impact = np.concatenate([np.sort(rnd.integers(1, 50, n))[::-1] for n in sizes]).astype(np.int32)
    tree = L.Tree(L.Tree.bits(doc, 9), start, impact)
    for i in range(4):
        for level in range(9):
            for node in range(1 << level):
                lo, hi = int(start[i]), int(start[i + 1])
                for k in range(level):
                    a, b = (int(tree.rank(np.array([k]), np.array([x]))[0]) for x in (lo, hi))
                    lo, hi = (int(tree.zeros[k]) + a, int(tree.zeros[k]) + b) if node >> (level - 1 - k) & 1 else (lo - a, hi - b)
                below = [int(x) for d, x in zip(doc[start[i] : start[i + 1]], impact[start[i] : start[i + 1]]) if d >> (9 - level) == node]
                assert tree.impact[level][lo:hi].tolist() == below == sorted(below, reverse=True)
    w = np.array([3, 1, 2, 5])
    score = Counter()
    for i in range(4):
        for d, x in zip(doc[start[i] : start[i + 1]].tolist(), impact[start[i] : start[i + 1]].tolist()):
            score[d] += int(w[i]) * x
    want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert list(zip(*(x.tolist() for x in tree.best(np.arange(4), w, 20)))) == want
