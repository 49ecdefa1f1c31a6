import random

from planarlake.llm import decontaminate as D


def greedy(p, t, least=5):
    """Longest common unmarked run first, by trying all places; ties by item place, then text place."""
    up, ut, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in up and j + n not in ut:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        up |= set(range(i, i + n))
        ut |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles_equal_greedy_search():
    rnd = random.Random(1)
    for _ in range(300):
        p = [rnd.randrange(60) for _ in range(rnd.randint(5, 50))]
        cut = sorted(rnd.sample(range(len(p)), min(3, len(p))))
        parts = [p[: cut[0]], p[cut[0] : cut[-1]], p[cut[-1] :]]
        rnd.shuffle(parts)
        t = [x for q in parts for x in [*q, *(rnd.randrange(60, 99) for _ in range(rnd.randint(0, 3)))]]
        a, b = D.tiles(p, t), greedy(p, t)
        assert sum(x[2] for x in a) == sum(x[2] for x in b)
        assert all(p[i : i + n] == t[j : j + n] and n >= 5 for i, j, n in a)


def test_reordered_passages_are_caught_and_clean_texts_left(spark, monkeypatch):
    rnd = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    filler = lambda n: [f"x{rnd.randrange(5000)}" for _ in range(n)]
    rows = [
        (1, " ".join(filler(50) + item + filler(900))),
        (2, " ".join(filler(9) + item[20:] + filler(30) + item[:20])),
        (3, " ".join(filler(30) + item[:12] + filler(30))),
        (4, " ".join(reversed(item))),
        (5, None), (6, ""), (None, "\n".join(x.upper() for x in item)), (7, "a b c"), (7, "a b c"),
        (8, " ".join((filler(40000)) + item)),
    ]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "a b c"), (12, None), (13, " ".join(filler(30))), (10, " ".join(item))], "item_id long, text string")
    for size in (25, 17):  # a filter that lets much through changes nothing
        monkeypatch.setattr(D, "FILTER_BITS", size)
        got = D.contaminated(docs, bench).collect()
        assert sorted((str(r.doc_id), r.item_id, r.coverage) for r in got) == [("1", 10, 1.0), ("2", 10, 1.0), ("7", 11, 1.0), ("7", 11, 1.0), ("8", 10, 1.0), ("None", 10, 1.0)]
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0


def test_pairs_against_brute_force_with_any_ids(spark):
    from decimal import Decimal

    rnd = random.Random(5)
    word = lambda: f"q{rnd.randrange(400)}"
    opening = [word() for _ in range(6)]  # which all items share
    items = [(Decimal(i), opening + [word() for _ in range(rnd.randint(0, 30))]) for i in range(12)]
    items += [(Decimal(50), ["yes", "no"]), (Decimal(51), items[3][1]), (None, ["one", "two", "three", "four"]), (Decimal(52), [])]
    texts = []
    for i in range(80):
        t = [word() for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(items)[1]
            a = rnd.randrange(len(p) + 1)
            t += p[a:] + [word() for _ in range(rnd.randint(0, 2))] + p[:a]
        texts.append((f"d{i}", t))
    docs = spark.createDataFrame([(d, " \n".join(t)) for d, t in texts], "doc_id string, text string")
    bench = spark.createDataFrame([(i, " ".join(p).title()) for i, p in items], "item_id decimal(10,0), text string")
    want = []
    for d, t in texts:
        for i, p in items:
            n = sum(x for _, _, x in greedy(p, t, min(5, len(p)))) if p else 0
            if p and n >= 0.6 * len(p):
                want.append((d, str(i), n))
    assert sorted((r.doc_id, str(r.item_id), r.covered_words) for r in D.contaminated(docs, bench).collect()) == sorted(want)
    assert sorted(r.doc_id for r in D.decontaminated(docs, bench).collect()) == sorted({d for d, _ in texts} - {d for d, *_ in want})
    none = D.decontaminated(spark.createDataFrame([(None, None), ("x", "")], docs.schema), bench)
    assert none.count() == 2 and D.decontaminated(docs, bench.limit(0)).count() == 80
