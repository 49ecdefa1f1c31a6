import random
import re
from collections import Counter

from pyspark.sql import functions as F

from planarlake.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(150):
        k = rnd.choice([2, 5, 400])
        rows.append((i, "".join(rnd.choice(["a", "é", "😀x", "b"][:k] if k < 9 else [str(rnd.randrange(400))]) + rnd.choice([" ", "  ", "\n", "#\t", "\x0b"]) for _ in range(rnd.randint(0, 60)))))
    part = " ".join(f"w{i}" for i in range(11))
    rows += [(500, None), (501, ""), (None, part + " x " + part), (502, part), (502, part), (503, ("long " * 3 + part + "\n") * 3000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, words int, lines int")
    got = Q.base_counts(df).collect()
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert mine == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_list_is_learned_and_keeps_clean_rows(spark):
    rnd = random.Random(1)
    good = [(i, " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(999)}x" for _ in range(50)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"W{rnd.randrange(999)}## |" for _ in range(50)), 0) for i in range(60)]
    rows = good + bad
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (7777, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2] + [(None, 0), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in Q.quality_rules(docs, labels).collect()}
    assert all(out[r[0]] for r in good) and not any(out[r[0]] for r in bad) and out[7777] is False
    none = Q.quality_rules(docs, labels.limit(0)).where(F.col("doc_id") < 2000)
    assert none.where("kept").count() == 360
    assert Q.quality_rules(docs.limit(0), labels).count() == 0


def brute_list(rows, precision=0.95, support=4):
    """Sequential covering by trying all thresholds between values, over rows of (features, bad, held back)."""
    import math

    ok = lambda rule, f: all(f[k] >= b if up else f[k] <= b for k, up, b in rule)
    found = []
    while True:
        left = [r for r in rows if not any(ok(x, r[0]) for x in found)]
        grow, rule = [r for r in left if not r[2]], []
        while True:
            inside = [r for r in grow if ok(rule, r[0])]
            bad0, good0 = sum(r[1] for r in inside), sum(not r[1] for r in inside)
            best, gain = None, 1e-9
            for k in Q.FEATURES:
                values = sorted({r[0][k] for r in inside})
                for i, v in enumerate(values):
                    low = (values[i - 1] + v + 1) // 2 if i else v
                    high = (v + values[i + 1]) // 2 if i + 1 < len(values) else v
                    for test in ((k, True, low), (k, False, high)):
                        bad = sum(r[1] for r in inside if ok([test], r[0]))
                        good = sum(not r[1] for r in inside if ok([test], r[0]))
                        new = bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0))) if bad else 0.0
                        if new > gain:
                            best, gain = test, new
            if best is None or best in rule:
                break
            rule.append(best)
        if not rule:
            return found
        count = lambda k, hold, bad: sum(ok(rule[:k], r[0]) and r[1] == bad for r in left if r[2] == hold)
        worth = [(count(k, True, True) - count(k, True, False)) / max(1, count(k, True, True) + count(k, True, False)) for k in range(1, len(rule) + 1)]
        k = 1 + worth.index(max(worth))
        b1, g1 = count(k, True, True), count(k, True, False)
        bad, good = b1 + count(k, False, True), g1 + count(k, False, False)
        if bad < support or bad < precision * (bad + good) or b1 < precision * (b1 + g1):
            return found
        found.append(rule[:k])


def test_list_equals_brute_force(spark):
    import zlib

    rnd = random.Random(12)
    rows = []
    for i in range(400):
        f = {k: rnd.randrange(12) for k in Q.FEATURES}
        bad = f["symbols"] > 8 and f["digits"] < 7 or f["marks"] == 0 or f["capitals"] + f["distinct"] < 4 or rnd.random() < 0.01
        rows.append((i, f, bool(bad)))
    df = spark.createDataFrame([(i, *f.values(), bad) for i, f, bad in rows], "doc_id long, " + ", ".join(f"{k} int" for k in Q.FEATURES) + ", bad boolean")
    got = Q.learn(df)
    want = brute_list([(f, bad, zlib.crc32(str(i).encode()) % 3 == 0) for i, f, bad in rows])
    assert [[(t.feature, t.above, t.bound) for t in r] for r in got] == want and len(want) > 1
