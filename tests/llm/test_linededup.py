import random

from planarlake.llm import linededup as D


def brute(rows):
    """{(id, text): (text left, lines, chunks gone, lines gone)}; ids sorted, null last."""
    docs = sorted(set(r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0]))
    texts, first, out = [t.split("\n") for _, t in docs], {}, {}
    for n, x in enumerate(texts):
        found = []
        for s in D.seeds([D.line_hash(y) for y in x]):
            at = first.setdefault(tuple(x[s : s + 2]), (n, s))
            if at != (n, s):
                found.append((s, at))
        gone = set()
        for k, (s, (m, f)) in enumerate(found):
            low, high = found[k - 1][0] if k else 0, found[k + 1][0] if k + 1 < len(found) else len(x)
            same = lambda i: 0 <= f + i - s < len(texts[m]) and texts[m][f + i - s] == x[i]
            i = s
            while i < high and same(i):
                gone.add(i)
                i += 1
            i = s - 1
            while i >= low and same(i):
                gone.add(i)
                i -= 1
        out[docs[n]] = ("\n".join(y for i, y in enumerate(x) if i not in gone), len(x), sum(i - 1 not in gone for i in gone), len(gone))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [[f"line {rnd.randrange(10**6)} é" for _ in range(rnd.randint(2, 14))] for _ in range(20)] + [[""] * 9, ["x"] * 40]
    rows = [(i, "\n".join(x for _ in range(rnd.randint(0, 5)) for x in rnd.choice(pool))) for i in range(200)]
    rows += [(300, None), (None, rows[0][1]), (301, ""), (rows[5][0], rows[5][1]), (302, "\n".join(pool[0] * 500))]
    df = spark.createDataFrame([(d, t, 3, "r") for d, t in rows], "doc_id long, text string, lines int, row string")
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed_chunks, r.n_removed_lines) for r in D.line_dedup(df).where("text is not null").collect())
    want = brute(rows)
    assert got == sorted((str(d), *want[d, t]) for d, t in rows if t is not None)
    assert sum(x[4] for x in got) > 100
    bare = D.line_dedup(df).where("text is null").collect()
    assert [tuple(r) for r in bare] == [(300, None, 0, 0, 0)]
    assert D.line_dedup(df.limit(0)).count() == 0


def test_places_resist_shifts():
    rnd = random.Random(9)
    lines = [f"l{rnd.randrange(10**9)}" for _ in range(300)]
    chosen = lambda x: {x[s] for s in D.seeds([D.line_hash(y) for y in x])}
    a, b = chosen(lines), chosen(["new", *lines[:100], "put in", *lines[100:]])
    assert len(a - b) <= 1 and 180 < len(a) < 270


def test_whole_repeated_runs_go(spark):
    rnd = random.Random(11)
    line = lambda: f"word {rnd.randrange(10**8)}"
    runs = [[line() for _ in range(n)] for n in (3, 4, 6, 9, 15)] * 4
    rows = [(i, "\n".join([line(), *r, line()])) for i, r in enumerate(runs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id: r.n_removed_lines for r in D.line_dedup(df).collect()}
    # A run goes whole or (no place in it chosen) stays whole.
    assert all(gone[i] in ((0,) if i < 5 else (0, len(r))) for i, r in enumerate(runs))
    assert all(gone[i] == len(r) for i, r in enumerate(runs) if i >= 5 and len(r) > 4)
