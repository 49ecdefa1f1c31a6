import random

from planarlake.llm import similar as S


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, least=0.8):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    low = {k: min([d for d in v if d is not None], default=None) for k, v in groups.items()}
    return sorted([(d, low[root(i)]) for i, (d, _) in enumerate(rows)], key=str)


def texts():
    """Texts with near copies at similarities around 0.8, a passage that many share, and a large group of near copies."""
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(3000)}"
    base = [[word() for _ in range(rnd.randint(3, 200))] for _ in range(40)]
    passage = [word() for _ in range(60)]
    rows = []
    for b in base:
        for edits in (0, 1, 2, 3, 5):
            w = list(b)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(rnd.randint(0, 12))] + passage) for _ in range(60)]
    rows += [" ".join(base[0] + [f"n{i}"]) for i in range(60)]
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (None, "a b"), (902, "A  b"), (7, rows[7])]


def test_all_pairs_of_similarity_as_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.similar_groups(df)
    assert sorted([(r.doc_id, r.component_id) for r in got.collect()], key=str) == brute(rows)
    assert S.similar_groups(df.limit(0)).count() == 0


def test_stage_takes_near_copies_at_many_bits(spark):
    import corpus_pipeline as P

    rows = [(d, t) for d, t in texts() if d is not None and d != 7]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(r.doc_id for r in P.dedup_near(spark, df, "").collect())
    assert left == sorted({g for _, g in brute(rows)})


def test_stage_keeps_one_row_of_each_group_with_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    t = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"]
    near = [x + " more" for x in t]
    # 5 stands in two groups: its first text goes with document 1, its second leads a group of its own.
    rows = [(None, t[0]), (None, t[1]), (None, near[1]), (1, t[2]), (5, near[2]), (5, t[3]), (6, near[3]), (7, t[4]), (7, t[5]), (7, t[5]), (8, None), (9, "")]
    df = spark.createDataFrame([(d, x, "en", f"s{i}", len(x or "")) for i, (d, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.dedup_near(spark, df, "").collect()
    got = sorted([(r.doc_id, r.text) for r in out], key=str)
    one = next(r.text for r in out if r.text in (t[1], near[1]))
    assert got == sorted([(None, t[0]), (None, one), (1, t[2]), (5, t[3]), (7, t[4]), (7, t[5]), (8, None)], key=str)
    assert {(r.doc_id, r.text, r.source) for r in out} <= {(d, x, f"s{i}") for i, (d, x) in enumerate(rows)}
