import random
import re

import numpy as np
import xxhash

from planarlake.llm import simhash as S


def brute(rows, n=3):
    """[(id, text)] to {(id, fingerprint hex, component)} by comparing all pairs."""
    fps = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    low = {k: min([d for d in v if d is not None], default=None) for k, v in groups.items()}
    return sorted(((d, f"{fps[i]:016x}", low[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    out = S.simhash_groups(df)
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out.collect()), key=str)


def test_keys_meet_for_every_pair_within_two_bits():
    tables, rng = S.golay_tables(), np.random.default_rng(1)
    for _ in range(40):
        a = int(rng.integers(0, 2**63))
        flips = {a} | {a ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i + 1)}
        fps = np.array(sorted(flips), np.uint64).view(np.int64)
        keys, at = S.fingerprint_keys(fps, tables)
        by = {}
        for k, i in zip(keys.tolist(), at.tolist()):
            by.setdefault(i, set()).add(k)
        mine = by[int(np.flatnonzero(fps.view(np.uint64) == np.uint64(a))[0])]
        assert all(mine & v for v in by.values())


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["The", "of", "and", "été", "cat", "dog", "runs", "sits", "x"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    rows = []
    for i, t in enumerate(base * 4):
        w = t.split()
        if w and i >= 40:
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " \t".join(w)))
    rows += [(900, None), (901, ""), (None, "a b"), (902, "a b"), (7, base[7]), (7, base[7])]
    assert found(spark, rows) == brute(rows)


def test_large_key_groups_go_through_halfway_words(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    fps = [1 << i for i in range(40)] + [3 << 50, 1 << 62 | 7, (1 << 62) | 5]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r.u, r.v) for r in S.links(df, 3).collect()}
    f = S.C.Forest()
    for u, v in got:
        assert (u ^ v).bit_count() <= 4
        f.join(u, v)
    assert len({f.root(x) for x in fps[:40]}) == 1
    assert f.root(3 << 50) == 3 << 50
    assert f.root(1 << 62 | 7) == f.root(1 << 62 | 5)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_components_over_many_rounds(spark, monkeypatch):
    from planarlake.llm import common as C

    monkeypatch.setattr(C, "ONE_TASK_EDGES", 5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (205, 203), (203, 201)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {101: 100, 205: 201, 203: 201}
    assert got == want
