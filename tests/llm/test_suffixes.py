import hashlib
import random

import numpy as np
import pytest
import xxhash

from planarlake.llm import suffixes as S


def brute(rows):
    """Rows of (id, text) to (id, bytes, removed, spans, sha256), by a dictionary of all windows."""

    def place(r):
        d, t = r
        often = sum(x[0] == d for x in rows) > 1 or d is None
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return (d is None, d or 0, (h - (1 << 64) if h >> 63 else h) if often else 0)

    seen, done = {}, {}
    for r in sorted(rows, key=place):
        if r in done:
            continue
        t = (r[1] or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen[w] = 1
        edges = np.diff(np.concatenate(([False], gone, [False])).astype(int))
        done[r] = (str(r[0]), len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return sorted(done[r] for r in rows)


def found(spark, rows):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, same int, late string")
    out = S.suffix_dedup(df).collect()
    for r in out:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)


def corpus(n=120, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rnd.randint(15, 60)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [text(rnd.randint(0, 40)) if rnd.random() < 0.5 else rnd.choice(shared)[rnd.randint(0, 20) :] for _ in range(rnd.randint(0, 5))]
        t = " ".join(parts)
        if rnd.random() < 0.2 and len(t) > 10:
            k = rnd.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i * 3 % 200, t) if i * 3 % 200 not in {r[0] for r in rows} else (1000 + i, t))
    return rows


@pytest.mark.parametrize("piece,many,gather", [(2 << 20, 20_000, 1 << 20), (900, 20_000, 3000), (2 << 20, 3, 2000)])
def test_against_brute_force(spark, monkeypatch, piece, many, gather):
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "GATHER", gather)
    rows = corpus()
    rows += [(2000, None), (2001, ""), (None, rows[3][1]), (2002, "a" * 700 + "b" + "a" * 400), (2003, "ab" * 300), (2004, "a" * 250)]
    rows += [(rows[5][0], rows[5][1]), (2005, rows[6][1]), (2005, rows[6][1] + " more"), (None, rows[8][1]), (2006, "\0" * 150 + "x" * 120 + "\0" * 130), (2007, rows[9][1] * 3)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_intervals_are_maximal_repeats():
    rnd = random.Random(4)
    base = "".join(rnd.choice("ab") for _ in range(60))
    strings = [(base * 3)[rnd.randint(0, 50) :][:165].encode() for _ in range(6)] + [b"b" + (base * 3)[:140].encode()]
    got = {(n, tuple(sorted(zip(o.tolist(), f.tolist())))) for n, o, f in S.repeats(strings, np.zeros(len(strings), np.int64))}
    where = {}
    for i, s in enumerate(strings):
        for a in range(len(s) - 99):
            for b in range(a + 100, len(s) + 1):
                where.setdefault(s[a:b], []).append((i, a))
    want = set()
    for sub, at in where.items():
        after = [strings[i][a + len(sub) : a + len(sub) + 1] or (i, a) for i, a in at]
        before = [strings[i][a - 1 : a] if a else (i, a) for i, a in at]
        if len(at) > 1 and len(set(after)) > 1 and len(set(before)) > 1:
            want.add((len(sub), tuple(sorted(at))))
    assert got == want
