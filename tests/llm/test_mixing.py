import math
import random

import pytest

from pyspark.sql import functions as F

from planarlake.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by handing out and taking back, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        each = left / sum(w[s] for s in free)
        over = {s for s in free if each * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: each * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows_of(n=3000):
    rnd = random.Random(2)
    return [(i, rnd.choice(["src0"] * 6 + ["a", "Z", "é", "b1", None, "tiny" if i % 97 == 0 else "b1"]), int(rnd.paretovariate(1.1) * 20) % 5000) for i in range(n)]


def test_targets_and_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "STRATUM", 400)
    rows = rows_of() + [(None, "a", None), (7, "a", 50), (7, "a", 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = M.mixed_copies(df).collect()
    again = M.mixed_copies(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, longest = {}, {}
    for _, s, z in rows:
        sizes[s] = sizes.get(s, 0) + (z or 0)
        longest[s] = max(longest.get(s, 0), z or 0)
    want = fill(sizes)
    taken, asked = {}, {}
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2 and 0 <= r.rate <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        asked[r.source] = asked.get(r.source, 0) + r.rate * r.size
    for s in sizes:
        assert abs(asked[s] - want[s]) <= 1e-5 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= max(longest[s], 0.02 * want[s])


def test_empty_and_wordless(spark):
    none = spark.createDataFrame([], "doc_id long, source string, size long")
    assert M.mixed_copies(none).count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r.size, r.target) for r in M.mixed_copies(zero).collect()] == [(0, 0.0)] * 2


def test_sizes_are_words(spark):
    df = spark.createDataFrame([(1, "a b\tc\n", "s", 1), (2, None, None, 1), (3, "", "s", 1), (4, " é\x0bx ", "s", 1)], "doc_id long, text string, source string, size int")
    assert [r["size"] for r in M.word_sizes(df).orderBy("doc_id").collect()] == [3, 0, 0, 2]


def root(sizes, target):
    """The tilt whose rates ask for the target, by halving over exact sums of a source's sizes."""
    asked = lambda t: math.fsum(z * 2.0 / (1.0 + math.exp(min(700.0, -t * z))) for z in sizes)
    lo, hi = -1.0, 1.0
    while asked(lo) > target:
        lo *= 2
    while asked(hi) < target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if asked(mid) < target else (lo, mid)
    return lo


@pytest.mark.parametrize("patience", [M.PATIENCE, 0])
def test_tilts_against_halving(spark, monkeypatch, patience):
    monkeypatch.setattr(M, "PATIENCE", patience)
    sizes = {"even": [10] * 50, "wide": [1, 3, 10**6] * 20, None: [7, 90, 2000], "near": list(range(1, 200))}
    share = {"even": 0.3, "wide": 1.7, None: 1e-3, "near": 2 - 1e-6}
    df = spark.createDataFrame([(s, z) for s, v in sizes.items() for z in v] + [("none", 0), ("gap", None)], "source string, size long")
    rows = [(s, len(v), sum(v), share[s] * sum(v)) for s, v in sizes.items()] + [("none", 1, 0, 0.0), ("gap", 1, None, None), ("all", 1, 5, 10.0)]
    targets = spark.createDataFrame(rows, "source string, n_docs long, source_size long, target double")
    got = {r.source: r for r in M.tilts(df, targets).collect()}
    assert len(got) == 7 and got["all"].tilt == math.inf and got["none"].tilt == 0
    for s, v in sizes.items():
        asked = sum(z * 2.0 / (1.0 + math.exp(min(700.0, -got[s].tilt * z))) for z in v)
        assert abs(asked - share[s] * sum(v)) <= 1e-6 * sum(v)
        tilt = root(v, share[s] * sum(v))
        # As near as the words asked for may miss the target by, and the rounding of tilts to eight digits by the mean size.
        slope = sum(2 * z * z * math.exp(-abs(tilt) * z) / (1 + math.exp(-abs(tilt) * z)) ** 2 for z in v)
        assert abs(got[s].tilt - tilt) <= 2e-10 * max(1.0, share[s] * sum(v)) / slope + 1e-8 * max(1.0, len(v) / sum(v))


def test_rates_are_nearest_in_relative_entropy(spark):
    """Among laws over 0, 1 and 2 copies that meet a source's words, none is nearer to (1/4, 1/2, 1/4) than the rates'."""
    rows = [(i, "s", z) for i, z in enumerate((5, 9, 40, 41, 300))] + [(9, "t", 1000)]
    got = [r for r in M.mixed_copies(spark.createDataFrame(rows, "doc_id long, source string, size long"), (1, 3)).collect() if r.source == "s"]
    # A rate r under the tilted law is a binomial of two tries with r / 2; its entropy against the base is twice that of a try.
    away = lambda rates: sum(2 * sum(q * math.log(2 * q) for q in (r / 2, 1 - r / 2) if q > 0) for r in rates)
    rates, rnd = [r.rate for r in got], random.Random(4)
    assert all(0 < r < 2 for r in rates)
    for _ in range(300):
        move = [rnd.uniform(-0.02, 0.02) for _ in rates]
        off = sum(m * r.size for m, r in zip(move, got)) / sum(r.size**2 for r in got)
        moved = [x + m - off * r.size for x, m, r in zip(rates, move, got)]
        if all(0 <= x <= 2 for x in moved):
            assert away(moved) >= away(rates) - 1e-9
