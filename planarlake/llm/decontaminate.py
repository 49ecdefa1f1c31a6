"""Benchmark decontamination by greedy string tiling.

Runs of five words (seeds; of a shorter item all its words) that a text shares with a benchmark item make them a
candidate pair; no other pair can have a tile. Texts keep only the stretches that a bit filter of the seeds lets through;
these are joined to the items by their seeds. Within a pair the longest non-overlapping common runs are marked again and
again (running Karp-Rabin: windows of the present length are hashed in the item and rolled over the text, matches
extended, marked longest first, the length lowered), so passages count wherever and in whatever order they stand. The
share of the item's words under tiles decides.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import words as W

#: Words of a seed, and of the shortest tile; items of fewer words take all of theirs.
SEED = 5
#: Share of an item's words that tiles must cover.
COVERED = 0.6
#: Bits of the filter of seeds: 4 MB, whatever the benchmark.
FILTER_BITS = 25


def tiles(item: list[int], text: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length) of two sequences; negative numbers in text match nothing."""
    used_p, used_t = [False] * len(item), [x < 0 for x in text]
    found: list[tuple[int, int, int]] = []
    mod, base = (1 << 61) - 1, 1_000_003

    def windows(seq, used, s):
        """(start, hash) of every unmarked window of s, rolled along."""
        top, h, run = pow(base, s, mod), 0, 0
        for i, x in enumerate(seq):
            if used[i]:
                h = run = 0
                continue
            h, run = (h * base + x + 1) % mod, run + 1
            if run > s:
                h = (h - (seq[i - s] + 1) * top) % mod
            if run >= s:
                yield i - s + 1, h

    def scan(s):
        at = defaultdict(list)
        for i, h in windows(item, used_p, s):
            at[h].append(i)
        out, most = [], 0
        for j, h in windows(text, used_t, s):
            for i in at.get(h, ()):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                if n >= s:
                    if n > 2 * s:
                        return n, []
                    out.append((n, i, j))
                    most = max(most, n)
        return most, out

    def mark(matches, s):
        by = defaultdict(list)
        for n, i, j in matches:
            by[n].append((i, j))
        n = max(by, default=0)
        while n >= s:
            for i, j in sorted(by.pop(n, ())):
                free = [not (used_p[i + x] or used_t[j + x]) for x in range(n)]
                if all(free):
                    used_p[i : i + n] = used_t[j : j + n] = [True] * n
                    found.append((i, j, n))
                else:  # what is left of it in one piece waits for its own length
                    x = 0
                    while x < n:
                        y = x
                        while y < n and free[y]:
                            y += 1
                        if y - x >= s:
                            by[y - x].append((i + x, j + x))
                        x = y + 1
            n = max((k for k in by if k < n), default=0)

    s = max(least, min(20, len(item)))
    while True:
        most, got = scan(s)
        if most > 2 * s:
            s = most
            continue
        mark(got, s)
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        else:
            return sorted(found)


def seeds_of(x: np.ndarray) -> np.ndarray:
    return W.rolled(x, min(SEED, len(x))).view(np.int64) if len(x) else np.zeros(0, np.int64)


def item_table(benchmark: DataFrame, item_col: str) -> DataFrame:
    """(item, item_id, n, words) of the distinct items with words: item is a number of its own, words are hashes."""
    items = benchmark.select(F.col(item_col).alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()

    def hashed(batches):
        words = W.Words()
        for b in C.slices(batches):
            x, count = words.of(*C.utf8(b.column(1)))
            ends = np.cumsum(count)
            parts = [x[e - n : e].tobytes() for e, n in zip(ends.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count.astype(np.int32)), pa.array(parts, pa.binary())], ["item_id", "n", "words"])

    schema = T.StructType([T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("n", T.IntegerType()), T.StructField("words", T.BinaryType())])
    return C.staged(items.mapInArrow(hashed, schema).where("n > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def item_seeds(items: DataFrame, covered: float) -> DataFrame:
    """(seed, item): enough of the items' seeds to meet every text that covers them. Tiles that cover so much of an item
    stand at ceil(covered * n / 5) of its seeds' places at least, so of the seeds that most items have all but one may go."""

    def cut(batches):
        for b in batches:
            seeds = [np.unique(seeds_of(np.frombuffer(x, np.uint64))) for x in b.column(2).to_pylist()]
            if seeds:
                item = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(s) for s in seeds])
                n = np.repeat(b.column(1).to_numpy(zero_copy_only=False), [len(s) for s in seeds])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds)), pa.array(item), pa.array(n)], ["seed", "item", "n"])

    seeds = C.staged(items.select("item", "n", "words").mapInArrow(cut, "seed long, item long, n int"), "seeds")
    often = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("often").desc(), "seed"))
    # Places repeat where an item repeats itself; distinct seeds are what can be left out, so a repeated one leaves none.
    places = F.col("n") - F.least(F.lit(SEED), F.col("n")) + 1
    spare = F.when(F.count(F.lit(1)).over(Window.partitionBy("item")) == places, F.ceil(F.lit(covered) * F.col("n") / SEED - 1e-9) - 1).otherwise(0)
    kept = seeds.join(often, "seed").withColumn("rank", rank).withColumn("spare", spare).where("rank > spare")
    return kept.select("seed", "item")


def stretches(docs: DataFrame, bits, sizes: list[int], least: int, id_col: str, text_col: str) -> DataFrame:
    """(text, doc_id, h, words, seeds) of texts with ``least`` words or more in seeds that pass the filter: the hashes of
    these words, a zero between stretches; text is a number of its own, h the text's hash."""

    def found(batches):
        words, mark = W.Words(), bits.value
        for b in C.slices(batches):
            x, count = words.of(*C.utf8(b.column(2)))
            ends = np.cumsum(count)
            left = np.repeat(ends, count) - np.arange(len(x))  # words from here to the text's end
            cover, hits = np.zeros(len(x) + 1, np.int32), []
            for k in sizes:
                h = W.rolled(x, k).view(np.int64)
                at = np.flatnonzero(W.has_bit(mark, h) & (left[: len(h)] >= k))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + k, -1)
                hits.append((at, h[at]))
            c = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            if not len(c):
                continue
            doc = np.searchsorted(ends, c, "right")
            new = np.flatnonzero((np.diff(c) != 1) | (np.diff(doc) != 0)) + 1
            seq, own = np.insert(x[c], new, 0), np.insert(doc, new, doc[new])
            at, h = (np.concatenate(v) for v in zip(*hits))
            by = np.argsort(at, kind="stable")
            at, h = at[by], h[by]
            of = np.searchsorted(ends, at, "right")
            rows = [i for i in np.unique(doc).tolist() if np.searchsorted(doc, i, "right") - np.searchsorted(doc, i) >= least]
            if rows:
                parts = [seq[np.searchsorted(own, i) : np.searchsorted(own, i, "right")].tobytes() for i in rows]
                seeds = [np.unique(h[np.searchsorted(of, i) : np.searchsorted(of, i, "right")]) for i in rows]
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(parts, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], ["doc_id", "h", "words", "seeds"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("seeds", T.ArrayType(T.LongType()))])
    texts = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    return C.staged(texts.mapInArrow(found, schema).withColumn("text", F.monotonically_increasing_id()), "stretches")


def tiled(docs: DataFrame, benchmark: DataFrame, covered: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """(doc_id, h, item_id, item_words, n_tiles, covered_words) of each text and item with enough coverage."""
    items = item_table(benchmark, item_col)
    sizes = sorted({min(SEED, r.n) for r in items.select(F.least("n", F.lit(SEED)).alias("n")).distinct().collect()})
    shortest = items.agg(F.min("n")).first()[0] or 1
    seeds = C.staged(item_seeds(items, covered), "seeds")
    # A stretch needs all of its seeds, so the filter has also those that the join leaves out.
    every = items.select("words").mapInArrow(_all_seeds, "seed long")
    bits = docs.sparkSession.sparkContext.broadcast(W.bits_of(every, FILTER_BITS))
    texts = stretches(docs, bits, sizes, int(np.ceil(covered * shortest - 1e-9)), id_col, text_col)
    pairs = texts.select("text", F.explode("seeds").alias("seed")).join(seeds, "seed").select("text", "item").distinct()
    both = pairs.join(items.select("item", "item_id", "n", F.col("words").alias("item_body")), "item").join(texts.select("text", "doc_id", "h", "words"), "text")

    def search(batches):
        for b in C.slices(batches, "words"):
            keep, numbers = [], []
            for i, (p, t) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                p, t = np.frombuffer(p, np.uint64), np.frombuffer(t, np.uint64)
                if len(t) < covered * len(p):
                    continue
                number = {h: k for k, h in enumerate(dict.fromkeys(p.tolist()))}
                found = tiles([number[h] for h in p.tolist()], [number.get(h, -1) for h in t.tolist()], min(SEED, len(p)))
                n = sum(x for _, _, x in found)
                if n >= covered * len(p) - 1e-9:
                    keep.append(i), numbers.append((len(p), len(found), n))
            if keep:
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in (0, 1, 2)), *(pa.array(v, pa.int64()) for v in zip(*numbers))], names)

    names = ["doc_id", "h", "item_id", "item_words", "n_tiles", "covered_words"]
    kinds = [docs.schema[id_col].dataType, T.LongType(), benchmark.schema[item_col].dataType, *[T.LongType()] * 3]
    schema = T.StructType([T.StructField(*x) for x in zip(names, kinds)])
    return both.select("doc_id", "h", "item_id", "n", "item_body", "words").mapInArrow(search, schema)


def _all_seeds(batches):
    for b in batches:
        seeds = [seeds_of(np.frombuffer(x, np.uint64)) for x in b.column(0).to_pylist()]
        if seeds:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds))], ["seed"])


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, id_col="doc_id", text_col="text", item_col="item_id") -> DataFrame:
    """(doc_id, item_id, item_words, n_tiles, covered_words, coverage) of each text and item with enough coverage.

    An item of fewer than five words must stand whole. Ids of documents and items may be of any type, and null. Null and
    wordless texts and items match nothing; repeated rows give repeated results, repeated items count once, the same text
    under two item ids twice. Empty tables give an empty result. Other columns are not read.
    """
    out = tiled(docs, benchmark, covered, id_col, text_col, item_col).drop("h")
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, text_col="text", item_col="item_id") -> DataFrame:
    """The rows of docs, as they are, whose text covers no benchmark item by ``covered`` or more.

    Rows go by their texts alone (128 bits of hash), whatever their ids; null and empty texts stay, as do all rows of an
    empty benchmark."""
    two = lambda c: F.xxhash64(F.lit(1), c)
    texts = docs.select(two(docs[text_col]).alias("other"), docs[text_col].alias("text"))
    found = tiled(texts, benchmark, covered, "other", "text", item_col)
    bad = C.staged(found.select(F.col("h").alias("bad_h"), F.col("doc_id").alias("bad_other")).distinct(), "found")
    gone = (F.xxhash64(docs[text_col]) == F.col("bad_h")) & (two(docs[text_col]) == F.col("bad_other"))
    return docs.join(bad, gone, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated, of all documents and all benchmark items."""
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {}
