"""Near copies by their whole shingle sets: every pair of a Jaccard similarity of at least so much is linked.

Two sets in one order of shingles can only be so similar if they share one of their first n - ceil(least * n) + 1 (prefix
filter), and if enough can follow the first one shared. The order puts shingles that many sets have last, by a table of
hashed counts of fixed size; any order is exact, this one keeps groups small. Each group of sets with a prefix shingle in
common is held against two of its sets first (the one that shares most of its shingles, and one by hash), as are the sets
that Golay-keyed SimHash links; only sets that are in different components then are compared in pairs. Texts are shingled again where their sets are needed, as that is cheaper than moving sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import simhash
from . import words as W

#: Slots of the table of hashed counts: 4 MB, whatever the input.
SLOT_BITS = 20
#: Slots in one row of the table on its way.
STRIPE = 1 << 14
#: Bits of the filter of sets that have partners: 2 MB.
FILTER_BITS = 24
#: Sets that a task remembers as written.
KNOWN = 200_000


class Shingler:
    """Shingle sets of texts: n words on end, hashed."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, W.Words()

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingles of each text (one of all its words if it has fewer than n)."""
        x, count = self.words.of(*C.utf8(texts))
        whole = W.rolled(x, self.n)
        out, at = [], 0
        for size in count.tolist():
            if size >= self.n:
                part = np.sort(whole[at : at + size - self.n + 1])
                out.append(part[np.concatenate(([True], part[1:] != part[:-1]))])
            else:
                out.append(W.rolled(x[at : at + size], size) if size else np.zeros(0, np.uint64))
            at += size
        return out


def set_id(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), 7)], np.uint64).view(np.int64)[0])


def slot_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles * W.SHUFFLE >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix_size(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def similar_enough(p: np.ndarray, q: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    both = np.concatenate((p, q))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= least * (len(both) - common) - 1e-9


def _arrays(batch: pa.RecordBatch, at: int) -> Iterator[np.ndarray]:
    data, offs = C.utf8(batch.column(at))
    raw = data.tobytes()
    return (np.frombuffer(raw, np.uint64, (b - a) // 8, a) for a, b in zip(offs.tolist(), offs[1:].tolist()))


def shingled(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(marked, counts): the set (sid) and its SimHash (fp) of every row of docs (doc_id, h, text); how many sets have a
    shingle of each slot.

    A task counts a set once; the table of counts has a fixed size and is all that the driver gets."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h long, sid long, fp long, stripe int, counts binary"

    def mark(batches):
        shingler, seen, total, some = Shingler(words), {}, np.zeros(1 << SLOT_BITS, np.int64), None
        for b in C.slices(batches):
            sid, fp, new = [], [], []
            for s in shingler.sets(b.column(2)):
                sid.append(k := set_id(s))
                if k not in seen:
                    seen[k] = simhash.majority(s)
                    new.append(s)
                fp.append(seen[k])
            if len(seen) > KNOWN:
                seen.clear()
            if new:
                total += np.bincount(slot_of(np.concatenate(new)), minlength=1 << SLOT_BITS)
            some = b.column(0).type
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sid, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), *none], ["doc_id", "h", "sid", "fp", "stripe", "counts"])
        rows = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(-1, STRIPE)
        at = np.flatnonzero(rows.any(1))
        if len(at):
            none = pa.nulls(len(at), some), *[pa.nulls(len(at), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array([rows[i].tobytes() for i in at], pa.binary())], ["doc_id", "h", "sid", "fp", "stripe", "counts"])

    def add(batches):
        """Sorted by stripe: one is held."""
        now, total = None, None
        for b in batches:
            for stripe, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if stripe != now:
                    if now is not None:
                        yield out(now, total)
                    now, total = stripe, np.zeros(STRIPE, np.uint64)
                total += np.frombuffer(c, np.uint32)
        if now is not None:
            yield out(now, total)

    def out(stripe, total):
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["stripe", "counts"])

    found = C.staged(docs.select("doc_id", "h", "text").mapInArrow(mark, schema), "marked")
    stripes = found.where("stripe is not null").select("stripe", "counts").repartition((1 << SLOT_BITS) // STRIPE, "stripe").sortWithinPartitions("stripe")
    table = np.zeros(1 << SLOT_BITS, np.uint32)
    for r in stripes.mapInArrow(add, "stripe int, counts binary").collect():
        table[r.stripe * STRIPE : (r.stripe + 1) * STRIPE] = np.frombuffer(r.counts, np.uint32)
    return found.where("stripe is null").select("doc_id", "h", "sid", "fp"), table


def simhash_pairs(marked: DataFrame, parts: int) -> DataFrame:
    """(u, v) sets that SimHash links, on fingerprints of two different bits or fewer: of each link one pair."""
    sets = marked.select("fp", "sid").distinct()
    low = C.staged(sets.groupBy("fp").agg(F.min("sid").alias("low")), "fingerprints")
    same = sets.join(low, "fp").where("sid <> low").select(F.col("low").alias("u"), F.col("sid").alias("v"))
    u, v = (low.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_sid")) for c in "uv")
    return same.union(simhash.links(low, parts).join(u, "u").join(v, "v").select("u_sid", "v_sid"))


def shared_prefixes(docs: DataFrame, table: np.ndarray, words: int, least: float) -> DataFrame:
    """(key, sid, n, pos) of the prefix shingles that several sets have; n is the size of the set."""
    counts = docs.sparkSession.sparkContext.broadcast(table)
    names, schema = ["key", "sid", "n", "pos"], "key long, sid long, n int, pos int"

    def prefixes(batches):
        shingler, seen, now = Shingler(words), set(), counts.value
        for b in C.slices(batches):
            out = []
            for s in shingler.sets(b.column(0)):
                k = set_id(s)
                if not len(s) or k in seen:
                    continue
                seen.add(k)
                p = prefix_size(len(s), least)
                first = s[np.lexsort((s, now[slot_of(s)]))[:p]]
                out.append((first.view(np.int64), np.full(p, k), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)))
            if len(seen) > KNOWN:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

    def several(batches):
        """Sorted by key and sid: rows of keys that have more sets than one, each set once. One row is held."""
        held = None  # the last row; whether it is out already
        for b in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            if not b.num_rows:
                continue
            gone = False
            if held is not None:
                cols, gone = [np.concatenate((x[:1], y)) for x, y in zip(held[0], cols)], held[1]
            key, sid = cols[0], cols[1]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            cols = [x[new] for x in cols]
            key = cols[0]
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            last = [x[-1:] for x in cols]
            if gone:
                keep[0] = False
            out = bool(keep[-1]) or (len(key) == 1 and gone)
            held = (last, out)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names)

    parts = C.parts_for(docs, 4)
    rows = docs.select("text").mapInArrow(prefixes, schema).repartition(parts, "key").sortWithinPartitions("key", "sid")
    return C.staged(rows.mapInArrow(several, schema), "shared")


def similar_links(docs: DataFrame, marked: DataFrame, table: np.ndarray, words: int, least: float) -> DataFrame:
    """(u, v) sets whose Jaccard similarity is ``least`` or more: enough of them to join all that are connected so."""
    shared = shared_prefixes(docs, table, words, least)

    def can(n, i, m, j):
        """Whether sets of n and m shingles that meet first at places i and j can be similar enough."""
        return (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (1 + F.least(n - i, m - j) - 1 >= least / (1 + least) * (n + m) - 1e-9)

    # Of a group of copies, the original shares more of its shingles than the others do.
    often = shared.groupBy("sid").agg(F.count(F.lit(1)).alias("often"))
    ranked = shared.join(often, "sid")
    first = lambda *by: F.min(F.struct(*by, "sid", "n", "pos"))
    reps = ranked.groupBy("key").agg(first(-F.col("often") / F.col("n"), F.xxhash64("sid")).alias("r0"), first(F.xxhash64("sid")).alias("r1"))
    reps = reps.select("key", F.explode(F.array(*[F.struct(*[F.col(f"r{i}.{c}").alias(f"b_{c}") for c in ("sid", "n", "pos")]) for i in (0, 1)])).alias("b")).select("key", "b.*")
    reps = C.staged(reps, "reps")  # so that the join can split the key that very many sets have
    star = shared.join(reps, "key").where((F.col("sid") != F.col("b_sid")) & can(F.col("n"), F.col("pos"), F.col("b_n"), F.col("b_pos")))
    pairs = star.select(F.col("b_sid").alias("u"), F.col("sid").alias("v")).union(simhash_pairs(marked, C.parts_for(docs, 4)))
    found = verified(docs, pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), words, least)
    roots = C.staged(C.components(found), "roots")
    rows = shared.join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
    apart = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rows = C.staged(rows.join(apart, "key"), "rows")
    C.discard(shared, reps)
    C.release(docs.sparkSession)
    b = rows.select("key", *[F.col(c).alias(f"b_{c}") for c in ("sid", "n", "pos", "root")])
    apart = F.col("root") < F.col("b_root")
    rest = rows.join(b, "key").where(apart & can(F.col("n"), F.col("pos"), F.col("b_n"), F.col("b_pos"))).select(F.col("sid").alias("u"), F.col("b_sid").alias("v")).distinct()
    more = verified(docs, rest, words, least)
    C.discard(rows, roots)
    return found.union(more)


def verified(docs: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the (u, v) pairs whose whole shingle sets have a Jaccard similarity of ``least`` or more."""
    spark = docs.sparkSession
    pairs = C.staged(pairs, "pairs")
    need = pairs.select(F.col("u").alias("sid")).union(pairs.select("v"))

    wanted = spark.sparkContext.broadcast(W.bits_of(need.select("sid"), FILTER_BITS))

    def sets(batches):
        shingler, seen, mark = Shingler(words), set(), wanted.value
        for b in C.slices(batches):
            out = []
            for s in shingler.sets(b.column(0)):
                k = set_id(s)
                if k not in seen and W.has_bit(mark, np.array([k]))[0]:
                    seen.add(k), out.append((k, s.tobytes()))
            if len(seen) > KNOWN:
                seen.clear()
            if out:
                k, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.binary())], ["sid", "shingles"])

    held = C.staged(docs.select("text").mapInArrow(sets, "sid long, shingles binary").join(need.distinct(), "sid").dropDuplicates(["sid"]), "sets")
    a, b = (held.select(F.col("sid").alias(c), F.col("shingles").alias(f"{c}s")) for c in "uv")

    def judged(batches):
        for x in batches:
            keep = [similar_enough(p, q, least) for p, q in zip(_arrays(x, 2), _arrays(x, 3))]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(b, "v").join(a, "u").select("u", "v", "us", "vs")
    out = C.staged(both.mapInArrow(judged, "u long, v long"), "similar")
    C.discard(pairs, held)
    return out


def _similar(docs: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(marked, roots): the set (sid) of every row of docs (doc_id, h, text), and the root of each set that has another."""
    marked, table = shingled(docs, words)
    return marked, C.components(similar_links(docs, marked, table, words, least))


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest id reachable over texts whose sets of shingles have a Jaccard similarity of
    ``least`` or more) of every row; all pairs count, none is missed for its fingerprint.

    Texts without words are alike. Null ids, repeated rows and empty tables are as in simhash_groups.
    """
    marked, roots = _similar(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("h", F.xxhash64("text")), words, least)
    low = marked.groupBy("sid").agg(F.min("doc_id").alias("low"))
    named = low.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "low", F.coalesce("root", "sid").alias("root"))
    group = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(named.join(group, "root").select("sid", "component_id"), "sid").select("doc_id", "component_id")


def similar_firsts(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs (doc_id, text and others) of each group of similar_groups: the one with the smallest id, null ids
    last, and of those the smallest hash of the whole row. Rows are told apart by id and hash, so that null and repeated
    ids lose none."""
    cols = docs.columns
    h = F.xxhash64(*[docs[c] for c in cols], *[docs[c].isNull() for c in cols])
    marked, roots = _similar(docs.select("doc_id", "text", h.alias("h")), words, least)
    low = marked.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")).alias("low"))
    named = low.join(roots, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("root", "sid")).agg(F.min("low").alias("low"))
    stay = named.select(F.col("low.doc_id").alias("stay_id"), F.col("low.h").alias("stay_h"))
    kept = docs.join(stay, docs.doc_id.eqNullSafe(F.col("stay_id")) & (h == F.col("stay_h")))
    return kept.dropDuplicates(["stay_id", "stay_h"]).select(*cols)
