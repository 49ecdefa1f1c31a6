"""SimHash near-duplicates: fingerprints joined on Golay-decoded segments, verified, grouped.

A 64-bit fingerprint has three segments of 23, 23 and 18 bits (the last is padded to 23). Two fingerprints that
differ at two bits at most agree wholly in some segment, and differ at two bits at most in the next one. The perfect
(23, 12) Golay code puts every 23-bit word within distance 3 of one codeword; words at distance 2 or less have a
codeword within distance 4 of both (the one that decodes a word halfway). So the exact bits of one segment, with the
12-bit index of each of the next segment's codewords within distance 4 (one or six), are keys on which every linked
pair meets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: g(x) of the (23, 12) binary Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: A key's fingerprints are compared in blocks up to so many; larger groups go through shared halfway words instead.
BLOCK = 512


def _rest(v: int) -> int:
    for b in range(22, 10, -1):
        if v >> b & 1:
            v ^= GENERATOR << (b - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits together with, by syndrome, the error patterns of weight 4 or less."""
    one = [_rest(1 << b) for b in range(23)]
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for b in range(12):
        low[1 << b : 2 << b] = low[: 1 << b] ^ one[b]
    for b in range(11):
        high[1 << b : 2 << b] = high[: 1 << b] ^ one[12 + b]
    errors: list[list[int]] = [[] for _ in range(2048)]
    for n in range(5):
        for bits in combinations(range(23), n):
            s = e = 0
            for b in bits:
                s, e = s ^ one[b], e | 1 << b
            errors[s].append(e)
    most = max(map(len, errors))
    return np.concatenate((low, high)), np.array([x + [-1] * (most - len(x)) for x in errors], np.int64)


def golay_keys(words: np.ndarray, tables) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of each 23-bit word; -1 where there are fewer."""
    syn, errors = tables
    s = syn[words & 4095] ^ syn[4096 + (words >> 12)]
    e = errors[s]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def fingerprint_keys(fp: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, with the position of each one's fingerprint."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys, at = [], []
    for i in range(3):
        g = golay_keys(seg[(i + 1) % 3], tables)
        row, _ = np.nonzero(g >= 0)
        keys.append((np.int64(i) << 60) | (seg[i][row] << 12) | g[g >= 0])
        at.append(row)
    return np.concatenate(keys), np.concatenate(at)


def fingerprint(words: list[bytes], n: int) -> int:
    """SimHash of one text's words: XXH64 (seed 42) of each n-word shingle; a bit is set if over half the hashes have it."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(text[i:j], 42) for i, j in zip(a, b)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero of none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every text; a null text has the fingerprint zero, as one without words."""

    def mark(batches):
        for b in C.slices(batches):
            fp = np.array([fingerprint(t.lower().split(), words) for t in C.raw_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(mark, f"doc_id {kind}, fp long")


def near(fp: np.ndarray) -> np.ndarray:
    """Position of the smallest fingerprint reachable within the block by links of two bits or fewer."""
    u = fp.view(np.uint64)
    linked = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    label = np.arange(len(u))
    while True:
        new = np.where(linked, label[None, :], len(u)).min(1)
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, parts: int) -> DataFrame:
    """(u, v) edges that join all distinct fingerprints (column fp) at two bits or fewer, without listing all pairs."""

    def keyed(batches):
        tables = golay_tables()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            keys, at = fingerprint_keys(fp, tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["key", "fp"])

    def paired(batches):
        """Sorted (key, fp) rows: links within small groups, halfway words of large ones. Holds one block at most."""
        key_left, fp_left, big = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        one = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))

        def done(keys, fp):
            nonlocal big
            cut = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
            u, v, w, x = [], [], [], []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                if keys[a] == big or b - a > BLOCK:
                    half = (fp[a:b].view(np.uint64)[:, None] ^ one).view(np.int64)
                    w.append(half.ravel())
                    x.append(np.repeat(fp[a:b], 65))
                else:
                    to = near(fp[a:b])
                    i = np.flatnonzero(to != np.arange(b - a))
                    u.append(fp[a:b][i])
                    v.append(fp[a:b][to[i]])
            for kind, p, q in ((0, u, v), (1, w, x)):
                if p:
                    p, q = np.concatenate(p), np.concatenate(q)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), kind, np.int32)), pa.array(p), pa.array(q)], ["kind", "u", "v"])

        for b in batches:
            keys = np.concatenate((key_left, b.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp_left, b.column(1).to_numpy(zero_copy_only=False)))
            # The last key may go on in the next batch.
            at = int(np.searchsorted(keys, keys[-1]))
            if len(keys) - at > BLOCK:
                yield from done(keys[:at], fp[:at]) if at else ()
                big = keys[-1]
                yield from _halfway(fp[at:], one)
                key_left, fp_left = np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            if big is not None and len(keys) and keys[0] == big:
                n = int(np.searchsorted(keys, big, "right"))
                yield from _halfway(fp[:n], one)
                keys, fp, at = keys[n:], fp[n:], max(0, at - n)
            if at:
                yield from done(keys[:at], fp[:at])
            key_left, fp_left = keys[at:], fp[at:]
        if len(key_left):
            yield from done(key_left, fp_left)

    rows = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    found = C.staged(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(paired, "kind int, u long, v long").distinct(), "links")
    half = found.where("kind = 1")
    centre = half.groupBy("u").agg(F.min("v").alias("c"))
    star = half.join(centre, "u").where("v <> c").select(F.col("v").alias("u"), F.col("c").alias("v"))
    return found.where("kind = 0").select("u", "v").union(star).distinct()


def _halfway(fp: np.ndarray, one: np.ndarray):
    if len(fp):
        half = (fp.view(np.uint64)[:, None] ^ one).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(half.size, np.int32)), pa.array(half.ravel()), pa.array(np.repeat(fp, 65))], ["kind", "u", "v"])


def simhash_groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links of two bits or fewer) of every row.

    Texts without words (null, empty, white space) have the fingerprint zero and are linked like any other. Repeated
    rows give repeated results. A null id takes part, but is never the smallest of a group that has another; a group
    of null ids only has a null component. An empty table gives an empty result. Exact copies meet once, as one
    distinct fingerprint; nothing of all documents is gathered on the driver.
    """
    parts = C.parts_for(docs, 4)
    marked = C.staged(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = C.components(links(distinct, parts))
    both = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    group = both.groupBy("root").agg(F.min("low").alias("component_id"))
    named = both.join(group, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups of all documents; null and empty texts have the fingerprint zero and are linked like others."""
    found = simhash_groups(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
ORACLES: dict[str, str] = {}
