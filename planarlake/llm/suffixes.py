"""Suffix-array dedup: bytes of 100-byte strings that start earlier in the corpus are removed.

Each window of 100 bytes is anchored at its smallest 32-gram hash (leftmost of ties), which equal windows share. Runs of
windows with one anchor are strings of at most 168 bytes; anchors part the corpus into buckets in which all occurrences of
a window meet, with about three runs a hundred bytes to move instead of a hundred suffixes.

- Runs that are equal as a whole are told by hash; all but the first are removed whole. Each task does so within its own
  batches first, so that a run that a third of all documents hold is a row a batch.
- Buckets with different runs (ends of shared passages, edits) get an enhanced suffix array: suffixes in order with the
  lengths of common prefixes, scanned with a stack for the intervals of the common-prefix tree. Intervals whose
  occurrences differ to the left are maximal repeats; all occurrences but the first are removed over their full length.
  The suffixes of a bucket too large for that are dealt out by their first 100 bytes and put in order by Spark's sort:
  those that begin alike stand together, and all but the first in the corpus go.

Removed runs of bytes meet their text again at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of a string that counts, and of the grams that anchor it.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes worked on at once; a longer text is cut into overlapping pieces.
PIECE = 2 << 20
#: Runs of a bucket that one suffix array takes, and bytes of runs that are gathered for one.
MANY, GATHER = 2000, 1 << 20
AT = np.uint64((1 << 24) - 1)


def grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-grams."""
    n = len(data) - 7
    word = np.empty(n, np.uint64)
    for r in range(8):
        part = np.frombuffer(data, "<u8", (len(data) - r) // 8, r)
        word[r::8] = part[: len(word[r::8])]
    m = len(data) - GRAM + 1
    h = word[:m] * np.uint64(0x9E3779B97F4A7C15)
    for k, mult in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(32)
        h += word[k : k + m]
        h *= np.uint64(mult)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def least(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w keys on end."""
    m = len(key)
    pad = np.full(-m % w, np.iinfo(np.uint64).max, np.uint64)
    a = np.concatenate((key, pad)).reshape(-1, w)
    before = np.minimum.accumulate(a, 1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: m - w + 1], before[w - 1 : m])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor hash) of the runs of a piece of several texts; ends are the texts' ends."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty
    h = grams(data)
    at = np.arange(len(h), dtype=np.uint64)
    anchor = (least((h & ~AT) | at, SPAN) & AT).astype(np.int64)
    n = len(anchor)
    good = np.zeros(len(data) + 1, np.int32)
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts >= LENGTH
    np.add.at(good, starts[long], 1)
    np.add.at(good, ends[long] - LENGTH + 1, -1)
    good = np.cumsum(good[:n]) > 0
    new = good.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~good[:-1]
    start = np.flatnonzero(new)
    stop = good.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~good[1:]
    return start, np.flatnonzero(stop) - start + 1, h[anchor[start]].view(np.int64)


def pieces(data: np.ndarray, offs: np.ndarray):
    """(first byte, piece, ends within it) so that each window of each text is in one piece whole."""
    if len(data) <= PIECE + LENGTH:
        yield 0, data, offs[1:]
        return
    for i in range(len(offs) - 1):
        for a in range(int(offs[i]), max(int(offs[i]) + 1, int(offs[i + 1]) - LENGTH + 1), PIECE):
            b = min(int(offs[i + 1]), a + PIECE + LENGTH - 1)
            yield a, data[a:b], np.array([b - a])


def intervals(lcp: np.ndarray, left: np.ndarray):
    """Stack scan of the common-prefix interval tree: (length, first, last) of intervals of LENGTH or more whose
    occurrences differ to the left. lcp[i] is what suffixes i - 1 and i share; left has the byte before each suffix,
    or a number of its own where there is none."""
    stack: list[list[int]] = []
    # diverse up to i: the last place where a neighbour's left byte differs
    change = np.concatenate(([0], np.maximum.accumulate(np.where(left[1:] != left[:-1], np.arange(1, len(left)), 0)))) if len(left) else left
    n = len(lcp)
    for i in range(1, n + 1):
        now = int(lcp[i]) if i < n else 0
        start = i - 1
        while stack and stack[-1][0] > now:
            size, start = stack.pop()
            if change[i - 1] > start:
                yield size, start, i - 1
        if now >= LENGTH and (not stack or stack[-1][0] < now):
            stack.append([now, start])


def repeats(strings: list[bytes], bucket: np.ndarray):
    """Maximal repeats among the strings of each bucket: (length, strings' positions, offsets) of each group."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(size.max())
    flat = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
    base = np.cumsum(size) - size
    n = size - LENGTH + 1
    own = np.repeat(np.arange(len(strings)), n)
    off = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    length = size[own] - off
    where = base[own] + off
    rows = np.zeros((len(own), 4 + width), np.uint8)
    rows[:, :4] = np.unique(bucket, return_inverse=True)[1][own].astype(">u4").view(np.uint8).reshape(-1, 4)
    span = np.arange(width)
    for a in range(0, len(own), 1 << 15):
        part = flat[where[a : a + (1 << 15), None] + span]
        part[span[None, :] >= length[a : a + (1 << 15), None]] = 0
        rows[a : a + (1 << 15), 4:] = part
    order = np.argsort(rows.view(f"S{4 + width}").ravel(), kind="stable")
    rows, own, off, length = rows[order], own[order], off[order], length[order]
    lcp = np.zeros(len(own), np.int64)
    for a in range(1, len(own), 1 << 15):
        b = min(len(own), a + (1 << 15))
        differ = rows[a:b] != rows[a - 1 : b - 1]
        first = np.where(differ.any(1), differ.argmax(1), 4 + width) - 4
        lcp[a:b] = np.minimum(first, np.minimum(length[a:b], length[a - 1 : b - 1]))
    left = np.where(off > 0, flat[base[own] + off - 1].astype(np.int64), -1 - np.arange(len(own)))
    lcp[lcp < LENGTH] = 0
    # Segments of suffixes with long common prefixes are scanned one by one.
    inside = lcp > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        for n, i, j in intervals(lcp[a - 1 : b].copy(), left[a - 1 : b]):
            yield n, own[a - 1 + i : a + j], off[a - 1 + i : a + j]


RUNS = "kind int, bucket long, run long, late boolean, doc_id {k}, same long, start long, windows int"
SPANS = "kind int, bucket long, late boolean, doc_id {k}, same long, start long, until long"
NAMES = [x.split()[0] for x in SPANS.split(", ")]
PLACE = ("late", "doc_id", "same")


def cut_runs(batches):
    """Rows of (late, doc_id, same, text) to runs: kind 0 for the first of equal ones here, 1 for later ones."""
    for b in C.slices(batches, max_bytes=PIECE):
        data, offs = C.utf8(b.column(3))
        same = b.column(2).to_numpy(zero_copy_only=False)
        rank = np.empty(b.num_rows, np.int64)  # of the documents, among those here
        late = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = b.column(1)
        order = pa.compute.sort_indices(pa.table({"late": pa.array(late), "id": ids, "same": pa.array(same)}), [("late", "ascending"), ("id", "ascending"), ("same", "ascending")]).to_numpy()
        rank[order] = np.arange(len(order))
        found = []
        for base, piece, ends in pieces(data, offs):
            start, windows, bucket = runs(piece, ends)
            raw = piece.tobytes()
            h = xxhash.xxh3_64_intdigest
            run = np.array([h(raw[s:e]) for s, e in zip(start.tolist(), (start + windows + LENGTH - 1).tolist())], np.uint64).view(np.int64)
            found.append((start + base, windows, bucket, run))
        if not found:
            continue
        start, windows, bucket, run = map(np.concatenate, zip(*found))
        doc = np.searchsorted(offs[1:], start, "right")
        start = start - offs[doc]
        by = np.lexsort((start, rank[doc], run, bucket))
        start, windows, bucket, run, doc = (x[by] for x in (start, windows, bucket, run, doc))
        again = np.zeros(len(by), bool)
        again[1:] = (bucket[1:] == bucket[:-1]) & (run[1:] == run[:-1])
        if len(by):
            # The same row twice is one document: equal places aren't later ones.
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))
            twin = again & (start == start[head]) & _alike(ids, late, same, doc, doc[head])
            again &= ~twin
        yield pa.RecordBatch.from_arrays(
            [pa.array(again.astype(np.int32)), pa.array(np.where(again, start * 31 + doc, bucket)), pa.array(run), b.column(0).take(pa.array(doc)), ids.take(pa.array(doc)), pa.array(same[doc]), pa.array(start), pa.array(windows.astype(np.int32))],
            ["kind", "bucket", "run", *PLACE, "start", "windows"],
        )


def _alike(ids, late, same, a, b):
    x, y = ids.take(pa.array(a)), ids.take(pa.array(b))
    equal = np.array(pa.compute.fill_null(pa.compute.equal(x, y), False)) | (late[a] + late[b] == 2)
    return equal & (same[a] == same[b])


def scan_runs(batches):
    """Runs in order of (kind, bucket, run, place): spans of later equal runs (kind 1), and the first of each different
    run of buckets that have several (kind 2). Keeps one row."""
    last = None  # (bucket, run) of the row before, and its place
    waiting = None  # the only run of the present bucket so far, as a row
    for b in batches:
        kind, bucket, run, start, windows = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 6, 7))
        n = len(kind)
        key = np.stack((kind.astype(np.int64), bucket, run))
        new_run, new_bucket = np.ones(n, bool), np.ones(n, bool)
        new_bucket[1:] = (key[:2, 1:] != key[:2, :-1]).any(0)
        new_run[1:] = new_bucket[1:] | (run[1:] != run[:-1])
        if last is not None and n:
            new_bucket[0] = tuple(key[:2, 0]) != last[:2]
            new_run[0] = new_bucket[0] or key[2, 0] != last[2]
        later = (kind == 1) | ~new_run
        if n:
            late, same = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64), b.column(5).to_numpy(zero_copy_only=False)
            # Copies of one row are no later ones: the same place as the row before.
            i = np.flatnonzero(later & (kind == 0))
            i = i[i > 0]
            twin = (start[i] == start[i - 1]) & _alike(b.column(4), late, same, i, i - 1)
            later[i[twin]] = False
            if last is not None and later[0] and kind[0] == 0:
                later[0] = (start[0], late[0], same[0], b.column(4)[0].as_py()) != last[3]
            last = (*map(int, key[:, -1]), (start[-1], late[-1], same[-1], b.column(4)[n - 1].as_py()))
        first = (kind == 0) & new_run
        group = np.cumsum(new_bucket)
        count = np.bincount(group[first], minlength=n + 1) if n else np.zeros(1, np.int64)
        several = first & (count[group] > 1)
        out = [b.take(pa.array(np.flatnonzero(later))), None]
        pick = several.copy()
        if n and not new_bucket[0]:
            # The first bucket began before: its runs here make several with the one that waits (or went already).
            here = first & (group == group[0])
            pick |= here
            if waiting is not None and here.any():
                yield _spans(waiting, 2)
                waiting = None
        elif n:
            waiting = None
        if n:
            tail = np.flatnonzero(first & (group == group[-1]))
            if group[-1] != group[0] or new_bucket[0]:
                waiting = b.slice(int(tail[0]), 1) if len(tail) == 1 else None
        out[1] = b.take(pa.array(np.flatnonzero(pick)))
        for rows, k in zip(out, (1, 2)):
            if rows.num_rows:
                yield _spans(rows, k)


def _spans(rows, kind):
    start = rows.column(6).to_numpy(zero_copy_only=False)
    until = start + rows.column(7).to_numpy(zero_copy_only=False) + LENGTH - 1
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), kind, np.int32)), rows.column(1), *(rows.column(i) for i in (3, 4, 5)), pa.array(start), pa.array(until)], NAMES)


def group_repeats(rows: pa.Table):
    """Spans to remove among the runs (bucket, place, start, bytes) of whole buckets."""
    strings = rows.column("bytes").to_pylist()
    start = rows.column("start").to_numpy()
    order = rows.append_column("i", pa.array(np.arange(rows.num_rows))).sort_by([(c, "ascending") for c in (*PLACE, "start")]).column("i").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Places in order: of one document, by start; runs of a document may overlap, so starts count, not runs.
    doc_of = _document_numbers(rows, order)
    at, a, b = [], [], []
    for n, own, off in repeats(strings, rows.column("bucket").to_numpy()):
        place = start[own] + off
        first = np.lexsort((place, doc_of[own]))[0]
        rest = np.ones(len(own), bool)
        rest &= (doc_of[own] != doc_of[own[first]]) | (place != place[first])
        at.append(own[rest])
        a.append(place[rest])
        b.append(place[rest] + n)
    if any(map(len, at)):
        # One run's spans become one where they touch: nested intervals repeat each other.
        own, a, b = np.concatenate(at), np.concatenate(a), np.concatenate(b)
        by = np.lexsort((a, own))
        own, a, b = own[by], a[by], b[by]
        reach = np.maximum.accumulate((own << 40) + b)
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] << 40) + a[1:] > reach[:-1]
        last = np.append(np.flatnonzero(new)[1:], len(own)) - 1
        at, a, b = [own[new]], [a[new]], [reach[last] - (own[new] << 40)]
        i = pa.array(np.concatenate(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(i), np.int32)), rows.column("bucket").take(i).combine_chunks(), *(rows.column(c).take(i).combine_chunks() for c in PLACE), pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], NAMES
        )


def _document_numbers(rows: pa.Table, order: np.ndarray) -> np.ndarray:
    """Numbers of the rows' documents in their order."""
    t = rows.select(list(PLACE)).take(pa.array(order)).combine_chunks()
    new = np.zeros(len(order), np.int64)
    for c in PLACE:
        x = t.column(c).combine_chunks()
        if len(x) > 1:
            differ = np.array(pa.compute.fill_null(pa.compute.not_equal(x.slice(1), x.slice(0, len(x) - 1)), False))
            nulls = np.array(x.is_null())
            new[1:] |= differ | (nulls[1:] != nulls[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def settle(batches):
    """Rows (kind, bucket, place, start, bytes) in that order, but for bytes that come after bucket, to spans: kind 2 are the
    runs of whole buckets, kind 3 the first bytes of suffixes. Holds a bucket's runs, or one suffix."""
    held: list[pa.Table] = []
    size, last = 0, None
    for b in batches:
        kind = b.column(0).to_numpy(zero_copy_only=False)
        n = int(np.searchsorted(kind, 3))
        if n:
            t = pa.Table.from_batches([b.slice(0, n)])
            held.append(t)
            size += t.get_total_buffer_size()
            bucket = t.column("bucket").to_numpy()
            if size >= GATHER and bucket[-1] != held[0].column("bucket")[0].as_py():
                t = pa.concat_tables(held).combine_chunks()
                k = int(np.searchsorted(t.column("bucket").to_numpy(), bucket[-1]))  # the last bucket may go on
                yield from group_repeats(t.slice(0, k))
                held = [t.slice(k)]
                size = held[0].get_total_buffer_size()
        if n < b.num_rows:
            if held:
                yield from group_repeats(pa.concat_tables(held).combine_chunks())
                held = []
            last = yield from _alike_before(b.slice(n), last)
    if held:
        yield from group_repeats(pa.concat_tables(held).combine_chunks())


def _alike_before(rows: pa.RecordBatch, last):
    """Spans of the rows whose bytes the row before has, at an earlier place; gives back the last row's bytes and place."""
    out, text = [], rows.column(rows.schema.get_field_index("bytes")).to_pylist()
    place = list(zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in (*PLACE, "start"))))
    for i, now in enumerate(zip(text, place)):
        # The same place again is a copy of the row: it shares what the one before it got.
        if last is not None and now[0] == last[0] and now[1] != last[1]:
            out.append(i)
        else:
            last = now if last is None or now[0] != last[0] else last
    if out:
        part = rows.take(pa.array(out))
        col = lambda c: part.column(part.schema.get_field_index(c))
        start = col("start").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(out), np.int32)), col("bucket"), *(col(c) for c in PLACE), col("start"), pa.array(start + LENGTH)], NAMES)
    return last


def removed_spans(docs: DataFrame, parts: int) -> DataFrame:
    """(late, doc_id, same, start, until) of bytes to remove, of (late, doc_id, same, text) rows; spans overlap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = list(PLACE)
    found = docs.select(*place, "text").mapInArrow(cut_runs, RUNS.format(k=kind))
    dealt = found.repartition(parts, "bucket").sortWithinPartitions("kind", "bucket", "run", "late", "doc_id", "same", "start")
    spans = C.staged(dealt.mapInArrow(scan_runs, SPANS.format(k=kind)), "spans")

    mixed = spans.where("kind = 2")
    large = C.staged(mixed.groupBy("bucket").count().where(F.col("count") > MANY).select("bucket", F.lit(True).alias("large")), "large")
    wanted = mixed.join(large, "bucket", "left").groupBy(*place).agg(F.collect_list(F.struct("bucket", "start", "until", F.coalesce("large", F.lit(False)).alias("large"))).alias("wanted"))
    both = on_place(docs, wanted, parts, "inner")

    def cut(batches):
        """Runs with their bytes; of large buckets the first bytes of all suffixes, in buckets by these."""
        for b in C.slices(batches):
            at, kinds, bucket, start, out = [], [], [], [], []

            def rows():
                i = pa.array(at, pa.int64())
                cols = [pa.array(kinds, pa.int32()), pa.array(bucket, pa.int64()), *(b.column(k).take(i) for k in range(3)), pa.array(start, pa.int64()), pa.array(out, pa.binary())]
                for x in (at, kinds, bucket, start, out):
                    x.clear()
                return pa.RecordBatch.from_arrays(cols, ["kind", "bucket", *place, "start", "bytes"])

            for i, (t, w) in enumerate(zip(C.raw_texts(b.column(3)), b.column(4).to_pylist())):
                for x in w:
                    if not x["large"]:
                        at.append(i), kinds.append(2), bucket.append(x["bucket"]), start.append(x["start"]), out.append(t[x["start"] : x["until"]])
                        continue
                    for o in range(x["start"], x["until"] - LENGTH + 1):
                        window = t[o : o + LENGTH]
                        at.append(i), kinds.append(3), bucket.append(xxhash.xxh3_64_intdigest(window) - (1 << 63)), start.append(o), out.append(window)
                if len(at) > 20_000:
                    yield rows()
            yield rows()

    strings = both.select(*place, "text", "wanted").mapInArrow(cut, f"kind int, bucket long, late boolean, doc_id {kind}, same long, start long, bytes binary")
    ordered = strings.repartition(parts, "bucket").sortWithinPartitions("kind", "bucket", "bytes", *place, "start")
    settled = C.staged(ordered.mapInArrow(settle, SPANS.format(k=kind)), "settled")
    cols = [*place, "start", "until"]
    return spans.where("kind = 1").select(*cols).union(settled.select(*cols))


def on_place(docs: DataFrame, per: DataFrame, parts: int, how: str) -> DataFrame:
    """docs joined to per-document rows on their place; ids may be null."""
    key = lambda p: [F.col("late").alias(f"{p}0"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(f"{p}1"), F.col("same").alias(f"{p}2")]
    left = docs.select("*", *key("a")).repartition(parts, "a0", "a1", "a2")
    right = per.select(*[c for c in per.columns if c not in PLACE], *key("b"))
    return left.join(right, [F.col(f"a{i}") == F.col(f"b{i}") for i in range(3)], how)


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(late, doc_id, same, text): a document's place in the order, and its text. Ids that stand in several rows are told
    apart by a hash of the text; equal rows are one document."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("late", F.col("doc_id").isNull())
    often = d.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("often"))
    if often.limit(1).count():
        text = F.xxhash64(F.coalesce("text", F.lit("")))
        d = d.join(often, F.col("doc_id").eqNullSafe(F.col("often")), "left")
        hit = F.col("often").isNotNull() | F.col("late")
        return d.select("late", "doc_id", F.when(hit, text).otherwise(F.lit(0)).cast("long").alias("same"), "text")
    return d.select("late", "doc_id", F.lit(0).cast("long").alias("same"), "text")


def suffix_dedup(docs: DataFrame, id_col="doc_id", text_col="text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of what was removed, in bytes) and, if
    asked for, kept (binary) of every row.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller id, or before in the same text; overlaps
    count. Null texts are empty. Null ids come last. Rows of one id are in order of a hash of their texts, and equal rows
    are one document, whose result each gets. An empty table gives an empty result.
    """
    parts = C.parts_for(docs, 8)
    kind = docs.schema[id_col].dataType.simpleString()
    d = placed(docs, id_col, text_col)
    gone = removed_spans(d, parts)
    per = gone.groupBy(*PLACE).agg(F.collect_list(F.struct("start", "until")).alias("gone"))
    both = on_place(d, per, parts, "left").select("doc_id", "text", "gone")

    def cut(batches):
        for b in C.slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            lists = b.column(2)
            offs, inner = lists.offsets.to_numpy(), lists.values
            a_all, e_all = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            live = np.array(lists.is_valid())
            for i, t in enumerate(C.raw_texts(b.column(1))):
                spans: list[tuple[int, int]] = []
                if live[i] and offs[i + 1] > offs[i]:
                    a, e = a_all[offs[i] : offs[i + 1]], e_all[offs[i] : offs[i + 1]]
                    by = np.argsort(a, kind="stable")
                    a, e = a[by], np.maximum.accumulate(e[by])
                    new = np.concatenate(([True], a[1:] > e[:-1]))
                    spans = list(zip(a[new].tolist(), e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(e) - 1]))].tolist()))
                at, kept = 0, []
                for x, y in spans:
                    kept.append(t[at:x])
                    at = y
                left = b"".join([*kept, t[at:]])
                for r, v in zip(rows, (len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": x, "end": y} for x, y in spans], left if keep_text else None)):
                    r.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    out = both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out if keep_text else out.drop("kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix_dedup of all documents, as counts and the checksum of what is left; null texts are empty."""
    out = suffix_dedup(C.table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
