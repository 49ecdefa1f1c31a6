"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of each two lines on end chooses places, so that putting in or taking out lines elsewhere
doesn't shift them. The two lines at a chosen place are the seed of a chunk: where they stand earlier in the corpus (in a
document before, or before in the same), the chunk reaches from there both ways, line by line, as far as the lines agree
with those around the first occurrence, or up to the next seed's. Chunks are removed after their bytes have been compared;
the first occurrence stays.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: So many of so many places are chosen, on average.
CHOSEN, EVERY = 3, 4
MULTIPLIER = 31


def line_hash(line: str) -> int:
    return int(hashlib.md5(line.encode()).hexdigest()[:8], 16)


def seeds(hashes: list[int]) -> list[int]:
    """First lines of the two at each chosen place."""
    return [i for i in range(len(hashes) - 1) if (hashes[i] * MULTIPLIER + hashes[i + 1]) % EVERY < CHOSEN]


def _row(doc: Column, text: Column) -> Column:
    return F.struct(doc.isNull().alias("late"), doc.alias("doc_id"), F.xxhash64(text).alias("h"))


def _key(row: str, prefix: str = "") -> list[Column]:
    """What tells rows apart, as two numbers that joins can deal out."""
    return [F.xxhash64(f"{row}.late", f"{row}.doc_id").alias(f"{prefix}k1"), F.col(f"{row}.h").alias(f"{prefix}k2")]


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, removed): rows has doc_id, text and row (what tells documents apart); removed has (row, start, lines) of
    the chunks that stand earlier with the same bytes; they may touch and overlap. docs has doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = C.parts_for(docs, 8)
    rows = docs.where(F.col("text").isNotNull()).select("*", _row(F.col("doc_id"), F.col("text")).alias("row"))
    row_kind = f"struct<late:boolean,doc_id:{kind},h:bigint>"

    def hashed(batches):
        for b in C.slices(batches):
            at, line, v, hi, lo = [], [], [], [], []
            for i, t in enumerate(b.column(b.schema.get_field_index("text")).to_pylist()):
                lines = t.split("\n")
                if len(lines) < 2:
                    continue
                found = [hashlib.md5(x.encode()).digest() for x in lines]
                n = len(lines)
                at += [i] * n
                line += range(n)
                v += [int.from_bytes(d[:8], "big", signed=True) for d in found]
                one, two = [None] * n, [None] * n
                for s in seeds([int.from_bytes(d[:4], "big") for d in found]):
                    d = hashlib.md5(found[s] + found[s + 1]).digest()
                    one[s], two[s] = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                hi += one
                lo += two
            row = b.column(b.schema.get_field_index("row")).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([row, pa.array(line, pa.int32()), *(pa.array(x, pa.int64()) for x in (v, hi, lo))], ["row", "i", "v", "hi", "lo"])

    # Repeated rows (same id, same text) are one document here, and share its result.
    lines = C.staged(rows.select("text", "row").mapInArrow(hashed, f"row {row_kind}, i int, v long, hi long, lo long"), "lines")
    found = lines.where("hi is not null")
    place = F.struct("row", "i")
    firsts = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end").select("hi", "lo", "first")
    firsts = C.staged(firsts, "firsts")  # so that the join below can split a seed that very many documents hold
    again = found.join(firsts, ["hi", "lo"]).where(place != F.col("first")).select("row", "i", "first").distinct()
    again = C.staged(again, "again")
    between, chunks = extended(lines, again)
    pieces = C.staged(chunks, "pieces")
    C.discard(lines, firsts, again, between)
    C.release(docs.sparkSession)
    # Bytes of the chunks and of their first occurrences, cut from the texts where they are.
    wanted = pieces.select("row", "start", "lines").union(pieces.select(F.col("first.row"), F.col("first.i"), "lines")).distinct()
    per = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "lines")).alias("wanted"))
    left = rows.select("text", "row", *_key("row")).repartition(parts, "k1", "k2")
    both = left.join(per.select("wanted", *_key("row", "w")), (F.col("k1") == F.col("wk1")) & (F.col("k2") == F.col("wk2")))

    def cut(batches):
        for b in C.slices(batches):
            at, start, size, out = [], [], [], []
            for i, (t, w) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                lines = t.split("\n")
                for x in w:
                    at.append(i), start.append(x["start"]), size.append(x["lines"]), out.append("\n".join(lines[x["start"] : x["start"] + x["lines"]]).encode())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(out, pa.binary())], ["row", "start", "lines", "bytes"])

    cuts = C.staged(both.select("row", "text", "wanted").mapInArrow(cut, f"row {row_kind}, start int, lines int, bytes binary").dropDuplicates(["row", "start", "lines"]), "bytes")
    one = cuts.select(*_key("row"), "start", "lines", F.col("bytes").alias("b1"))
    two = cuts.select(*_key("row", "f"), F.col("start").alias("fi"), "lines", F.col("bytes").alias("b2"))
    placed = pieces.select("row", "start", "lines", *_key("row"), *_key("first.row", "f"), F.col("first.i").alias("fi"))
    removed = placed.join(one, ["k1", "k2", "start", "lines"]).join(two, ["fk1", "fk2", "fi", "lines"]).where("b1 = b2").select("row", "start", "lines")
    removed = C.staged(removed, "removed")
    C.discard(pieces, cuts)
    C.release(docs.sparkSession)
    return rows, removed


def extended(lines: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a staged table that is read, chunks): (row, start, lines, first) of the chunks of each seed that stands earlier: its lines and, up to the seed before it
    and the one after it, those that agree with the lines around the first occurrence."""
    seeds = again.select(*_key("row"), "i", F.col("first").alias("seed"))
    doc = Window.partitionBy("k1", "k2").orderBy("i")
    some = seeds.select("k1", "k2").distinct()
    mine = lines.select("row", *_key("row"), "i", "v").join(some, ["k1", "k2"], "left_semi").distinct().join(seeds, ["k1", "k2", "i"], "left")
    # Lines from one seed on up to the next make a group; group 0 is what stands before the first.
    mine = mine.withColumn("seed_i", F.when(F.col("seed").isNotNull(), F.col("i")))
    mine = mine.withColumn("left", F.last(F.when(F.col("seed").isNotNull(), F.struct("seed", "i")), True).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    mine = mine.withColumn("right", F.first(F.when(F.col("seed").isNotNull(), F.struct("seed", "i")), True).over(doc.rowsBetween(1, Window.unboundedFollowing)))
    mine = mine.where("left is not null or right is not null").drop("seed", "seed_i")
    between = mine = C.staged(mine, "between")
    # Lines of a seed agree as they are; each other one is held against the lines around both neighbours' first ones.
    own = F.col("left").isNotNull() & (F.col("i") - F.col("left.i") < 2)
    refs = mine.select("k1", "k2", "i", "v", F.explode(F.array(*[F.struct(F.lit(side == "left").alias("is_left"), F.when(F.col(side).isNotNull(), F.struct(*_key(f"{side}.seed.row", "f"), (F.col(f"{side}.seed.i") + F.col("i") - F.col(f"{side}.i")).alias("fi"))).alias("ref")) for side in ("left", "right")])).alias("x"), own.alias("own"))
    refs = refs.where("x.ref is not null and not (own and x.is_left)").select("k1", "k2", "i", "v", "x.is_left", "x.ref.*")
    there = lines.select(*_key("row", "f"), F.col("i").alias("fi"), F.col("v").alias("fv"))
    same = refs.join(there, ["fk1", "fk2", "fi"]).where("v = fv").groupBy("k1", "k2", "i").agg(F.max("is_left").alias("as_left"), F.max(~F.col("is_left")).alias("as_right"))
    mine = mine.withColumn("own", own).join(same, ["k1", "k2", "i"], "left")
    group = Window.partitionBy("k1", "k2", "left.i").orderBy("i")
    on = F.sum((~(F.col("own") | F.coalesce("as_left", F.lit(False)))).cast("int")).over(group) == 0
    back = F.sum((~F.coalesce("as_right", F.lit(False))).cast("int")).over(group.rowsBetween(0, Window.unboundedFollowing)) == 0
    mine = mine.withColumn("on", on & F.col("left").isNotNull()).withColumn("back", back & F.col("right").isNotNull())
    after = mine.where("on").groupBy("row", "left").agg(F.count(F.lit(1)).cast("int").alias("after"))
    before = mine.where("back").groupBy("row", F.col("right").alias("left")).agg(F.count(F.lit(1)).cast("int").alias("before"))
    sides = after.select("row", "left", "after", F.lit(0).alias("before")).union(before.select("row", "left", F.lit(0), "before"))
    both = sides.groupBy("row", "left").agg(F.sum("after").cast("int").alias("after"), F.sum("before").cast("int").alias("before"))
    first = F.struct(F.col("left.seed.row").alias("row"), (F.col("left.seed.i") - F.col("before")).alias("i")).alias("first")
    return between, both.select("row", (F.col("left.i") - F.col("before")).alias("start"), (F.col("after") + F.col("before")).alias("lines"), first)


def line_dedup(docs: DataFrame, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (what is left), columns to ``keep`` (prefixed kept_), n_lines, n_removed_chunks, n_removed_lines (long) of every row;
    chunks that touch count as one.

    Null texts stay null, with no lines; an empty text is one empty line. Rows alike in id and text count as one document
    and share its result. Documents are in order of id, null ids last; a document whose chunks all stood earlier is left
    with an empty text.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(f"kept_{c}") for c in keep])
    carried = [f"kept_{c}" for c in keep]
    parts = C.parts_for(docs, 8)
    rows, removed = repeated_chunks(docs)
    per = removed.groupBy("row").agg(F.collect_list(F.struct("start", "lines")).alias("gone"))
    left = rows.select("*", *_key("row")).repartition(parts, "k1", "k2")
    both = left.join(per.select("gone", *_key("row", "w")), (F.col("k1") == F.col("wk1")) & (F.col("k2") == F.col("wk2")), "left")

    def rebuild(batches):
        for b in C.slices(batches):
            texts, n_lines, n_chunks, n_gone = [], [], [], []
            for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = t.split("\n")
                drop = {i for x in gone or () for i in range(x["start"], x["start"] + x["lines"])}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t)
                n_lines.append(len(lines)), n_chunks.append(sum(i - 1 not in drop for i in drop)), n_gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[3:], *(pa.array(x, pa.int64()) for x in (n_lines, n_chunks, n_gone))], names)

    numbers = ["n_lines", "n_removed_chunks", "n_removed_lines"]
    names = ["doc_id", "text", *carried, *numbers]
    schema = T.StructType([*(docs.schema[c] for c in ("doc_id", "text", *carried)), *(T.StructField(c, T.LongType()) for c in numbers)])
    out = both.select("doc_id", "text", "gone", *carried).mapInArrow(rebuild, schema)
    zero = F.lit(0).cast("long")
    bare = docs.where(F.col("text").isNull()).select("doc_id", "text", *carried, zero.alias("n_lines"), zero.alias("n_removed_chunks"), zero.alias("n_removed_lines"))
    return out.union(bare)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_dedup of all documents, the text that is left as its MD5."""
    out = line_dedup(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.md5("text").alias("kept_md5"))


#: Documents' chunks and what is left, for tables whose ids are unique: every seed's reach is found by its nearest misfits.
ORACLE = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
rolled AS (SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS v, lead(line) OVER w AS next FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
seeds AS (SELECT doc_id, i, line, next FROM rolled WHERE next IS NOT NULL AND (v * {MULTIPLIER} + ('0x' || md5(next)[1:8])::BIGINT) % {EVERY} < {CHOSEN}),
firsts AS (SELECT doc_id, i, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM seeds WINDOW w AS (PARTITION BY line, next ORDER BY doc_id, i)),
again AS (SELECT *, coalesce(lag(i) OVER w, 0) AS low, coalesce(lead(i) OVER w, 1 << 30) AS high FROM firsts WHERE (doc_id, i) <> (fd, fi) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
reach AS (SELECT a.doc_id, a.i, a.low,
    coalesce(min(l.i) FILTER (l.i > a.i AND f.line IS DISTINCT FROM l.line), least(a.high, max(l.i) + 1)) AS until,
    coalesce(max(l.i) FILTER (l.i < a.i AND f.line IS DISTINCT FROM l.line) + 1, a.low) AS start
  FROM again a JOIN lines l ON l.doc_id = a.doc_id AND l.i >= a.low AND l.i < a.high LEFT JOIN lines f ON f.doc_id = a.fd AND f.i = l.i - a.i + a.fi
  GROUP BY a.doc_id, a.i, a.low, a.high),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, until)) AS i FROM reach),
marked AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (head) AS n_removed_chunks, count(*) FILTER (gone) AS n_removed_lines,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5
FROM edges GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": ORACLE}
