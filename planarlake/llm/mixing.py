"""Mixing sources to target weights by entropy balancing.

Copies of a document start from the law (1/4, 1/2, 1/4) over 0, 1 and 2. Among all laws whose expected words meet each
source's target, the closest in relative entropy tilts it exponentially by the document's words, so a document of x
words has the expected copies 2 / (1 + exp(-lambda x)) with one lambda a source: the root of the convex dual's
gradient, found by Newton steps over the histogram of sizes. Rates become copies by systematic rounding in order of
size, which keeps a stratum's words within one document of what the rates ask for.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents in a stratum of the rounding, about. A source of any size is dealt out over strata by a hash.
STRATUM = 8000
OFFSETS = 16
#: Newton steps before every other one halves the bracket.
PATIENCE = 30
#: Rates are counted in units of 2^-20, so that running sums are exact.
BITS = 20
UNIT = 1 << BITS


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, target) of (source, size) rows; one row a source, null for null. Null sizes count for
    nothing, an empty table gives an empty result.

    Sources in order of code points, null last, get the weights in turn. Targets share ``share`` times all words by
    weight and stop at ``cap`` times the source's own; the excess is shared again until none is above. The level (words
    a unit of weight) only rises, and is all that the driver gets.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    # Ranks come from a sort over all tasks: a source's place in its part of the order, after the parts before.
    per = C.staged(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in sorted(per.groupBy(part.alias("p")).count().collect()):
        before += [F.lit(r.p), F.lit(total)]
        total += r["count"]
    rank = place + (F.create_map(*before)[part] if before else 0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    most = cap * F.col("source_size")
    level = 0.0
    while True:
        full = most <= F.lit(level) * F.col("weight")
        got = per.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if not got["all"] or not got["weight"]:
            break
        new = (share * got["all"] - (got["full"] or 0.0)) / got["weight"]
        if new <= level:
            break
        level = new
    return per.select("source", "n_docs", "source_size", F.least(most, F.lit(level) * F.col("weight")).alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, exact: float = 1e-10) -> DataFrame:
    """(source, tilt, n_docs, source_size, target): the dual's root of each source, by Newton steps within brackets.

    Rates are 2 / (1 + exp(-tilt * size)). A source whose target is all it can give has an infinite tilt; one that has
    no words has none (0). Steps end when every source is as near as ``exact`` of its target, or its bracket has no number
    left inside. The null source is a source, null sizes count for nothing, and an empty table gives an empty result.
    """
    hist = C.staged(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
    full = (F.col("source_size") > 0) & (F.col("target") >= 2.0 * F.col("source_size") * (1 - 1e-12))
    state = targets.select(
        "*", mean.alias("mean"), full.alias("full"), F.lit(0.0).alias("x"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), full.alias("done"),
    )
    state = C.staged(state, "tilt")
    for turn in count():
        todo = state.where("not done and source_size > 0").select(F.col("source").alias("s"), "x", "mean")
        both = hist.join(todo, F.col("source").eqNullSafe(F.col("s")))
        rate = 2.0 / (1.0 + F.exp(-F.col("x") * F.col("size") / F.col("mean")))
        words = F.col("n") * F.col("size")
        sums = both.groupBy("s").agg(
            F.sum(words * rate).alias("words"), F.sum(words * rate * (1.0 - rate / 2.0) * F.col("size") / F.col("mean")).alias("slope")
        )
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        over = F.col("words") - F.col("target")
        lo = F.when(over < 0, F.col("x")).otherwise(F.col("lo"))
        hi = F.when(over > 0, F.col("x")).otherwise(F.col("hi"))
        step = F.col("x") - over / F.greatest(F.col("slope"), F.lit(1e-300))
        new = new.withColumn("lo", lo).withColumn("hi", hi).withColumn("next", step)
        # Out of the bracket, or with no bound on a side yet a jump: halve, or double.
        low = F.coalesce("lo", F.least(F.col("hi") * 2 - 1, F.lit(-1.0)))
        high = F.coalesce("hi", F.greatest(F.col("lo") * 2 + 1, F.lit(1.0)))
        middle = (low + high) / 2
        # Late steps halve every other time, so that any bracket closes.
        newton = (F.col("next") > low) & (F.col("next") < high) & F.lit(turn < PATIENCE or turn % 2 == 0)
        new = new.withColumn("next", F.when(newton, F.col("next")).otherwise(middle))
        met = F.col("words").isNull() | (F.abs(over) <= exact * F.greatest("target", F.lit(1.0))) | (middle <= F.col("lo")) | (middle >= F.col("hi"))
        met = F.coalesce(met, F.lit(False))
        new = new.withColumn("x", F.when(met, F.col("x")).otherwise(F.col("next"))).withColumn("done", F.col("done") | met)
        state = C.staged(new.drop("words", "slope", "next"), "tilt")
        if not state.where("not done and source_size > 0").limit(1).count():
            break
    # Sums of floats depend on their order in the last digits; rounded, reruns agree.
    tilt = F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.round("x", 8) / F.col("mean"))
    return state.select("source", tilt.alias("tilt"), "n_docs", "source_size", "target")


def mixed_copies(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5) -> DataFrame:
    """Copies (0, 1 or 2) of each row of (doc_id, source, size), with rate, source_size and target.

    Repeated rows are rows of their own; null ids and sources are values like others; size null counts as 0, and rows of
    size 0 take the rate 1 (0 words however often). An empty table gives an empty result. Nothing is drawn at random.
    """
    sizes = sizes.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    dual = tilts(sizes, source_targets(sizes, weights, share)).withColumnRenamed("source", "s")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt") == float("inf"), F.lit(2.0)).otherwise(2.0 / (1.0 + F.exp(-F.col("tilt") * F.col("size"))))
    h = F.xxhash64("doc_id", "size")
    rows = sizes.join(dual, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate).withColumn("h", h)
    rows = rows.withColumn("q", F.round(F.col("rate") * UNIT).cast("long"))
    rows = rows.withColumn("stratum", F.pmod(F.col("h"), F.ceil(F.col("n_docs") / STRATUM)))
    w = Window.partitionBy("source", "stratum").orderBy("size", "h", F.col("doc_id").asc_nulls_last())
    rows = rows.withColumn("run", F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def copies(u):
        return F.shiftright(F.col("run") + u, BITS) - F.shiftright(F.col("run") - F.col("q") + u, BITS)

    # Of several starting points the one whose words come nearest to the rates' is taken, stratum by stratum.
    all_of = Window.partitionBy("source", "stratum")
    want = F.sum(F.col("q") * F.col("size")).over(all_of)
    starts = [i * UNIT // OFFSETS for i in range(OFFSETS)]
    miss = F.array_min(F.array(*[F.struct(F.abs(F.sum(copies(F.lit(u)) * F.col("size")).over(all_of) * UNIT - want).alias("by"), F.lit(u).alias("u")) for u in starts]))
    rows = rows.withColumn("u", miss["u"])
    return rows.select("doc_id", "source", "size", "rate", "source_size", "target", copies(F.col("u")).alias("copies"))


def word_sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, size) of every row: its number of words, 0 for a null text. Other columns are not read; null ids,
    null sources and repeated rows stay as they are."""
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(C.WORD)), F.lit(0)).cast("long")
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.alias("size"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed_copies of all documents by their words, as words taken; null texts have none, null sources are one source, rows
    are documents."""
    sizes = C.staged(word_sizes(C.table(spark, sf_dir, "documents")), "words")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed_copies(sizes).select("doc_id", "size", "source_size", "target", taken)


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
