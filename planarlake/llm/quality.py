"""Quality rules: text features by DataFrame functions, and a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on whole-number features. Grown on two thirds of the labelled rows by
information gain, it is pruned to the prefix that is best on the other third, and kept if precise enough there; the
rows that it covers leave, and the next rule is learned. All statistics are counts by feature value, summed by Spark:
one bounded table (features x values) comes to the driver a step. The list is one Spark CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Whole-number features that rules may test; permille unless named otherwise.
FEATURES = ("symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "word_tenths", "log_words", "distinct")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.bound if self.above else F.col(self.feature) <= self.bound


Rule = tuple[Test, ...]


def _permille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1000), F.floor(part * 1000 / whole))).otherwise(0).cast("int")


def base_counts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and FEATURES (int) of each row.

    Null texts have no words. Words found in windows of eight words that stand twice or more in the text are found by
    64-bit hashes of the windows, within the row: nothing is shuffled.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    d = docs.select(docs[id_col].alias("doc_id"), text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(C.WORD), F.lit(0)))
    n = F.size("words").cast("long")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(C.WORD))
    grams = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    chars = F.length(F.translate("text", SPACES, "")).cast("long")
    d = d.select(
        "doc_id", "text", n.alias("n_words"), chars.alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.coalesce(grams, F.array().cast("array<bigint>")).alias("grams"), F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    # Only texts with a window twice go on to positions: the windows in order of hash, those equal to a neighbour.
    twice = F.size(F.array_distinct("grams")) < F.size("grams")
    d = d.withColumn("sorted", F.when(twice, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("sorted", lambda x, k: (x["h"] == F.try_element_at("sorted", k + 2)["h"]) | (F.when(k > 0, F.try_element_at("sorted", F.greatest(k, F.lit(1)))["h"]) == x["h"]))
    d = d.withColumn("at", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(same, lambda x: x["i"]))))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at("at", k + 2) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.select("doc_id", "text", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_distinct", F.size("lines").alias("n_lines"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    letters = F.col("word_chars")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _permille(F.col("n_symbols"), letters).alias("symbols"), _permille(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines"), _permille(F.col("n_repeat_words"), F.col("n_words")).alias("repeats"),
        _permille(count("[A-Z]"), letters).alias("capitals"), _permille(count("[0-9]"), letters).alias("digits"), _permille(count("[!?;:=@]"), letters).alias("marks"),
        F.least(F.lit(1000), F.floor(letters * 10 / F.greatest(F.col("n_words"), F.lit(1)))).cast("int").alias("word_tenths"),
        F.floor(F.log2(F.col("n_words") + 1) * 4).cast("int").alias("log_words"), _permille(F.col("n_distinct"), F.col("n_words")).alias("distinct"),
    )


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for t in rule:
        out = out & t.column()
    return out


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """FOIL's gain of a condition that keeps (bad, good) of (bad0, good0)."""
    if bad <= 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def best_test(rows: DataFrame) -> tuple[Test | None, float]:
    """The threshold with the largest gain over rows with feature columns and weight columns bad and good."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])
    table = rows.select(F.explode(pairs).alias("p"), "bad", "good").groupBy("p.f", "p.v").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    best, gain = None, 1e-9
    for f in FEATURES:
        own = sorted((r.v, r.bad, r.good) for r in table if r.f == f)
        bad0, good0 = sum(r[1] for r in own), sum(r[2] for r in own)
        if not bad0:
            continue
        b = g = 0
        values = [r[0] for r in own]
        for i, (v, bad, good) in enumerate(own):
            # Bounds lie halfway to the next value seen.
            low = (values[i - 1] + v + 1) // 2 if i else v
            high = (v + values[i + 1]) // 2 if i + 1 < len(own) else v
            for test, x, y in ((Test(f, True, low), bad0 - b, good0 - g), (Test(f, False, high), b + bad, g + good)):
                if (new := _gain(x, y, bad0, good0)) > gain:
                    best, gain = test, new
            b, g = b + bad, g + good
    return best, gain


def learn(labelled: DataFrame, precision: float = 0.95, support: int = 4) -> list[Rule]:
    """An ordered list of rules for bad rows from FEATURES, doc_id and bad (boolean). All labelled rows count.

    Tests are added to a rule until none gains anything, and rules to the list until one isn't precise enough or covers too
    few bad rows; there is no other end.
    """
    hold = F.coalesce(C.crc_mod(F.col("doc_id"), 3) == 0, F.lit(False))
    d = C.staged(labelled.select(*FEATURES, F.col("bad").cast("int").alias("bad"), (~F.col("bad")).cast("int").alias("good"), hold.alias("hold")), "labelled")
    found: list[Rule] = []
    while True:
        left = d
        for r in found:
            left = left.where(~matches(r))
        rule: Rule = ()
        while True:
            test, _gain_of = best_test(left.where(~F.col("hold") & matches(rule)))
            if test is None or test in rule:
                break
            rule += (test,)
        if not rule:
            break
        # Prune: of the prefixes, the one with the best balance on the rows held back; ties to the shorter.
        sums = [f(F.when(matches(rule[: k + 1]) & h, F.col(c))).alias(f"{c}{k}{i}") for k in range(len(rule)) for c in ("bad", "good") for i, h in enumerate((F.col("hold"), ~F.col("hold"))) for f in (F.sum,)]
        got = left.agg(*sums).first()
        at = lambda c, k, i: got[f"{c}{k}{i}"] or 0
        worth = [(at("bad", k, 0) - at("good", k, 0)) / max(1, at("bad", k, 0) + at("good", k, 0)) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda k: (worth[k], -k))
        bad, good = at("bad", k, 0) + at("bad", k, 1), at("good", k, 0) + at("good", k, 1)
        if bad < support or bad < precision * (bad + good) or at("bad", k, 0) < precision * (at("bad", k, 0) + at("good", k, 0)):
            break
        found.append(rule[: k + 1])
    return found


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that matches speaks (bad); good where none does."""
    out = F.lit(True)
    if rules:
        case = F.when(matches(rules[0]), False)
        for r in rules[1:]:
            case = case.when(matches(r), False)
        out = case.otherwise(True)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """Base counts, base_failed and kept of every row; the list is learned from labels (id, 0 bad or 1 good).

    Null ids and labels teach nothing; ids with several labels teach each; without labels no rule is learned and kept is
    not base_failed. Repeated rows are judged each.
    """
    d = C.staged(base_counts(docs, id_col, text_col), "quality")
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull())
    taught = d.join(known, F.col("doc_id") == F.col("l_id")).select(*d.columns, (F.col("label") == 0).alias("bad"))
    rules = learn(taught)
    return d.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules of all documents, learned from the labels table."""
    out = quality_rules(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {}
