"""The corpus pipeline: documents to a mix, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds which copy a row is. Rows are
rows: null and repeated ids and repeated rows are treated like others, unless a stage says so; other columns than those of
documents are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarlake.llm import common as C
from planarlake.llm import decontaminate, langid, linededup, mixing, similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Posterior that a document's language must have.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: und (null texts and those without a letter) and unsure ones go; a null lang
    becomes the predicted one, others stay. Ties between languages go to the first by name."""
    import public_tokenizers

    train = docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang")
    found = langid.language_id(docs, train, public_tokenizers.path("piece_bpe_32k.model"), keep=("text", "lang", "source", "n_chars"))
    known = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that stood earlier; n_chars follows. Null texts stay null; a text whose lines
    all stood earlier becomes empty. Rows alike in id and text are one document and share its result."""
    out = linededup.line_dedup(docs, keep=("lang", "source"))
    return out.select("doc_id", "text", F.col("kept_lang").alias("lang"), F.col("kept_source").alias("source"), F.length("text").cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more), the row with
    the smallest id (null ids last, ties by a hash of the row). Texts without words are alike, null ones too."""
    return similar.similar_firsts(docs.select(*COLUMNS), 5, 0.8)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), C.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often (0, 1 or 2 times) as its rounded rate says, with copy from 1 on. Rows get a number of
    their own first, so that null and repeated ids and repeated rows keep their own copies."""
    rows = C.staged(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    sizes = C.staged(mixing.word_sizes(rows, id_col="row"), "words")
    copies = mixing.mixed_copies(sizes).where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    return rows.join(copies, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = C.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
