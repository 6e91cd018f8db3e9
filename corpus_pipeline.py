"""A pipeline over `documents` made of the operators in mosaicell.llm.

Every stage takes tables of any size, the empty one included, and rows with nulls in any column; repeated rows and ids
are documents of their own, ties go to the smaller id (null ids last), texts of any length are read whole, and columns
beside those of `documents` are dropped. Null texts count as empty; they stay null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicell.functions.tables import holding
from mosaicell.llm import mixing, queries, simhash, suffix, toxicity
from mosaicell.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Domains of the mix and their weights (toxic documents have left before); bounds of a document's rate. The lower bound keeps every document that the stages
#: before kept. The tokens of the mix follow from what is there: as few as reach the weights within the bounds.
MIX = {"fine": 0.75, "plain": 0.25}
MIX_LEAST, MIX_MOST = 1.0, 8.0
#: Words of a shingle, and the Jaccard similarity from which on texts are near copies.
NEAR_WORDS, NEAR_LEAST = 5, 0.8
#: Bytes of a repeated string, fewer than 50 words have (of all runs of 51 words one in a thousand has under 203 bytes), and
#: the positions among which a window of that length chooses its anchor.
REPEAT_BYTES, REPEAT_SPREAD = 200, 96
#: Bytes that a task hands to its Python at once. Spark goes by 10 000 rows and 64 MB, and a worker keeps what a batch once took.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """`stage`, from which on the session's batches are of BATCH_BYTES, unless its user has set them: what a stage returns runs when it is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores 0.7 or more go."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, field, keep=tuple(COLUMNS[1:])).where("score < 0.7").select(*COLUMNS)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays; every link is verified."""
    return simhash.similar_keep(docs, words=NEAR_WORDS, least=NEAR_LEAST).select(*COLUMNS)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes go that strings of 200 bytes cover which start anywhere else; so do texts of which nothing is left."""
    rows = docs.select("doc_id", "text", F.col("text").isNull().alias("absent"), "lang", "source", "n_chars")
    out = suffix.remove_repeats(rows, length=REPEAT_BYTES, spread=REPEAT_SPREAD, keep=("absent", "lang", "source", "n_chars"))
    text = F.when(~F.col("absent"), F.col("kept_text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.where("n_removed = 0 or n_removed < n_bytes").select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, each at least once."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    found = mixing.mix(docs, labelled, MIX, None, MIX_LEAST, MIX_MOST, keep=tuple(COLUMNS[1:]))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids."""
    return queries.packed(spark, docs)


STAGES = [(name, in_small_batches(stage)) for name, stage in
          [("toxicity", no_toxic), ("simhash", no_near_duplicates), ("suffix", no_repeats), ("mixing", mixed), ("packing", packed)]]

#: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the documents are written to the shared folder and read again.

    What a stage writes on its way goes when its result is written, and that result when the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), Scratch()
    for name, stage in STAGES[:-1]:
        with holding() as made:
            found = stage(spark, docs, sf_dir)
        own = Scratch()
        docs = own.written(found, name)
        made.clear()
        before.clear()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
