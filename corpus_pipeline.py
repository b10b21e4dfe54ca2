"""The corpus pipeline: filter, deduplicate, cut repeats, mix and pack one table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``docs`` is what
the stage before kept, with the columns of ``documents``; the first gets
``documents`` itself.  The last returns packed pieces.  Every stage works on all
rows and whole texts it is given, and each calls one operator of
``lodestone.llm`` by its general interface.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, neardup, packing, substring, toxicity
from lodestone.llm.common import carried, light_batches, materialize, release, restored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages share executors: what one leaves in the JVM and in the workers is there when the next one runs, so each
#: holds less than its operator alone would.  Bytes of an Arrow batch, and parts of texts that a worker remembers.
BATCH_BYTES, KEPT_PARTS = 4 << 20, 200_000


def lightly(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with small Arrow batches for the tables that it writes inside."""

    @wraps(stage)
    def run(spark: SparkSession, *args, **named) -> DataFrame:
        with light_batches(spark, BATCH_BYTES):
            return stage(spark, *args, **named)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more go; null and empty texts stay.  The model learns from the labelled rows among docs."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@lightly
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


@lightly
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that occur again anywhere go, wherever they stand; every row stays.

    A text that loses words is its kept words joined by one space; n_chars
    follows the text.  Further columns stay, whatever their names.
    """
    plain, names = carried(docs, "doc_id", "text")
    out = substring.remove_repeats(plain, window=35)
    chars = next(r for r, c in names.items() if c == "n_chars")
    out = out.withColumn(chars, F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col(chars)))
    return restored(out.withColumnRenamed("kept_text", "text"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes near its target: a row is there 0, 1 or 2 times, as the mix takes it.

    Texts without words weigh nothing in a mix and stay once.  Rows without id
    stay once too; rows of one id are taken alike.  Further columns stay,
    whatever their names.
    """
    plain, names = carried(docs, "doc_id", "text")
    plan = mixing.mix_sources(docs.select("doc_id", "text", "source")).groupBy("doc_id").agg(F.max("copies").alias("copies"), F.max("size").alias("size"))
    times = F.when(F.coalesce("size", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    joined = plain.join(plan.hint("shuffle_hash"), "doc_id", "left").withColumn("copies", times)
    return restored(joined.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))), names)


@lightly
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row in sequences of 2048 tokens; repeated rows are packed each by itself."""
    return packing.pack(docs, kept_parts=KEPT_PARTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express none of the trained, hashed and drawn stages; tests hold them against brute force.
ORACLE_SQL = None


@lightly
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are a written table, deleted once the next one is there; the last stage reads the one before it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
