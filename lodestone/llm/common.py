"""Helpers shared by the training-data operators.

Nothing here collects rows of a corpus to the driver.  Intermediate results
that are read twice are written once, as Parquet, to the shared folder that
the cluster names in ``spark.checkpoint.dir``; a lost executor then costs the
rerun of its tasks and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import run_dir

#: What ends a word: space and the ASCII controls \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path among this application's tables, which ``sources.shared.clear`` deletes."""
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._scratch_path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def light_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about ``most`` bytes in what runs inside; afterwards the session's own bound holds again, and a smaller one all along."""
    own = spark.conf.get(BATCH_BYTES, None)
    if own is not None and 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) <= most:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if own is None else spark.conf.set(BATCH_BYTES, own)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of an id written as text."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def small(batches, rows: int = 512):
    """Batches in slices, so that only a slice's texts are Python objects at a time; unused memory is given back at the end."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 24:
            self[word] = value
        return value


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def carried(docs: DataFrame, *kept: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but ``kept`` under names of no meaning, so that none clashes; and what they were, in order."""
    names = {c if c in kept else f"_c{k}": c for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(r) for r, c in names.items()]), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(r).alias(c) for r, c in names.items()])


def relabel(ids: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """ids with ``column`` replaced by its label, where it has one.  labels: (id, component)."""
    named = labels.select(F.col("id").alias(column), F.col("component").alias("_label"))
    rest = [c for c in ids.columns if c != column]
    return ids.join(named, column, "left").select(*rest, F.coalesce("_label", column).alias(column))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", tag: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable, for each id that an edge touches.

    Contraction: each id hooks onto its smallest neighbour, two pointer jumps
    flatten what that makes, and the edges between what is left go on to the next
    round.  A star is one round; the rounds grow with the logarithm of the
    longest chain, and the edges shrink with each.  Every round is a written
    table.  Nulls are not allowed; self links are.
    """
    live = materialize(edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).distinct(), f"{tag}-0")
    found = None
    for k in range(1, 64):
        both = live.select(F.col("u").alias("id"), F.col("v").alias("near")).union(live.select("v", "u"))
        first = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("component")), f"{tag}-hooks-{k}")
        hooks = relabel(first, "component", first)
        hooks = materialize(relabel(hooks, "component", hooks).select("id", "component"), f"{tag}-labels-{k}")
        before, gone = found, live
        found = hooks if found is None else materialize(relabel(found, "component", hooks).select("id", "component"), f"{tag}-found-{k}")
        live = relabel(relabel(live, "u", hooks), "v", hooks).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        live = materialize(live, f"{tag}-{k}")
        release(first, gone, *([] if before is None else [before, hooks]))
        if live.isEmpty():
            release(live)
            return found
    raise RuntimeError("components did not settle in 64 rounds")
