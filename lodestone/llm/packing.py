"""Packing documents into token sequences by best-fit decreasing.

Documents longer than a sequence are first cut into full windows; what is left
of each document is then packed, longest first, into the open window with the
least room that still takes it.  Open windows are found through a segment tree
indexed by remaining capacity: one descent gives the tightest non-empty
capacity at or above a length.

At scale the pieces are dealt by a hash of all that tells them apart into shards
of about ``shard_documents`` documents; equal pieces are counted first and dealt
one by one, so that no id and no repeated row fills a shard alone.  A shard is
packed by itself, so memory is bounded however large the corpus is; the only loss
is the last, partly filled windows of a shard.  Only piece sizes are shuffled,
never texts or ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import END_ID, default_path, encoder

#: Parts of texts that a worker remembers, at some 200 bytes each; nothing else is large here.
KEPT_PARTS = 900_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class CapacityTree:
    """Counts of open windows by remaining capacity, as a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, least: int) -> int:
        """Smallest capacity of at least ``least`` that an open window has, or -1."""
        count, k = self.count, least + self.leaves
        if count[k]:
            return least
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length; lengths come in descending order, none above capacity."""
    tree = CapacityTree(capacity)
    open_windows: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, n in enumerate(lengths.tolist()):
        room = tree.tightest(n)
        if room < 0:
            w, room, made = made, capacity, made + 1
        else:
            w = open_windows[room].pop()
            tree.add(room, -1)
        window[k], offset[k] = w, capacity - room
        if room > n:
            open_windows[room - n].append(w)
            tree.add(room - n, 1)
    return window, offset


def tokenized_pieces(docs: DataFrame, sequence: int, tokenizer: str, lead: bool = True, kept_parts: int = KEPT_PARTS) -> DataFrame:
    """PIECES of every document: full windows first, then the rest, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, lead, kept_parts)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                ids, texts = (batch.column(i).slice(a, 512).to_pylist() for i in range(2))
                rows: list[tuple] = []
                for doc, got in zip(ids, enc.batch([t or "" for t in texts]), strict=True):
                    got += END_ID
                    n = len(got) // 4
                    for start in range(0, n, sequence):
                        part = got[4 * start : 4 * (start + sequence)]
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, sequence: int = 2048, tokenizer: str | None = None, shard_documents: int = 50_000, lead: bool = True, kept_parts: int = KEPT_PARTS) -> DataFrame:
    """One row for each piece of each document.

    docs: doc_id and text; further columns are ignored.  A null or empty text
    is a document of the end id alone.  A null doc_id is packed like any other.
    Repeated rows are packed each by itself.  An empty table gives an empty
    result.  Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.  The same rows give the same sequences, however they are dealt and
    however many parts of texts a worker remembers (``kept_parts``).
    """
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    shards = max(1, -(-docs.count() // shard_documents))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # Written, so that counting does not hold memory beside the workers that encode.
    pieces = materialize(tokenized_pieces(docs, sequence, tokenizer, lead, kept_parts), "pieces").groupBy(*columns).agg(F.count("*").alias("rows"))
    # Equal pieces one by one again, a thousand at a time.
    pieces = pieces.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / 1000))))
    pieces = pieces.withColumn("nth", F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("rows"), (F.col("part") + 1) * 1000) - 1)))
    shard = F.pmod(F.xxhash64(*columns, "nth", F.lit("shard")), F.lit(shards))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        window, offset = best_fit_decreasing(part["length"].to_numpy(), sequence)
        return part.drop(columns="shard").assign(sequence_id=(part["shard"].to_numpy(np.int64) << 40) + window, offset=offset)

    named = pieces.withColumn("shard", shard).select(F.col("doc_id").cast("string"), *columns[1:], "shard")  # text in pandas, where null integers would turn to floats
    out = named.groupBy("shard").applyInPandas(place, PIECES.replace("doc_id bigint", "doc_id string") + ", sequence_id bigint, offset bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
