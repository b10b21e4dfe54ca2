"""Repeated passages, found exactly with an FM-index for each shard.

A window is ``window`` consecutive words of one text.  Every window is named by
its anchor: the run of ``gram`` words in it with the least hash.  Equal windows
have equal anchors, so a window can repeat only among passages with its anchor.
Consecutive windows with one anchor form a passage; on average a passage has
about fifteen windows.

1. Each text is read once and gives its passages: anchor, content hash, place.
2. Anchors that occur once in the corpus are dropped; that is nearly all text.
3. Equal passages become one, with a weight; its words are fetched from one
   document that has it.
4. Passages are dealt to shards by anchor.  A shard builds an FM-index over its
   passages; each passage is streamed against it by backward search, and its
   maximal matches that occur twice or more, of ``window`` words or longer, are
   reported.
5. The spans go back to every place that has the passage.

Nothing in the corpus is capped: an anchor with more than ``hot_passages``
different passages (the rim of a passage that very many texts share) would be
too much for one shard; its windows are anchored anew, more finely, and go through
FM-indexes of their own (``by_finer_anchors``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, materialize, mix, release, small, word_hashes
from .fmindex import FMIndex, matched_intervals

GRAM = 8
LOW32 = np.uint64(0xFFFFFFFF)
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 18)
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


class RangeHashes:
    """Hash of any run of words: a polynomial over the words' hashes, modulo 2**64."""

    def __init__(self, x: np.ndarray):
        up, self.down = Powers.to(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * GOLDEN)


def passages(x: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, content, start, words) of the passages of texts laid end to end."""
    none = (np.zeros(0, np.int64),) * 5
    n, grams = len(x), window - gram + 1
    if n < window:
        return none
    hashes = RangeHashes(x)
    at = np.arange(n - gram + 1)
    v = hashes.of(at, at + gram)
    low = (v & ~LOW32) | at.astype(np.uint64)  # ties go to the first
    span = 1
    while span * 2 <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < grams:
        low = np.minimum(low[: len(low) - (grams - span)], low[grams - span :])
    first = np.concatenate([[0], np.cumsum(lengths)])
    text = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.arange(len(low))
    begin = begin[begin + window <= first[text[: len(low)] + 1]]
    if not len(begin):
        return none
    anchor = (low[begin] & LOW32).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1) | (text[begin[1:]] != text[begin[:-1]])])
    head = np.flatnonzero(new)
    s = begin[head]
    e = begin[np.concatenate([head[1:], [len(begin)]]) - 1] + window
    t = text[s]
    return t, v[anchor[head]].view(np.int64), hashes.of(s, e).view(np.int64), s - first[t], e - s


KEYED = "d bigint, k bigint, a bigint, c bigint, s int, n int"


def find_passages(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """Step 1: KEYED rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            d, k = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_pylist()
            a = 0
            while a < len(texts):
                words, lengths, b = [], [], a
                while b < len(texts) and len(words) < 120_000:
                    own = texts[b].encode().split() if texts[b] else []
                    words += own
                    lengths.append(len(own))
                    b += 1
                t, anchor, content, s, n = passages(word_hashes(words), np.array(lengths, np.int64), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(d[a:b][t]), pa.array(k[a:b][t]), pa.array(anchor), pa.array(content), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["d", "k", "a", "c", "s", "n"])
                a = b

    return keyed.select("d", "k", "text").mapInArrow(run, KEYED)


def fetch_words(joined: DataFrame) -> DataFrame:
    """Step 3: (a, c, w, hot, words) from rows (text, wanted: a, c, s, n, w, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().encode().split()
                rows = wanted.as_py()
                cols = [[r[f] for r in rows] for f in ("a", "c", "w", "hot")] + [[b" ".join(words[r["s"] : r["s"] + r["n"]]) for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["a", "c", "w", "hot", "words"])

    return joined.select("text", "wanted").mapInArrow(run, "a bigint, c bigint, w bigint, hot boolean, words binary")


def match_shard(table: pa.Table, window: int) -> pa.Table:
    """Step 4, for one shard: (a, c, begins, ends)."""
    a, c, w = (table.column(f).to_numpy() for f in ("a", "c", "w"))
    words = table.column("words").to_pylist()
    _, keep = np.unique(np.stack([a, c], 1), axis=0, return_index=True)  # a repeated row of documents gives a passage twice
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(x, len(number) + 1) for x in words[i].split()], np.int64) for i in keep]
    found = matched_intervals(FMIndex(texts, w[keep], 2 * window), window)
    hit = [i for i, spans in enumerate(found) if spans]
    begins, ends = [[x for x, _ in found[i]] for i in hit], [[x for _, x in found[i]] for i in hit]
    ints = pa.list_(pa.int32())
    return pa.table({"a": a[keep][hit], "c": c[keep][hit], "begins": pa.array(begins, ints), "ends": pa.array(ends, ints)})


def window_keys(words: list[bytes], window: int, rim: int) -> list[tuple[int, int, int]]:
    """(place, finer anchor, content) of each window: the anchor is a hash of its first and last ``rim`` words."""
    out = []
    for t in range(len(words) - window + 1):
        own = words[t : t + window]
        rims = own if 2 * rim >= window else own[:rim] + own[-rim:]
        out.append((t, signed(b" ".join(rims), rim), signed(b" ".join(own), 0)))
    return out


def signed(data: bytes, seed: int) -> int:
    h = xxhash.xxh3_64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def by_finer_anchors(hot: DataFrame, window: int, rim: int, hot_passages: int, shard_passages: int) -> DataFrame:
    """(a, c, begins, ends) of passages (a, c, w, words) whose anchors have too many for one index.

    Their windows are passages of their own here, anchored by the ``rim`` words
    at either end: texts around one shared passage differ in one of the two.
    Anchors seen once are dropped; the rest is dealt to FM-indexes as before.  An
    anchor that is still too much goes on with rims twice as long, in the end
    with whole windows, when an anchor has one window only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = [(one["a"], one["c"], one["w"], *key) for one in batch.slice(a, 512).to_pylist() for key in window_keys(one["words"].split(b" "), window, rim)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["a", "c", "w", "t", "a2", "c2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, wanted in zip(batch.column(0), batch.column(1), strict=True):
                own, rows = words.as_py().split(b" "), wanted.as_py()
                cols = [pa.array([r[f] for r in rows], pa.int64()) for f in ("a2", "c2", "w")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([b" ".join(own[r["t"] : r["t"] + window]) for r in rows], pa.binary())], names=["a", "c", "w", "words"])

    last = 2 * rim >= window
    hot = hot.dropDuplicates(["a", "c"]).select("a", "c", "w", "words")
    rows = materialize(hot.mapInArrow(run, "a bigint, c bigint, w bigint, t bigint, a2 bigint, c2 bigint"), "hot-windows")
    repeated = materialize(rows.groupBy("a2").agg(F.sum("w").alias("times")).where("times >= 2").select("a2"), "hot-repeated")
    places = materialize(rows.join(repeated, "a2"), "hot-places")
    release(rows, repeated)
    kinds = materialize(places.groupBy("a2", "c2").agg(F.sum("w").alias("w"), F.min(F.struct("a", "c", "t")).alias("at")).select("a2", "c2", "w", "at.a", "at.c", "at.t"), "hot-kinds")
    wanted = kinds.groupBy("a", "c").agg(F.collect_list(F.struct("a2", "c2", "w", "t")).alias("wanted"))  # at most a passage's windows
    words = materialize(hot.join(wanted, ["a", "c"]).select("words", "wanted").mapInArrow(cut, "a bigint, c bigint, w bigint, words binary"), "hot-words")
    crowds = materialize(kinds.groupBy("a2").agg(F.count("*").alias("n")).where(F.lit(not last) & (F.col("n") > hot_passages)).select(F.col("a2").alias("a")), "hot-crowds")
    shards = max(1, -(-kinds.count() // shard_passages))
    found = match_shards(words.join(crowds, "a", "left_anti"), window, shards)
    if not last and not crowds.isEmpty():
        found = found.unionByName(by_finer_anchors(words.join(crowds, "a", "left_semi"), window, 2 * rim, hot_passages, shard_passages))
    found = materialize(found.select(F.col("a").alias("a2"), F.col("c").alias("c2")), "hot-found")
    release(kinds, crowds, words)
    hits = places.join(found, ["a2", "c2"]).groupBy("a", "c").agg(F.collect_list(F.col("t").cast("int")).alias("begins"))
    return hits.withColumn("ends", F.transform("begins", lambda t: (t + window).cast("int")))


def match_shards(words: DataFrame, window: int, shards: int) -> DataFrame:
    """(a, c, begins, ends) of passages (a, c, w, words), dealt to FM-indexes by anchor."""
    shard = F.pmod(F.xxhash64("a", F.lit("shard")), F.lit(shards))
    return words.select("a", "c", "w", "words").withColumn("shard", shard).groupBy("shard").applyInArrow(lambda t: match_shard(t, window), "a bigint, c bigint, begins array<int>, ends array<int>")


def with_keys(docs: DataFrame) -> DataFrame:
    """d, k: what tells rows of documents apart; rows alike in both have the same result."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "k": F.xxhash64("text")})


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = GRAM, hot_passages: int = 4096, shard_passages: int = 8192) -> DataFrame:
    """(d, k, begins, ends): spans of words covered by windows that occur more than once.

    docs: doc_id, text.  Spans may overlap; texts without any are left out.
    """
    rows = materialize(find_passages(with_keys(docs.select("doc_id", "text")).where("text IS NOT NULL"), window, gram), "passages")
    # Written, so that the join has plain exchanges on both sides and can split a hot anchor's rows.
    repeated = materialize(rows.groupBy("a").agg(F.count("*").alias("times")).where("times >= 2").select("a"), "repeated-anchors")
    places = materialize(rows.join(repeated, "a"), "places")
    release(rows, repeated)
    kinds = places.groupBy("a", "c").agg(F.count("*").alias("w"), F.min(F.struct("d", "k", "s", "n")).alias("at"))
    kinds = materialize(kinds.select("a", "c", "w", "at.d", "at.k", "at.s", "at.n"), "kinds")
    hot = materialize(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot_passages).select("a", F.lit(True).alias("hot")), "hot-anchors")
    wanted = kinds.join(hot, "a", "left").groupBy("d", "k").agg(F.collect_list(F.struct("a", "c", "s", "n", "w", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    texts = with_keys(docs.select("doc_id", "text")).select("d", "k", "text")
    words = materialize(fetch_words(texts.join(wanted.hint("shuffle_hash"), ["d", "k"])), "passage-words")
    shards = max(1, -(-kinds.count() // shard_passages))
    any_hot = not hot.isEmpty()
    release(kinds, hot)
    found = match_shards(words.where(~F.col("hot")), window, shards)
    if any_hot:
        found = found.unionByName(by_finer_anchors(words.where("hot"), window, gram, hot_passages, shard_passages))
    found = materialize(found, "repeated-spans")
    release(words)
    spans = places.join(found, ["a", "c"]).select("d", "k", F.expr("transform(begins, x -> x + s)").alias("begins"), F.expr("transform(ends, x -> x + s)").alias("ends"))
    return spans.groupBy("d", "k").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))


def kept_words(words: list[bytes], begins: list[int] | None, ends: list[int] | None) -> list[bytes]:
    if not begins:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, begins, 1)
    np.add.at(depth, ends, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def remove_repeats(docs: DataFrame, window: int = 35, **options) -> DataFrame:
    """docs with kept_text, n_words, n_removed and kept_sha256.

    docs: doc_id, text and further columns, which stay.  Each word covered by a
    window of ``window`` words that also starts anywhere else goes, in every
    place that has it; windows are judged on the input.  A null text has no
    words; texts of fewer words than a window stay whole; equal rows count as
    places of each other.  kept_text is the text as it was where nothing goes,
    else the kept words joined by one space (null stays null).
    """
    names = [c for c in docs.columns if c not in ("text", "kept_text", "n_words", "n_removed", "kept_sha256")]
    rest = [f"_c{i}" for i in range(len(names))]  # columns that come along may have any names
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(r) for c, r in zip(names, rest, strict=True)])
    keyed = with_keys(plain).select("d", "k", *rest, "text")
    joined = keyed.join(repeated_spans(docs, window, **options).hint("shuffle_hash"), ["d", "k"], "left")
    out_schema = keyed.select(*rest, "text").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, begins, ends = (batch.column(batch.schema.get_field_index(f)) for f in ("text", "begins", "ends"))
            kept, n, gone, sha = [], [], [], []
            for t, b, e in zip(texts.to_pylist(), begins.to_pylist(), ends.to_pylist(), strict=True):
                words = t.encode().split() if t else []
                left = kept_words(words, b, e)
                joined_words = b" ".join(left)
                kept.append(t if len(left) == len(words) else joined_words.decode())
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(joined_words).hexdigest())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[*rest, "text", "n_words", "n_removed", "kept_sha256"])

    out = joined.select(*rest, "text", "begins", "ends").mapInArrow(run, out_schema)
    return out.select(*[F.col(r).alias(c) for r, c in zip(rest, names, strict=True)], F.col("text").alias("kept_text"), "n_words", "n_removed", "kept_sha256")
