"""Near-duplicate documents by MinHash with tensored banding, confirmed on full sets.

A table's key needs 2r minhashes.  They come in halves: two collections of m
groups of r minhashes each.  Group i of the first with group j of the second
make the key of table (i, j), so 2mr minhashes serve m*m tables.  m is the least
for which a pair at the threshold is missed with a chance of at most ``miss``
in either collection.

1. Each text is read once: set size, 128-bit hash of the set, half keys.
2. Documents of equal sets become one.
3. Half keys that only one set has are dropped; the rest are paired to table keys.
4. Each bucket's members are held against its first member, on full sets.
5. A bucket whose members are still in several components has pairs that nobody
   compared.  Such buckets overlap, so the members of those that hang together are
   dealt to blocks of bounded size, and in a block the pairs that share a bucket
   (a half key of either collection) are compared, once each.  So every pair that
   shares a bucket is compared or already known to be connected; no bucket is
   capped.
6. Components by minimum labels.

Texts are fetched only for sets that share a bucket.  A leader with many members
is dealt into many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, carried, connected_components, materialize, mix, relabel, release, restored, small, word_hashes
from .substring import with_keys

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def collections_needed(similarity: float, rows: int, miss: float) -> int:
    return max(2, math.ceil(math.log(miss) / math.log(1 - similarity**rows)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words, of the whole sequence."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    x = word_hashes(words)
    n = min(width, len(x))
    h = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * GOLDEN + x[i : len(x) - n + 1 + i]
        h ^= h >> np.uint64(29)
    h = mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


class HalfKeys:
    """Keys of the 2m groups of r minhashes, for many sets at once."""

    def __init__(self, m: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.groups, self.rows = 2 * m, rows
        self.flip = rng.integers(0, 1 << 63, 2 * m * rows, dtype=np.uint64)
        self.times = rng.integers(0, 1 << 63, 2 * m * rows, dtype=np.uint64) | np.uint64(1)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
        x = np.concatenate(sets)
        out = np.empty((len(sets), self.groups), np.uint64)
        for g in range(self.groups):
            key = np.full(len(sets), g + 1, np.uint64)
            for k in range(g * self.rows, (g + 1) * self.rows):
                key = mix(key * GOLDEN + np.minimum.reduceat((x ^ self.flip[k]) * self.times[k], first))
            out[:, g] = key
        return out.view(np.int64)


def sketches(docs: DataFrame, width: int, m: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, k, n, h1, h2, halves) of every row; halves null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = HalfKeys(m, rows, seed)
        for batch in small(batches):
            texts = batch.column(2).to_pylist()
            a = 0
            while a < len(texts):
                sets, b, total = [], a, 0
                while b < len(texts) and total < 150_000:
                    sets.append(shingle_set(texts[b], width))
                    total += len(sets[-1])
                    b += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                halves: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, keys.of([sets[i] for i in full]), strict=True):
                        halves[i] = row
                h = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                part = lambda i: pa.array([None if x is None else int.from_bytes(x[8 * i : 8 * i + 8], "little", signed=True) for x in h], pa.int64())  # noqa: E731, B023
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), part(0), part(1), pa.array(halves, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "n", "h1", "h2", "halves"])
                a = b

    keyed = with_keys(docs.select("doc_id", "text"))
    return keyed.select(F.col("doc_id").cast("bigint"), "k", "text").mapInArrow(run, "doc_id bigint, k bigint, n bigint, h1 bigint, h2 bigint, halves array<bigint>")


def linked(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def confirm(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (src, dst) from rows (xd, xk, salt, y, text): y null is the leader's text, the rest its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, np.zeros(0, np.uint64)
        for batch in small(batches):
            cols = [batch.column(i).to_pylist() for i in range(5)]
            src, dst = [], []
            for xd, xk, salt, y, text in zip(*cols, strict=True):
                own = shingle_set(text, width)
                if y is None:
                    group, leader = (xd, xk, salt), own
                elif group == (xd, xk, salt) and percent * len(leader) <= 100 * len(own) and percent * len(own) <= 100 * len(leader) and linked(len(leader), len(own), common_size(leader, own), percent):
                    src.append(xd)
                    dst.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return rows.select("xd", "xk", "salt", "y", "text").mapInArrow(run, "src bigint, dst bigint")


def compare_block(ids: list[int], labels: list[int], side: np.ndarray, sets: list[np.ndarray], halves: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect different labels, of pairs that share a half key of either collection.  side: 0 and 1 are compared with each other, 2 with all of 2."""
    m = halves.shape[1] // 2
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    label = np.array(labels)
    mark = np.zeros(int(local.max()) + 1, np.int64)
    out = []
    for i in range(len(ids)):
        own = local[first[i] : first[i] + size[i]]
        fit = (label != label[i]) & (100 * size >= percent * size[i]) & (percent * size <= 100 * size[i])
        fit &= (np.arange(len(ids)) > i) & ((side == 2) | (side != side[i]))
        some = np.flatnonzero(fit)
        shared = halves[some] == halves[i]
        some = some[shared[:, :m].any(1) & shared[:, m:].any(1)]
        if not len(some):
            continue
        mark[own] = 1
        if 4 * len(some) < len(ids):
            common = np.array([mark[local[first[j] : first[j] + size[j]]].sum() for j in some])
        else:
            common = np.add.reduceat(mark[local], first)[some]
        mark[own] = 0
        for j in some[100 * common >= percent * (size[some] + size[i] - common)].tolist():
            if label[j] != label[i]:
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return out


def components(docs: DataFrame, width: int = 3, percent: int = 85, rows: int = 3, miss: float = 1e-5, seed: int = 7, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    docs: doc_id, text; further columns are ignored, texts of any length are
    read whole, a repeated row gives its result again.  Words are runs of other
    characters than space and the controls 0x09-0x0D, with A-Z lower-cased.  A
    text without words (or null) has an empty set and is linked with nothing; a
    text of fewer words than ``width`` has one shingle.  Sets are linked when
    100 * intersection >= percent * union.  Rows of one doc_id belong together.
    A row without doc_id keeps to itself: component_id null, kept true.
    """
    m = collections_needed(percent / 100, rows, miss)
    seen = materialize(sketches(docs, width, m, rows, seed), "sketches")
    sets = seen.where("h1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").alias("d"), "k")).alias("u"), F.min_by("halves", F.struct("doc_id", "k")).alias("halves"))
    sets = materialize(sets.select("h1", "h2", "u.d", "u.k", "halves"), "sets")
    halves = sets.select("d", "k", F.posexplode("halves").alias("g", "half"))
    # Counts are written before their joins: with plain exchanges on both sides, hot keys' rows can be split.
    shared = materialize(halves.groupBy("half").agg(F.count("*").alias("sets")).where("sets >= 2").select("half"), "shared-halves")
    side = lambda first: F.collect_list(F.when((F.col("g") < m) == F.lit(first), F.col("half")))
    hit = halves.join(shared, "half").groupBy("d", "k").agg(side(True).alias("a"), side(False).alias("b")).where("size(a) > 0 AND size(b) > 0")
    hit = materialize(hit, "half-hits")
    release(shared)
    tables = hit.select("d", "k", F.explode(F.expr("flatten(transform(a, x -> transform(b, y -> xxhash64(x, y))))")).alias("t"))
    leaders = materialize(tables.groupBy("t").agg(F.min(F.struct("d", "k")).alias("x"), F.count("*").alias("size")).where("size >= 2"), "leaders")
    buckets = materialize(tables.join(leaders, "t").select("t", "d", "k", F.col("x.d").alias("xd"), F.col("x.k").alias("xk"), "size"), "buckets")
    release(hit, leaders)
    near = buckets.select("d", "k").distinct()
    texts = materialize(with_keys(docs.select("doc_id", "text")).select("d", "k", "text").join(near.hint("shuffle_hash"), ["d", "k"]).dropDuplicates(["d", "k"]), "near-texts")

    pairs = materialize(buckets.where("d <> xd OR k <> xk").select("xd", "xk", "d", "k").distinct(), "pairs")
    load = materialize(pairs.groupBy("xd", "xk").agg(F.ceil(F.count("*") / 256).cast("bigint").alias("parts")), "loads")
    members = pairs.join(load, ["xd", "xk"]).select("xd", "xk", F.pmod(F.xxhash64("d", "k"), "parts").alias("salt"), F.col("d").alias("y"), "d", "k")
    lead = load.select("xd", "xk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("salt")).select("xd", "xk", "salt", F.lit(None).cast("bigint").alias("y"), F.col("xd").alias("d"), F.col("xk").alias("k"))
    held = members.unionByName(lead).join(texts, ["d", "k"]).select("xd", "xk", "salt", "y", "text")
    ordered = held.repartition("xd", "xk", "salt").sortWithinPartitions("xd", "xk", "salt", F.col("y").asc_nulls_first())
    links = materialize(confirm(ordered, width, percent), "links")
    release(pairs, load)

    comp = connected_components(links, tag="star")
    labelled = buckets.join(comp.withColumnsRenamed({"id": "d", "component": "label"}), "d", "left").withColumn("label", F.coalesce("label", "d"))
    torn = labelled.where("size >= 3").groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("t")
    left = materialize(labelled.where("size >= 3").join(torn, "t", "left_semi").select("xd", "d", "k", "label").distinct(), "torn")
    if not left.isEmpty():
        cluster = connected_components(left.select(F.col("xd").alias("src"), F.col("d").alias("dst")), tag="torn")
        rows_left = left.select("d", "k", "label").distinct().join(cluster.withColumnsRenamed({"id": "d", "component": "cluster"}), "d")
        sizes = rows_left.groupBy("cluster").agg(F.count("*").alias("n"))
        blocks = F.when(F.col("n") <= block, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / block)).cast("int")
        dealt = rows_left.join(sizes, "cluster").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("d", "k", F.lit("block")), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
        dealt = dealt.join(texts, ["d", "k"]).join(sets.select("d", "k", "halves"), ["d", "k"]).select("cluster", "p", "q", "own", "d", "label", "halves", "text")

        def compare(part: pa.Table) -> pa.Table:
            sets_here = [shingle_set(t, width) for t in part.column("text").to_pylist()]
            p, q, own = (part.column(c).to_numpy() for c in ("p", "q", "own"))
            sides = np.where(p == q, 2, (own == q).astype(np.int64))
            halves_here = part.column("halves").combine_chunks().flatten().to_numpy().reshape(-1, 2 * m)
            got = compare_block(part.column("d").to_pylist(), part.column("label").to_pylist(), sides, sets_here, halves_here, percent)
            return pa.table({"src": pa.array([x for x, _ in got], pa.int64()), "dst": pa.array([y for _, y in got], pa.int64())})

        more = materialize(dealt.groupBy("cluster", "p", "q").applyInArrow(compare, "src bigint, dst bigint").distinct(), "more-links")
        across = relabel(relabel(more, "src", comp), "dst", comp)
        comp = comp.unionByName(more.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(comp, "id", "left_anti").withColumn("component", F.col("id")))
        comp = relabel(comp, "component", connected_components(across, tag="all")).select("id", "component")
        comp = materialize(comp, "components")
        release(more)
    release(links, buckets, texts, left)
    named = sets.select("h1", "h2", "d").join(comp.withColumnRenamed("id", "d"), "d", "left").select("h1", "h2", F.coalesce("component", "d").alias("component"))
    every = seen.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
    # Empty sets meet nothing; together they would be one key of the join.
    out = every.where("h1 IS NOT NULL").join(named, ["h1", "h2"], "left").unionByName(every.where("h1 IS NULL").withColumn("component", F.lit(None).cast("bigint")))
    ids = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", ids.alias("component_id"), F.coalesce(F.col("doc_id") == ids, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """One document of each group stays: the one of the smallest id.  Columns as they were.

    Rows alike in id and text are one; rows of one id with different texts all
    stay or all go; rows without id stay.
    """
    keep = components(docs, width, percent, **options).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    plain, names = carried(docs, "doc_id", "text")
    named = plain.where("doc_id IS NOT NULL").join(keep.hint("shuffle_hash"), "doc_id", "left_semi").withColumn("k", F.xxhash64("text")).dropDuplicates(["doc_id", "k"]).drop("k")
    return restored(named.unionByName(plain.where("doc_id IS NULL")), names)
