"""Search and near-duplicates over tables of embeddings."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, connected_components, materialize, mix, shuffle_partitions

LOG = logging.getLogger(__name__)
#: Rows of a table that is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 100_000


def usable(vector: str) -> Column:
    """Neither null nor empty, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of float64; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all() and width in (None, int(sizes[0])):
        return flat.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), width or int(sizes.max(initial=1))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


# --- Voronoi kNN join -----------------------------------------------------------------------------


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as whole float64 numbers."""
    return np.floor(x * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("inner products need more than 64 bits")


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each query, ties to the smaller id; an id counts once."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])])[: len(query)]
    query, ids, scores = query[new], ids[new], scores[new]
    first = np.concatenate([[True], query[1:] != query[:-1]])[: len(query)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    keep = np.arange(len(query)) - start < k
    return query[keep], ids[keep], scores[keep]


RINGS = 8


class Cells:
    """Pivots, and each pivot's rows in rings of like norm: the cells.  Of a cell its radius, its largest norm, its size and some of its rows: the summary."""

    def __init__(self, pivots: np.ndarray, scale: int):
        self.pivots, self.scale = pivots, scale
        norms = np.sqrt((pivots * pivots).sum(1))
        self.middle = float(np.median(norms)) or 1.0
        self.count = len(pivots) * RINGS
        self.radius, self.norm, self.size = np.full(self.count, -1.0), np.zeros(self.count), np.zeros(self.count, np.int64)
        self.rows, self.ids = np.zeros((0, pivots.shape[1])), np.zeros(0, np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and how far its pivot is.  Rings are half octaves of norm around the pivots' median."""
        square = (x * x).sum(1)
        pivot = (square[:, None] - 2 * x @ self.pivots.T + (self.pivots * self.pivots).sum(1)).argmin(1)
        ring = np.floor(np.log2(np.maximum(square, 1e-9)) - 2 * math.log2(self.middle)).astype(np.int64) + RINGS // 2
        return pivot * RINGS + np.clip(ring, 0, RINGS - 1), np.sqrt(((x - self.pivots[pivot]) ** 2).sum(1))

    def bounds(self, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each query: a score that rows of k ids reach at least; for each cell a score that no row of it passes.

        A row is within the radius of its pivot and within its ring's norm; either bounds the product.
        """
        reach = products(q, self.rows).astype(float)
        reach[ids[:, None] == self.ids] = -np.inf
        at_least = np.full(len(q), -np.inf)
        if len(self.ids) > k:
            at_least = -np.partition(-reach, k - 1, axis=1)[:, k - 1]
        norm = np.sqrt((q * q).sum(1))[:, None]
        most = np.minimum(np.repeat(q @ self.pivots.T, RINGS, axis=1) + norm * self.radius, norm * self.norm)
        most = np.where(self.radius < 0, -np.inf, most + 1e-6 * (1 + np.abs(most)))
        return at_least, most


def summarize(data: DataFrame, cells: Cells, kept: int) -> None:
    """Fill in the summary: at most ``kept`` rows of a cell from each partition, then of each cell."""
    schema = "cell int, id bigint, far double, v array<double>, radius double, norm double, n bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def reduced(cell, ids, far, x, radius, norm, n) -> pa.Table:
        """Of each cell the nearest rows, an id once; the cell's measures stand on the first and are neutral on the others."""
        out = []
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            pick = own[np.lexsort((ids[own], far[own]))]
            pick = pick[np.sort(np.unique(ids[pick], return_index=True)[1])[:kept]]
            first = np.arange(len(pick)) == 0
            measures = [np.where(first, f, 0) for f in (radius[own].max(), norm[own].max(), n[own].sum())]
            out.append(pa.table([pa.array(cell[pick], pa.int32()), pa.array(ids[pick], pa.int64()), pa.array(far[pick]), pa.array(list(x[pick]), pa.list_(pa.float64())), *map(pa.array, measures)], names=names))
        return pa.concat_tables(out)

    def again(t: pa.Table) -> pa.Table:
        return reduced(*(matrix(t.column(c)) if c == "v" else t.column(c).to_numpy() for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(matrix(batch.column(1), cells.pivots.shape[1]), cells.scale)
            cell, far = cells.nearest(x)
            t = reduced(cell, batch.column(0).to_numpy(), far, x, far, np.sqrt((x * x).sum(1)), np.ones(len(x), np.int64))
            held = t if held is None else again(pa.concat_tables([held, t]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    rows = data.mapInArrow(run, schema).groupBy("cell").applyInArrow(again, schema).collect()  # kept rows of each cell
    rows.sort(key=lambda r: (r["cell"], r["far"], r["id"]))
    for r in rows:
        if r["n"]:
            cells.radius[r["cell"]], cells.norm[r["cell"]], cells.size[r["cell"]] = r["radius"], r["norm"], r["n"]
    rows = list({r["id"]: r for r in reversed(rows)}.values())  # k rows of the summary are k ids, as in the answer
    if rows:
        cells.rows, cells.ids = np.array([r["v"] for r in rows]), np.array([r["id"] for r in rows])


def pivots_for(rows: int) -> int:
    """More pivots for more rows, so that cells get narrower; 1,024 at most, so that they can be broadcast."""
    return min(1024, max(64, math.isqrt(rows) // 4))


def spread_out(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample, each next one the farthest from those taken, so that every cluster gets one; the first is the nearest to the mean."""
    taken = [int(((sample - sample.mean(0)) ** 2).sum(1).argmin())]
    far = ((sample - sample[taken[0]]) ** 2).sum(1)
    while len(taken) < min(pivots, len(sample)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[taken[-1]]) ** 2).sum(1))
    return sample[taken]


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int | None = None, kept: int = 8, group_queries: int = 4096, slice_rows: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x), exactly.

    vectors: vec_id, embedding; further columns are ignored.  Ties go to the
    smaller vec_id; a query is never its own candidate; fewer than k candidates
    give fewer rows.  Rows without vec_id, and vectors that are null, empty or
    hold null or non-finite components take no part.  Shorter vectors count as
    filled with zeros.  A repeated row counts once.

    Data and queries are put in the cells of the pivots, a cell for each ring of
    like norm.  From a summary (each cell's radius, largest norm and a few of its
    rows, an id once) every query gets a score that k ids reach, and each cell one
    that none of its rows passes.  Query cells are gathered into groups of bounded
    size; a cell's rows go to the groups that may need them, dealt into slices of
    bounded size, and each group and slice is solved by itself, its cells in order
    of promise.  How much of the data is sent is logged.  Where vectors lie
    without any order in many dimensions no cell can be ruled out: then each
    group gets all rows, and the work is queries times rows.
    """
    spark = vectors.sparkSession
    data = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("bigint").alias("id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("q"))
    out_schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    stats = data.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not stats["n"]:
        return spark.createDataFrame([], out_schema)
    pivots, width = pivots or pivots_for(stats["n"]), int(stats["width"])
    chosen = data.orderBy(F.xxhash64("id", F.lit("pivot")), "id").select("embedding").limit(8 * pivots).collect()  # a bounded sample
    sample = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        sample[i, : len(r["embedding"])] = r["embedding"]
    cells = Cells(spread_out(np.unique(whole_numbers(sample, scale), axis=0), pivots), scale)
    summarize(data.select("id", "embedding"), cells, kept)
    shared = spark.sparkContext.broadcast(cells)  # at most 1,024 pivots and ``kept`` rows of a cell

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            cell = c.nearest(whole_numbers(matrix(batch.column(1), width), scale))[0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    placed = data.mapInArrow(place, data.select("*").schema.add("cell", "integer"))
    # Query groups: neighbouring cells together, a full cell in several parts.
    sizes = {r["cell"]: r["n"] for r in placed.where("q").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rows, group, room = [], 0, group_queries
    for cell in sorted(sizes, key=lambda c: (*cells.pivots[c // RINGS], c)):
        parts = -(-sizes[cell] // group_queries)
        if parts > 1 or sizes[cell] > room:
            group, room = group + 1, group_queries
        rows.append((cell, group, parts))
        group, room = (group + parts, group_queries) if parts > 1 else (group, room - sizes[cell])
    if not rows:
        return spark.createDataFrame([], out_schema)
    # At most one row for each cell.
    layout = F.broadcast(spark.createDataFrame(rows, "cell int, first int, parts int"))
    queries = placed.where("q").join(layout, "cell").withColumn("grp", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int")).select("id", "embedding", "grp")

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at_least, most = c.bounds(whole_numbers(matrix(batch.column(1), width), scale), batch.column(0).to_numpy(), k)
            need, grp = most >= at_least[:, None], batch.column(2).to_numpy()
            for g in np.unique(grp):
                cell = np.flatnonzero(need[grp == g].any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), g, np.int32)), pa.array(cell.astype(np.int32)), pa.array(c.size[cell])], names=["grp", "cell", "size"])

    needed = materialize(queries.mapInArrow(needs, "grp int, cell int, size bigint").distinct(), "needed-cells")
    sums = needed.agg(F.sum("size").alias("sent"), F.count_distinct("grp").alias("groups"), F.count("*").alias("rows")).first()
    LOG.info("cells: %d of %d rows for each of %d groups of queries on average", round((sums["sent"] or 0) / max(1, sums["groups"])), stats["n"], sums["groups"])
    if sums["rows"] <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    slices = max(1, -(-stats["n"] // slice_rows))
    sent = placed.select("id", "embedding", "cell").join(needed.drop("size"), "cell").withColumns({"part": F.pmod(F.xxhash64("id", F.lit("slice")), F.lit(slices)).cast("int"), "q": F.lit(False)})
    asked = queries.withColumns({"cell": F.lit(-1), "part": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), "q": F.lit(True)})
    columns = ["grp", "part", "q", "id", "cell", "embedding"]

    def solve(t: pa.Table) -> pa.Table:
        c = shared.value
        is_q = t.column("q").to_numpy(zero_copy_only=False)
        ids, cell, x = t.column("id").to_numpy(), t.column("cell").to_numpy(), whole_numbers(matrix(t.column("embedding"), width), scale)
        qid, q = ids[is_q], x[is_q]
        at_least, most = c.bounds(q, qid, k)
        found = (np.zeros(0, np.int64),) * 3
        here = cell[~is_q]
        did, d = ids[~is_q], x[~is_q]
        for one in sorted(set(here.tolist()), key=lambda v: -most[:, v].max()):
            own = np.flatnonzero(here == one)
            ask = np.flatnonzero(most[:, one] >= at_least)
            step = max(64, 4_000_000 // max(1, len(ask)))
            for a in range(0, len(own) if len(ask) else 0, step):
                some = own[a : a + step]
                scores = products(q[ask], d[some])
                hit = (scores >= at_least[ask][:, None]) & (qid[ask][:, None] != did[some])
                r, s = np.nonzero(hit)
                found = best(*(np.concatenate(z) for z in zip(found, (ask[r], did[some][s], scores[r, s]), strict=True)), k)
                count = np.bincount(found[0], minlength=len(qid))
                last = np.cumsum(count) - 1
                full = count >= k
                at_least[full] = np.maximum(at_least[full], found[2][last[full]])
        return pa.table({"query_id": qid[found[0]], "vec_id": found[1], "score": found[2]})

    partial = sent.select(*columns).unionByName(asked.select(*columns)).groupBy("grp", "part").applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    # At most k rows for each query and slice: a query's rows are few.
    ranked = partial.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("at", "one")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", (-F.col("one.low")).alias("score"))


# --- Sorted projection passes ---------------------------------------------------------------------

#: Rows from which the crowding of prefixes is estimated; it decides costs, never results.
MEASURED_ROWS = 20_000
MOST_SIGNS = 48


def passes_needed(signs: int, cosine: float, miss: float) -> int:
    """Passes after which a pair at the threshold agreed in all ``signs`` signs once, but for a chance of ``miss``.

    A sign agrees with chance 1 - angle / pi, however the vectors lie, and the
    signs are independent of each other.
    """
    near = (1 - math.acos(cosine) / math.pi) ** signs
    return 1 if near >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-near)))


def sign_keys(x: np.ndarray, signs: int, passes: int, seed: int) -> np.ndarray:
    """rows x passes: signs of random projections, the first as the highest bit."""
    out = np.zeros((len(x), passes), np.int64)
    for p in range(passes if signs else 0):
        planes = np.random.default_rng((seed, p)).standard_normal((x.shape[1], signs))
        out[:, p] = ((x @ planes) > 0).astype(np.int64) @ (np.int64(1) << np.arange(signs - 1, -1, -1, dtype=np.int64))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b), places in ids, connect: each place to the least id of its part."""
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            break
    touched = np.unique(np.concatenate([a, b]))
    keep = touched[root[touched] != touched]
    return ids[root[keep]], ids[keep]


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Vectors of one length only meet each other.  Batches: id, embedding."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for size in np.unique(sizes) if batch.num_rows else ():
            yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


def sampled_keys(vectors: DataFrame, rows: int, signs: int, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and keys of at most about MEASURED_ROWS vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, some in by_length(batches):
            k = sign_keys(unit(matrix(some.column(1))), signs, passes, seed)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), size, np.int64)), pa.array(list(k), pa.list_(pa.int64()))], names=["size", "keys"])

    one_of = max(1, -(-rows // MEASURED_ROWS))
    some = vectors.where(F.pmod(F.xxhash64("id", F.lit("crowding")), F.lit(one_of)) == 0).mapInArrow(run, "size bigint, keys array<bigint>").toArrow()
    return some.column("size").to_numpy(), some.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, passes)


def signs_for(sizes: np.ndarray, keys: np.ndarray, rows: int, cosine: float, miss: float, room: int, carry: int) -> int:
    """Signs with the least work over all passes, as the sampled keys (of MOST_SIGNS signs) tell how prefixes are crowded."""
    work = []
    for signs in range(MOST_SIGNS + 1):
        each = []
        for k in keys.T:
            n = np.unique(np.stack([sizes, k >> (MOST_SIGNS - signs)]), axis=1, return_counts=True)[1].astype(float)
            scale = rows / max(1, len(sizes))
            each.append((n * (carry * np.maximum(1, np.ceil(n * scale / room)) + (n - 1) * scale)).sum() / max(1, len(sizes)))
        work.append(passes_needed(signs, cosine, miss) * np.mean(each))
    return int(np.argmin(work))


def crowded(sizes: np.ndarray, keys: np.ndarray, rows: int, room: int) -> dict[tuple[int, int, int], int]:
    """Of each (length, pass, key) that holds more than ``room`` rows, as the sample tells: into how many parts its rows go."""
    out, scale = {}, rows / max(1, len(sizes))
    for p, k in enumerate(keys.T):
        groups, n = np.unique(np.stack([sizes, k]), axis=1, return_counts=True)
        for g in np.flatnonzero((n >= 8) & (n * scale > room)):
            out[int(groups[0, g]), p, int(groups[1, g])] = math.ceil(n[g] * scale / room)
    return out


def group_hash(*tags: np.ndarray) -> np.ndarray:
    h = np.zeros(len(tags[0]), np.uint64)
    for t in tags:
        h = mix((h + t.astype(np.uint64)) * GOLDEN + np.uint64(1))
    return h.view(np.int64)


def group_links(ids: np.ndarray, own: np.ndarray, x: np.ndarray, cosine: float, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows that links of the group connect; ``crossing``: only links between different parts count.

    Rows known to be connected are not compared again.
    """
    src = dst = np.zeros(0, np.int64)
    root, place = np.arange(len(ids)), np.arange(len(ids))
    for a in range(0, len(ids), 256):
        some = place[a : a + 256]
        rest = place[a:]
        if (root[some] == root[a]).all():
            rest = rest[root[rest] != root[a]]
        if not len(rest):
            continue
        near = x[some] @ x[rest].T >= cosine
        if crossing:
            near &= own[some][:, None] != own[rest]
        i, j = np.nonzero(near)
        i, j = some[i], rest[j]
        new = root[i] != root[j]
        if new.any():
            src, dst = spanning(place, np.concatenate([src, i[new]]), np.concatenate([dst, j[new]]))
            root = place.copy()
            root[dst] = src
    return ids[src], ids[dst]


def projection_links(vectors: DataFrame, rows: int, cosine: float, miss: float, seed: int, room: int, carry: int) -> DataFrame:
    """(src, dst): verified links that connect what the passes found.  vectors: id, embedding."""
    width = int(vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)
    signs = signs_for(*sampled_keys(vectors, rows, MOST_SIGNS, 3, seed + 1), rows, cosine, miss, room, carry)
    passes = passes_needed(signs, cosine, miss)
    parts_of = crowded(*sampled_keys(vectors, rows, signs, passes, seed), rows, room)
    names = ["g", "pass", "key", "pair", "own", "id", "embedding"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, some in by_length(batches):
            ids = some.column(0).to_numpy()
            k = sign_keys(unit(matrix(some.column(1))), signs, passes, seed)
            spread = mix(ids.astype(np.uint64)) >> np.uint64(1)
            for p in range(passes):
                parts = np.array([parts_of.get((size, p, v), 1) for v in k[:, p].tolist()], np.int64)
                own = (spread % parts.astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(len(ids)), parts)
                other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                pair = np.minimum(own[at], other) * parts[at] + np.maximum(own[at], other)
                for a in range(0, len(at), 10_000):
                    t = at[a : a + 10_000]
                    tags = np.full(len(t), size * passes + p, np.int64), k[t, p], pair[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(group_hash(*tags)), *map(pa.array, tags), pa.array(own[t]), pa.array(ids[t]), some.column(1).take(pa.array(t))], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            tags, ids, own, x = (np.concatenate(c) for c in zip(*held, strict=True))
            for tag in np.unique(tags, axis=0):  # one, but for equal hashes of different groups
                at = np.flatnonzero((tags == tag).all(1))
                src, dst = group_links(ids[at], own[at], x[at, : tag[0] // passes], cosine, (own[at] != own[at[0]]).any()) if len(at) > 1 else ((), ())
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group, tags = batch.column(0).to_numpy(), np.stack([batch.column(c).to_numpy() for c in (1, 2, 3)], 1)
            own, ids = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            every = unit(matrix(batch.column(6), width))
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and group[a] != held_group:
                    if len(held) > 1 or len(held[0][1]) > 1:
                        yield from links()
                    held = []
                held_group = group[a]
                held.append((tags[a:b], ids[a:b], own[a:b], every[a:b]))
        if held:
            yield from links()

    tasks = max(shuffle_partitions(vectors.sparkSession), -(-rows * passes // 200_000))
    kind = vectors.schema["embedding"].dataType.simpleString()
    # A group is within one task, so that no border parts it; sorted by one number, its hash, which is the quickest sort there is.
    dealt = vectors.mapInArrow(keys, f"g bigint, pass bigint, key bigint, pair bigint, own bigint, id bigint, embedding {kind}").repartition(tasks, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(sweep, "src bigint, dst bigint").distinct()


def cosine_components(vectors: DataFrame, cosine: float = 0.95, miss: float = 1e-4, seed: int = 3, block: int = 1024, carry: int = 1000) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    vectors: vec_id, embedding (further columns are ignored).  Vectors that are
    null, empty, zero or hold null or non-finite components are linked with
    nothing, and so are vectors of another length.  Vectors alike in every
    component are one for the passes and count each for the links.  Rows of one
    vec_id belong together and are no links of each other.  A row without vec_id
    keeps to itself (component_id null, kept true).

    A pass sorts all vectors by the signs of random projections and compares all
    that agree in every sign, however many they are; a crowded prefix is compared
    in parts of about ``4 * block`` rows.  The number of passes follows from that
    of the signs and ``miss`` alone, so the chance to miss a pair is the same
    wherever it lies.  How many signs make the least work is measured on a sample
    (``carry``: the comparisons that taking a row through a pass is worth).  Links
    found join vectors into components; links within a component, also those
    that no pass held, are then counted exactly, in blocks of ``block`` vectors, so
    that a component of any size is many tasks.
    """
    fit = usable("embedding") & F.exists("embedding", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    plain = F.transform("embedding", lambda x: (x + F.lit(0).cast(kind)).cast(kind))  # one zero
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.when(F.coalesce(fit, F.lit(False)), plain).alias("embedding"))
    rows = materialize(rows.withColumn("same", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))), "vectors")
    valid = rows.where("embedding IS NOT NULL AND id IS NOT NULL")
    classes = materialize(valid.groupBy("same", "embedding").agg(F.min("id").alias("id"), F.count_distinct(F.col("id")).alias("copies")), "vector-classes")
    n = classes.count()
    links = projection_links(classes.select("id", "embedding"), n, cosine, miss, seed, 4 * block, carry)
    comp = connected_components(links, tag="vectors")
    members = materialize(classes.join(comp, "id"), "vector-members")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.when(F.col("n") <= block, F.lit(1)).otherwise(F.ceil(F.col("n") / block)).cast("int")
    dealt = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "copies", "embedding")

    def count(t: pa.Table) -> pa.Table:
        ids, copies, own = (t.column(c).to_numpy() for c in ("id", "copies", "own"))
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        x = unit(matrix(t.column("embedding")))
        total = np.zeros(len(ids), np.int64)
        for a in range(0, len(ids), 512):
            near = x[a : a + 512] @ x.T >= cosine
            if p != q:
                near &= own[a : a + 512, None] != own
            total[a : a + 512] = near @ copies
        if p == q:
            total -= (np.einsum("ij,ij->i", x, x) >= cosine) * copies
        return pa.table({"id": ids, "n": total})

    found = dealt.groupBy("component", "p", "q").applyInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("others"))
    named = classes.join(comp, "id", "left").join(found, "id", "left")
    named = named.select("same", "embedding", "copies", F.col("id").alias("rep"), F.coalesce("component", "id").alias("component"), F.coalesce("others", F.lit(0)).alias("others"))
    named = named.select(F.col("same").alias("of"), F.col("embedding").alias("e"), "copies", "component", "others")
    # Vectors that link with nothing would be one key of the join.
    some, none = rows.where("same IS NOT NULL"), rows.where("same IS NULL").select("id", *[F.lit(None).cast("bigint").alias(c) for c in ("copies", "component", "others")])
    out = some.join(named, (F.col("same") == F.col("of")) & (F.col("embedding") == F.col("e")), "left").select("id", "copies", "component", "others").unionByName(none)
    ids = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    links_of = F.when(F.col("id").isNotNull() & F.col("copies").isNotNull(), F.col("others") + F.col("copies") - 1).otherwise(F.lit(0)).cast("bigint")
    return out.select(F.col("id").alias("vec_id"), links_of.alias("n_links"), ids.alias("component_id"), F.coalesce(F.col("id") == ids, F.lit(True)).alias("kept"))
