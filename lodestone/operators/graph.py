"""Graph analysis over edges(src, dst): components, shortest paths, betweenness.

Ids are dense bigints in file order (``dense_ids``).  Graphs whose size is known
to fit are worked on in one task or with a broadcast adjacency; beyond
``SMALL_EDGES`` edges the same results come from DataFrame loops.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

SMALL_EDGES = 2_000_000


def numbered(rows: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """rows with 0, 1, ... in the given order, which should leave no ties.  Sorted by ranges; each range's offset is added to its own count."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ids")
    # A row for each partition.
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_row") - F.col("_low")).alias(name), *rows.columns)


def dense_ids(names: DataFrame, name: str = "file") -> DataFrame:
    """(id, name): 0, 1, ... in name order."""
    return numbered(names.select(name).distinct(), name)


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def tarjan(n: int, heads: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Component of each of n vertices, named by its smallest member; adjacency in compressed rows."""
    index, low, comp = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
    on, stack, clock = np.zeros(n, bool), [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, heads[root])]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on[root] = True
        while work:
            v, at = work[-1]
            if at < heads[v + 1]:
                work[-1] = (v, at + 1)
                w = targets[at]
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, heads[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                members = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    members.append(w)
                    if w == v:
                        break
                comp[members] = min(members)
    return comp


def compressed(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((dst, src))
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order]


def _small_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One task; for graphs of a checked size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["v"] >= 0, "v"].unique()) if (pdf["v"] >= 0).any() else np.zeros(0, np.int64)
        e = pdf[pdf["v"] < 0]
        heads, targets = compressed(np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]), len(ids))
        return pd.DataFrame({"id": ids, "scc_id": ids[tarjan(len(ids), heads, targets)]})

    rows = edges.select("src", "dst", F.lit(-1).cast("bigint").alias("v")).unionByName(vertices.select(F.lit(-1).cast("bigint").alias("src"), F.lit(-1).cast("bigint").alias("dst"), F.col("id").cast("bigint").alias("v")))
    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "id bigint, scc_id bigint").select("id", "scc_id")


def _spread(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that reaches each vertex along edges, itself included.

    A label is a vertex that reaches its bearer, so that vertex's own label does
    too: labels are taken along the edges and then from the labels' labels, and
    the rounds grow with the logarithm of a path's length.
    """
    labels = vertices.select("id", F.col("id").alias("label"))
    while True:
        seen = edges.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("seen"))
        near = materialize(labels.join(seen, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("seen", "label")).alias("label")), "spread-near")
        further = near.select(F.col("id").alias("label"), F.col("label").alias("least"))
        far = materialize(near.join(further, "label").select("id", F.col("least").alias("label"), (F.col("was") != F.col("least")).alias("moved")), "spread")
        labels = far.select("id", "label")
        if far.where("moved").isEmpty():
            return labels


def _large_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Trim, colour forward by smallest label, gather backward within a colour, until nothing is left."""
    done = None
    live_v, live_e = materialize(vertices, "scc-v"), materialize(edges.where("src <> dst").distinct(), "scc-e")
    while not live_v.isEmpty():
        inner = live_v.join(live_e.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(live_e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        alone = live_v.join(inner, "id", "left_anti").select("id", F.col("id").alias("scc_id"))
        inner = materialize(inner, "scc-inner")
        colour = _spread(inner, live_e.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        same = live_e.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        # A colour is the smallest id of its vertices; those that lead back to it are its component.
        back = _spread(colour, materialize(transpose(same.select("src", "dst")), "scc-back"))
        found = back.join(colour.withColumnRenamed("label", "colour"), "id").where("label = colour").select("id", F.col("label").alias("scc_id"))
        round_ = materialize(alone.unionByName(found), "scc-round")
        done = round_ if done is None else done.unionByName(round_)
        live_v = materialize(inner.join(round_, "id", "left_anti"), "scc-v")
        live_e = materialize(live_e.join(live_v.withColumnRenamed("id", "src"), "src", "left_semi").join(live_v.withColumnRenamed("id", "dst"), "dst", "left_semi"), "scc-e")
    return done if done is not None else vertices.select("id", F.col("id").alias("scc_id"))


def strongly_connected(edges: DataFrame, vertices: DataFrame | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(id, scc_id) of each vertex; a component is named by its smallest member.  A self loop is a component of one."""
    vertices = (vertices or vertices_of(edges)).select(F.col("id").cast("bigint")).distinct()
    edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    return _small_components(edges, vertices) if fits(edges, vertices, small_edges) else _large_components(edges, vertices)


def component_sizes(scc: DataFrame) -> DataFrame:
    """(scc_id, size, is_cycle); a component of one is no cycle."""
    return scc.groupBy("scc_id").agg(F.count("*").alias("size")).withColumn("is_cycle", F.col("size") > 1)


def size_histogram(scc: DataFrame) -> DataFrame:
    return component_sizes(scc).groupBy("size").agg(F.count("*").alias("count")).orderBy("size")


def largest_component(scc: DataFrame) -> DataFrame:
    """(scc_id, size) of the largest; of equals the one named by the smallest id."""
    return component_sizes(scc).orderBy(F.desc("size"), "scc_id").limit(1).select("scc_id", "size")


def members_of_largest(scc: DataFrame) -> DataFrame:
    """(id) of the largest component."""
    return scc.join(F.broadcast(largest_component(scc).select("scc_id")), "scc_id", "left_semi").select("id")  # one row


def components_by_size(scc: DataFrame) -> DataFrame:
    """(size, scc_id, id): members with their component and its size, a row each, so that no row grows with the graph."""
    return scc.join(component_sizes(scc), "scc_id").select("size", "scc_id", "id")


def shared_adjacency(edges: DataFrame, vertices: DataFrame) -> Broadcast:
    """(ids, heads, targets) of a graph whose size is checked."""
    ids = np.sort(vertices.toArrow().column(0).to_numpy())
    e = edges.toArrow()
    heads, targets = compressed(np.searchsorted(ids, e.column(0).to_numpy()), np.searchsorted(ids, e.column(1).to_numpy()), len(ids))
    return edges.sparkSession.sparkContext.broadcast((ids, heads, targets))


def fits(edges: DataFrame, vertices: DataFrame, small_edges: int) -> bool:
    return edges.limit(small_edges + 1).count() <= small_edges and vertices.limit(small_edges + 1).count() <= small_edges


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None, most: int | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(s, v, d, sigma): distance and number of shortest paths from each source.

    Parallel edges count each, self loops never lie on a shortest path.  Up to
    ``small_edges`` edges and vertices each source is one walk over a broadcast
    adjacency; beyond, a level of all sources is a round.  ``most`` bounds the
    rounds: where they do not suffice, this raises.
    """
    sources = (sources or vertices_of(edges)).select(F.col("id").cast("bigint"))
    edges = materialize(edges.where("src <> dst").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")), "bfs-edges")
    vertices = vertices_of(edges).union(sources).distinct()
    if most is None and fits(edges, vertices, small_edges):
        return _walked_paths(shared_adjacency(edges, vertices), sources)
    frontier = materialize(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")), "bfs-0")
    out, seen = frontier, frontier.select("s", "v")
    for d in itertools.count(1):
        if most is not None and d > most:
            raise RuntimeError(f"paths are longer than {most - 1} edges")
        grown = frontier.join(edges, frontier["v"] == edges["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        frontier = materialize(grown.join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "sigma"), f"bfs-{d}")
        if frontier.isEmpty():
            break
        out, seen = out.unionByName(frontier), seen.unionByName(frontier.select("s", "v"))
        if d % 50 == 0:  # plans stay short, however many levels
            out = materialize(out, f"bfs-to-{d}")
            seen = out.select("s", "v")
    return out


def walk(heads: np.ndarray, targets: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Distances (-1: not reached) and numbers of shortest paths from s, and the edges on them, level by level."""
    n, degree = len(heads) - 1, np.diff(heads)
    distance, sigma = np.full(n, -1), np.zeros(n)
    distance[s], sigma[s] = 0, 1.0
    front, steps, level = np.array([s]), [], 0
    while len(front):
        count = degree[front]
        tail = np.repeat(front, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(heads[front], count)
        head = targets[at]
        level += 1
        front = np.unique(head[distance[head] < 0])
        distance[front] = level
        on_path = distance[head] == level
        tail, head = tail[on_path], head[on_path]
        np.add.at(sigma, head, sigma[tail])
        steps.append((tail, head))
    return distance, sigma, steps


def _walked_paths(shared: Broadcast, sources: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, heads, targets = shared.value
        for batch in batches:
            for s in batch.column(0).to_numpy():
                distance, sigma, _ = walk(heads, targets, int(np.searchsorted(ids, s)))
                reached = np.flatnonzero(distance >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reached), s)), pa.array(ids[reached]), pa.array(distance[reached].astype(np.int32)), pa.array(sigma[reached])], names=["s", "v", "d", "sigma"])

    spread = sources.repartition(max(1, sources.sparkSession.sparkContext.defaultParallelism * 2), "id")
    return spread.mapInArrow(run, "s bigint, v bigint, d int, sigma double")


def brandes(heads: np.ndarray, targets: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Summed dependencies of every vertex on the sources, level by level."""
    n = len(heads) - 1
    total = np.zeros(n)
    for s in sources:
        _, sigma, steps = walk(heads, targets, s)
        delta = np.zeros(n)
        for tail, head in reversed(steps):
            np.add.at(delta, tail, sigma[tail] / sigma[head] * (1 + delta[head]))
        delta[s] = 0
        total += delta
    return total


def betweenness(edges: DataFrame, vertices: DataFrame | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(id, score): betweenness over directed shortest paths, over (n - 1)(n - 2) where there are more than two vertices."""
    spark = edges.sparkSession
    vertices = (vertices or vertices_of(edges)).select(F.col("id").cast("bigint")).distinct()
    n = vertices.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if not n:
        return vertices.withColumn("score", F.lit(0.0))
    edges = edges.where("src <> dst").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    if fits(edges, vertices, small_edges):
        shared = shared_adjacency(edges, vertices)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, h, t = shared.value
            total = np.zeros(len(names))
            for pdf in batches:
                total += brandes(h, t, pdf["id"].to_numpy())
            touched = np.flatnonzero(total)
            yield pd.DataFrame({"id": names[touched], "part": total[touched]})

        tasks = max(1, min(n // 32, spark.sparkContext.defaultParallelism * 2))
        parts = spark.range(n).repartition(tasks).mapInPandas(run, "id bigint, part double").groupBy("id").agg(F.sum("part").alias("part"))
    else:
        parts = _dependencies(edges, vertices)
    return vertices.join(parts, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("score"))


def _dependencies(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same sums by DataFrame rounds: paths forward, then dependencies back from the farthest level."""
    paths = materialize(shortest_paths(edges, vertices, small_edges=0), "paths")
    deepest = paths.agg(F.max("d")).first()[0] or 0
    delta = None
    for d in range(deepest, 0, -1):
        here = paths.where(F.col("d") == d)
        own = here.withColumn("delta", F.lit(0.0)) if delta is None else here.join(delta.select("s", "v", "delta"), ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        before = paths.where(F.col("d") == d - 1).select("s", F.col("v").alias("src"), F.col("sigma").alias("sigma_src"))
        step = own.join(edges.withColumnRenamed("dst", "v"), "v").join(before, ["s", "src"]).groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("sigma_src") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
        step = materialize(step, f"delta-{d}")
        delta = step if delta is None else delta.unionByName(step)
    if delta is None:
        return vertices.withColumn("part", F.lit(0.0))
    return delta.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("part"))


def chokepoints(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k highest scores, ties to the smaller id."""
    return scores.orderBy(F.desc("score"), "id").limit(k)
