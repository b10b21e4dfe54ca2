"""Positions of vertices: circles and layers."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .graph import SMALL_EDGES, compressed, fits, numbered


@dataclass(frozen=True)
class CircularConfig:
    radius: float = 300.0
    start_angle: float = 0.0
    center_x: float = 0.0
    center_y: float = 0.0


@dataclass(frozen=True)
class LayeredConfig:
    max_iterations: int = 50
    node_spacing: float = 120.0
    layer_spacing: float = 150.0
    scale_factor: float = 1.5


#: The circle of a drawing of 1200 by 900 with margins of 50.
EXPORT_CIRCLE = CircularConfig(min(900 - 100, 1200 - 100) * 0.4, 0.0, 600.0, 450.0)


def circular(ids: DataFrame, config: CircularConfig = CircularConfig(), n: int | None = None) -> DataFrame:
    """(id, x, y) of dense ids 0 .. n - 1, evenly on a circle."""
    n = ids.count() if n is None else n
    angle = config.start_angle + F.col("id") * (2 * math.pi / max(1, n))
    return ids.select("id", (config.center_x + config.radius * F.cos(angle)).alias("x"), (config.center_y + config.radius * F.sin(angle)).alias("y"))


def pairs_at_least(first: list[int], second: list[int]) -> int:
    """Pairs of a place in first and one in second, both sorted, that is not above it."""
    total = at = 0
    for p in first:
        while at < len(second) and second[at] <= p:
            at += 1
        total += at
    return total


class LayeredGraph:
    """The layered layout of one graph, step by step; vertices 0 .. n - 1, neighbours in id order."""

    def __init__(self, n: int, edges: list[tuple[int, int]], config: LayeredConfig = LayeredConfig()):
        self.n, self.config = n, config
        self.out: list[list[int]] = [[] for _ in range(n)]
        for a, b in sorted(edges):
            self.out[a].append(b)
        self.dummies: set[int] = set()

    def break_cycles(self) -> None:
        """Depth first from every vertex in turn; an edge to a vertex on the path goes, one of a kind at a time.

        What an earlier root reached holds no cycle any more and leads nowhere
        else, so no later root has to enter it again.
        """
        seen: set[int] = set()
        for root in range(self.n):
            if root in seen:
                continue
            seen.add(root)
            path = {root}
            work = [(root, iter(list(self.out[root])))]
            while work:
                v, rest = work[-1]
                for w in rest:
                    if w not in seen:
                        seen.add(w)
                        path.add(w)
                        work.append((w, iter(list(self.out[w]))))
                        break
                    if w in path and w in self.out[v]:
                        self.out[v].remove(w)
                else:
                    work.pop()
                    path.discard(v)

    def incoming(self) -> list[list[int]]:
        back: list[list[int]] = [[] for _ in range(len(self.out))]
        for a, targets in enumerate(self.out):
            for b in targets:
                back[b].append(a)
        return back

    def assign_layers(self) -> list[list[int]]:
        """Least distance from a vertex without predecessors (or with the fewest); unreached ones in the first layer.

        Within a layer by falling degree, then id.
        """
        back = self.incoming()
        least = min((len(b) for b in back), default=0)
        layer = {v: 0 for v in range(self.n) if len(back[v]) == least} if self.n else {}
        front = sorted(layer)
        while front:
            new = []
            for v in front:
                for w in self.out[v]:
                    if w not in layer:
                        layer[w] = layer[v] + 1
                        new.append(w)
            front = new
        for v in range(self.n):
            layer.setdefault(v, 0)
        layers: list[list[int]] = [[] for _ in range(max(layer.values(), default=-1) + 1)]
        for v in sorted(layer, key=lambda v: (-(len(self.out[v]) + len(back[v])), v)):
            layers[layer[v]].append(v)
        return layers

    def expand_long_edges(self, layers: list[list[int]]) -> None:
        """A dummy on each layer between the ends of an edge."""
        at = {v: k for k, layer in enumerate(layers) for v in layer}
        for a in range(self.n):
            for b in list(self.out[a]):
                if at[b] > at[a] + 1:
                    self.out[a].remove(b)
                    last = a
                    for k in range(at[a] + 1, at[b]):
                        dummy = len(self.out)
                        self.out.append([])
                        self.dummies.add(dummy)
                        layers[k].append(dummy)
                        self.out[last].append(dummy)
                        last = dummy
                    self.out[last].append(b)

    def crossings(self, first: list[int], second: list[int]) -> int:
        """Pairs of edges between two layers whose ends are not in the order of their starts; a shared end counts."""
        place = {v: k for k, v in enumerate(second)}
        total, seen = 0, [0] * (len(second) + 1)  # a tree of counts by place

        def at_least(p: int) -> int:
            out, k = 0, p + 1
            while k <= len(second):
                out += seen[k]
                k += k & -k
            return out

        for v in first:
            ends = [place[w] for w in self.out[v] if w in place]
            total += sum(at_least(p) for p in ends)
            for p in ends:
                k = p + 1
                while k > 0:
                    seen[k] += 1
                    k -= k & -k
        return total

    def reduce_crossings(self, layers: list[list[int]]) -> None:
        """Passes over the layers; each takes its best swap of two neighbours, until none helps.

        A swap changes only the crossings between the edges of the two.
        """
        for _ in range(self.config.max_iterations):
            better = False
            for k in range(len(layers) - 1):
                layer, best, swap = layers[k], 0, -1
                place = {v: j for j, v in enumerate(layers[k + 1])}
                ends = [sorted(place[w] for w in self.out[v] if w in place) for v in layer]
                for j in range(len(layer) - 1):
                    change = pairs_at_least(ends[j + 1], ends[j]) - pairs_at_least(ends[j], ends[j + 1])
                    if change < best:
                        best, swap = change, j
                if swap >= 0:
                    layer[swap], layer[swap + 1] = layer[swap + 1], layer[swap]
                    better = True
            if not better:
                return

    def coordinates(self, layers: list[list[int]]) -> dict[int, tuple[float, float]]:
        """Layers centred on 0, then three times half way to the mean of the neighbours."""
        c, back = self.config, self.incoming()
        height = max(0, len(layers) - 1) * c.layer_spacing
        xy = {}
        for k, layer in enumerate(layers):
            width = max(0, len(layer) - 1) * c.node_spacing
            for j, v in enumerate(layer):
                xy[v] = ((j * c.node_spacing - width / 2) * c.scale_factor, (k * c.layer_spacing - height / 2) * c.scale_factor)
        for _ in range(3):
            moved = dict(xy)
            for v, (x, y) in xy.items():
                near = [xy[w][0] for w in back[v] + self.out[v]]
                if near and v not in self.dummies:
                    moved[v] = (0.5 * x + 0.5 * sum(near) / len(near), y)
            xy = moved
        return xy

    def run(self) -> tuple[list[list[int]], dict[int, tuple[float, float]]]:
        self.break_cycles()
        layers = self.assign_layers()
        self.expand_long_edges(layers)
        self.reduce_crossings(layers)
        return layers, self.coordinates(layers)


LAYERED = "graph string, id bigint, layer int, ord int, is_dummy boolean, x double, y double"


def layered(edges: DataFrame, vertices: DataFrame, config: LayeredConfig = LayeredConfig()) -> DataFrame:
    """LAYERED rows of each graph; edges(graph, src, dst), vertices(graph, id) with any bigint ids.

    Breaking cycles and swapping neighbours go one after another by nature, so
    one graph is one task; many graphs run side by side.  A large graph without
    cycles takes ``assign_layers``, ``order_layers`` and ``coordinates``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf["kind"] == "v", "src"])
        at = {v: k for k, v in enumerate(ids)}
        e = pdf[pdf["kind"] == "e"]
        g = LayeredGraph(len(ids), [(at[a], at[b]) for a, b in zip(e["src"], e["dst"], strict=True)], config)
        layers, xy = g.run()
        name = pdf["graph"].iloc[0]
        rows = [(name, ids[v] if v < len(ids) else -1 - v, k, j, v in g.dummies, *xy[v]) for k, layer in enumerate(layers) for j, v in enumerate(layer)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LAYERED.split(", ")])

    both = edges.select("graph", F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.lit("e").alias("kind")).unionByName(vertices.select("graph", F.col("id").cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("dst"), F.lit("v").alias("kind")).distinct())
    return both.groupBy("graph").applyInPandas(run, LAYERED)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _layers_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """One graph in one task: rows (src, dst, v), v of a vertex's row its id, else -1."""
    ids = np.sort(pdf.loc[pdf["kind"] == "v", "src"].to_numpy())
    e = pdf[pdf["kind"] == "e"]
    a, b = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])
    heads, targets = compressed(a, b, len(ids))
    back, layer = np.bincount(b, minlength=len(ids)), np.full(len(ids), -1)
    front, level = np.flatnonzero(back == back.min(initial=len(pdf))), 0
    while len(front):
        layer[front] = level
        level += 1
        count = heads[front + 1] - heads[front]
        head = targets[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(heads[front], count)]
        front = np.unique(head[layer[head] < 0])
    return pd.DataFrame({"id": ids, "layer": np.maximum(layer, 0)})


def assign_layers(edges: DataFrame, vertices: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(id, layer) of one graph without cycles: the least distance from a vertex without predecessors.

    Without any such vertex those with the fewest predecessors begin; what is not
    reached is in layer 0.  Up to ``small_edges`` edges and vertices this is one
    task; beyond, a layer is a round.
    """
    vertices = vertices.select(F.col("id").cast("bigint")).distinct()
    edges = edges.where("src <> dst").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).distinct()
    if fits(edges, vertices, small_edges):
        rows = edges.withColumn("kind", F.lit("e")).unionByName(vertices.select(F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"), F.lit("v").alias("kind")))
        return rows.groupBy(F.lit(0).alias("all")).applyInPandas(_layers_of, "id bigint, layer int").select("id", "layer")
    vertices, edges = materialize(vertices, "layer-vertices"), materialize(edges, "layer-edges")
    back = vertices.join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    fewest = back.agg(F.min("n")).first()[0]
    done = front = materialize(back.where(F.col("n") == (fewest or 0)).select("id", F.lit(0).alias("layer")), "layer-0")
    for layer in itertools.count(1):
        reached = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = materialize(reached.join(done, "id", "left_anti").select("id", F.lit(layer).alias("layer")), f"layer-{layer}")
        if front.isEmpty():
            return done.unionByName(vertices.join(done, "id", "left_anti").select("id", F.lit(0).alias("layer")))
        done = done.unionByName(front)
        if layer % 50 == 0:  # plans stay short, however many layers
            done = materialize(done, f"layers-to-{layer}")


def order_layers(layers: DataFrame, edges: DataFrame, small_rows: int = SMALL_EDGES) -> DataFrame:
    """(id, layer, ord): places within a layer by falling degree, then id.

    Up to ``small_rows`` vertices a layer is sorted in one task; beyond, all are
    numbered over ranges, so that a layer may hold most of them.
    """
    ranked = layers.join(degrees(edges), "id", "left").select("id", "layer", F.coalesce(-(F.col("in_degree") + F.col("out_degree")), F.lit(0)).alias("low"))
    if layers.limit(small_rows + 1).count() <= small_rows:
        return ranked.select("id", "layer", (F.row_number().over(Window.partitionBy("layer").orderBy("low", "id")) - 1).alias("ord"))
    ranked = materialize(numbered(ranked, "layer", "low", "id", name="rank"), "layer-ranks")
    first = ranked.groupBy("layer").agg(F.min("rank").alias("first"))
    return ranked.join(first, "layer").select("id", "layer", (F.col("rank") - F.col("first")).cast("int").alias("ord"))


def coordinates(ordered: DataFrame, edges: DataFrame, config: LayeredConfig = LayeredConfig()) -> DataFrame:
    """(id, x, y) of (id, layer, ord): layers centred on 0, then three times half way to the mean of the neighbours."""
    sizes = ordered.groupBy("layer").agg(F.count("*").alias("n"))
    height = (ordered.agg(F.max("layer")).first()[0] or 0) * config.layer_spacing
    x = (F.col("ord") * config.node_spacing - (F.col("n") - 1) * config.node_spacing / 2) * config.scale_factor
    y = (F.col("layer") * config.layer_spacing - height / 2) * config.scale_factor
    xy = materialize(ordered.join(sizes, "layer").select("id", x.alias("x"), y.alias("y")), "layer-xy")
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("w")).union(edges.select("dst", "src"))
    for k in range(3):
        mean = near.join(xy.select(F.col("id").alias("w"), F.col("x").alias("near_x")), "w").groupBy("id").agg(F.avg("near_x").alias("mean"))
        xy = materialize(xy.join(mean, "id", "left").select("id", F.when(F.col("mean").isNull(), F.col("x")).otherwise(0.5 * F.col("x") + 0.5 * F.col("mean")).alias("x"), "y"), f"layer-xy-{k}")
    return xy


def crossing_counts(layers: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, crossings) between each layer and the next; layers(id, layer, ord), edges(src, dst).

    Ends are counted by place first, so pairs of edges are never made: for each
    place of a start, the edges of starts before it whose end is at or after.
    """
    ends = edges.join(layers.select(F.col("id").alias("src"), "layer", F.col("ord").alias("p")), "src").join(layers.select(F.col("id").alias("dst"), F.col("layer").alias("to"), F.col("ord").alias("q")), "dst").where("to = layer + 1").select("layer", "p", "q")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        g = LayeredGraph(0, [])
        starts = int(pdf["p"].max()) + 1
        g.out = [[] for _ in range(starts)]
        for p, q in zip(pdf["p"], pdf["q"], strict=True):
            g.out[p].append(int(q))
        return pd.DataFrame({"layer": [pdf["layer"].iloc[0]], "crossings": [g.crossings(list(range(starts)), list(range(int(pdf["q"].max()) + 1)))]})

    return ends.groupBy("layer").applyInPandas(count, "layer int, crossings bigint")


def fit_box(positions: DataFrame, size: float = 800.0, center: float = 500.0) -> DataFrame:
    """Scaled into a square around the centre by the larger extent; a single place goes to the centre."""
    box = positions.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    place = lambda v, lo, hi: F.when(extent > 0, (F.col(v) - (F.col(lo) + F.col(hi)) / 2) / extent * size + center).otherwise(F.lit(center))
    return positions.join(F.broadcast(box)).select("id", place("x", "x0", "x1").alias("x"), place("y", "y0", "y1").alias("y"))


LAYOUTS = ("circular", "layered")


def positions(ids: DataFrame, edges: DataFrame, kind: str = LAYOUTS[0]) -> DataFrame:
    """(id, x, y) of one graph of dense ids by the layout of that name; dummies are left out."""
    if kind not in LAYOUTS:
        raise ValueError(f"no such layout: {kind}")
    if kind == "circular":
        return circular(ids)
    one = F.lit("all").alias("graph")
    return layered(edges.select(one, "src", "dst"), ids.select(one, "id")).where("NOT is_dummy").select("id", "x", "y")


def hit_test(points: DataFrame, nodes: DataFrame, cell_width: float = 40.0) -> DataFrame:
    """(point, id): the smallest id whose circle holds the point.  points(point, x, y), nodes(id, x, y, radius).

    Both are put on a grid; a node of any radius meets the points of every cell
    that its circle's square touches, so the cell's width decides costs only.
    """
    cell = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / cell_width).cast("bigint")
    touched = lambda c: F.explode(F.sequence(cell(F.col(c) - 1.001 * F.col("radius")), cell(F.col(c) + 1.001 * F.col("radius"))))
    p = points.select("point", F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("i"), cell("y").alias("j"))
    n = nodes.where("radius > 0").select("id", F.col("x").alias("nx"), F.col("y").alias("ny"), "radius", touched("x").alias("i"), "y").withColumn("j", touched("y"))
    dx, dy = F.col("px") - F.col("nx"), F.col("py") - F.col("ny")
    return p.join(n, ["i", "j"]).where(F.sqrt(dx * dx + dy * dy) < F.col("radius")).groupBy("point").agg(F.min("id").alias("id"))


def visible(positions: DataFrame, edges: DataFrame, width: float, height: float, radius: Column | float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to draw: centres within the canvas and a radius; edges with either end inside."""
    from ..functions.geometry import in_canvas

    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    inside = positions.where(in_canvas(F.col("x"), F.col("y"), width, height)).select("id")
    drawn = edges.join(inside.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(inside.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left").where("a OR b").select("src", "dst")
    return positions.where(in_canvas(F.col("x"), F.col("y"), width, height, r)), drawn
