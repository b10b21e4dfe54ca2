"""Drawing a graph: a table of marks, an SVG document, a PNG image.

A drawing goes to one document, so its marks come to the driver in the end; they
are placed, sized and written as text by executors.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import arrowhead, node_size
from ..functions.languages import color_of, display_name
from ..functions.paths import file_name, file_stem
from .layout import EXPORT_CIRCLE, circular
from .reports import loc_bounds

WIDTH, HEIGHT, MARGIN, LEGEND_STEP = 1200, 900, 50, 25


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace((F.round(x, 4) + 0.0).cast("string"), r"\.0$", ""), r"^-0$", "0")


def scene(nodes: DataFrame, ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed nodes, placed edges) on the export circle.  ids: (id, file); edges by file, to nodes only."""
    placed = ids.join(circular(ids, EXPORT_CIRCLE), "id").join(nodes.select("file", "loc", "language"), "file")
    placed = placed.join(F.broadcast(loc_bounds(nodes)))  # one row
    placed = placed.withColumn("r", node_size(F.col("loc"), F.col("min_loc"), F.col("max_loc"))).withColumn("color", color_of(F.col("language")))
    ends = placed.select("file", "id", "x", "y")
    lines = edges.join(ends.select(F.col("file").alias("src"), F.col("id").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1")), "src").join(ends.select(F.col("file").alias("dst"), F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
    return placed.select("id", "file", "language", "x", "y", "r", "color"), lines.select("a", "b", "x1", "y1", "x2", "y2")


def svg_marks(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """(z, ord, sub, fragment): edges below nodes and labels, the legend by language name on top."""

    def tag(text: str, **values: Column) -> Column:
        parts = text.split("@")
        return F.concat(*[F.lit(p) if k % 2 == 0 else values[p] for k, p in enumerate(parts)])

    edge = tag('<line marker-end="url(#arrowhead)" stroke="lightblue" stroke-width="2" x1="@x1@" x2="@x2@" y1="@y1@" y2="@y2@"/>', **{c: number(F.col(c)) for c in ("x1", "x2", "y1", "y2")})
    circle = tag('<circle cx="@x@" cy="@y@" fill="@color@" r="@r@" stroke="black" stroke-width="2"><title>@name@</title></circle>', x=number(F.col("x")), y=number(F.col("y")), r=number(F.col("r")), color=F.col("color"), name=escape_xml(file_name(F.col("file"))))
    label = tag('<text dominant-baseline="middle" fill="black" font-family="Arial" font-size="12" text-anchor="middle" x="@x@" y="@y@">@name@</text>', x=number(F.col("x")), y=number(F.col("y")), name=escape_xml(file_stem(F.col("file"))))
    marks = lines.select(F.lit(0).alias("z"), F.col("a").alias("ord"), F.col("b").alias("sub"), edge.alias("fragment"))
    marks = marks.unionByName(placed.select(F.lit(1).alias("z"), F.col("id").alias("ord"), F.lit(0).cast("bigint").alias("sub"), circle.alias("fragment")))
    marks = marks.unionByName(placed.select(F.lit(1).alias("z"), F.col("id").alias("ord"), F.lit(1).cast("bigint").alias("sub"), label.alias("fragment")))
    legend = placed.agg(F.array_sort(F.collect_set(F.struct(display_name(F.col("language")).alias("name"), "color"))).alias("all")).select(F.posexplode("all").alias("k", "l"))
    y = number(F.lit(MARGIN) + F.col("k") * LEGEND_STEP)
    dot = tag(f'<circle cx="{MARGIN}" cy="@y@" fill="@color@" r="6" stroke="black" stroke-width="1"/>', y=y, color=F.col("l.color"))
    name = tag(f'<text dominant-baseline="middle" font-family="Arial" font-size="12" x="{MARGIN + 15}" y="@y@">@name@</text>', y=y, name=F.col("l.name"))
    for sub, mark in enumerate((dot, name)):
        marks = marks.unionByName(legend.select(F.lit(2).alias("z"), F.col("k").cast("bigint").alias("ord"), F.lit(sub).cast("bigint").alias("sub"), mark.alias("fragment")))
    return marks


HEAD = f'<svg height="{HEIGHT}" style="background-color: white" viewBox="0 0 {WIDTH} {HEIGHT}" width="{WIDTH}" xmlns="http://www.w3.org/2000/svg">\n<marker id="arrowhead" markerHeight="7" markerWidth="10" orient="auto" refX="10" refY="3.5">\n<path d="M0,0 L10,3.5 L0,7 z" fill="lightblue"/>\n</marker>\n'


def svg(placed: DataFrame, lines: DataFrame) -> str | None:
    """The document; None for a graph without nodes."""
    rows = svg_marks(placed, lines).orderBy("z", "ord", "sub").select("fragment").collect()
    return HEAD + "\n".join(r[0] for r in rows) + "\n</svg>\n" if rows else None


# A 5 by 7 font; each glyph is 7 rows of 5 bits.
FONT = {
    "a": "00000 00000 01110 00001 01111 10001 01111", "b": "10000 10000 11110 10001 10001 10001 11110", "c": "00000 00000 01111 10000 10000 10000 01111",
    "d": "00001 00001 01111 10001 10001 10001 01111", "e": "00000 00000 01110 10001 11111 10000 01110", "f": "00110 01000 11110 01000 01000 01000 01000",
    "g": "00000 01111 10001 10001 01111 00001 01110", "h": "10000 10000 11110 10001 10001 10001 10001", "i": "00100 00000 01100 00100 00100 00100 01110",
    "j": "00010 00000 00110 00010 00010 10010 01100", "k": "10000 10010 10100 11000 10100 10010 10001", "l": "01100 00100 00100 00100 00100 00100 01110",
    "m": "00000 00000 11010 10101 10101 10101 10101", "n": "00000 00000 11110 10001 10001 10001 10001", "o": "00000 00000 01110 10001 10001 10001 01110",
    "p": "00000 11110 10001 10001 11110 10000 10000", "q": "00000 01111 10001 10001 01111 00001 00001", "r": "00000 00000 10110 11000 10000 10000 10000",
    "s": "00000 00000 01111 10000 01110 00001 11110", "t": "01000 01000 11110 01000 01000 01000 00110", "u": "00000 00000 10001 10001 10001 10011 01101",
    "v": "00000 00000 10001 10001 10001 01010 00100", "w": "00000 00000 10001 10101 10101 10101 01010", "x": "00000 00000 10001 01010 00100 01010 10001",
    "y": "00000 10001 10001 10001 01111 00001 01110", "z": "00000 00000 11111 00010 00100 01000 11111", "_": "00000 00000 00000 00000 00000 00000 11111",
    "-": "00000 00000 00000 11111 00000 00000 00000", ".": "00000 00000 00000 00000 00000 01100 01100", "+": "00000 00100 00100 11111 00100 00100 00000",
    "0": "01110 10001 10011 10101 11001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110", "2": "01110 10001 00001 00110 01000 10000 11111",
    "3": "11110 00001 00001 01110 00001 00001 11110", "4": "00010 00110 01010 10010 11111 00010 00010", "5": "11111 10000 11110 00001 00001 10001 01110",
    "6": "01110 10000 11110 10001 10001 10001 01110", "7": "11111 00001 00010 00100 01000 01000 01000", "8": "01110 10001 10001 01110 10001 10001 01110",
    "9": "01110 10001 10001 01111 00001 00001 01110",
    "A": "01110 10001 10001 11111 10001 10001 10001", "B": "11110 10001 10001 11110 10001 10001 11110", "C": "01110 10001 10000 10000 10000 10001 01110",
    "D": "11110 10001 10001 10001 10001 10001 11110", "E": "11111 10000 10000 11110 10000 10000 11111", "F": "11111 10000 10000 11110 10000 10000 10000",
    "G": "01110 10001 10000 10111 10001 10001 01110", "H": "10001 10001 10001 11111 10001 10001 10001", "I": "01110 00100 00100 00100 00100 00100 01110",
    "J": "00111 00010 00010 00010 00010 10010 01100", "K": "10001 10010 10100 11000 10100 10010 10001", "L": "10000 10000 10000 10000 10000 10000 11111",
    "M": "10001 11011 10101 10101 10001 10001 10001", "N": "10001 11001 10101 10011 10001 10001 10001", "O": "01110 10001 10001 10001 10001 10001 01110",
    "P": "11110 10001 10001 11110 10000 10000 10000", "Q": "01110 10001 10001 10001 10101 10010 01101", "R": "11110 10001 10001 11110 10100 10010 10001",
    "S": "01111 10000 10000 01110 00001 00001 11110", "T": "11111 00100 00100 00100 00100 00100 00100", "U": "10001 10001 10001 10001 10001 10001 01110",
    "V": "10001 10001 10001 10001 10001 01010 00100", "W": "10001 10001 10001 10101 10101 11011 10001", "X": "10001 10001 01010 00100 01010 10001 10001",
    "Y": "10001 10001 01010 00100 00100 00100 00100", "Z": "11111 00001 00010 00100 01000 10000 11111", " ": "00000 00000 00000 00000 00000 00000 00000",
}
#: Stands for a character that the font lacks.
BOX = "11111 10001 10001 10001 10001 10001 11111"


class Canvas:
    def __init__(self, width: int = WIDTH, height: int = HEIGHT):
        self.pixels = np.full((height, width, 3), 255, np.uint8)

    def where(self, x0: float, y0: float, x1: float, y1: float):
        h, w, _ = self.pixels.shape
        a, b, c, d = max(0, int(x0)), min(w, int(x1) + 2), max(0, int(y0)), min(h, int(y1) + 2)
        ys, xs = np.mgrid[c : max(c, d), a : max(a, b)]
        return (slice(c, max(c, d)), slice(a, max(a, b))), xs + 0.5, ys + 0.5

    def disc(self, x: float, y: float, r: float, color: tuple, rim: float = 0.0) -> None:
        box, xs, ys = self.where(x - r - rim, y - r - rim, x + r + rim, y + r + rim)
        far = np.hypot(xs - x, ys - y)
        if rim:
            self.pixels[box][far <= r + rim / 2] = 0
        self.pixels[box][far <= r - rim / 2] = color

    def line(self, x1: float, y1: float, x2: float, y2: float, color: tuple, width: float = 2.0) -> None:
        n = int(max(abs(x2 - x1), abs(y2 - y1)) * 2) + 1
        t = np.linspace(0, 1, n)
        for off in np.linspace(-width / 2, width / 2, 5):
            long = max(1e-9, np.hypot(x2 - x1, y2 - y1))
            xs = np.clip(x1 + (x2 - x1) * t - off * (y2 - y1) / long, 0, self.pixels.shape[1] - 1).astype(int)
            ys = np.clip(y1 + (y2 - y1) * t + off * (x2 - x1) / long, 0, self.pixels.shape[0] - 1).astype(int)
            self.pixels[ys, xs] = color

    def triangle(self, a: tuple, b: tuple, c: tuple, color: tuple) -> None:
        box, xs, ys = self.where(min(a[0], b[0], c[0]), min(a[1], b[1], c[1]), max(a[0], b[0], c[0]), max(a[1], b[1], c[1]))
        side = lambda p, q: (xs - p[0]) * (q[1] - p[1]) - (ys - p[1]) * (q[0] - p[0])
        s = [side(a, b), side(b, c), side(c, a)]
        self.pixels[box][((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))] = color

    def text(self, x: float, y: float, words: str, centered: bool = True) -> None:
        glyphs = [FONT.get(c, BOX) for c in words]
        left, top = int(x - (6 * len(glyphs) / 2 if centered else 0)), int(y - 3)
        for k, glyph in enumerate(glyphs):
            for row, bits in enumerate(glyph.split()):
                for col, bit in enumerate(bits):
                    px, py = left + 6 * k + col, top + row
                    if bit == "1" and 0 <= px < self.pixels.shape[1] and 0 <= py < self.pixels.shape[0]:
                        self.pixels[py, px] = 0

    def png(self) -> bytes:
        h, w, _ = self.pixels.shape
        rows = np.concatenate([np.zeros((h, 1), np.uint8), self.pixels.reshape(h, -1)], 1).tobytes()
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


LIGHT_BLUE = (173, 216, 230)


def png(placed: DataFrame, lines: DataFrame) -> bytes | None:
    """The same scene as pixels; None for a graph without nodes."""
    nodes = placed.withColumn("stem", file_stem(F.col("file"))).orderBy("id").collect()
    if not nodes:
        return None
    head = arrowhead(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    canvas = Canvas()
    for e in lines.select("*", *[c.alias(k) for k, c in head.items()]).orderBy("a", "b").collect():
        canvas.line(e["x1"], e["y1"], e["x2"], e["y2"], LIGHT_BLUE)
        if e["tip_x"] is not None:
            canvas.triangle((e["tip_x"], e["tip_y"]), (e["left_x"], e["left_y"]), (e["right_x"], e["right_y"]), LIGHT_BLUE)
    rgb = lambda c: tuple(int(c[k : k + 2], 16) for k in (1, 3, 5))
    for n in nodes:
        canvas.disc(n["x"], n["y"], n["r"], rgb(n["color"]), 2.0)
        canvas.text(n["x"], n["y"], n["stem"])
    names = {"Cpp": "C++"}
    for k, (name, color) in enumerate(sorted({(names.get(n["language"], n["language"]), n["color"]) for n in nodes})):
        canvas.disc(MARGIN, MARGIN + k * LEGEND_STEP, 6, rgb(color), 1.0)
        canvas.text(MARGIN + 15, MARGIN + k * LEGEND_STEP, name, centered=False)
    return canvas.png()
