"""Whole trees on disk, resolution cases, graphs and drawings."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry
from lodestone.operators import graph, layout, render, resolve
from lodestone.project import Project, checked
from lodestone.sources import files, gitignore
from lodestone.sources.files import NoSupportedFiles


def tree(root, contents):
    for name, text in contents.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text.encode() if isinstance(text, str) else text)


def edges_of(project):
    strip = lambda p: p.removeprefix(project.root + "/")
    return {(strip(r["src"]), strip(r["dst"])) for r in project.edges.collect()}


def pixels(data):
    """Rows of a PNG of 8-bit colours, as this package writes them."""
    import struct
    import zlib

    import numpy as np

    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, kinds, packed = 8, [], b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        kinds.append(kind)
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            assert (depth, colour) == (8, 2)
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + 3 * width)
    assert (rows[:, 0] == 0).all()
    return rows[:, 1:].reshape(height, width, 3)


def test_drawings_of_a_mixed_tree(spark, tmp_path):
    tree(tmp_path, {"engine/Loop.cc": '#include "Clock.hh"\n#include "clock.hpp"\n\n\n', "engine/clock.hpp": "#include <chrono>\n", "tools/gen.py": "import shape\n", "tools/shape.py": "", "broken.cxx": b"int \xc3\x28;"})
    p = Project.scan(spark, str(tmp_path))
    assert edges_of(p) == {("engine/Loop.cc", "engine/clock.hpp")}  # local Python imports are looked up from the root
    assert {r["name"]: (r["language"], r["loc"], r["dependencies"]) for r in p.summary().collect()} == {"Loop.cc": ("C++", 5, 1), "clock.hpp": ("C++", 2, 0), "gen.py": ("Python", 2, 0), "shape.py": ("Python", 1, 0)}
    svg, png = tmp_path / "o.svg", tmp_path / "o.png"
    assert p.export(str(svg)) and p.export(str(png))
    text = svg.read_text()
    assert text.startswith("<svg") and text.count("<line") == 1 and text.count("<title>") == 4 and ">C++<" in text and ">Python<" in text
    image = pixels(png.read_bytes())
    assert image.shape == (900, 1200, 3)
    # Four nodes stand at the ends of a cross; off their labels they have their language's colour.
    for (x, y), want in {(920, 450): (0, 89, 156), (600, 770): (0, 89, 156), (280, 450): (255, 212, 59), (600, 130): (255, 212, 59)}.items():
        assert tuple(image[y - 12, x]) == want
    assert tuple(image[610, 760]) == (173, 216, 230)  # half way along the edge from the first node to the second
    assert tuple(image[5, 5]) == (255, 255, 255)
    for bad in ("o.gif", "o"):
        with pytest.raises(ValueError):
            p.export(str(tmp_path / bad))


def test_glyphs():
    canvas = render.Canvas(40, 12)
    canvas.text(2, 5, "Aa\u00e9", centered=False)
    ink = (canvas.pixels == 0).all(2)
    for k, glyph in enumerate((render.FONT["A"], render.FONT["a"], render.BOX)):
        assert ["".join("1" if x else "0" for x in row) for row in ink[2:9, 2 + 6 * k : 7 + 6 * k]] == glyph.split()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lodestone.project import main

    tree(tmp_path / "t", {"a.py": "import b\n", "b.py": "import a\n", "c.py": "import a\n"})
    monkeypatch.chdir(tmp_path)
    assert main([str(tmp_path / "t")]) == 0
    said = capsys.readouterr().out
    assert "a.py: Python, 2 lines" in said and "1 components of 2" in said and "a.py: 0.500000" in said
    assert main([str(tmp_path / "t"), "--details", "a.py"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert [line.replace(os.path.realpath(tmp_path), "") for line in said if line.split(" ")[0] in ("incoming", "local", "outgoing")] == ["incoming (2): /t/b.py, /t/c.py", "local (1): b", "outgoing (1): /t/b.py"]
    assert main([str(tmp_path / "t"), "o.svg", "-v"]) == 0 and (tmp_path / "o.svg").exists()
    assert main([str(tmp_path / "none")]) == 1 and main([str(tmp_path / "t"), "o.gif"]) == 1


def test_python_tree(spark, tmp_path):
    tree(tmp_path, {"main.py": "import utils\nimport api.routes\nimport os\n", "utils.py": "", "api/__init__.py": "", "api/routes.py": "from ..utils import x\nfrom . import y\n"})
    p = Project.scan(spark, str(tmp_path))
    assert edges_of(p) == {("main.py", "utils.py"), ("main.py", "api/routes.py"), ("api/routes.py", "utils.py"), ("api/routes.py", "api/__init__.py")}
    local = {(r["raw"], r["path"], r["is_local"]) for r in p.imports.where(F.col("file").endswith("routes.py")).collect()}
    assert ("..utils", "utils", True) in local and ("x", "x", False) in local


def test_rust_tree(spark, tmp_path):
    tree(tmp_path, {"lib.rs": "mod utils;\nmod api;\nuse crate::api::routes;\nuse crate::foo;\n", "utils.rs": "", "api/mod.rs": "mod routes;\n", "api/routes.rs": "use super::super::utils;\nfn f() { api::routes(); }\n"})
    p = Project.scan(spark, str(tmp_path))
    assert edges_of(p) == {("lib.rs", "utils.rs"), ("lib.rs", "api/mod.rs"), ("lib.rs", "api/routes.rs"), ("api/mod.rs", "api/routes.rs"), ("api/routes.rs", "utils.rs")}


def test_typescript_tree(spark, tmp_path):
    tree(tmp_path, {"main.ts": "import './utils'; import './components'; import './components/button'; import './none'; import 'react'; import './a.service';", "utils.ts": "", "a.ts": "", "components/button.ts": "import '../utils'", "components/index.ts": ""})
    p = Project.scan(spark, str(tmp_path))
    assert edges_of(p) == {("main.ts", "utils.ts"), ("main.ts", "components/index.ts"), ("main.ts", "components/button.ts"), ("main.ts", "a.ts"), ("components/button.ts", "utils.ts")}


def test_cpp_search_order(spark):
    inventory = spark.createDataFrame([(p, True) for p in ("/r/helper.h", "/r/include/helper.h", "/r/include/other.hpp", "/r/src/x/deep.h", "/r/lib/up.h", "/r/string.h")], "path string, is_node boolean")
    wanted = [("helper.h", "/r/helper.h"), ("include/helper", "/r/include/helper.h"), ("other", "/r/include/other.hpp"), ("x/deep.h", "/r/src/x/deep.h"), ("up.h", "/r/lib/up.h"), ("../include/other.hpp", "/r/include/other.hpp"), ("string.h", None), ("no.h", None)]
    imports = spark.createDataFrame([("/r/lib/sub/main.cpp", "Cpp", n, n) for n, _ in wanted], "file string, language string, raw string, path string")
    got = {r["raw"]: r["target"] for r in resolve.resolve_imports(imports, inventory, spark.createDataFrame([], "file string"), F.lit("/r")).collect()}
    assert got == {n: t for n, t in wanted if t}


def test_ignore_rules(tmp_path, spark):
    tree(tmp_path, {".gitignore": "ignored.py\nbuild/\n!keep.py\n*.ts\n", "ignored.py": "", "a.py": "", "build/b.py": "", "c.ts": "", ".hidden.py": ""})
    names = lambda no: {os.path.basename(p) for p in files.walk(str(tmp_path), no)}
    assert names(False) == {"a.py"} and names(True) == {"ignored.py", "a.py", "b.py", "c.ts"}
    rules = gitignore.parse("/top.txt\ndoc/**/x\n**/deep\na[0-9].c\n# no\n\\!odd\n")
    hit = lambda p: gitignore.ignored(p, False, rules)
    assert hit("top.txt") and not hit("sub/top.txt") and hit("doc/a/b/x") and hit("doc/x") and hit("q/deep") and hit("z/a1.c") and hit("!odd")


def test_ignore_rules_of_a_repository(tmp_path, monkeypatch):
    """Rules above the root, of info/exclude and of the user, and which of them win."""
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home/.config"))
    made = {"home/.gitconfig": "[core]\n\texcludesFile = ~/mine\n", "home/mine": "user_*.py\n", "repo/.git/info/exclude": "local.py\nback.py\n", "repo/.gitignore": "/in/x.py\nup.py\n", "repo/in/.gitignore": "!back.py\n", "repo/in/sub/.gitignore": "deep.py\n", "repo/in/sub/.ignore": "!deep.py\nplain.py\n", ".ignore": "far.py\n"}
    kept = {"repo/in/a.py", "repo/in/back.py", "repo/in/sub/deep.py", "repo/in/sub/x.py"}
    for name in [*kept, "repo/in/x.py", "repo/in/up.py", "repo/in/local.py", "repo/in/user_1.py", "repo/in/far.py", "repo/in/sub/plain.py"]:
        made[name] = ""
    tree(tmp_path, made)
    seen = lambda root, no=False: {os.path.relpath(p, tmp_path) for p in files.walk(str(tmp_path / root), no)}
    assert seen("repo/in") == kept
    assert len(seen("repo/in", True)) == 10
    os.rename(tmp_path / "repo/.git", tmp_path / "repo/no")  # outside a repository only the root's .gitignore and .ignore files count
    assert seen("repo/in") == kept | {"repo/in/x.py", "repo/in/up.py", "repo/in/local.py", "repo/in/user_1.py"}


def test_scan_of_a_store(spark, tmp_path):
    """The scan through Spark's file systems finds what the local one finds, odd names included."""
    tree(tmp_path / "s", {".gitignore": "gone.py\n", "gone.py": "", "pkg/__init__.py": "import os\n", "pkg/_own/[id].ts": "let a = 1\n", "a b.py": "x", "bad.py": b"\xff", "__pycache__/z.py": "", "b.txt": ""})
    root = os.path.realpath(tmp_path / "s")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for no in (False, True):
        local, store = files.scan(spark, root, no), files.scan_store(spark, f"file://{root}", no)
        assert rows(store[0]) == rows(local[0]) and rows(store[1]) == rows(local[1])
        assert local[0].count() == 4 + no
    assert files.scan_store(spark, f"file://{root}", at_once=1)[0].count() == 4


def test_empty_and_bad_arguments(spark, tmp_path):
    with pytest.raises(NoSupportedFiles):
        Project.scan(spark, str(tmp_path))
    for path, out in ((str(tmp_path / "none"), None), (str(tmp_path), " "), (str(tmp_path), "a/b.svg"), (str(tmp_path), "x.gif")):
        with pytest.raises(ValueError):
            checked(path, out)
    assert checked(str(tmp_path), "x.svg") == (os.path.realpath(tmp_path), "x.svg")


GRAPHS = {
    "dag": ([(0, 1), (1, 2)], 3, {1: 3}),
    "cycle": ([(0, 1), (1, 2), (2, 0)], 3, {3: 1}),
    "two cycles": ([(0, 1), (1, 0), (2, 3), (3, 4), (4, 2)], 5, {2: 1, 3: 1}),
    "nested": ([(1, 2), (2, 1), (0, 1), (3, 0), (2, 3)], 4, {4: 1}),
    "self loop": ([(0, 0)], 1, {1: 1}),
    "complex": ([(0, 1), (1, 2), (2, 0), (3, 4), (4, 3), (5, 6), (7, 8), (8, 9), (9, 7), (2, 3), (6, 7)], 10, {3: 2, 2: 1, 1: 2}),
}


def frames(spark, edges, n):
    return spark.createDataFrame(edges, "src bigint, dst bigint"), spark.range(n)


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges, n, sizes = GRAPHS[name]
    e, v = frames(spark, edges, n)
    small = {r["id"]: r["scc_id"] for r in graph.strongly_connected(e, v).collect()}
    assert {r["size"]: r["count"] for r in graph.size_histogram(graph.strongly_connected(e, v)).collect()} == sizes
    if name in ("complex", "self loop"):
        assert {r["id"]: r["scc_id"] for r in graph.strongly_connected(e, v, small_edges=0).collect()} == small


def test_empty_graph(spark):
    e, v = frames(spark, [], 0)
    assert graph.strongly_connected(e, v).count() == 0 and graph.betweenness(e, v).count() == 0


BETWEEN = {
    "path": ([(0, 1), (1, 2)], 3, [0, 0.5, 0]),
    "star": ([(0, 1), (1, 0), (0, 2), (2, 0), (0, 3), (3, 0)], 4, [1, 0, 0, 0]),
    "bridge": ([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)], 6, [0.05, 0.2, 0.35, 0.35, 0.2, 0.05]),
}


@pytest.mark.parametrize("name", BETWEEN)
def test_betweenness(spark, name):
    edges, n, want = BETWEEN[name]
    e, v = frames(spark, edges, n)
    fast = {r["id"]: round(r["score"], 6) for r in graph.betweenness(e, v).collect()}
    assert [fast[i] for i in range(n)] == want
    if name == "bridge":
        assert {r["id"]: round(r["score"], 6) for r in graph.betweenness(e, v, small_edges=0).collect()} == fast


def test_layered_steps():
    g = layout.LayeredGraph(4, [(0, 1), (1, 2), (2, 0), (0, 3)])
    g.break_cycles()
    assert g.out == [[1, 3], [2], [], []]
    assert g.assign_layers() == [[0], [1, 3], [2]]
    h = layout.LayeredGraph(4, [(0, 2), (0, 3), (1, 2), (1, 3)])
    assert h.crossings([0, 1], [2, 3]) == 3  # shared ends count
    layers = [[0, 1], [3, 2]]
    k = layout.LayeredGraph(4, [(0, 2), (1, 3)])
    k.reduce_crossings(layers)
    assert k.crossings(*layers) == 0
    x = layout.LayeredGraph(3, [(0, 1), (1, 2), (0, 2)])
    long = [[0], [1], [2]]
    x.expand_long_edges(long)
    assert x.dummies == {3} and long == [[0], [1, 3], [2]] and x.out[0] == [1, 3] and x.out[3] == [2]


def test_single_place_goes_to_the_centre(spark):
    assert layout.fit_box(spark.createDataFrame([(0, 1.0, 2.0)], "id bigint, x double, y double")).collect()[0][1:] == (500.0, 500.0)


def test_culling_and_colours(spark):
    nodes = spark.createDataFrame([(0, 5.0, 5.0), (1, -5.0, 5.0), (2, -50.0, 5.0)], "id bigint, x double, y double")
    drawn, lines = layout.visible(nodes, spark.createDataFrame([(0, 2), (1, 2)], "src bigint, dst bigint"), 10, 10, 6)
    assert {r["id"] for r in drawn.collect()} == {0, 1} and [tuple(r) for r in lines.collect()] == [(0, 2)]
    flags = spark.createDataFrame([(True, True, True, True), (False, True, True, True), (False, False, True, True), (False, False, False, True), (False, False, False, False)], "a boolean, b boolean, c boolean, d boolean")
    color = geometry.node_color(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit("#FFD43B"))
    assert [r[0] for r in flags.select(color).collect()] == ["#ffa500", "#add8e6", "#ff6464", "#ffd43b", "#7f6a1d"]


def test_camera():
    view, screen = (0.0, 0.0, 100.0, 50.0), (200.0, 200.0)
    moved = geometry.zoom_about(view, 2.0, 25.0, 25.0)
    assert moved == (12.5, 12.5, 50.0, 25.0) and geometry.pan(view, 10, 0) == (-10.0, 0.0, 100.0, 50.0)
    assert screen


def test_empty_drawing(spark):
    placed = spark.createDataFrame([], "id bigint, file string, language string, x double, y double, r double, color string")
    lines = spark.createDataFrame([], "a bigint, b bigint, x1 double, y1 double, x2 double, y2 double")
    assert render.svg(placed, lines) is None and render.png(placed, lines) is None


def test_streaming_facts(spark, tmp_path):
    from lodestone.streaming import watch

    tree(tmp_path / "src", {"a.py": "import os\n", "b.txt": "x", "c.cpp": '#include "d.h"\n'})
    q = watch(spark, str(tmp_path / "src")).writeStream.format("memory").queryName("facts").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert {(r["kind"], r["name"]) for r in spark.table("facts").collect()} == {("import", "os"), ("import_local", "d.h")}
    finally:
        q.stop()


def test_hit_test_of_wide_circles(spark):
    nodes = spark.createDataFrame([(1, 39.0, 39.0, 56.0), (2, 500.0, 500.0, 130.0), (3, 501.0, 500.0, 1.0)], "id bigint, x double, y double, radius double")
    points = [(1, 81.0, 39.0), (2, 39.0, -2.0), (3, 94.9, 39.0), (4, 95.1, 39.0), (5, 500.0, 629.0), (6, 501.0, 500.5), (7, 408.5, 408.5)]
    got = layout.hit_test(spark.createDataFrame(points, "point bigint, x double, y double"), nodes).collect()
    assert {r["point"]: r["id"] for r in got} == {1: 1, 2: 1, 3: 1, 5: 2, 6: 2, 7: 2}


def test_shortest_paths_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(53)], "src bigint, dst bigint")
    start = spark.createDataFrame([(0,)], "id bigint")
    for small in (graph.SMALL_EDGES, 0):
        assert {r["v"]: (r["d"], r["sigma"]) for r in graph.shortest_paths(chain, start, small_edges=small).collect()} == {i: (i, 1.0) for i in range(54)}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(chain, start, most=5)


def test_layers_of_a_table_as_of_one_graph(spark):
    """The rounds over DataFrames agree with the steps of one graph."""
    import random

    rng = random.Random(5)
    n = 60
    edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(90)) if a < b})
    g = layout.LayeredGraph(n, edges)
    layers = g.assign_layers()
    xy = g.coordinates(layers)
    e, v = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.range(n)
    for small in (layout.SMALL_EDGES, 0):
        ordered = layout.order_layers(layout.assign_layers(e, v, small), e, small)
        got = {r["id"]: (r["layer"], r["ord"]) for r in ordered.collect()}
        assert got == {v: (k, j) for k, layer in enumerate(layers) for j, v in enumerate(layer)}
    placed = {r["id"]: (r["x"], r["y"]) for r in layout.coordinates(ordered, e).collect()}
    assert placed.keys() == xy.keys() and all(placed[v] == pytest.approx(xy[v]) for v in xy)


def test_layers_where_every_vertex_has_a_predecessor(spark):
    ring = spark.createDataFrame([(10, 20), (20, 30), (30, 10), (20, 20), (40, 10)], "src bigint, dst bigint")
    v = spark.createDataFrame([(10,), (20,), (30,), (40,), (50,)], "id bigint")
    for small in (layout.SMALL_EDGES, 0):
        assert {r["id"]: r["layer"] for r in layout.assign_layers(ring, v, small).collect()} == {40: 0, 50: 0, 10: 1, 20: 2, 30: 3}
        alone = layout.assign_layers(ring.where("src < 40"), v.where("id < 40"), small)
        assert {r["id"]: r["layer"] for r in alone.collect()} == {10: 0, 20: 0, 30: 0}


def test_swaps_count_what_a_recount_counts():
    import random

    rng = random.Random(7)
    for _ in range(30):
        edges = [(a, b) for a in range(6) for b in range(6, 12) if rng.random() < 0.4]
        g = layout.LayeredGraph(12, edges)
        layer, below = list(range(6)), list(range(6, 12))
        place = {v: j for j, v in enumerate(below)}
        ends = [sorted(place[w] for w in g.out[v]) for v in layer]
        for j in range(5):
            swapped = layer[:j] + [layer[j + 1], layer[j]] + layer[j + 2 :]
            change = layout.pairs_at_least(ends[j + 1], ends[j]) - layout.pairs_at_least(ends[j], ends[j + 1])
            assert g.crossings(swapped, below) - g.crossings(layer, below) == change


def test_cycles_go_whatever_root_they_hang_on():
    import random

    rng = random.Random(9)
    for _ in range(40):
        n = 8
        g = layout.LayeredGraph(n, [(rng.randrange(n), rng.randrange(n)) for _ in range(16)])
        g.break_cycles()
        left, alive = {v: set(g.out[v]) for v in range(n)}, set(range(n))
        while sinks := {v for v in alive if not left[v] & alive}:
            alive -= sinks
        assert not alive


def test_shortest_paths_both_ways(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(45)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.shortest_paths(e)) == rows(graph.shortest_paths(e, small_edges=0))


def test_large_components_of_long_cycles(spark):
    """Rings far longer than the rounds it takes, joined one way, and random graphs."""
    import random

    ring = lambda a, n: [(a + i, a + (i + 1) % n) for i in range(n)]
    rng = random.Random(2)
    for edges, n in ((ring(0, 40) + ring(40, 25) + [(3, 50), (65, 5), (60, 66)], 67), ([(rng.randrange(40), rng.randrange(40)) for _ in range(60)], 40)):
        e, v = frames(spark, edges, n)
        small, large = ({r["id"]: r["scc_id"] for r in graph.strongly_connected(e, v, small_edges=k).collect()} for k in (graph.SMALL_EDGES, 0))
        assert large == small
