"""Every query of the engine's own operators, by name, and its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, includes, languages, paths
from ..operators import extract, graph, layout, render, reports, resolve
from ..sources import files as sources
from . import families as fam
from . import fixtures as cases

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

# The hand-off graph, the virtual tree, and what they lead to, for the oracles.
U = """WITH RECURSIVE t AS (SELECT user_id src, lead(user_id) OVER (ORDER BY ts,event_id) dst FROM events),
g AS (SELECT src,dst,count(*) n FROM t WHERE dst IS NOT NULL AND src<>dst GROUP BY ALL),
e AS (SELECT src,dst FROM (SELECT *,row_number() OVER (PARTITION BY src ORDER BY n DESC,dst) r FROM g) WHERE r<=2),
v AS (SELECT src id FROM e UNION SELECT dst FROM e)"""
SCC = U + """, r(s,t) AS (SELECT id,id FROM v UNION SELECT r.s,e.dst FROM r JOIN e ON r.t=e.src),
comp AS (SELECT a.s id, min(a.t) scc_id FROM r a JOIN r b ON a.s=b.t AND a.t=b.s GROUP BY 1)"""
BFS = U + """, w(s,v,d,sig) AS (SELECT id,id,0,1::DOUBLE FROM v UNION ALL
SELECT w.s,e.dst,w.d+1,sum(w.sig) FROM w JOIN e ON w.v=e.src WHERE w.d<40 GROUP BY 1,2,3),
sp AS (SELECT s,v,min(d) d,arg_min(sig,d) sig FROM w GROUP BY 1,2)"""
BC = BFS + """, bc AS (SELECT a.v, sum(a.sig*b.sig/p.sig) x FROM sp a JOIN sp b ON a.v=b.s JOIN sp p ON p.s=a.s AND p.v=b.v
WHERE a.s<>a.v AND b.s<>b.v AND a.s<>b.v AND p.d=a.d+b.d GROUP BY 1),
bb AS (SELECT v.id, coalesce(x,0)/((SELECT count(*)-1 FROM v)*(SELECT count(*)-2 FROM v)) score FROM v LEFT JOIN bc ON v.id=bc.v)"""
V = """WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_size AS sz, count(*) OVER () AS n FROM part),
x AS (SELECT i, i % 4 AS c, i // 4 AS m, sz, n FROM b),
y AS (SELECT i, c, m, sz, CASE WHEN m > 0 THEN 4*(m // 2)+c ELSE -1 END t1,
 CASE WHEN m % 11 = 0 AND 4*(2*m+1)+c < n THEN 4*(2*m+1)+c ELSE -1 END t2 FROM x),
p AS (SELECT *, CASE c WHEN 0 THEN '/v/py/mod'||i||'.py' WHEN 1 THEN '/v/src/mod'||i||'.rs' WHEN 2 THEN '/v/ts/mod'||i||'.ts' ELSE '/v/cpp/mod'||i||'.hpp' END AS file,
 CASE c WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 2 THEN 'TypeScript' ELSE 'Cpp' END AS language FROM y),
ed AS (SELECT DISTINCT a.file src, z.file dst FROM p a JOIN p z ON (z.i = a.t1 OR z.i = a.t2) WHERE a.i <> z.i)"""
# Lines: the head, one for each target, the function, the blank ones, and the last.
LOC = "(1 + (c=3)::INT + (t1>=0)::INT + (t2>=0)::INT + 1 + (c=0)::INT + sz + 1)"
SIZE_OF = f"(SELECT min({LOC}) FROM p), (SELECT max({LOC}) FROM p)"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def _rows(columns: str, rows: list[tuple]) -> str:
    """SQL of fixed rows, for operators that are held against given cases."""
    return f"SELECT * FROM {cases.sql_rows(columns, rows)}"


# --- Functions over given cases -------------------------------------------------------------------

PATHS = [("lib/./net/sock.hh", "lib/net/sock.hh"), (r"lib\net\sock.hh", "lib/net/sock.hh"), ("lib//net////sock.hh", "lib/net/sock.hh"), ("lib/net/", "lib/net"), ("lib/net/..", "lib"), ("lib/net/../../x", "x"), ("lib/../../x", "../x"), ("../../../x", "../../../x"), ("../a/../b", "../b"), ("/lib/../x", "/x"), ("/./x", "/x"), ("/", "/"), ("/..", "/.."), (".", "."), ("lib/..", "."), ("", "."), ("...", "..."), (r"..\x/.\y", "../x/y"), (None, None)]


@query("path_normalize", _rows("path, normal", PATHS))
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p, _ in PATHS], "path string").select("path", paths.normalize_path(F.col("path")).alias("normal"))


# Name, standard header, outside library.
INCLUDES = [("deque", True, False), ("chrono", True, False), ("memory.hxx", True, False), ("map.h.hpp", False, False), ("ctime.h.h", True, False), ("Regex", False, False), ("mapper", False, False), ("cuda/kernel.cuh", False, True), ("CURL/easy.h", False, True), ("curl_easy.h", False, True), ("curly.h", False, False), ("pthread", False, True), ("own/arpa/inet.h", False, True), ("my_sys/x.h", False, True), ("linux/types.h", False, True), ("bzip2.h", False, True), ("intrin.h", False, True), ("qtree.h", False, False), ("sdlx/a.h", False, False), ("fcntl.h", False, True), ("engine/render.hpp", False, False), ("", False, False)]


@query("include_filter", _rows("name, is_standard, is_library, is_filtered", [(n, s, e, s or e) for n, s, e in INCLUDES]))
def include_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return spark.createDataFrame([(n,) for n, _, _ in INCLUDES], "name string").select("name", includes.is_standard_header(name).alias("is_standard"), includes.is_external_library(name).alias("is_library"), includes.is_filtered_include(name).alias("is_filtered"))


ARROW = """WITH l AS (SELECT n_nationkey id, 10*n_nationkey x, 3*n_nationkey+1 y, atan2(3*n_nationkey+1, 10*n_nationkey) a FROM nation),
t AS (SELECT *, x - 20*cos(a) tx, y - 20*sin(a) ty FROM l)
SELECT id, round(tx, 6) AS tip_x, round(ty, 6) AS tip_y, round(tx - 10*cos(a+0.5), 6) AS left_x, round(ty - 10*sin(a+0.5), 6) AS left_y, round(tx - 10*cos(a-0.5), 6) AS right_x, round(ty - 10*sin(a-0.5), 6) AS right_y FROM t"""


@query("arrow_geometry", ARROW)
def arrow_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    head = geometry.arrowhead(F.lit(0.0), F.lit(0.0), 10.0 * n, 3.0 * n + 1)
    return fam.table(spark, sf_dir, "nation").select(n.alias("id"), *[F.round(v, 6).alias(c) for c, v in head.items()])


COLORS = [("Python", "Python", "#FFD43B", 255, 212, 59, "black"), ("Rust", "Rust", "#DEA584", 222, 165, 132, "black"), ("TypeScript", "TypeScript", "#007ACC", 0, 122, 204, "white"), ("Cpp", "C++", "#00599C", 0, 89, 156, "white")]


@query("language_colors", _rows("language, display, color, r, g, b, label", COLORS))
def language_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = languages.rgb_of(F.col("color"))
    return languages.dimension(spark).select("language", "display", "color").distinct().select("*", *[rgb[k].alias(c) for k, c in enumerate("rgb")], languages.label_color(F.col("color")).alias("label"))


# --- The virtual source tree ----------------------------------------------------------------------


@query("lang_detect", V + " SELECT file, language FROM p")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.part_files(spark, sf_dir).select(F.col("path").alias("file"), languages.language_of(F.col("path")).alias("language"))


@query("project_languages", "SELECT * FROM (VALUES ('Python'),('Rust'),('TypeScript'),('Cpp')) AS t(language)")
def project_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import project_languages as found

    return found(fam.part_files(spark, sf_dir))


@query("loc_count", V + f" SELECT file, {LOC}::INT AS loc FROM p")
def loc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.part_files(spark, sf_dir).select(F.col("path").alias("file"), paths.line_count(F.col("content")).alias("loc"))


IMPORTS = V + """, im AS (SELECT file, CASE c WHEN 0 THEN 'os' WHEN 1 THEN 'std::fs' WHEN 2 THEN 'react' ELSE 'vector' END AS path, FALSE AS is_local FROM p
UNION ALL SELECT file, 'string.h', TRUE FROM p WHERE c = 3
UNION ALL SELECT file, 'f', FALSE FROM p WHERE c = 0 AND (t1 >= 0 OR t2 >= 0)
UNION ALL SELECT file, CASE c WHEN 0 THEN 'py.mod'||t WHEN 1 THEN 'crate::mod'||t WHEN 2 THEN './mod'||t ELSE 'mod'||t||'.hpp' END, TRUE FROM (SELECT file, c, t1 t FROM p WHERE t1 >= 0 UNION SELECT file, c, t2 FROM p WHERE t2 >= 0))"""


@query("import_extract", IMPORTS + " SELECT file, path, is_local FROM im")
def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.part_project(spark, sf_dir).imports.select("file", "path", "is_local")


@query("symbol_extract", V + " SELECT file, 'function' AS kind, 'f_'||i AS name FROM p")
def symbol_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_facts(fam.part_files(spark, sf_dir)).where("kind IN ('function', 'container')").select("file", "kind", "name")


@query("module_map", V + " SELECT file, 'crate::mod'||i AS module FROM p WHERE c = 1")
def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fam.part_files(spark, sf_dir).where(F.col("path").endswith(".rs")).select(F.col("path").alias("file"))
    return resolve.module_map(files, F.lit("/v"))


def _resolved(language: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = fam.part_project(spark, sf_dir)
        rust = p.nodes.where("language = 'Rust'").select("file")
        found = resolve.resolve_imports(p.imports.where((F.col("language") == language) & F.col("is_local")), p.inventory, rust, F.lit("/v"))
        return found.where("file <> target").select("file", "target").distinct()

    return run


for _name, _language in (("resolve_python", "Python"), ("resolve_rust", "Rust"), ("resolve_typescript", "TypeScript"), ("resolve_cpp", "Cpp")):
    query(_name, V + f" SELECT ed.src AS file, ed.dst AS target FROM ed JOIN p ON p.file = ed.src WHERE p.language = '{_language}'")(_resolved(_language))


@query("dependency_edges", V + " SELECT src, dst FROM ed")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.part_project(spark, sf_dir).edges


@query("node_summary", IMPORTS + f""" SELECT p.file, regexp_extract(p.file, '([^/]*)$', 1) AS name, CASE language WHEN 'Cpp' THEN 'C++' ELSE language END AS language, {LOC}::INT AS loc, 1::BIGINT AS functions, 0::BIGINT AS containers,
 (SELECT count(*) FROM im WHERE im.file = p.file) AS imports, (SELECT count(*) FROM ed WHERE ed.src = p.file) AS dependencies FROM p""")
def node_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.part_project(spark, sf_dir).summary()


@query("incoming_deps", V + " SELECT dst AS file, count(*) AS n_incoming, string_agg(src, ',' ORDER BY src) AS sources FROM ed GROUP BY 1")
def incoming_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fam.part_project(spark, sf_dir)
    return reports.incoming(p.edges, p.nodes).withColumn("sources", F.array_join("sources", ","))


@query("outgoing_deps", V + " SELECT src AS file, count(*) AS n_outgoing, string_agg(dst, ',' ORDER BY dst) AS targets FROM ed GROUP BY 1")
def outgoing_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fam.part_project(spark, sf_dir)
    return reports.outgoing(p.edges, p.nodes).withColumn("targets", F.array_join("targets", ","))


@query("import_partition", IMPORTS + " SELECT file, count(*) FILTER (is_local) AS n_local, count(*) FILTER (NOT is_local) AS n_external FROM im GROUP BY 1")
def import_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.import_partition(fam.part_project(spark, sf_dir).nodes)


@query("files_by_language", V + " SELECT language, count(*) AS files, min(file) AS first FROM p GROUP BY 1")
def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.files_by_language(fam.part_project(spark, sf_dir).nodes)


@query("loc_bounds", V + f" SELECT min({LOC})::INT AS min_loc, max({LOC})::INT AS max_loc FROM p")
def loc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.loc_bounds(fam.part_files(spark, sf_dir).select(paths.line_count(F.col("content")).alias("loc")))


@query("node_size_scored", "SELECT n_nationkey AS id, round((20 + n_nationkey / 24.0 * 20) * (1 + 0.4 * n_regionkey / 4.0), 6) AS size FROM nation")
def node_size_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = geometry.node_size(F.col("n_nationkey"), F.lit(0), F.lit(24), score=F.col("n_regionkey") / 4)
    return fam.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.round(size, 6).alias("size"))


COLORED = V + """, z AS (SELECT *, i % 11 = 0 AS sel, i % 7 = 0 AS hov, i % 5 = 0 AS cyc, i % 3 = 0 AS gone FROM p)
SELECT file, gone AS is_external, CASE WHEN sel THEN '#ffa500' WHEN hov THEN '#add8e6' WHEN cyc THEN '#ff6464'
 WHEN gone THEN CASE c WHEN 0 THEN '#ffd43b' WHEN 1 THEN '#dea584' WHEN 2 THEN '#007acc' ELSE '#00599c' END
 ELSE CASE c WHEN 0 THEN '#7f6a1d' WHEN 1 THEN '#6f5242' WHEN 2 THEN '#003d66' ELSE '#002c4e' END END AS color FROM z"""


@query("node_colors", COLORED)
def node_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of nodes that are selected, hovered, in the largest cycle, missing on disk, or none of these."""
    i = F.regexp_extract("file", r"mod(\d+)", 1).cast("bigint")
    nodes = fam.part_files(spark, sf_dir).select(F.col("path").alias("file"))
    there = nodes.where(i % 3 != 0).select(F.col("file").alias("path"))
    missing = reports.external_nodes(nodes, there).select("file", F.lit(True).alias("is_external"))
    rows = nodes.join(missing, "file", "left").select("file", F.coalesce("is_external", F.lit(False)).alias("is_external"))
    return rows.select("file", "is_external", geometry.node_color(i % 11 == 0, i % 7 == 0, i % 5 == 0, F.col("is_external"), languages.color_of(languages.language_of(F.col("file")))).alias("color"))


@query("details_panel", IMPORTS + """ SELECT src AS file, 'outgoing' AS section, dst AS item FROM ed UNION ALL SELECT dst, 'incoming', src FROM ed
UNION ALL SELECT file, CASE WHEN is_local THEN 'local' ELSE 'external' END, path FROM im UNION ALL SELECT file, 'functions', 'f_'||i FROM p""")
def details_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fam.part_project(spark, sf_dir)
    return reports.details(p.nodes, p.edges)


@query("node_size", V + f", z AS (SELECT file, {LOC} loc, (SELECT min({LOC}) FROM p) lo, (SELECT max({LOC}) FROM p) hi FROM p) SELECT file, round(CASE WHEN hi = lo THEN 30 ELSE 20 + (loc - lo)::DOUBLE / (hi - lo) * 20 END, 6) AS size FROM z")
def node_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fam.part_files(spark, sf_dir).select(F.col("path").alias("file"), paths.line_count(F.col("content")).alias("loc"))
    sized = nodes.join(F.broadcast(reports.loc_bounds(nodes)))  # one row
    return sized.select("file", F.round(geometry.node_size(F.col("loc"), F.col("min_loc"), F.col("max_loc")), 6).alias("size"))


@query("tree_scc_histogram", V + """, two AS (SELECT count(*) k FROM ed a JOIN ed b ON a.src = b.dst AND a.dst = b.src),
n2 AS (SELECT k // 2 AS pairs, (SELECT count(*) FROM (SELECT src FROM ed UNION SELECT dst FROM ed)) AS nodes FROM two)
SELECT 1::BIGINT AS size, nodes - 2*pairs AS count FROM n2 UNION ALL SELECT 2, pairs FROM n2""")
def tree_scc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = fam.part_project(spark, sf_dir).indexed()
    return graph.size_histogram(graph.strongly_connected(edges))


@query("svg_marks", V + " SELECT z, count(*) AS marks FROM (SELECT 0 AS z FROM ed UNION ALL SELECT 1 FROM p UNION ALL SELECT 1 FROM p UNION ALL SELECT 2 FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8))) GROUP BY z")
def svg_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.svg_marks(*fam.part_project(spark, sf_dir).scene()).where(F.length("fragment") > 0).groupBy("z").agg(F.count("*").alias("marks"))


PLACED = V + f""", z AS (SELECT *, {LOC} AS loc, 2*pi()*(row_number() OVER (ORDER BY file) - 1)/(count(*) OVER ()) AS a, min({LOC}) OVER () AS lo, max({LOC}) OVER () AS hi FROM p),
pl AS (SELECT *, round(600+320*cos(a), 4) AS x, round(450+320*sin(a), 4) AS y FROM z)"""


def _number(name: str) -> Column:
    return F.regexp_extract("fragment", rf' {name}="([^"]*)"', 1).cast("double")


@query("svg_nodes", PLACED + """ SELECT regexp_extract(file, '([^/]*)$', 1) AS name, regexp_extract(file, '([^/.]*)[.][a-z]*$', 1) AS label, x, y, round(CASE WHEN hi = lo THEN 30 ELSE 20 + (loc - lo)::DOUBLE / (hi - lo) * 20 END, 4) AS r,
 CASE c WHEN 0 THEN '#FFD43B' WHEN 1 THEN '#DEA584' WHEN 2 THEN '#007ACC' ELSE '#00599C' END AS fill FROM pl""")
def svg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's circle and label as they stand in the drawing's text."""
    marks = fam.materialize(render.svg_marks(*fam.part_project(spark, sf_dir).scene()), "marks")
    own = lambda tag: marks.where((F.col("z") == 1) & F.col("fragment").startswith(tag))
    labels = own("<text").select("ord", F.regexp_extract("fragment", ">([^<]*)<", 1).alias("label"))
    circles = own("<circle").select("ord", F.regexp_extract("fragment", "<title>([^<]*)<", 1).alias("name"), _number("cx").alias("x"), _number("cy").alias("y"), _number("r").alias("r"), F.regexp_extract("fragment", 'fill="([^"]*)"', 1).alias("fill"))
    return circles.join(labels, "ord").drop("ord")


@query("svg_lines", PLACED + " SELECT s.x AS x1, s.y AS y1, d.x AS x2, d.y AS y2 FROM ed JOIN pl s ON s.file = ed.src JOIN pl d ON d.file = ed.dst")
def svg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = render.svg_marks(*fam.part_project(spark, sf_dir).scene()).where("z = 0")
    return marks.select(*[_number(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


LEGEND = [("Python", "#FFD43B"), ("C++", "#00599C"), ("Rust", "#DEA584"), ("TypeScript", "#007ACC")]


@query("svg_legend", _rows("ord, fragment", [(k, text) for k, (name, color) in enumerate(sorted(LEGEND)) for text in (f'<circle cx="50" cy="{50 + 25 * k}" fill="{color}" r="6" stroke="black" stroke-width="1"/>', f'<text dominant-baseline="middle" font-family="Arial" font-size="12" x="65" y="{50 + 25 * k}">{name}</text>')]))
def svg_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.svg_marks(*fam.part_project(spark, sf_dir).scene()).where("z = 2").select("ord", "fragment")


# --- Sources and trees written out by hand --------------------------------------------------------


@query("extract_cases", cases.sql_numbered("file, kind, name", [(f"/f§/{tail}", kind, name) for tail, _, facts in cases.SOURCES.values() for kind, name in facts]))
def extract_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.files_of(cases.suppliers(spark, sf_dir), "/f", {tail: text for tail, text, _ in cases.SOURCES.values()})
    return extract.extract_facts(files).select("file", "kind", "name")


@query("macro_includes", cases.sql_numbered("kind, name", cases.MACRO_FACTS))
def macro_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.files_of(cases.suppliers(spark, sf_dir), "/f", {"m.cpp": cases.MACRO_SOURCE})
    return extract.extract_facts(files, macro_includes=True).where("kind LIKE 'import%'").select("kind", "name")


@query("import_cases", cases.sql_numbered("file, path, is_local", [("/f§/pkg/a.py", p, local) for p, local in cases.NEIGHBOUR_IMPORTS]))
def import_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which Python imports are local, as their neighbours tell, and what is left of leading dots."""
    files = cases.files_of(cases.suppliers(spark, sf_dir), "/f", cases.NEIGHBOURS)
    return extract.imports_of(extract.extract_facts(files), files.select("path")).select("file", "path", "is_local").distinct()


@query("resolve_cases", cases.sql_numbered("src, dst", [(f"/t§/{a}", f"/t§/{b}") for a, b in cases.EDGES]))
def resolve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of a tree in four languages, one for each supplier, each with a root of its own."""
    rows = cases.suppliers(spark, sf_dir)
    files = fam.materialize(cases.files_of(rows, "/t", cases.TREE), "tree-files")
    inventory = files.select("path", "is_node").unionByName(cases.files_of(rows, "/t", cases.NOT_NODES, False).select("path", "is_node"))
    facts = fam.materialize(extract.extract_facts(files), "tree-facts")
    nodes = files.select(F.col("path").alias("file"), languages.language_of(F.col("path")).alias("language"))
    return resolve.dependency_edges(facts, extract.imports_of(facts, inventory), inventory, nodes, F.regexp_extract("file", r"^(/t\d+)/", 1))


@query("scan_tree", _rows("file, language, loc", [(name, {"py": "Python", "rs": "Rust", "ts": "TypeScript"}[name.rpartition(".")[2]], data.count(b"\n") + 1) for name, (data, is_node) in cases.RULED.items() if is_node]))
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with ignore rules, hidden files and broken bytes, scanned where Spark can read it."""
    return _scanned(spark, no_gitignore=False)


@query("scan_tree_all", _rows("file, language, loc", [(name, lang, data.count(b"\n") + 1) for name, (data, _) in cases.RULED.items() for lang in [{"py": "Python", "rs": "Rust", "ts": "TypeScript"}.get(name.rpartition(".")[2])] if lang and not name.startswith(".")]))
def scan_tree_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder without its ignore rules."""
    return _scanned(spark, no_gitignore=True)


def _scanned(spark: SparkSession, no_gitignore: bool) -> DataFrame:
    root = fam.write_files(spark, {name: data for name, (data, _) in cases.RULED.items()})
    files, _ = sources.scan_store(spark, root, no_gitignore)
    path = F.col("path")
    return files.select(F.substring(path, F.length("root") + 2, F.length(path)).alias("file"), languages.language_of(path).alias("language"), paths.line_count(F.col("content")).alias("loc"))


# --- The hand-off graph ---------------------------------------------------------------------------


@query("handoff_edges", U + " SELECT src, dst FROM e")
def handoff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.handoff_edges(spark, sf_dir)


@query("transpose", U + " SELECT dst AS src, src AS dst FROM e")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transpose(fam.handoff_edges(spark, sf_dir))


@query("degrees", U + " SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM v")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.degrees(fam.handoff_edges(spark, sf_dir))


def _scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strongly_connected(fam.materialize(fam.handoff_edges(spark, sf_dir), "handoff"))


@query("scc_assign", SCC + " SELECT id, scc_id FROM comp")
def scc_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scc(spark, sf_dir)


@query("scc_histogram", SCC + " SELECT size, count(*) AS count FROM (SELECT count(*) size FROM comp GROUP BY scc_id) GROUP BY 1")
def scc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.size_histogram(_scc(spark, sf_dir))


@query("largest_scc", SCC + " SELECT scc_id, count(*) AS size FROM comp GROUP BY 1 ORDER BY size DESC, scc_id LIMIT 1")
def largest_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(_scc(spark, sf_dir))


@query("sccs_by_size", SCC + " SELECT count(*) OVER (PARTITION BY scc_id) AS size, scc_id, id FROM comp")
def sccs_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components_by_size(_scc(spark, sf_dir))


@query("largest_members", SCC + " SELECT id FROM comp WHERE scc_id = (SELECT scc_id FROM comp GROUP BY 1 ORDER BY count(*) DESC, scc_id LIMIT 1)")
def largest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.members_of_largest(_scc(spark, sf_dir))


@query("scc_stats", SCC + " SELECT (SELECT count(DISTINCT scc_id) FROM comp) AS sccs, (SELECT count(*) FROM v) AS nodes")
def scc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scc(spark, sf_dir).agg(F.count_distinct("scc_id").alias("sccs"), F.count("*").alias("nodes"))


@query("bfs_sigma", BFS + ", s5 AS (SELECT id FROM v ORDER BY id LIMIT 5) SELECT s, v, d::INT AS d, sig AS sigma FROM sp WHERE s IN (SELECT id FROM s5)")
def bfs_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from the five smallest ids: single sources are what the operator is for."""
    edges = fam.materialize(fam.handoff_edges(spark, sf_dir), "handoff")
    return graph.shortest_paths(edges, graph.vertices_of(edges).orderBy("id").limit(5))


CHAIN = "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)"


@query("bfs_chain", CHAIN + " SELECT 0::BIGINT AS s, i AS v, i::INT AS d, 2.0**least(i, 50) AS sigma FROM p")
def bfs_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances along one path through all parts, as long as the table; its first fifty steps are doubled."""
    i = F.col("id")
    ids = graph.dense_ids(fam.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    edges = ids.where(i > 0).select((i - 1).alias("src"), i.alias("dst"))
    return graph.shortest_paths(edges.unionByName(edges.where("dst <= 50")), spark.range(1))


@query("bfs_sigma_all", BFS + " SELECT s, v, d::INT AS d, sig AS sigma FROM sp")
def bfs_sigma_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from every id."""
    return graph.shortest_paths(fam.materialize(fam.handoff_edges(spark, sf_dir), "handoff"))


@query("betweenness", BC + " SELECT id, round(score, 6) AS score FROM bb")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.betweenness(fam.materialize(fam.handoff_edges(spark, sf_dir), "handoff")).select("id", F.round("score", 6).alias("score"))


@query("chokepoints_topk", BC + " SELECT id, round(score, 6) AS score FROM bb ORDER BY round(score, 9) DESC, id LIMIT 5")
def chokepoints_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = graph.betweenness(fam.materialize(fam.handoff_edges(spark, sf_dir), "handoff")).withColumn("score", F.round("score", 9))
    return graph.chokepoints(scores).select("id", F.round("score", 6).alias("score"))


@query("score_lookup", BC + SCC[len(U):] + ", sz AS (SELECT scc_id, count(*) size FROM comp GROUP BY 1) SELECT v.id, round(score, 6) AS score, sz.size AS scc_size, sz.size > 1 AS is_cycle FROM v JOIN bb ON bb.id = v.id JOIN comp ON comp.id = v.id JOIN sz ON sz.scc_id = comp.scc_id")
def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fam.materialize(fam.handoff_edges(spark, sf_dir), "handoff")
    scc = graph.strongly_connected(edges)
    sizes = scc.join(graph.component_sizes(scc), "scc_id").select("id", F.col("size").alias("scc_size"), "is_cycle")
    return graph.betweenness(edges).select("id", F.round("score", 6).alias("score")).join(sizes, "id", "left")


# --- Layouts --------------------------------------------------------------------------------------

CIRCLE = U + ", q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM v)"


def _circle(spark: SparkSession, sf_dir: str, config: layout.CircularConfig = layout.CircularConfig()) -> DataFrame:
    names = graph.vertices_of(fam.handoff_edges(spark, sf_dir)).withColumnRenamed("id", "name")
    ids = graph.dense_ids(names, "name")
    return layout.circular(ids, config).join(ids, "id").select(F.col("name").alias("id"), "x", "y")


@query("circular_layout", CIRCLE + " SELECT id, round(300*cos(2*pi()*k/n), 6) + 0 AS x, round(300*sin(2*pi()*k/n), 6) + 0 AS y FROM q")
def circular_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _circle(spark, sf_dir).select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query("export_circle", CIRCLE + " SELECT id, round(600+320*cos(2*pi()*k/n), 6) AS x, round(450+320*sin(2*pi()*k/n), 6) AS y FROM q")
def export_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _circle(spark, sf_dir, layout.EXPORT_CIRCLE).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("screen_positions", CIRCLE + " SELECT id, round((300*cos(2*pi()*k/n) - 50)*0.5 + 400, 6) AS x, round((300*sin(2*pi()*k/n) - 25)*0.5 + 300, 6) AS y FROM q")
def screen_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circle through a camera that sees 1600 by 900 around (50, 25), on a screen of 800 by 600."""
    x, y = geometry.world_to_screen(F.col("x"), F.col("y"), (-750.0, -425.0, 1600.0, 900.0), (800.0, 600.0))
    return _circle(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("visible_edges", CIRCLE + ", c AS (SELECT id, 300*cos(2*pi()*k/n) x, 300*sin(2*pi()*k/n) y FROM q), i AS (SELECT id FROM c WHERE x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 300) SELECT src, dst FROM e WHERE src IN (SELECT id FROM i) OR dst IN (SELECT id FROM i)")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visible(_circle(spark, sf_dir), fam.handoff_edges(spark, sf_dir), 200.0, 300.0)[1]


@query("fit_box", CIRCLE + ", c AS (SELECT id, 300*cos(2*pi()*k/n) x, 300*sin(2*pi()*k/n) y FROM q), b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM c) SELECT id, round((x-(x0+x1)/2)/greatest(x1-x0,y1-y0)*800+500, 6) AS x, round((y-(y0+y1)/2)/greatest(x1-x0,y1-y0)*800+500, 6) AS y FROM c, b")
def fit_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fit_box(_circle(spark, sf_dir)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


TREE = V + """, te AS (SELECT i src, t1 dst FROM y WHERE t1 >= 0 AND t1 <> i), tv AS (SELECT i id FROM y),
ly(id, l) AS (SELECT id, 0 FROM tv WHERE id NOT IN (SELECT dst FROM te) UNION SELECT te.dst, ly.l+1 FROM ly JOIN te ON te.src = ly.id),
lay AS (SELECT id, min(l) layer FROM ly GROUP BY 1),
deg AS (SELECT id, (SELECT count(*) FROM te WHERE src=id) + (SELECT count(*) FROM te WHERE dst=id) g FROM tv),
od AS (SELECT lay.id, layer, row_number() OVER (PARTITION BY layer ORDER BY g DESC, lay.id) - 1 AS ord, count(*) OVER (PARTITION BY layer) AS w FROM lay JOIN deg ON deg.id = lay.id)"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = fam.part_tree(spark, sf_dir)
    return layout.order_layers(fam.materialize(layout.assign_layers(edges, vertices), "layers"), edges)


@query("layer_assign", TREE + " SELECT id, layer::INT AS layer FROM lay")
def layer_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("id", "layer")


@query("layer_order", TREE + " SELECT id, layer::INT AS layer, ord::INT AS ord FROM od")
def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("id", "layer", "ord")


@query("crossing_count", TREE + ", ends AS (SELECT a.layer, a.ord p, b.ord q FROM te JOIN od a ON a.id = te.src JOIN od b ON b.id = te.dst WHERE b.layer = a.layer + 1) SELECT layer::INT AS layer, (SELECT count(*) FROM ends f JOIN ends h ON h.layer = f.layer AND f.p < h.p AND f.q >= h.q WHERE f.layer = z.layer) AS crossings FROM (SELECT DISTINCT layer FROM ends) z")
def crossing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.crossing_counts(_layers(spark, sf_dir), fam.part_tree(spark, sf_dir)[0])


STEP = "SELECT a.id, CASE WHEN count(b.x) > 0 THEN 0.5*any_value(a.x) + 0.5*avg(b.x) ELSE any_value(a.x) END x, any_value(a.y) y FROM {0} a LEFT JOIN near ON near.id = a.id LEFT JOIN {0} b ON b.id = near.w GROUP BY a.id"
COORDS = (
    TREE
    + """, c0 AS (SELECT id, (ord*120.0 - (w-1)*60.0)*1.5 x, (layer*150.0 - (SELECT max(layer) FROM lay)*75.0)*1.5 y FROM od),
near AS (SELECT src id, dst w FROM te UNION ALL SELECT dst, src FROM te), """
    + f"c1 AS ({STEP.format('c0')}), c2 AS ({STEP.format('c1')}), c3 AS ({STEP.format('c2')}) SELECT id, round(x, 3)::DOUBLE AS x, round(y, 3)::DOUBLE AS y FROM c3"
)


@query("layer_coords", COORDS)
def layer_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fam.materialize(fam.part_tree(spark, sf_dir)[0], "tree")
    placed = layout.coordinates(fam.materialize(_layers(spark, sf_dir), "layers"), edges)
    return placed.select("id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


# Graph, vertices, edges, and each vertex's layer, place, x and y.
LAYERED_CASES = [
    ("cycle", 4, [(0, 1), (1, 2), (2, 0), (0, 3)], [(0, 0, 0, -2.8125, -225.0), (1, 1, 0, -28.125, 0.0), (3, 1, 1, 11.25, 0.0), (2, 2, 0, -39.375, 225.0)]),
    ("crossing", 4, [(0, 3), (1, 2)], [(1, 0, 0, -90.0, -112.5), (0, 0, 1, 90.0, -112.5), (2, 1, 0, -90.0, 112.5), (3, 1, 1, 90.0, 112.5)]),
    ("self loop", 3, [(0, 0), (1, 2)], [(1, 0, 0, -45.0, -112.5), (0, 0, 1, 90.0, -112.5), (2, 1, 0, -45.0, 112.5)]),
]


@query("sugiyama_cases", "SELECT graph || n_nationkey AS graph, 10*n_nationkey + id AS id, layer, ord, FALSE AS is_dummy, x::DOUBLE AS x, y::DOUBLE AS y FROM nation, " + cases.sql_rows("graph, id, layer, ord, x, y", [(g, *r) for g, _, _, rows in LAYERED_CASES for r in rows]))
def sugiyama_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles broken, layers, swaps and places of small graphs, one of each for every nation; ids do not begin at 0."""
    n = F.col("n_nationkey")
    nations = fam.table(spark, sf_dir, "nation").select("n_nationkey")
    e = nations.select(F.explode(F.array(*[F.struct(F.concat(F.lit(g), n.cast("string")).alias("graph"), (10 * n + a).alias("src"), (10 * n + b).alias("dst")) for g, _, edges, _ in LAYERED_CASES for a, b in edges])).alias("e")).select("e.*")
    v = nations.select(F.explode(F.array(*[F.struct(F.concat(F.lit(g), n.cast("string")).alias("graph"), (10 * n + k).alias("id")) for g, size, _, _ in LAYERED_CASES for k in range(size)])).alias("v")).select("v.*")
    return layout.layered(e, v)


@query("layout_factory", CIRCLE + " SELECT 'circular' AS kind, k AS id, round(300*cos(2*pi()*k/n), 6) + 0 AS x, round(300*sin(2*pi()*k/n), 6) + 0 AS y FROM q UNION ALL SELECT 'layered', id, x, y FROM (VALUES (0, 0.0, -112.5), (1, 0.0, 112.5)) AS t(id, x, y)")
def layout_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default layout of the hand-off graph, and the other one of a single edge."""
    ids = graph.dense_ids(graph.vertices_of(fam.handoff_edges(spark, sf_dir)).withColumnRenamed("id", "name"), "name")
    pair, edge = spark.range(2), spark.range(1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    named = [layout.positions(i, e, kind).select(F.lit(kind).alias("kind"), "id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y")) for i, e, kind in ((ids, edge, layout.LAYOUTS[0]), (pair, edge, "layered"))]
    return named[0].unionByName(named[1])


@query("sugiyama_coords")
def sugiyama_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole layered layout of the hand-off graph; its steps go one after another, small graphs and tests hold them."""
    edges = fam.handoff_edges(spark, sf_dir)
    out = layout.layered(edges.withColumn("graph", F.lit("handoff")), graph.vertices_of(edges).withColumn("graph", F.lit("handoff")))
    return out.select("id", "layer", "ord", "is_dummy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("hit_test", CIRCLE + ", c AS (SELECT id, 300*cos(2*pi()*k/n) x, 300*sin(2*pi()*k/n) y FROM q), pt AS (SELECT n_nationkey point, 300*cos(n_nationkey*0.25) px, 300*sin(n_nationkey*0.25) py FROM nation) SELECT point, min(id) AS id FROM pt JOIN c ON sqrt((px-x)*(px-x)+(py-y)*(py-y)) < 30 GROUP BY 1")
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    points = fam.table(spark, sf_dir, "nation").select(n.alias("point"), (300 * F.cos(n * 0.25)).alias("x"), (300 * F.sin(n * 0.25)).alias("y"))
    return layout.hit_test(points, _circle(spark, sf_dir).withColumn("radius", F.lit(30.0)))


@query("hit_test_sizes", U + """, q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v),
c AS (SELECT id, 35.0*(k % 40) x, 35.0*(k // 40) y, (20 + (k % 21))*(1 + 0.4*(k % 3)/2.0) r FROM q),
pt AS (SELECT s_suppkey point, 11.0*(s_suppkey % 120) px, 7.0*(s_suppkey % 31) py FROM supplier)
SELECT point, min(id) AS id FROM pt JOIN c ON sqrt((px-x)*(px-x)+(py-y)*(py-y)) < r GROUP BY 1""")
def hit_test_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping circles as wide as ``node_size`` makes them with a score: radii from 20 to 56."""
    ids = graph.dense_ids(graph.vertices_of(fam.handoff_edges(spark, sf_dir)).withColumnRenamed("id", "name"), "name")
    k = F.col("id")
    size = geometry.node_size(k % 21, F.lit(0), F.lit(20), score=(k % 3) / 2)
    nodes = ids.select(F.col("name").alias("id"), (35.0 * (k % 40)).alias("x"), (35.0 * F.floor(k / 40)).alias("y"), size.alias("radius"))
    s = F.col("s_suppkey")
    return layout.hit_test(fam.table(spark, sf_dir, "supplier").select(s.alias("point"), (11.0 * (s % 120)).alias("x"), (7.0 * (s % 31)).alias("y")), nodes)


VIEW, SCREEN = (-750.0, -425.0, 1600.0, 900.0), (800.0, 600.0)
CAMERA = """WITH p AS (SELECT s_suppkey AS id, s_suppkey % 97 - 40.0 AS x, s_suppkey % 89 - 30.0 AS y FROM supplier),
z AS (SELECT 50.0 - (50.0 + 750)/2 AS l, 25.0 - (25.0 + 425)/2 AS t, 800.0 AS w, 450.0 AS h)
SELECT id, round((x - (l - 30 + w/2)) + 400, 6) AS sx, round((y - (t + 12 + h/2)) + 300, 6) AS sy, x::DOUBLE AS wx, y::DOUBLE AS wy,
 CASE WHEN x < 0.1 THEN 0.1 WHEN x > 1000 THEN 1000 ELSE x END::DOUBLE AS zoom, x BETWEEN -5 AND 45 AND y BETWEEN -5 AND 35 AS inside FROM p, z"""


@query("camera_views", CAMERA)
def camera_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoomed by two about (50, 25) and dragged by (30, -12): to the screen, back to the world, zoom limits, culling."""
    s = F.col("s_suppkey")
    p = fam.table(spark, sf_dir, "supplier").select(s.alias("id"), (s % 97 - 40.0).alias("x"), (s % 89 - 30.0).alias("y"))
    view = geometry.pan(geometry.zoom_about(VIEW, 2.0, 50.0, 25.0), 30.0, -12.0)
    sx, sy = geometry.world_to_screen(F.col("x"), F.col("y"), view, SCREEN)
    wx, wy = geometry.screen_to_world(sx, sy, view, SCREEN)
    return p.select("id", F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"), (F.round(wx, 6) + 0.0).alias("wx"), (F.round(wy, 6) + 0.0).alias("wy"), geometry.clamp_zoom(F.col("x")).alias("zoom"), geometry.in_canvas(F.col("x"), F.col("y"), 40.0, 30.0, 5.0).alias("inside"))


@query("visible_nodes", CIRCLE + ", c AS (SELECT id, 300*cos(2*pi()*k/n) x, 300*sin(2*pi()*k/n) y FROM q) SELECT id FROM c WHERE x BETWEEN -40 AND 240 AND y BETWEEN -40 AND 340")
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visible(_circle(spark, sf_dir), fam.handoff_edges(spark, sf_dir), 200.0, 300.0, 40.0)[0].select("id")


# --- Page links -----------------------------------------------------------------------------------


@query("page_links", "SELECT page_id, count(*) AS links, count(*) FILTER (starts_with(href, '/')) AS n_local FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY 1")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.page_links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if("is_local").alias("n_local"))


@query("page_link_targets", "SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY 1 ORDER BY n DESC, href LIMIT 20")
def page_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return fam.page_links(spark, sf_dir).groupBy("href").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "href").limit(20)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
