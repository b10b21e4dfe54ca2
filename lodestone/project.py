"""A whole source tree: scan, extract, resolve, draw.  ``python -m lodestone PATH [OUT]``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.languages import language_of
from .operators import extract, graph, render, reports, resolve
from .sources import files as sources
from .sources.shared import materialize


@dataclass
class Project:
    """The tables of one tree."""

    root: str
    inventory: DataFrame
    files: DataFrame  # file, loc, language
    facts: DataFrame
    imports: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, files: DataFrame, inventory: DataFrame, root: str, compat: bool = False, macro_includes: bool = False) -> Project:
        """From files(path, root, content) and inventory(path, is_node)."""
        facts = materialize(extract.extract_facts(files, macro_includes), "facts")  # texts are read once
        imports = materialize(extract.imports_of(facts, inventory), "imports")
        nodes = extract.nodes(files, inventory, facts, imports)
        known = files.select(F.col("path").alias("file"), language_of(F.col("path")).alias("language"))
        edges = resolve.dependency_edges(facts, imports, inventory, known, F.lit(root), compat)
        return cls(root, inventory, extract.base_nodes(files), facts, imports, nodes, edges)

    @classmethod
    def scan(cls, spark: SparkSession, path: str, no_gitignore: bool = False, **options) -> Project:
        root = os.path.realpath(path)
        files, inventory = sources.scan(spark, root, no_gitignore)
        sources.project_languages(files)
        return cls.build(files, inventory, root if os.path.isdir(root) else os.path.dirname(root), **options)

    def summary(self) -> DataFrame:
        return reports.node_summary(self.nodes, self.edges)

    def indexed(self) -> tuple[DataFrame, DataFrame]:
        """(ids(id, file), edges(src, dst) by id, between nodes only)."""
        ids = graph.dense_ids(self.files)
        by = lambda c: ids.select(F.col("file").alias(c), F.col("id").alias(f"{c}_id"))
        return ids, self.edges.join(by("src"), "src").join(by("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))

    def analysis(self) -> list[str]:
        """The analysis panel: components by size, and the five highest betweenness scores."""
        ids, edges = self.indexed()
        edges, vertices = materialize(edges, "edges"), ids.select("id")
        sizes = graph.size_histogram(graph.strongly_connected(edges, vertices)).collect()
        top = graph.chokepoints(graph.betweenness(edges, vertices)).join(ids, "id").orderBy(F.desc("score"), "id").collect()
        return [f"{r['count']} components of {r['size']}" for r in sizes] + [f"{r['file']}: {r['score']:.6f}" for r in top]

    def details(self, file: str) -> list[str]:
        """The details panel of one file, named from the root or in full."""
        rows = reports.details(self.nodes, self.edges).where(F.col("file") == os.path.join(self.root, file))
        counts = rows.groupBy("section").agg(F.array_sort(F.collect_list("item")).alias("items")).orderBy("section").collect()
        return [f"{r['section']} ({len(r['items'])}): {', '.join(r['items'])}" for r in counts]

    def scene(self) -> tuple[DataFrame, DataFrame]:
        return render.scene(self.files, graph.dense_ids(self.files), self.edges)

    def export(self, out: str) -> bool:
        """Write an .svg or a .png; False, and no file, for a graph without nodes."""
        data = render.svg(*self.scene()) if out.endswith(".svg") else render.png(*self.scene()) if out.endswith(".png") else False
        if data is False:
            raise ValueError("Unsupported output format")
        if data is None:
            return False
        with open(out, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
        return True


def checked(path: str | None, out: str | None) -> tuple[str, str | None]:
    """Arguments that hold: the path is there, the output is a bare file name."""
    path = path or os.getcwd()
    if not os.path.exists(path):
        raise ValueError(f"Path does not exist: {path}")
    if out is not None:
        if not out.strip():
            raise ValueError("Output filename cannot be empty")
        if "/" in out or "\\" in out:
            raise ValueError("Output filename cannot contain path separators")
        if out != "gui" and not out.endswith((".svg", ".png")):
            raise ValueError("Unsupported output format")
    return os.path.realpath(path), out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("path", nargs="?")
    parser.add_argument("output", nargs="?")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("--no-gitignore", action="store_true")
    parser.add_argument("--details", metavar="FILE", help="list what this file depends on, who depends on it, and what it holds")
    parser.add_argument("--version", action="version", version="lodestone 0.1")
    given = parser.parse_args(args)
    try:
        path, out = checked(given.path, given.output)
        spark = SparkSession.builder.appName("lodestone").getOrCreate()
        project = Project.scan(spark, path, given.no_gitignore)
        if given.details:
            for line in project.details(given.details):
                print(line)
            return 0
        panels = out in (None, "gui")  # no window is opened: its panels are printed
        if given.verbose or panels:
            for r in project.summary().orderBy("file").toLocalIterator():
                print(f"{r['file']}: {r['language']}, {r['loc']} lines, {r['functions']} functions, {r['containers']} containers, {r['imports']} imports, {r['dependencies']} dependencies")
        if panels:
            for line in project.analysis():
                print(line)
        else:
            project.export(out)
    except ValueError as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


__all__ = ["Project", "checked", "main"]
