"""Summaries of nodes(file, loc, language, imports, functions, ...) and edges(src, dst) by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import display_name
from ..functions.paths import file_name


def loc_bounds(nodes: DataFrame) -> DataFrame:
    """(min_loc, max_loc), both 0 without nodes."""
    return nodes.agg(F.coalesce(F.min("loc"), F.lit(0)).alias("min_loc"), F.coalesce(F.max("loc"), F.lit(0)).alias("max_loc"))


def node_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The verbose report: file, name, language, loc and counts of functions, containers, imports, dependencies."""
    out = edges.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("dependencies"))
    counts = [F.size(c).cast("bigint").alias(c) for c in ("functions", "containers", "imports")]
    return nodes.join(out, "file", "left").select("file", file_name(F.col("file")).alias("name"), display_name(F.col("language")).alias("language"), "loc", *counts, F.coalesce("dependencies", F.lit(0)).cast("bigint").alias("dependencies"))


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, n_outgoing, targets): dependencies that are nodes themselves, sorted."""
    known = edges.join(nodes.select(F.col("file").alias("dst")), "dst", "left_semi")
    return known.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("n_outgoing"), F.array_sort(F.collect_list("dst")).alias("targets"))


def incoming(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, n_incoming, sources): who depends on a file, sorted."""
    known = edges.join(nodes.select(F.col("file").alias("src")), "src", "left_semi")
    return known.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n_incoming"), F.array_sort(F.collect_list("src")).alias("sources"))


def import_partition(nodes: DataFrame) -> DataFrame:
    """(file, n_local, n_external)."""
    local = F.size(F.filter("imports", lambda x: x["is_local"])).cast("bigint")
    return nodes.select("file", local.alias("n_local"), (F.size("imports") - local).cast("bigint").alias("n_external"))


def files_by_language(nodes: DataFrame) -> DataFrame:
    """(language, files, first): how many files, and the first by name; the files themselves are ``nodes`` by language."""
    return nodes.groupBy("language").agg(F.count("*").alias("files"), F.min("file").alias("first"))


def external_nodes(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Nodes whose file is not there."""
    return nodes.join(inventory.select(F.col("path").alias("file")), "file", "left_anti")


def details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, section, item): what the details panel of a node lists, a row each.

    Sections: incoming and outgoing (nodes), local and external (imports), functions, containers.
    """
    known = nodes.select(F.col("file").alias("other"))
    out = edges.select(F.col("src").alias("file"), F.lit("outgoing").alias("section"), F.col("dst").alias("item")).unionByName(edges.select(F.col("dst").alias("file"), F.lit("incoming").alias("section"), F.col("src").alias("item")))
    out = out.join(known, F.col("item") == F.col("other"), "left_semi").join(nodes.select("file"), "file", "left_semi")
    imports = nodes.select("file", F.explode("imports").alias("i")).select("file", F.when(F.col("i.is_local"), "local").otherwise("external").alias("section"), F.col("i.path").alias("item"))
    lists = nodes.select("file", F.explode(F.create_map(*[x for c in ("functions", "containers") for x in (F.lit(c), F.col(c))])).alias("section", "items")).select("file", "section", F.explode("items").alias("item"))
    return out.unionByName(imports).unionByName(lists)
