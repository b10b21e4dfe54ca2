"""Graphs and source trees that the driver's tables give: hand-offs of events, a virtual tree of parts, page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..project import Project
from ..sources.shared import materialize, write_files

__all__ = ["handoff_edges", "materialize", "page_links", "part_files", "part_project", "part_rows", "part_tree", "table", "write_files"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def handoff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): to each user the two users who most often come next, self left out; ties to the smaller id.

    The order of all events needs each range of time to know the first event of
    the next; ranges are sorted by themselves and only their ends meet.
    """
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    # Written once: the ranges are drawn from a sample, and both readers have to see the same.
    ordered = materialize(events.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()), "events")
    within = ordered.withColumn("dst", F.lead("user_id").over(Window.partitionBy("part").orderBy("ts", "event_id")))
    # Ends: one row for each range.
    last = ordered.groupBy("part").agg(F.max(F.struct("ts", "event_id", "user_id")).alias("z"), F.min(F.struct("ts", "event_id", "user_id")).alias("a"))
    joins = last.select(F.col("z.user_id").alias("user_id"), F.lead("a.user_id").over(Window.orderBy("part")).alias("dst"))
    steps = within.select("user_id", "dst").unionByName(joins).where("dst IS NOT NULL AND user_id <> dst")
    counted = steps.groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("n"))
    # Two per user before and after the shuffle: Spark cuts a rank limit on both sides.
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return counted.withColumn("place", place).where("place <= 2").select("src", "dst")


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the virtual tree: i, c, m, sz, n, t1, t2."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    ids = graph.dense_ids(part, "p_partkey")
    n = part.count()
    b = ids.join(part, "p_partkey").select(F.col("id").alias("i"), F.col("p_size").alias("sz"), F.lit(n).alias("n")).withColumns({"c": F.col("i") % 4, "m": F.floor(F.col("i") / 4)})
    t2 = 4 * (2 * F.col("m") + 1) + F.col("c")
    return b.withColumns({"t1": F.when(F.col("m") > 0, 4 * F.floor(F.col("m") / 2) + F.col("c")).otherwise(-1), "t2": F.when((F.col("m") % 11 == 0) & (t2 < F.col("n")), t2).otherwise(-1)})


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, root, content): a source file for each part, a quarter in each language."""
    nl = F.lit("\n")
    i, c = F.col("i"), F.col("c")
    pick = lambda *four: F.when(c == 0, four[0]).when(c == 1, four[1]).when(c == 2, four[2]).otherwise(four[3])
    lit = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    path = pick(lit("/v/py/mod", i, ".py"), lit("/v/src/mod", i, ".rs"), lit("/v/ts/mod", i, ".ts"), lit("/v/cpp/mod", i, ".hpp"))
    head = pick(lit("import os\n"), lit("use std::fs;\n"), lit('import r from "react";\n'), lit('#include <vector>\n#include "string.h"\n'))
    link = lambda t: F.when(t < 0, "").otherwise(pick(lit("from py.mod", t, " import f\n"), lit("use crate::mod", t, ";\n"), lit('import { f } from "./mod', t, '";\n'), lit('#include "mod', t, '.hpp"\n')))
    body = pick(lit("def f_", i, "():\n    pass\n"), lit("fn f_", i, "() {}\n"), lit("function f_", i, "() {}\n"), lit("void f_", i, "() {}\n"))
    content = F.concat(head, link(F.col("t1")), link(F.col("t2")), body, F.repeat(nl, F.col("sz")))
    return part_rows(spark, sf_dir).select(path.alias("path"), F.lit("/v").alias("root"), content.alias("content"))


def part_project(spark: SparkSession, sf_dir: str) -> Project:
    files = materialize(part_files(spark, sf_dir), "part-files")
    return Project.build(files, files.select("path", F.lit(True).alias("is_node")), "/v")


def part_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of the part numbers with the first target only: no cycle but for self."""
    rows = part_rows(spark, sf_dir)
    return rows.where("t1 >= 0 AND t1 <> i").select(F.col("i").alias("src"), F.col("t1").cast("bigint").alias("dst")), rows.select(F.col("i").alias("id"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href, is_local) of each link; local from a slash on."""
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", href.alias("href")).withColumn("is_local", F.col("href").startswith("/"))
