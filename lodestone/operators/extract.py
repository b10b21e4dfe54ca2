"""Facts and nodes of source files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import language_of
from ..functions.paths import join_path, line_count, parent_dir
from . import lexers

FACTS = "file string, language string, kind string, name string"


def extract_facts(files: DataFrame, macro_includes: bool = False, references: bool = True) -> DataFrame:
    """FACTS of files(path, content): one distinct row for each symbol; unknown languages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, code in zip(pdf["path"], pdf["language"], pdf["content"], strict=True):
                rows += [(path, language, k, n) for k, n in sorted(lexers.facts(language, path, code, macro_includes)) if references or k != "reference"]
            yield pd.DataFrame(rows, columns=["file", "language", "kind", "name"])

    known = files.select("path", language_of(F.col("path")).alias("language"), "content").where("language IS NOT NULL AND content IS NOT NULL")
    return known.mapInPandas(run, FACTS)


def imports_of(facts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(file, language, raw, path, is_local).  raw: as written; path: a local Python import without its leading dots.

    A Python import is local if it begins with a dot, or if any one of its
    dotted parts is a module or a package in the importing file's folder.
    """
    rows = facts.where("kind IN ('import', 'import_local')").select("file", "language", F.col("name").alias("raw"), (F.col("kind") == "import_local").alias("told"))
    python = rows.where("language = 'Python'").select("file", "raw").distinct()
    part = python.where(~F.col("raw").startswith(".")).select("file", "raw", F.explode(F.split("raw", r"\.")).alias("part"))
    place = part.select("file", "raw", F.explode(F.array(join_path(parent_dir(F.col("file")), F.concat("part", F.lit(".py"))), join_path(parent_dir(F.col("file")), F.concat("part", F.lit("/__init__.py"))))).alias("path"))
    near = place.join(inventory.select("path").distinct(), "path", "left_semi").select("file", "raw").distinct().withColumn("near", F.lit(True))
    joined = rows.join(near, ["file", "raw"], "left")
    local = F.when(F.col("language") == "Python", F.col("raw").startswith(".") | F.coalesce("near", F.lit(False))).otherwise(F.col("told"))
    path = F.when((F.col("language") == "Python") & F.col("is_local"), F.ltrim(F.col("raw"), F.lit("."))).otherwise(F.col("raw"))
    return joined.withColumn("is_local", local).withColumn("path", path).select("file", "language", "raw", "path", "is_local")


def base_nodes(files: DataFrame) -> DataFrame:
    """(file, loc, language) of the files in a known language."""
    return files.select(F.col("path").alias("file"), line_count(F.col("content")).alias("loc"), language_of(F.col("path")).alias("language")).where("language IS NOT NULL AND loc IS NOT NULL")


def nodes(files: DataFrame, inventory: DataFrame, facts: DataFrame | None = None, imported: DataFrame | None = None) -> DataFrame:
    """One row for each file: file, loc, language, imports, functions, containers, external_references; lists sorted."""
    facts = extract_facts(files) if facts is None else facts
    imported = imports_of(facts, inventory) if imported is None else imported
    lists = facts.groupBy("file").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(name) for kind, name in (("function", "functions"), ("container", "containers"), ("reference", "external_references"))])
    imports = imported.groupBy("file").agg(F.array_sort(F.collect_set(F.struct("path", "is_local"))).alias("imports"))
    base = base_nodes(files)
    none = F.array().cast("array<string>")
    out = base.join(lists, "file", "left").join(imports, "file", "left")
    return out.select("file", "loc", "language", F.coalesce("imports", F.array().cast("array<struct<path:string,is_local:boolean>>")).alias("imports"), *[F.coalesce(c, none).alias(c) for c in ("functions", "containers", "external_references")])
