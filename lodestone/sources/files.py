"""Source trees as DataFrames: files(path, root, content) and inventory(path, is_node).

The walk lists names on the driver, which prunes ignored folders and needs
nothing but names and ignore files; contents are read by executors.  ``scan``
takes a folder that every machine sees; ``scan_store`` one of any store that
Spark's file systems reach.
"""

from __future__ import annotations

import configparser
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language_of
from . import gitignore
from .shared import hadoop_path, materialize

Entry = tuple[str, bool, bool]  # name, is a folder, is a regular file


class LocalTree:
    """Folders of this machine."""

    def entries(self, folder: str) -> list[Entry]:
        return sorted((e.name, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)) for e in os.scandir(folder))

    def read(self, path: str) -> str | None:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    def above(self, folder: str) -> list[str]:
        """Folders above, the nearest first."""
        out = []
        while (up := os.path.dirname(folder)) != folder:
            out.append(up)
            folder = up
        return out

    def has(self, path: str) -> bool:
        return os.path.exists(path)

    def global_excludes(self) -> str | None:
        """The user's own excludes file: core.excludesFile, or git's default place."""
        home = os.path.expanduser("~")
        base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
        for config in (os.path.join(home, ".gitconfig"), os.path.join(base, "git", "config")):
            parser = configparser.ConfigParser(strict=False, allow_no_value=True, interpolation=None)
            try:
                parser.read_string("\n".join(line.strip() for line in (self.read(config) or "").splitlines()))
            except configparser.Error:
                continue
            if named := parser.get("core", "excludesfile", fallback=None):
                return self.read(os.path.expanduser(named.strip('"')))
        return self.read(os.path.join(base, "git", "ignore"))


class StoreTree(LocalTree):
    """Folders of a store that Spark's file systems know; what stands above the root is not read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.fs = hadoop_path(spark, root)[0]

    def entries(self, folder: str) -> list[Entry]:
        found = self.fs.listStatus(hadoop_path(self.spark, folder)[1])
        return sorted((s.getPath().getName(), s.isDirectory(), s.isFile()) for s in found)

    def read(self, path: str) -> str | None:
        data = self.bytes(path)
        return None if data is None else data.decode("utf-8", "replace")

    def bytes(self, path: str) -> bytes | None:
        at = hadoop_path(self.spark, path)[1]
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def above(self, folder: str) -> list[str]:
        return []

    def has(self, path: str) -> bool:
        return self.fs.exists(hadoop_path(self.spark, path)[1])

    def global_excludes(self) -> str | None:
        return None


class Rules:
    """Ignore rules in force in a folder.  The last that matches wins: of the kinds below the later ones, within a kind the deeper ones.

    The root's own .gitignore always counts; the user's excludes, the
    repository's info/exclude and other .gitignore files count inside a
    repository; .ignore files count everywhere, above the root too.
    """

    def __init__(self, base: list[gitignore.Rule], git: list[gitignore.Rule], plain: list[gitignore.Rule], in_git: bool):
        self.base, self.git, self.plain, self.in_git = base, git, plain, in_git
        self.every = base + git + plain

    @classmethod
    def at(cls, tree: LocalTree, root: str) -> Rules:
        above = tree.above(root)
        repository = next((d for d in [root, *above] if tree.has(os.path.join(d, ".git"))), None)
        base = gitignore.parse(tree.read(os.path.join(root, ".gitignore")) or "", root)
        if repository:
            base += gitignore.parse(tree.global_excludes() or "", repository)
            base += gitignore.parse(tree.read(os.path.join(repository, ".git", "info", "exclude")) or "", repository)
        out = cls(base, [], [], repository is not None)
        for folder in reversed(above):
            inside = repository is not None and (folder + "/").startswith(repository.rstrip("/") + "/")
            out = out.within(tree, folder, inside)
        return out

    def within(self, tree: LocalTree, folder: str, git: bool | None = None) -> Rules:
        in_git = self.in_git if git is None else git
        own = gitignore.parse(tree.read(os.path.join(folder, ".gitignore")) or "", folder) if in_git else []
        plain = gitignore.parse(tree.read(os.path.join(folder, ".ignore")) or "", folder)
        return Rules(self.base, self.git + own, self.plain + plain, self.in_git) if own or plain else self


def walk_tree(tree: LocalTree, root: str, no_gitignore: bool = False) -> Iterator[tuple[str, bool]]:
    """(path, is a node) of every regular file below root; hidden and ignored ones are no nodes."""

    def visit(folder: str, rules: Rules | None, node: bool) -> Iterator[tuple[str, bool]]:
        try:
            entries = tree.entries(folder)
        except Exception as error:  # unreadable folders are told of and left out
            print(f"Error: {error}")
            return
        ruled = any(name in (".gitignore", ".ignore") for name, _, _ in entries)
        rules = None if not rules or not node else rules.within(tree, folder) if ruled else rules
        for name, is_dir, is_file in entries:
            path = f"{folder.rstrip('/')}/{name}"
            own = node and not name.startswith(".") and not (rules and gitignore.ignored(path, is_dir, rules.every))
            if is_dir:
                yield from visit(path, rules, own)
            elif is_file:
                yield path, own

    return visit(root, None if no_gitignore else Rules.at(tree, root), True)


def walk(root: str, no_gitignore: bool = False) -> list[str]:
    """Regular files below root that are nodes; a file is itself."""
    root = os.path.realpath(root)
    return [root] if os.path.isfile(root) else [p for p, node in walk_tree(LocalTree(), root, no_gitignore) if node]


def decode_utf8(files: DataFrame) -> DataFrame:
    """Rows whose bytes are valid UTF-8, as text; the others go."""
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))  # decode fails on other bytes, wherever a filter is moved to
    return files.withColumn("content", text).where("content IS NOT NULL")


def inventory_of(spark: SparkSession, paths: Iterator[tuple[str, bool]]) -> DataFrame:
    """(path, is_node), all files: what an import can lead to."""
    names, nodes = [], []
    for path, node in paths:
        names.append(path)
        nodes.append(node)
    return spark.createDataFrame(pa.table({"path": pa.array(names, pa.string()), "is_node": pa.array(nodes, pa.bool_())}))


def sources_among(inventory: DataFrame) -> DataFrame:
    """(path) of the nodes in a known language."""
    return inventory.where(F.col("is_node") & language_of(F.col("path")).isNotNull()).select("path")


def scan(spark: SparkSession, root: str, no_gitignore: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files of known languages, inventory)."""
    root = os.path.realpath(root)
    alone = not os.path.isdir(root)
    base = os.path.dirname(root) if alone else root
    inventory = inventory_of(spark, iter([(root, True)]) if alone else walk_tree(LocalTree(), root, no_gitignore))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():  # one file at a time
                if (content := file_bytes(path)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    contents = sources_among(inventory).mapInArrow(read, "path string, content binary")
    return decode_utf8(contents).select("path", F.lit(base).alias("root"), "content"), inventory


def file_bytes(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def scan_store(spark: SparkSession, root: str, no_gitignore: bool = False, at_once: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """The same of a folder in any store.  Paths are those of the store, without its scheme.

    Spark's reader reads the files, but leaves out empty ones, which are added,
    and names that begin with an underscore; those (``__init__.py``) are read
    through the file system, at most about ``at_once`` bytes at a time, into a
    table of their own.
    """
    tree, where = StoreTree(spark, root), root.rstrip("/")
    top = hadoop_path(spark, where)[1].toUri().getPath()
    inventory = materialize(inventory_of(spark, ((top + p[len(where) :], node) for p, node in walk_tree(tree, where, no_gitignore))), "inventory")
    wanted = [r["path"] for r in sources_among(inventory).toLocalIterator()]  # names only
    plain = [where + p[len(top) :] for p in wanted if not p.rpartition("/")[2].startswith("_")]
    odd = [where + p[len(top) :] for p in wanted if p.rpartition("/")[2].startswith("_")]
    parts: list[DataFrame] = []
    if plain:
        escaped = ["".join("\\" + c if c in "[]{}*?\\" else c for c in p) for p in plain]
        parts.append(spark.read.format("binaryFile").load(escaped).select(F.regexp_replace("path", r"^[a-z]+:(?://[^/]*)?(?=/)", "").alias("path"), "content"))
        empty = sources_among(inventory).where(~F.col("path").rlike("/_[^/]*$")).join(parts[0].select("path"), "path", "left_anti")
        parts.append(empty.withColumn("content", F.lit(b"")))
    rows, size = [], 0
    for k, path in enumerate(odd):
        data = tree.bytes(path) or b""
        rows.append((top + path[len(where) :], data))
        size += len(data)
        if size >= at_once or k == len(odd) - 1:
            parts.append(materialize(spark.createDataFrame(rows, "path string, content binary"), "odd-names"))
            rows, size = [], 0
    contents = parts[0] if parts else spark.createDataFrame([], "path string, content binary")
    for more in parts[1:]:
        contents = contents.unionByName(more)
    return decode_utf8(contents).select("path", F.lit(top).alias("root"), "content"), inventory


class NoSupportedFiles(ValueError):
    def __init__(self):
        super().__init__("No supported language files found in the project")


def project_languages(files: DataFrame) -> DataFrame:
    """Distinct languages; an error if there is none."""
    out = files.select(language_of(F.col("path")).alias("language")).where("language IS NOT NULL").distinct()
    if out.isEmpty():
        raise NoSupportedFiles
    return out
