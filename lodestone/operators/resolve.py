"""Imports to files.

A resolver turns each import into an ordered list of keys; a key is ``f:`` and a
path, or ``m:``, a root and a Rust module below it, so that many trees with roots
of their own can be resolved at once.  One join with the lookup table (inventory and
module map) finds which keys exist, and the first in order wins.  Resolvers are
registered by language, so another language is one more function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.includes import is_filtered_include
from ..functions.paths import dotted_to_path, file_stem, join_path, normalize_path, parent_dir

# Where headers are looked for below the root, and the extensions that are tried.
INCLUDE_DIRS = "include include/public include/internal src src/include public private headers inc".split()
INCLUDE_EXTENSIONS = ".h .hpp .hxx .h++ .cc .cpp .cxx .c++".split()


def _file(path: Column) -> Column:
    return F.concat(F.lit("f:"), path)


def _module(root: Column, module: Column) -> Column:
    return F.concat(F.lit("m:"), root, F.lit("|"), module)


def python_keys(raw: Column, file: Column, root: Column, module: Column) -> Column:
    """Relative: k dots lead k - 1 folders up, nothing after them is the package itself.  Else from the root."""
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    rest = dotted_to_path(F.ltrim(raw, F.lit(".")))
    folder = normalize_path(F.concat(parent_dir(file), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)))))
    base = F.when(dots > 0, folder).otherwise(root)
    stem = join_path(base, rest)
    return F.when(rest == "", F.array(_file(join_path(base, F.lit("__init__.py"))))).otherwise(F.array(_file(F.concat(stem, F.lit(".py"))), _file(F.concat(stem, F.lit("/__init__.py")))))


def typescript_keys(raw: Column, file: Column, root: Column, module: Column) -> Column:
    """The extension is replaced, not added; then the folder's index.  Only relative paths."""
    path = normalize_path(join_path(parent_dir(file), raw))
    with_ext = F.concat(parent_dir(path), F.lit("/"), file_stem(path), F.lit(".ts"))
    return F.when(raw.startswith("."), F.array(_file(normalize_path(with_ext)), _file(join_path(path, F.lit("index.ts")))))


def cpp_keys(raw: Column, file: Column, root: Column, module: Column) -> Column:
    """Including folder, root, common folders below the root, then up to four folders above; each exact, then by extension."""
    name = normalize_path(raw)
    here = parent_dir(file)
    dirs = F.array(here, root, *[F.concat(root, F.lit("/" + d)) for d in INCLUDE_DIRS])
    above = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(here, "/"), lambda x: x != ""), 1, F.greatest(F.size(F.filter(F.split(here, "/"), lambda x: x != "")) - k, F.lit(0))), "/"))), lambda d: d != "/")
    names = F.when(name.contains("."), F.array(name)).otherwise(F.array(name, *[F.concat(name, F.lit(e)) for e in INCLUDE_EXTENSIONS]))
    keys = F.flatten(F.transform(F.array_distinct(F.concat(dirs, above)), lambda d: F.transform(names, lambda n: _file(normalize_path(F.concat(d, F.lit("/"), n))))))
    return F.when(~is_filtered_include(raw), keys)


def rust_keys(raw: Column, file: Column, root: Column, module: Column) -> Column:
    """Exact modules for crate::, super:: and siblings; a bare name is a module declaration first."""
    parts = F.split(module, "::")
    levels = F.size(parts)
    ups = F.size(F.split(F.regexp_extract(raw, r"^((?:super::)*)", 1), "super::")) - 1
    rest = F.regexp_replace(raw, r"^(?:super::)+", "")
    m = lambda head, tail: _module(root, F.concat(head, F.lit("::"), tail))
    above = F.array_join(F.slice(parts, 1, F.greatest(levels - ups, F.lit(0))), "::")
    parent = F.array_join(F.slice(parts, 1, F.greatest(levels - 1, F.lit(0))), "::")
    sibling = F.when(levels > 1, m(parent, F.regexp_replace(raw, "^self::", "")))
    here = parent_dir(file)
    declared = F.array(_file(join_path(here, F.concat(raw, F.lit(".rs")))), _file(join_path(here, F.concat(raw, F.lit("/mod.rs")))), m(module, raw))
    bare = ~raw.contains("::") & ~raw.startswith("crate")
    return (
        F.when(bare, F.concat(declared, F.filter(F.array(sibling), lambda x: x.isNotNull())))
        .when(raw.startswith("crate::"), F.array(_module(root, raw)))
        .when(raw.startswith("super::"), F.when(levels > ups, F.array(m(above, rest))))
        .otherwise(F.when(levels > 1, F.array(sibling)))
    )


Keys = Callable[[Column, Column, Column, Column], Column]
RESOLVERS: dict[str, Keys] = {"Python": python_keys, "Rust": rust_keys, "TypeScript": typescript_keys, "Cpp": cpp_keys}


def module_of(file: Column, root: Column) -> Column:
    """Rust module path of a file: below the root, without a leading src; mod, main and lib add nothing."""
    relative = F.substring(file, F.length(root) + 2, F.lit(1 << 20))
    parts = F.split(F.regexp_replace(relative, r"^src/", ""), "/")
    named = F.transform(parts, lambda p: F.regexp_replace(p, r"\.rs$", ""))
    kept = F.transform(F.filter(F.zip_with(parts, named, lambda p, n: F.struct(p.alias("p"), n.alias("n"))), lambda x: ~(x["p"].endswith(".rs") & x["n"].isin("mod", "main", "lib"))), lambda x: x["n"])
    return F.when(file.startswith(F.concat(root, F.lit("/"))), F.array_join(F.concat(F.array(F.lit("crate")), kept), "::"))


def module_map(files: DataFrame, root: Column) -> DataFrame:
    """(file, module) of each Rust file in files(file)."""
    return files.select("file", module_of(F.col("file"), root).alias("module")).where("module IS NOT NULL")


def lookup_table(inventory: DataFrame, modules: DataFrame, root: Column) -> DataFrame:
    """(key, target); of files that claim one module the smallest path has it."""
    paths = inventory.select(_file(F.col("path")).alias("key"), F.col("path").alias("target")).distinct()
    return paths.unionByName(modules.groupBy(_module(root, F.col("module")).alias("key")).agg(F.min("file").alias("target")))


def first_match(wanted: DataFrame, lookup: DataFrame, by: list[str]) -> DataFrame:
    """wanted: ``by`` and keys.  The target of the first key that is there; rows without one are left out."""
    tried = wanted.select(*by, F.posexplode("keys").alias("pos", "key"))
    return tried.join(lookup, "key").groupBy(*by).agg(F.min_by("target", "pos").alias("target"))


def resolve_imports(imports: DataFrame, inventory: DataFrame, rust_files: DataFrame, root: Column, compat: bool = False) -> DataFrame:
    """(file, language, raw, target) of imports(file, language, raw, path) that lead to a file.

    compat: local Python imports are looked up from the root, without their dots.
    """
    modules = module_map(rust_files, root)
    written = F.when(F.lit(compat) & (F.col("language") == "Python"), F.col("path")).otherwise(F.col("raw"))
    wanted = None
    for language, make in RESOLVERS.items():
        own = imports.where(F.col("language") == language)
        own = own.join(modules, "file", "left") if language == "Rust" else own.withColumn("module", F.lit(None).cast("string"))
        keyed = own.select("file", "language", "raw", make(written, F.col("file"), root, F.col("module")).alias("keys"))
        wanted = keyed if wanted is None else wanted.unionByName(keyed)
    return first_match(wanted, lookup_table(inventory, modules, root), ["file", "language", "raw"])


def dependency_edges(facts: DataFrame, imports: DataFrame, inventory: DataFrame, nodes: DataFrame, root: Column, compat: bool = False) -> DataFrame:
    """Distinct (src, dst): local imports that lead to a file, and Rust paths that name a module; no file leads to itself."""
    rust = nodes.where("language = 'Rust'").select("file")
    found = resolve_imports(imports.where("is_local"), inventory, rust, root, compat).select(F.col("file").alias("src"), F.col("target").alias("dst"))
    modules = module_map(rust, root).groupBy(root.alias("root"), "module").agg(F.min("file").alias("dst"))
    references = facts.where("language = 'Rust' AND kind = 'reference'").select(F.col("file").alias("src"), root.alias("root"), F.concat(F.lit("crate::"), "name").alias("module"))
    return found.unionByName(references.join(modules, ["root", "module"]).select("src", "dst")).where("src <> dst").distinct()
