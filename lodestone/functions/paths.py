"""Path and file-name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))


def normalize_path(path: Column) -> Column:
    """Forward slashes; no empty or ``.`` parts; ``..`` takes the part before it, if that is not ``..`` itself.

    A leading slash stays, what is left of nothing is ``.``, null stays null.
    """
    fold = F.aggregate(
        _parts(path),
        F.array().cast("array<string>"),
        lambda kept, x: F.when((x == "..") & (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != ".."), F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(x))),
    )
    joined = F.array_join(fold, "/")
    rooted = F.translate(path, "\\", "/").startswith("/")
    return F.when(path.isNull(), F.lit(None).cast("string")).when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def parent_dir(path: Column) -> Column:
    """What stands before the last slash; ``/`` for a file at the top; empty without a slash."""
    return F.when(path.rlike(r"^/[^/]*$"), F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The name without what follows its last dot; a leading dot belongs to the stem."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path; the path where there is none."""
    return F.element_at(F.split(path, r"\."), -1)


def join_path(directory: Column, rest: Column) -> Column:
    return F.when(directory == "/", F.concat(F.lit("/"), rest)).when(directory == "", rest).otherwise(F.concat(directory, F.lit("/"), rest))


def dotted_to_path(name: Column) -> Column:
    return F.translate(name, ".", "/")


def line_count(content: Column) -> Column:
    """Line feeds plus one."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("int")
