"""The four languages, their file extensions and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import extension

# Name, display name, extensions, colour.
LANGUAGES = (
    ("Python", "Python", ("py",), "#FFD43B"),
    ("Rust", "Rust", ("rs",), "#DEA584"),
    ("TypeScript", "TypeScript", ("ts",), "#007ACC"),
    ("Cpp", "C++", ("cpp", "cc", "cxx", "c++", "h", "hpp", "hxx", "h++"), "#00599C"),
)


def dimension(spark: SparkSession) -> DataFrame:
    """language, display, ext, color: one row for each extension."""
    return spark.createDataFrame([(n, d, e, c) for n, d, es, c in LANGUAGES for e in es], "language string, display string, ext string, color string")



def language_of(path: Column) -> Column:
    """By the text after the last dot, as it is written; null if it is none of the known ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for n, _, es, _ in LANGUAGES for e in es for x in (e, n)]), extension(path))


def display_name(language: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, d, _, _ in LANGUAGES for x in (n, d)]), language)


def color_of(language: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, _, _, c in LANGUAGES for x in (n, c)]), language)


def rgb_of(hexadecimal: Column) -> Column:
    """Three numbers from 0 to 255."""
    return F.transform(F.array(F.lit(2), F.lit(4), F.lit(6)), lambda at: F.conv(F.substring(hexadecimal, at, F.lit(2)), 16, 10).cast("int"))


def label_color(hexadecimal: Column) -> Column:
    """Black on bright colours, white on dark ones: red, green and blue above 400 in all are bright."""
    return F.when(F.aggregate(rgb_of(hexadecimal), F.lit(0), lambda a, x: a + x) > 400, F.lit("black")).otherwise(F.lit("white"))
