"""Files that arrive over time: facts by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_facts
from ..sources.files import decode_utf8


def watch(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Facts of every file that comes to be below a folder, each file once; a stream to write or to join."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return extract_facts(decode_utf8(found.select(F.regexp_replace("path", r"^[a-z]+:(?://[^/]*)?(?=/)", "").alias("path"), "content")))
