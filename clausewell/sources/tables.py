"""Sources and sinks: Parquet tables, markdown corpora, JSON lines, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.functions.text import iso_seconds


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausewell-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def grown_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that appends make grow; before the first one it is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def markdown_corpus(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """type, state, source, section, title, url and text of every ``<folder>/<state>/<type>/**/*.md``.

    The heading ``# <section> — <title>`` and the line ``Source: <url>`` are read from the text; a file without a
    heading is named by its stem.
    """
    files = spark.read.text(f"{folder}/{state}", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.col("_metadata.file_path")
    kept = files.select(F.col("value").alias("text"), path.alias("source"))
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    return kept.select(
        F.regexp_extract("source", f"/{state}/([^/]+)/", 1).alias("type"), F.lit(state).alias("state"), "source",
        filled(F.regexp_extract("text", r"(?m)^# (.+?) — .+$", 1), F.lit("")).alias("section"),
        filled(F.regexp_extract("text", r"(?m)^# .+? — (.+)$", 1), F.regexp_extract("source", r"([^/]+)\.md$", 1)).alias("title"),
        F.regexp_extract("text", r"(?m)^Source: (\S+)", 1).alias("url"), "text")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log or test set of JSON lines with an explicit schema; fields that a row lacks are null."""
    return spark.read.schema(schema).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines; a log without the column ``ts`` gets the time of the write, to the second."""
    rows = rows if "ts" in rows.columns else rows.withColumn("ts", iso_seconds(F.current_timestamp()))
    rows.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and all of ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
