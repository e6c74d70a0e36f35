"""Collections of chunks as Parquet tables: rebuilt whole, read by section, exported in chunk order; and label manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.functions.text import chunk_order

MANIFEST = "leases array<struct<file: string, category: string, red: map<string, array<string>>, missing_protections: array<string>>>"


def rebuild(chunks: DataFrame, path: str) -> None:
    """Drop what the collection holds and write ``chunks`` instead. They must not be read from ``path``."""
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, section: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A collection, or one section of it; filter and columns reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("section") == section) if section is not None else rows
    return rows.select(*columns) if columns else rows


def export(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy a collection in the order of its chunks, ids as they are: files hold ranges that follow one another."""
    rows = spark.read.parquet(source).withColumn("ord", chunk_order(F.col("chunk_id")))
    rebuild(rows.repartitionByRange("ord").sortWithinPartitions("ord", "chunk_id"), target)
    return spark.read.schema(rows.schema).parquet(target)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, category and missing_protections of every document that a manifest lists, with its planted clauses ``red``."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("leases").alias("lease")).select("lease.*")


def planted(documents: DataFrame) -> DataFrame:
    """(file, number, accepted): a manifest's planted clauses by their printed numbers."""
    each = documents.select("file", F.explode("red").alias("number", "accepted"))
    return each.withColumn("number", F.col("number").try_cast("int"))
