"""Log rows without a schema, as VARIANT: fields that may be absent, null, a number or an object are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text: str, name: str = "record") -> DataFrame:
    """``rows`` with ``text`` as a variant in ``name``; text that is no JSON is null there, and marked in ``<name>_broken``."""
    found = rows.withColumn(name, F.try_parse_json(text))
    return found.withColumn(f"{name}_broken", F.col(text).isNotNull() & F.col(name).isNull())


def kind(record: Column, path: str) -> Column:
    """absent, null, object, array, string, boolean or number of what stands at ``path``; null where there is no record."""
    found = F.try_variant_get(record, path, "variant")
    type_name = F.schema_of_variant(found)
    plain = (
        F.when(found.isNull(), "absent").when(F.is_variant_null(found), "null").when(type_name.startswith("OBJECT"), "object").when(type_name.startswith("ARRAY"), "array")
        .when(type_name == "STRING", "string").when(type_name == "BOOLEAN", "boolean").otherwise("number"))
    return F.when(record.isNotNull(), plain)


def number(record: Column, path: str, inner: str) -> Column:
    """A number at ``path``, or at ``inner`` of an object there; anything else is null."""
    return F.coalesce(F.try_variant_get(record, path, "double"), F.try_variant_get(record, f"{path}.{inner}", "double"))


def field_profile(rows: DataFrame, record: str, paths: list[str], group: str | None = None) -> DataFrame:
    """group, field, kind and n: how often each field is of each kind. Fields are pivoted inside the row and pre-aggregated."""
    each = F.array(*(F.struct(F.lit(p.removeprefix("$.")).alias("field"), kind(F.col(record), p).alias("kind")) for p in paths))
    keys = [group] if group else []
    found = rows.filter(F.col(record).isNotNull()).select(*keys, F.explode(each).alias("f"))
    return found.groupBy(*keys, F.col("f.field").alias("field"), F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"))
