"""Tables, shared scratch storage (from runtime) and small Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from ..runtime import forget, shared_dir, stored

__all__ = ["crc_part", "forget", "fresh", "long_ids", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(key: str | Column, parts: int) -> Column:
    """crc32 of the key as decimal text, modulo parts."""
    return F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(parts))


def long_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with `key` as a long. Keys that aren't whole numbers are refused here, by name, and not within a task."""
    kind = df.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{key} must be a column of whole numbers, not {kind.simpleString()}")
    return df if isinstance(kind, LongType) else df.withColumn(key, F.col(key).cast("long"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
