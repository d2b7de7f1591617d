"""Exact row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.sources.store import stored


def numbered(df: DataFrame, keys: list[str], order: list[tuple[Column, bool]], name: str) -> DataFrame:
    """df with the 1-based place of each row within its keys, as a long; order lists columns and whether they ascend.

    Rows are dealt by ranges of (keys, order), so that a hot key spreads over many tasks; places are counted within a
    range, and the rows of the ranges before it are added from a table with a row for each key and range. The ranges are
    written before they are counted, as a repeated range partitioning may cut elsewhere. Null keys are keys. Rows that tie
    in ``order`` get any order.
    """
    parts = df.select("*", *(c.alias(f"_o{i}") for i, (c, _) in enumerate(order)))
    by = [F.asc(f"_o{i}") if up else F.desc(f"_o{i}") for i, (_, up) in enumerate(order)]
    dealt = stored(parts.repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*by))
    return dealt.withColumn("_place", within).join(starts, same).select(*df.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))
