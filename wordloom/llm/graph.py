"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(a, b) -> (v, comp): the smallest vertex reachable, for every vertex that has an edge to another one.

    Each step replaces edges by stars around smaller vertices and never adds any, so the work of a step is linear in the
    edges and the number of steps is logarithmic. Steps are written to the shared folder. Nulls, loops and repeated
    edges are ignored; an empty table gives an empty table.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    seen = None
    for _ in range(max_steps):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest one
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a vertex and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {max_steps} steps")
    leaves = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("v"), "comp")
    return leaves.unionByName(leaves.select(F.col("comp").alias("v"), "comp").distinct())
