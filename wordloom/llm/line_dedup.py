"""Line deduplication: a line that several documents share stays only in the document with the smallest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import BLANKS, ascii_lower, named, replaced, two_hashes, written


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Replace the text by its kept lines and append n_lines and n_dropped (longs).

    Lines of all documents are exploded and hashed, distinct documents are counted per hash, and every line whose key
    has at least ``min_chars`` code points and is found in at least ``min_docs`` documents goes, except in the document
    with the smallest id that holds it. The kept lines are joined in their order.

    Lines are split and hashed once; only hashes, ids and positions are shuffled by line, and whole texts move once, to
    meet their own positions. Lines are told by two 64-bit hashes, whatever their length; a hot line is counted before the
    shuffle, and its rows meet the shared keys in a join that splits hot partitions.
    A null or empty text is one empty line. A null id counts as one document after all others. Rows with the same id are
    one document: the line stays in each of them or goes from each of them. Input columns stay; clashing n_lines and
    n_dropped are replaced, other names can't clash; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row is told by its id and its text, so that equal rows share one decision
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), *(h.alias(f"m{i}") for i, h in enumerate(two_hashes(text))), F.struct(*(named(c) for c in docs.columns)).alias("row"))
    lines = source.select("id", "m0", "m1", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars).select("id", "m0", "m1", "pos", *(h.alias(f"k{i}") for i, h in enumerate(two_hashes(F.col("key")))))
    keyed = written(keyed, "line-keys")

    held = keyed.select("k0", "k1", "id")
    if min_docs > 2:
        held = held.distinct()
    counts = held.groupBy("k0", "k1").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max(F.col("id").isNull()).alias("unnamed"), F.count("*").alias("n"))
    if min_docs > 2:
        shared = F.col("n") >= min_docs
    else:
        shared = (F.col("first_id") < F.col("last_id")) | (F.col("unnamed") & F.col("first_id").isNotNull())
    # written, so that both sides of the next join are plain exchanges and a hot line's partition can be split
    common = written(counts.where(shared).select("k0", "k1", "first_id"), "lines")
    drops = (
        keyed.join(common, ["k0", "k1"])
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy("id", "m0", "m1")
        .agg(F.sort_array(F.collect_set("pos")).alias("drops"))
        .withColumnsRenamed({"id": "drop_id", "m0": "d0", "m1": "d1"})
    )
    same = F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("m0") == F.col("d0")) & (F.col("m1") == F.col("d1"))
    parts = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drops")), lambda i: F.get(F.col("parts"), i))
    joined = source.join(drops, same, "left").withColumn("parts", F.when(F.col("drops").isNotNull(), parts))
    new = {
        text_col: F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size(parts).cast("long"),
        "n_dropped": F.coalesce(F.size("drops"), F.lit(0)).cast("long"),
    }
    return joined.select(*replaced(F.col("row"), docs.columns, new))
