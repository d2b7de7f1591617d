"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
#: Java pattern for a run of them.
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


_OWN_DIRS: dict[str, str] = {}
_SUBFOLDER = "wordloom.subfolder"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to the named columns (all of them if none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a new one in tests."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN_DIRS:
        _OWN_DIRS[application] = tempfile.mkdtemp(prefix="spark-wordloom-")
    return _OWN_DIRS[application]


@contextmanager
def subfolder(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables that this thread writes meanwhile go to a folder of this name in the shared one; gives its path."""
    sc = spark.sparkContext
    before = sc.getLocalProperty(_SUBFOLDER)
    sc.setLocalProperty(_SUBFOLDER, name)
    try:
        yield f"{shared_dir(spark)}/{name}"
    finally:
        sc.setLocalProperty(_SUBFOLDER, before)


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    A lost executor then costs the tasks it ran, not the stages before the cut.
    """
    spark = df.sparkSession
    inner = spark.sparkContext.getLocalProperty(_SUBFOLDER)
    path = "/".join(x for x in (shared_dir(spark), inner, f"{label}-{uuid.uuid4().hex}") if x)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables that nothing still to be computed reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a written table that nothing still to be computed reads."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        delete_folder(table.sparkSession, folder)


def named(column: str) -> Column:
    """A column by its very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def replaced(row: Column, columns: list[str], new: dict[str, Column]) -> list[Column]:
    """The columns of a row kept as one struct, those in ``new`` replaced where they stand, or appended."""
    lower = {k.lower(): k for k in new}
    kept = [new[lower[c.lower()]].alias(c) if c.lower() in lower else row.getField(c).alias(c) for c in columns]
    there = {c.lower() for c in columns}
    return kept + [v.alias(k) for k, v in new.items() if k.lower() not in there]


def two_hashes(c: Column) -> tuple[Column, Column]:
    """128 bits of a value as two longs: the hash from two starting points."""
    return F.xxhash64(c), F.xxhash64(F.lit(20), c)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; none for a null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANK_RUN), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words: every blank made a space, split at single spaces, empty parts left out."""
    spaced = F.coalesce(c, F.lit(""))
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


class BitFilter:
    """A broadcast bit array that is set for all given longs: it only spares work, an exact join follows.

    The longs are hashes: of others, as row numbers, many may have the same low bits, which fills the array for all.
    It has sixteen bits for each of them, up to 2^30 bits (128 MB); a fuller array beyond that bound loses nothing.
    """

    def __init__(self, df: DataFrame, column: str) -> None:
        self.bits = 1 << min(30, max(20, (16 * df.count()).bit_length()))
        slot = F.pmod(F.col(column), F.lit(self.bits))
        words = df.groupBy(F.floor(slot / 63).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 63).cast("int"))).alias("b"))
        table = np.zeros(self.bits // 63 + 1, dtype=np.int64)
        for r in words.toLocalIterator():
            table[r["w"]] = r["b"]
        self.table: Broadcast = df.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        slot = values % self.bits
        return ((self.table.value[slot // 63] >> (slot % 63)) & 1) == 1

