"""Integrity, freshness and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import fold_case
from wordloom.operators.ranks import numbered
from wordloom.sources.store import stored


def integrity_violations(documents: DataFrame, versions: DataFrame, heads: DataFrame, blocks: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """(check, id): documents without a first version, without a head, with a head that leads nowhere; versions without
    blocks; and files (file_id, doc_id, status) of completed legacy jobs that are no version of their document."""
    def rows(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("check"), F.col(column).cast("string").alias("id"))

    first = versions.where("version_number = 1").select("doc_id")
    found = (
        rows(documents.join(first, "doc_id", "left_anti"), "no_original_version", "doc_id")
        .unionByName(rows(documents.join(heads, "doc_id", "left_anti"), "no_head", "doc_id"))
        .unionByName(rows(heads.join(versions, "version_id", "left_anti"), "dangling_head", "doc_id"))
        .unionByName(rows(versions.join(blocks, "version_id", "left_anti"), "version_without_blocks", "version_id"))
    )
    if legacy is None:
        return found
    files = legacy.where("status = 'completed'").select(F.col("file_id").alias("version_id"), "doc_id")
    return found.unionByName(rows(files.join(versions, ["version_id", "doc_id"], "left_anti"), "legacy_file_without_version", "version_id"))


def cache_freshness(versions: DataFrame, cache: DataFrame, identity: list[str]) -> DataFrame:
    """fresh, stale, legacy (a rendition without recorded identity) or missing, by null-safe equality of the identity."""
    c = cache.select("version_id", F.lit(True).alias("cached"), *(F.col(x).alias(f"cached_{x}") for x in identity))
    same = F.lit(True)
    for x in identity:
        same = same & F.col(x).eqNullSafe(F.col(f"cached_{x}"))
    nothing = F.coalesce(*(F.col(f"cached_{x}").cast("string") for x in identity)).isNull()
    state = F.when(F.col("cached").isNull(), "missing").when(nothing, "legacy").when(same, "fresh").otherwise("stale")
    return versions.join(c, "version_id", "left").select("version_id", state.alias("state"))


def element_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("set_id", "doc_id").agg(F.count("*").alias("blocks"))


def group_counts(groups: DataFrame) -> DataFrame:
    """Link groups of each set."""
    return groups.groupBy("set_id").agg(F.count("*").alias("groups"))


def set_summary(documents: DataFrame, operations: DataFrame, legacy_jobs: DataFrame | None = None) -> DataFrame:
    """Per set: documents, completed operations and completed legacy jobs, 0 where there are none.

    With a column created_at in ``documents`` every set has the newest one and its place, newest set first, then by set.
    """
    dated = "created_at" in documents.columns
    d = documents.groupBy("set_id").agg(F.count("*").alias("documents"), *([F.max("created_at").alias("created_at")] if dated else []))
    for name, jobs in (("operations", operations), ("legacy_jobs", legacy_jobs)):
        if jobs is not None:
            n = jobs.where("status = 'completed'").groupBy(F.col("set_id").alias("_set")).agg(F.count("*").alias(name))
            d = d.join(n, F.col("set_id").eqNullSafe(F.col("_set")), "left").drop("_set").withColumn(name, F.coalesce(name, F.lit(0)))
    return numbered(d, [], [(F.col("created_at"), False), (F.col("set_id"), True)], "place") if dated else d


def job_list(operations: DataFrame, statuses: list[str], limit: int = 50) -> DataFrame:
    """The newest operations with one of the statuses, restores left out."""
    chosen = operations.where(F.col("status").isin(*statuses) & (F.col("operation_type") != "version_restore"))
    return chosen.orderBy(F.desc("created_at"), "operation_id").limit(limit)


def group_order(groups: DataFrame, detail_limit: int = 100) -> DataFrame:
    """Groups of each set by members and text; detail goes where a set has more than ``detail_limit`` groups."""
    ranked = numbered(groups, ["set_id"], [(F.col("members"), False), (F.lower("representative_text"), True), (F.col("match_hash"), True)], "place")
    many = groups.groupBy(F.col("set_id").alias("_set")).agg((F.count("*") > detail_limit).alias("_many"))
    shown = ranked.join(many, F.col("set_id").eqNullSafe(F.col("_set")))
    return shown.withColumn("representative_text", F.when(~F.col("_many"), F.col("representative_text"))).drop("_set", "_many")


def unsupported_diagnostics(blocks: DataFrame) -> DataFrame:
    """Per document, tag and reason: read-only blocks (columns reason, null for editable ones, and blocking_tag if there is one)."""
    keys = ["doc_id", *(c for c in ("blocking_tag",) if c in blocks.columns), "reason"]
    return blocks.where("reason IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("blocks"))


#: ` (n)` for copies of uploads, `-n` from 2 on for outputs of templates: text before and after a number, the first one.
NUMBERINGS = {"copy": (" (", ")", 1), "output": ("-", "", 2)}


def _stepped_over(waiting: DataFrame) -> DataFrame:
    """Numbers that copies step over: (set_id, key, n, r) -> (set_id, key, free), free being how many below n they don't.

    r copies of a name came before the file that has its number n. If they step over s lower numbers, copy n - s comes to
    n, and finds it taken unless it is one of those r. So s is carried along the numbers of a name: rows pass once, in
    order, and nothing but s is kept.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, 0
        for batch in batches:
            rows, free = [], []
            for i, (of, key, n, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("set_id", "key", "n", "r")))):
                at, s = (at, s) if at == (of, key) else ((of, key), 0)
                if s < n - r:
                    s += 1
                    rows.append(i)
                    free.append(n - s)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("set_id", "key")), pa.array(free, pa.int64())], names=["set_id", "key", "free"])

    kind = waiting.schema["set_id"].dataType.simpleString()
    return waiting.repartition("set_id", "key").sortWithinPartitions("set_id", "key", "n").select("set_id", "key", "n", "r").mapInArrow(walk, f"set_id {kind}, key string, free long")


def _number(copies: DataFrame, later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies with their numbers, and (set_id, key) of the names of ``later`` files that are given to copies before they come."""
    of = ["set_id", "key"]
    within = lambda df, keys: df.join(keys.select(F.col("set_id").alias("_s"), F.col("key").alias("_k")).distinct(), F.col("set_id").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")), "left_semi")
    came = later.where("n >= 1").groupBy("set_id", F.col("parent").alias("key"), "n").agg(F.min(F.struct("upload", "name")).alias("came"), F.min("key").alias("own_key"))
    came = stored(within(came, copies))
    near = within(copies, came).withColumn("crowded", F.lit(True))
    times = near.select(*of, "upload", "name", F.lit(None).cast("long").alias("n")).unionByName(came.select(*of, "came.upload", "came.name", "n"))
    placed = numbered(times, of, [(F.col("upload"), True), (F.col("name"), True)], "p").where("n IS NOT NULL")
    waiting = numbered(placed, of, [(F.col("p"), True)], "m").withColumn("r", F.col("p") - F.col("m"))
    steps = stored(_stepped_over(waiting))
    rest = ["upload", "name", "stem", "ext"]
    # a number that is stepped over with f free ones below it comes before copy f + 1
    line = near.select(*of, *rest, F.col("copy").alias("at"), F.lit(0).alias("step")).unionByName(steps.select(*of, F.col("free").alias("at"), F.lit(1).alias("step")), allowMissingColumns=True)
    crowded = numbered(line, of, [(F.col("at"), True), (F.col("step"), True)], "number").where("step = 0").select(*of, *rest, "number")
    alone = copies.join(came.select(F.col("set_id").alias("_s"), F.col("key").alias("_k")).distinct(), F.col("set_id").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")), "left_anti")
    taken = crowded.select(F.col("set_id").alias("_s"), F.col("key").alias("_k"), F.col("number").alias("_n"))
    given = came.join(taken, F.col("set_id").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("n") == F.col("_n")), "left_semi")
    return alone.select(*of, *rest, F.col("copy").alias("number")).unionByName(crowded), given.select("set_id", F.col("own_key").alias("key"))


def unique_names(files: DataFrame, numbering: str = "copy") -> DataFrame:
    """(set_id, upload, name) -> unique_name: a name that an earlier file of the set has gets the first free number.

    Names are told without regard to case; earlier is by upload, then name. A file may come with a number of its own, such
    as ``a (2)``: copies of ``a`` step over that number from then on, and if one has got it before, the file is a copy of
    that name. What a copy gets depends on names that end in fewer numbers only, so names are settled by how many they
    end in, from none up. Places among copies, and among copies and numbers stepped over, are counted by ranges, so that a
    hot name spreads over tasks. The number goes before the last dot that isn't among the first characters. A null set is
    a set; a null name is empty; equal rows get names of their own.
    """
    before, after, first = NUMBERINGS[numbering]
    one = re.escape(before) + r"([1-9][0-9]{0,17})" + re.escape(after)
    name = F.coalesce(F.col("name"), F.lit(""))
    cut = F.when(F.ltrim(name, F.lit(".")).contains("."), F.length(name) - F.instr(F.reverse(name), ".")).otherwise(F.length(name))
    stem, ext = F.substr(name, F.lit(1), cut), F.substr(name, cut + 1)
    number = F.regexp_extract("stem", one + r"\z", 1).try_cast("long") - (first - 1)
    ending = F.regexp_extract("stem", f"(?:{one})+\\z", 0)
    rows = files.select("set_id", "upload", name.alias("name"), stem.alias("stem"), ext.alias("ext"), fold_case(name).alias("key"))
    rows = rows.withColumn("n", number).withColumn("parent", fold_case(F.concat(F.regexp_replace("stem", one + r"\z", ""), "ext")))
    rows = stored(rows.withColumn("level", F.size(F.regexp_extract_all(ending, F.lit(one), F.lit(1)))))
    most = rows.agg(F.max("level")).first()[0]
    made, given = [], None
    for level in range(0 if most is None else most + 1):
        mine = rows.where(F.col("level") == level)
        if given is None:
            mine = mine.withColumn("free", F.lit(1))
        else:
            names = given.select(F.col("set_id").alias("_s"), F.col("key").alias("_k"))
            mine = mine.join(names, F.col("set_id").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")), "left").withColumn("free", F.col("_k").isNull().cast("int")).drop("_s", "_k")
        placed = numbered(mine, ["set_id", "key"], [(F.col("upload"), True), (F.col("name"), True)], "place").withColumn("copy", F.col("place") - F.col("free"))
        copies = placed.where("copy > 0")
        if level < most:
            copies, given = _number(stored(copies), rows.where(F.col("level") == level + 1))
        else:
            copies = copies.withColumn("number", F.col("copy"))
        new = F.concat("stem", F.lit(before), (F.col("number") + (first - 1)).cast("string"), F.lit(after), "ext")
        made += [placed.where("copy = 0").withColumn("unique_name", F.col("name")), copies.withColumn("unique_name", new)]
    made = [x.select("set_id", "upload", "name", "unique_name") for x in made] or [rows.select("set_id", "upload", "name", F.col("name").alias("unique_name"))]
    return reduce(DataFrame.unionByName, made)
