"""Version chains: history, lineage, text at a version, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators.ranks import numbered
from wordloom.sources.store import stored


def version_summary(heads: DataFrame, versions: DataFrame) -> DataFrame:
    """The current version of each document."""
    return heads.join(versions.drop("doc_id"), "version_id").select("doc_id", "version_id", "version_number", "revision")


def version_history(versions: DataFrame, heads: DataFrame, restores: DataFrame | None = None) -> DataFrame:
    """All versions of each document, newest first within it, the current one marked.

    restores (version_id, restored_from): versions that a restore made, and the ones they copy; with it every version has
    restored_from_version_id and restored_from_version_number, null unless a restore made it.
    """
    current = heads.select("version_id", F.lit(True).alias("is_current"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("version_number")))
    out = versions.join(current, "version_id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False))).withColumn("place", place)
    if restores is None:
        return out
    origin = versions.select(F.col("version_id").alias("restored_from_version_id"), F.col("version_number").alias("restored_from_version_number"))
    made = restores.select("version_id", F.col("restored_from").alias("restored_from_version_id")).join(origin, "restored_from_version_id", "left")
    return out.join(made, "version_id", "left")


def next_version_number(versions: DataFrame, bases: DataFrame) -> DataFrame:
    """(doc_id, base_number) -> the number an edit gets, base + 1, and the one a restore gets, max + 1."""
    most = versions.groupBy("doc_id").agg(F.max("version_number").alias("last"))
    return bases.join(most, "doc_id").select("doc_id", (F.col("base_number") + 1).alias("edit_number"), (F.col("last") + 1).alias("restore_number"))


def lineage(versions: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, version_id, distance): all ancestors of the current version by parent pointer; of a cycle each one once.

    Each step is a join for all documents at once, with distances doubling: pointers to the 2^k-th ancestor. It ends with
    the first step that reaches no further version, so a chain of n versions takes about log2(n) steps; steps are written.
    """
    jump = versions.select(F.col("version_id").alias("child"), F.col("parent_version_id").alias("up")).where("up IS NOT NULL")
    reached = heads.select("doc_id", "version_id", F.lit(0).cast("long").alias("distance"))
    known, step = reached.count(), 1
    while True:
        further = reached.join(jump, reached["version_id"] == jump["child"]).select("doc_id", F.col("up").alias("version_id"), (F.col("distance") + step).alias("distance"))
        reached = stored(reached.unionByName(further).groupBy("doc_id", "version_id").agg(F.min("distance").alias("distance")))
        now = reached.count()
        if now == known:
            return reached.withColumn("distance", F.col("distance").cast("int"))
        known, step = now, step * 2
        hop = jump.select(F.col("child").alias("mid"), F.col("up").alias("far"))
        jump = stored(jump.join(hop, jump["up"] == hop["mid"]).select("child", F.col("far").alias("up")))


def text_at_version(states: DataFrame, key: list[str], order: str, before: str, now: str) -> DataFrame:
    """Replay backwards: at version v an element has the before-text of the first later version that touched it, else today's.

    Chains are dealt by ranges of (key, order), so that one of any length spreads over tasks. Within a range the last text
    met going backwards is carried along; what a range carries on comes from the ranges after it, a row for each key and
    range. Nothing is scanned twice. Null keys are keys; versions of one element with equal order get any order.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    named = states.withColumns({k: F.col(c) for k, c in zip(keys, key)} | {"_o": F.col(order)})
    dealt = stored(named.repartitionByRange(*keys, F.desc("_o")).withColumn("_range", F.spark_partition_id()))
    back = W.partitionBy(*keys, "_range").orderBy(F.desc("_o")).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.last(before, ignorenulls=True).over(back))
    ends = dealt.where(F.col(before).isNotNull()).groupBy(*keys, "_range").agg(F.min_by(before, "_o").alias("_first"))
    every = dealt.select(*keys, "_range").distinct().join(ends.withColumnsRenamed({k: f"_e{k}" for k in keys} | {"_range": "_r"}), _equal(keys, "_e") & (F.col("_range") == F.col("_r")), "left")
    carried = F.last("_first", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    carried = every.select(*(F.col(k).alias(f"_c{k}") for k in keys), F.col("_range").alias("_r"), carried.alias("_carried")).where("_carried IS NOT NULL")
    out = own.join(carried, _equal(keys, "_c") & (F.col("_range") == F.col("_r")), "left")
    return out.select(*states.columns, F.coalesce("_own", "_carried", F.col(now)).alias("text_at_version"))


def _equal(keys: list[str], prefix: str) -> Column:
    """Columns equal those of the same names with a prefix; null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def version_diff(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Blocks of two versions by place: unchanged, changed, added or removed, with the hashes concerned."""
    b = base.select(*key, F.col("match_hash").alias("old_hash"), F.lit(True).alias("in_base"))
    n = new.select(*key, F.col("match_hash").alias("new_hash"), F.lit(True).alias("in_new"))
    state = F.when(F.col("in_base").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return b.join(n, key, "full_outer").select(*key, state.alias("state"), "old_hash", "new_hash")


def changed_hashes(diff: DataFrame) -> DataFrame:
    """Distinct hashes that a change takes away or brings."""
    rows = diff.where("state <> 'unchanged'").select(F.explode(F.array("old_hash", "new_hash")).alias("match_hash"))
    return rows.where("match_hash IS NOT NULL").distinct()


def history_events(operations: DataFrame, targets: DataFrame, versions: DataFrame) -> DataFrame:
    """Per operation: how many targets and versions it has, and which, in order.

    targets: operation_id, element_id; versions: operation_id, version_id. An operation's own lists are gathered, which its
    limit of targets bounds.
    """
    t = targets.groupBy("operation_id").agg(F.count("*").alias("targets"), F.sort_array(F.collect_list("element_id")).alias("target_elements"))
    v = versions.groupBy("operation_id").agg(F.count("*").alias("versions"), F.sort_array(F.collect_list("version_id")).alias("version_ids"))
    out = operations.join(t, "operation_id", "left").join(v, "operation_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind.simpleString()}>"))
    lists = {"target_elements": targets.schema["element_id"].dataType, "version_ids": versions.schema["version_id"].dataType}
    return out.withColumns({"targets": F.coalesce("targets", F.lit(0)), "versions": F.coalesce("versions", F.lit(0)), **{k: none(F.col(k), t) for k, t in lists.items()}})


def history_union(*events: DataFrame) -> DataFrame:
    """Events of several kinds as one table, each with its place among the set's, newest first."""
    both = events[0]
    for e in events[1:]:
        both = both.unionByName(e)
    return numbered(both, ["set_id"], [(F.col("created_at"), False), (F.col("event_id"), True)], "place")


def backfill_lineage(files: DataFrame, documents: DataFrame | None = None, versions: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Numbered chains from files without versions: order by time and id, parents by lag, the last one current.

    files: doc_id, file_id, created_at. With ``documents`` (doc_id) every document also gets an original version, whose id
    is the document's and which is parent of its first file, unless ``versions`` (doc_id, version_id, version_number,
    file_id: null for originals) has it. Versions known there keep their numbers; the original takes the first free
    number, new files the numbers after all others. A document in ``heads`` (doc_id, version_id) keeps its current version.
    """
    w = W.partitionBy("doc_id").orderBy("created_at", "file_id")
    if documents is None:
        return files.select(
            "doc_id", "file_id", F.row_number().over(w).alias("version_number"), F.lag("file_id").over(w).alias("parent_file_id"), F.lead("file_id").over(w).isNull().alias("is_current")
        )
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    if versions is None:
        versions = spark.createDataFrame([], f"doc_id {kind}, version_id string, version_number int, file_id string")
    if heads is None:
        heads = spark.createDataFrame([], f"doc_id {kind}, version_id string")
    number = F.col("version_number").cast("int")
    facts = versions.groupBy("doc_id").agg(F.max(number).alias("last"), F.sort_array(F.collect_set(number)).alias("used"), F.max(F.when(F.col("file_id").isNull(), F.col("version_id"))).alias("original"))
    # the numbers used are those of one document; the first gap is where a sorted number isn't its place
    gap = F.coalesce(F.element_at(F.filter(F.sequence(F.lit(1), F.size("used") + 1), lambda i: ~F.array_contains("used", i)), 1), F.lit(1))
    base = documents.select("doc_id").join(facts, "doc_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    base = base.withColumn("gap", gap).withColumn("top", F.greatest(F.coalesce("last", F.lit(0)), F.when(F.col("original").isNull(), F.col("gap")).otherwise(0)))
    base = base.select("doc_id", "original", "gap", "top", F.coalesce("original", F.col("doc_id").cast("string")).alias("root"))
    known = versions.where("file_id IS NOT NULL").select("doc_id", "file_id", F.col("version_id").alias("known_id"), number.alias("known_number"))
    new = F.col("known_id").isNull()
    chain = files.join(base, "doc_id").join(known, ["doc_id", "file_id"], "left").withColumn("id", F.coalesce("known_id", F.col("file_id").cast("string")))
    made = chain.select(
        "doc_id", F.col("id").alias("version_id"), F.coalesce("known_number", F.col("top") + F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).alias("version_number"),
        F.coalesce(F.lag("id").over(w), "root").alias("parent_version_id"), F.lead("id").over(w).isNull().alias("last_file"), new.alias("new"),
    )
    with_files = files.select("doc_id").distinct().withColumn("has_files", F.lit(True))
    originals = base.join(with_files, "doc_id", "left").select(
        "doc_id", F.col("root").alias("version_id"), F.when(F.col("original").isNull(), F.col("gap")).alias("version_number"), F.lit(None).cast("string").alias("parent_version_id"), F.col("has_files").isNull().alias("last_file"), F.col("original").isNull().alias("new"),
    )
    both = originals.unionByName(made).join(heads.select("doc_id", F.col("version_id").alias("head")), "doc_id", "left")
    current = F.coalesce(F.col("head") == F.col("version_id"), F.col("last_file"))
    return both.where("new").select("doc_id", "version_id", "version_number", "parent_version_id", current.alias("is_current"))


def merge_job_updates(updates: DataFrame, limit: int = 20) -> DataFrame:
    """The last state of each job, the newest ``limit`` jobs by when they were submitted."""
    last = updates.groupBy("job_id").agg(F.max_by(F.struct("status", "value"), F.struct("ts", "event_id")).alias("last"), F.min("ts").alias("submitted_at"))
    return last.orderBy(F.desc("submitted_at"), "job_id").limit(limit).select("job_id", "last.status", "last.value", "submitted_at")


def retain_newest(df: DataFrame, key: str, order: str, n: int, tie: str) -> DataFrame:
    """Each row with whether it is among the newest n of its key."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))
    return df.withColumn("keep", place <= n)


def timing_summary(df: DataFrame, group: str, value: str, baseline: float) -> DataFrame:
    """Median, maximum, nearest-rank 95th percentile and improvement of the median on a baseline, in percent.

    All are values at certain ranks, and ranks of a group of any size are counted by ranges. Nulls don't count; a group
    of nulls alone has no row.
    """
    ranked = numbered(df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")), ["g"], [(F.col("v"), True)], "rank")
    sizes = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("size_of")).agg(F.count("*").alias("n"))
    at95 = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") * F.lit(0.95) + 0.5)))
    middle = F.col("rank").isin(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    out = ranked.join(sizes, F.col("g").eqNullSafe(F.col("size_of"))).groupBy("g").agg(
        F.avg(F.when(middle, F.col("v"))).alias("median"), F.max("v").alias("max"), F.max(F.when(F.col("rank") == at95, F.col("v"))).alias("p95")
    )
    return out.select(F.col("g").alias(group), "median", "max", "p95", ((baseline - F.col("median")) / baseline * 100).alias("improvement"))
