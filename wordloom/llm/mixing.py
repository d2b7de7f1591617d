"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import named, replaced, word_count, written

#: Characters whose share lowers a document's quality weight.
NOISE = "#*$%&|<>!@^_~=+{}[]"
NOISE_RUN = r"[#*$%&|<>!@^_~=+{}\[\]]+"


def quality_weight(text: Column) -> Column:
    """1 for clean text, down to 0.1 as the share of noise characters nears 18 %."""
    t = F.coalesce(text, F.lit(""))
    noise = F.length(t) - F.length(F.regexp_replace(t, NOISE_RUN, ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * noise / F.greatest(F.length(t), F.lit(1)))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) drawn from the first 52 bits of a digest, so that every run draws the same."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, source_col: str, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, most_sources: int = 1_000_000) -> DataFrame:
    """(source, source_size) -> one row per source with its target.

    Sources in code point order, null last, weigh ``weights``, repeating. Targets share the sum of all sizes by weight
    and stop at ``cap`` times a source's size; the excess is shared again among the others. The fixed point is a water
    level: with sources ordered by cap * size / weight, the level is the first at which the sources below are full.
    Windows run over the sources alone, one row each, in one task; more than ``most_sources`` raise an error.
    """
    sizes = written(sizes, "mix-sources")
    if (n := sizes.count()) > most_sources:
        raise ValueError(f"{n} sources, {most_sources} at most: mix by something coarser")
    order = W.orderBy(F.col(source_col).asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    full = F.lit(cap) * F.col("source_size")
    by_level = W.orderBy(full / F.col("w"), F.col(source_col).asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    first = F.min(F.when(F.col("level") <= full / F.col("w"), F.struct("rank", "level"))).over(everything)
    filled = ranked.withColumn("level", level).withColumn("rank", F.row_number().over(by_level)).withColumn("water", first["level"])
    return filled.select(source_col, "source_size", F.least(full.cast("double"), F.col("water") * F.col("w")).alias("target"))


def mix_sources(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weight: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20, buckets: int = 4096, small_plan: int = 50_000
) -> DataFrame:
    """Append size, source_size, target, copies and taken to every document.

    A source's budget is met by complete epochs (every document once) and then by a fraction: each document has the
    Efraimidis-Spirakis key -ln(u) / weight, documents go in key order, and their sizes are summed until the rest of the
    budget is reached; the document that crosses it is taken if that ends nearer to it. ``copies`` is how often the mix
    takes the document and ``taken`` is copies * size, at most ``cap`` times the size.

    The prefix sum never orders a whole source in one task: keys fall into ranges of their logarithm, ``buckets`` / 4 for
    each doubling, sizes are summed by source and range, and only the range in which a source's budget ends is ordered.
    Whatever the weights, a range of that width holds at most about 1/buckets of the documents of a source: of keys with
    any one weight no more than ln(2) * 4 / (e * buckets) fall into it.
    The plan has a row for each source and is broadcast only if its counted rows are at most ``small_plan``.

    A null text has size 0 and is never worth taking twice; a null source is a source of its own, last in order; rows
    with equal ids and texts draw the same key and are ordered as equals, so both or neither of them cross the budget.
    A very long text is one step of the sum: it is taken if half of it fits. Columns with the names appended here are
    replaced where they stand, other names can't clash; an empty table gives an empty table. Equal inputs give equal
    results on every run.
    """
    text = F.col(text_col)
    quality = quality_weight(text) if weight is None else weight
    u = uniform(seed, F.col(id_col))
    source = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), F.col(source_col).alias("src"), F.col(id_col).cast("string").alias("id"), word_count(text).alias("size"), (-F.log(u) / quality).alias("key"))
    keyed = source.withColumn("range", F.floor(F.log2("key") * (buckets / 4)).cast("int"))
    light = written(keyed.select("src", "range", "size", "key", "id"), "mix-keys")

    sums = light.groupBy("src", "range").agg(F.sum("size").alias("n"))
    targets = source_targets(sums.groupBy("src").agg(F.sum("n").alias("source_size")), "src", weights, cap)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # where the budget ends: some tens of thousands of rows a source at most
    running = W.partitionBy("src").orderBy("range")
    cut = (
        sums.withColumn("upto", F.sum("n").over(running))
        .join(targets.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")))
        .where(F.col("upto") >= F.col("rest"))
        .groupBy("s")
        .agg(F.min(F.struct(F.col("range").alias("cut_range"), (F.col("upto") - F.col("n")).alias("cut_before"))).alias("cut"))
        .select("s", "cut.cut_range", "cut.cut_before")
    )
    plan = targets.join(cut, F.col("src").eqNullSafe(F.col("s")), "left").select(F.col("src").alias("plan_source"), "source_size", "target", "epochs", "rest", "cut_range", "cut_before")
    # the last range alone is ordered; ties in the key are one step
    steps = light.join(plan, F.col("src").eqNullSafe(F.col("plan_source")) & (F.col("range") == F.col("cut_range"))).groupBy("src", "rest", "cut_before", "key", "id").agg(F.sum("size").alias("n"))
    ordered = W.partitionBy("src").orderBy("key", "id")
    steps = steps.withColumn("upto", F.col("cut_before") + F.sum("n").over(ordered)).withColumn("taken_here", F.col("upto") - F.col("n") / 2 <= F.col("rest"))
    last = steps.where("taken_here").groupBy("src").agg(F.max(F.struct("key", "id")).alias("last"))
    plan = plan.join(last.withColumnRenamed("src", "ls"), F.col("plan_source").eqNullSafe(F.col("ls")), "left").drop("ls", "rest", "cut_before")
    plan = written(plan, "mix-plan")
    if plan.count() <= small_plan:
        plan = F.broadcast(plan)

    fraction = (
        F.when(F.col("range") < F.col("cut_range"), F.lit(1))
        .when((F.col("range") == F.col("cut_range")) & (F.struct("key", "id") <= F.col("last")), F.lit(1))
        .otherwise(F.lit(0))
    )
    copies = F.least(F.lit(cap).cast("long"), F.col("epochs") + F.coalesce(fraction, F.lit(0)))
    planned = keyed.join(plan, F.col("src").eqNullSafe(F.col("plan_source"))).withColumn("copies", copies)
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": (F.col("copies") * F.col("size")).cast("long")}
    return planned.select(*replaced(F.col("row"), docs.columns, new))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Every document as many times as the mix takes it; those it doesn't take go."""
    times = F.array_repeat(F.struct(*(named(c) for c in mixed.columns)), F.col("copies").cast("int"))
    return mixed.where(F.col("copies") > 0).select(F.explode(times).alias("row")).select("row.*")
