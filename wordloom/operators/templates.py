"""Templates filled from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import fold_case, placeholders, safe_output_name
from wordloom.operators.checks import unique_names

# Fixed value: the grammar of a placeholder.
_PLACE = r"\{\{\s*([A-Za-z][A-Za-z0-9_]*)\s*\}\}"


def rendered(template: Column, values: Column) -> Column:
    """The template with its placeholders filled once: what a value contains isn't expanded again."""
    texts = F.split(template, _PLACE, -1)
    names = F.regexp_extract_all(template, F.lit(_PLACE), F.lit(1))
    filled = F.transform(names, lambda n: F.coalesce(values[n], F.lit("")))
    return F.array_join(F.zip_with(texts, filled, lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))), "")


def render_templates(template: str, records: DataFrame) -> DataFrame:
    """The template filled from every record (name, values)."""
    return records.select("name", rendered(F.lit(template), F.col("values")).alias("output"))


def missing_values(template: str, records: DataFrame) -> DataFrame:
    """(name, field) for every placeholder whose value is blank or absent."""
    fields = records.select("name", "values", F.explode(placeholders(F.lit(template))).alias("field"))
    return fields.where(F.btrim(F.coalesce(F.col("values")[F.col("field")], F.lit(""))) == "").select("name", "field")


def reconcile_records(template: Column, values: Column) -> Column:
    """The template's fields alone, absent ones empty."""
    return F.map_from_entries(F.transform(placeholders(template), lambda n: F.struct(n, F.coalesce(values[n], F.lit("")))))


def template_violations(template: Column, longest: int = 100_000, most_fields: int = 50) -> Column:
    """Why a template can't be rendered, as an array of codes; empty if it can."""
    n = F.size(placeholders(template))
    checks = F.array(F.when(F.btrim(template) == "", "empty_template"), F.when(F.length(template) > longest, "template_too_long"), F.when(n == 0, "no_placeholder"), F.when(n > most_fields, "too_many_fields"))
    return F.filter(checks, lambda x: x.isNotNull())


def record_violations(template: str, records: DataFrame, longest_name: int = 200, longest_value: int = 10_000, least: int = 2, most: int | None = None) -> DataFrame:
    """(name, violation) of a batch, a row each; none if it can be rendered.

    Names must be there, short enough and different without regard to case; every placeholder needs a value that isn't
    blank or too long; names of values must be names of fields. ``least`` and ``most`` limit the records (no limit if null).
    """
    shown = records.withColumn("name", F.btrim(F.coalesce("name", F.lit(""))))
    fields = placeholders(F.lit(template))
    value = lambda f: F.col("values")[f]
    checks = F.array(
        F.when((F.col("name") == "") | (F.length("name") > longest_name), "invalid_name"),
        F.when(F.exists(fields, lambda f: F.btrim(F.coalesce(value(f), F.lit(""))) == ""), "missing_value"),
        F.when(F.exists(fields, lambda f: F.coalesce(F.length(value(f)) > longest_value, F.lit(False))), "value_too_long"),
        F.when(F.exists(F.coalesce(F.map_keys("values"), F.array().cast("array<string>")), lambda k: ~k.rlike(r"^[A-Za-z][A-Za-z0-9_]*$")), "invalid_field"),
    )
    rows = shown.select("name", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("violation"))
    twice = shown.groupBy(fold_case(F.col("name")).alias("k")).agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1").select("name", F.lit("duplicate_name").alias("violation"))
    n = records.agg(F.count("*").alias("n"))
    count = F.when(F.col("n") < least, "not_enough_records").when(F.col("n") > (most if most is not None else F.lit(None).cast("long")), "too_many_records")
    return rows.unionByName(twice).unionByName(n.select(F.lit(None).cast("string").alias("name"), count.alias("violation")).where("violation IS NOT NULL")).distinct()


def output_names(records: DataFrame) -> DataFrame:
    """(name, upload) -> file_name of every record's output, different without regard to case: base, base-2, base-3.

    records: set_id (a batch), upload (its place, from 1) and name.
    """
    base = safe_output_name(F.btrim("name"), F.concat(F.lit("Record-"), F.col("upload").cast("string")))
    named = unique_names(records.select("set_id", "upload", F.concat(base, F.lit(".txt")).alias("name")), "output")
    return named.select("set_id", "upload", F.col("unique_name").alias("file_name"))
