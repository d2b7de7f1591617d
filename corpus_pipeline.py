"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import delete_folder, subfolder, table, written
from wordloom.llm.jaccard_join import jaccard_components
from wordloom.llm.line_dedup import line_dedup
from wordloom.llm.mixing import mix_sources, repeat_rows
from wordloom.llm.packing import pack_documents
from wordloom.llm.quality_rules import quality_rules
from wordloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them.

    The filter also asks for a row number that is always there, as Spark pushes no filter below a row number: below the
    projections that compute the verdict its expressions would be copied into one another many times over. Repeated rows stay or go together; very long texts are
    judged whole; other columns than those of documents are left behind; an empty table stays empty.
    """
    judged = quality_rules(docs.select(*COLUMNS)).select(*COLUMNS, F.col("quality.kept").alias("kept"), F.monotonically_increasing_id().alias("number"))
    return judged.where("kept AND number >= 0").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first one alone; n_chars follows the text.

    Null texts become empty; rows with equal ids are one document; a text whose lines all go stays as an empty one. Texts of
    any length are split whole; ties go to the smallest id; other columns than those of documents are left behind; an
    empty table stays empty.
    """
    return line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays.

    Rows are told by numbers of their own: of copies with one id one stays, different texts with one id are different
    documents, and rows without an id are compared like others and come after those with one. Texts without words are
    linked with nothing and stay. Very long texts are compared whole, and an empty table stays empty.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    found = jaccard_components(rows, id_col="row", size=5, percent=80).select("row", "component_id")
    # documents alone in their component stay without meeting anything; what goes is written, so that its size is known
    # when it is joined with the texts, and few rows are broadcast
    found = written(found, "components")
    shared = found.join(found.where("row <> component_id").select("component_id").distinct(), "component_id")
    named = shared.join(rows.select("row", "doc_id"), "row")
    firsts = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))["row"].alias("first"))
    gone = written(named.join(firsts, "component_id").where("row <> first").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them; null sources are one source, texts without words are taken as their
    source's epochs say. A very long text is taken whole or not; an empty table stays empty."""
    return repeat_rows(mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences; every row is packed, repeated ones and those without an
    id or text too. Very long texts are cut into pieces; an empty table gives an empty one."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The tokenizer and the weighted draw cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing what each returns for the next one.

    Every stage of a run has a folder of its own in the shared one, for what it returns and what it writes on the way. It is
    deleted once the next stage is written, as nothing reads it then; runs side by side don't meet.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with subfolder(spark, f"run-{uuid.uuid4().hex}-{name}") as folder:
            docs = written(stage(spark, docs, sf_dir), name)
        if before:
            delete_folder(spark, before)
        before = folder
    return docs
