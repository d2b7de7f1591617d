"""From a table of documents to ordered, typed, normalised and hashed blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import element_type, exact_match_hash, list_level, list_type, normalise_text, structure_hash, style_context

BLANKS = " \t\n\x0b\x0c\r"


def positional_style(ordinal: Column) -> Column:
    """A heading first, then a list item at every fifth place, else plain paragraphs."""
    return F.when(ordinal == 0, "Heading 1").when(ordinal % 5 == 4, "List Number 2").otherwise("Normal")


@dataclass(frozen=True)
class Workspace:
    """Tables of a corpus: blocks of versions, and which version of a document is current."""

    documents: DataFrame
    versions: DataFrame
    heads: DataFrame
    blocks: DataFrame


def typed_blocks(lines: DataFrame) -> DataFrame:
    """Add type, match context, normal form and hash to rows with set_id, doc_id, version_id, paragraph_index, ordinal, style and text."""
    typed = lines.withColumn("element_type", element_type(F.col("style"))).withColumn("match_context", style_context(F.col("style"))).withColumn("normalized_text", normalise_text(F.col("text")))
    return typed.withColumn("match_hash", exact_match_hash(F.col("element_type"), F.col("normalized_text"), F.col("match_context")))


def with_structure(blocks: DataFrame) -> DataFrame:
    """Add the hash of a block's structure; a column alignment is part of it where there is one."""
    nothing = F.lit(None).cast("string")
    alignment = F.col("alignment") if "alignment" in blocks.columns else nothing
    return blocks.withColumn(
        "structure_hash",
        structure_hash(element_type=F.col("element_type"), style_name=F.col("style"), list_type=list_type(F.col("style")), list_level=list_level(F.col("style")), alignment=alignment, context=nothing, matching_context=F.col("match_context")),
    )


def ingest_blocks(docs: DataFrame, set_col: str = "source", id_col: str = "doc_id", text_col: str = "text", style_rule: Callable[[Column], Column] = positional_style) -> Workspace:
    """Split texts into line blocks; blank ones are dropped, ordinals count what is left.

    The ordinal comes from the array of a document's lines, so nothing is shuffled. Every document gets version 1, which
    is current. Null texts have no blocks; a null set is a set of its own.
    """
    names = F.concat(F.lit("doc-"), F.lpad(F.col(id_col).cast("string"), 8, "0"), F.lit(".docx"))
    documents = docs.select(F.col(set_col).alias("set_id"), F.col(id_col).alias("doc_id"), names.alias("name"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("checksum"))
    version_id = F.concat(F.col("doc_id").cast("string"), F.lit(":1"))
    versions = documents.select("set_id", "doc_id", version_id.alias("version_id"), F.lit(None).cast("string").alias("parent_version_id"), F.lit(1).alias("version_number"), "checksum")
    heads = documents.select("doc_id", version_id.alias("version_id"), F.lit(1).alias("revision"))
    parts = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("paragraph_index"), F.btrim(x, F.lit(BLANKS)).alias("text")))
    kept = F.filter(parts, lambda x: x["text"] != "")
    lines = docs.select(F.col(set_col).alias("set_id"), F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("ordinal", "line")).select(
        "set_id", "doc_id", version_id.alias("version_id"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line.paragraph_index").cast("string")).alias("element_id"),
        "line.paragraph_index", "ordinal", style_rule(F.col("ordinal")).alias("style"), "line.text",
    )
    blocks = typed_blocks(lines).withColumn("shared_state", F.lit("shared")).withColumn("supported", F.lit(True))
    return Workspace(documents, versions, heads, blocks)


def write_snapshot(blocks: DataFrame, path: str) -> None:
    """Append blocks of new versions, a folder for each set."""
    blocks.write.partitionBy("set_id").mode("append").parquet(path)


def bundle_manifest(ws: Workspace, staged: DataFrame) -> DataFrame:
    """Per document its staged checksum where an edit made one, else the current version's; archive names in order."""
    current = ws.documents.join(ws.heads, "doc_id").join(ws.versions.select("version_id", F.col("checksum").alias("current_checksum")), "version_id")
    return current.join(staged.select("doc_id", F.col("checksum").alias("staged_checksum")), "doc_id", "left").select(
        "set_id", "doc_id", F.col("name").alias("archive_name"), F.coalesce("staged_checksum", "current_checksum").alias("checksum"), F.col("staged_checksum").isNotNull().alias("edited")
    )
