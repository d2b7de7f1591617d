"""Versioned edits: validation, preview, new snapshots, restore, link-group maintenance. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.text import alignment_of, delta_violations, delta_with_replacement, restyled
from wordloom.operators.checks import unique_names
from wordloom.operators.matching import KIND, THRESHOLD, asked_blocks, compatible, current_blocks, exact_link_groups, latest_decisions, pair_score
from wordloom.sources.ingest import Workspace, ingest_blocks, typed_blocks, with_structure

MAX_TARGETS, MAX_CHARS = 500, 20_000


def stale_bases(request: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, base_version_id) of a request -> conflict where another version is current, unknown where there is none."""
    state = F.when(F.col("version_id").isNull(), "unknown").when(F.col("version_id") == F.col("base_version_id"), "ok").otherwise("conflict")
    return request.join(heads.select("doc_id", "version_id"), "doc_id", "left").select("doc_id", state.alias("state"))


def overlapping_operations(pending: DataFrame, request: DataFrame) -> DataFrame:
    """Pending operations (operation_id, documents) that touch a document of the request.

    With a column request_id in the request, pairs (request_id, operation_id) for each of its requests.
    """
    ids = [c for c in ("request_id",) if c in request.columns]
    touched = pending.select("operation_id", F.explode("documents").alias("doc_id"))
    return touched.join(request.select(*ids, "doc_id").distinct(), "doc_id", "inner" if ids else "left_semi").select(*ids, "operation_id").distinct()


def resolve_targets(targets: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Targets with match_type, decision, score and mode -> accepted or not, and why not."""
    near = F.col("match_type") == "near"
    reason = (
        F.when(F.col("decision").isin("ignored", "removed"), F.concat(F.lit("match_"), F.col("decision")))
        .when((F.col("mode") == "override") & (F.col("match_type") != "source"), "override_takes_source_only")
        .when(near & (F.col("decision") != "confirmed"), "near_not_confirmed")
        .when(near & (F.col("score") < threshold), "below_threshold")
    )
    return targets.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def validate_edit(blocks: DataFrame, heads: DataFrame, targets: DataFrame) -> DataFrame:
    """Violations of a request (element_id, doc_id, base_version_id, replacement), a row each; none if it is valid.

    With a column request_id every request is judged by itself, and the violations have it too.
    """
    ids = [c for c in ("request_id",) if c in targets.columns]
    b = targets.join(blocks.select("element_id", "supported", F.col("version_id").alias("found_version")), "element_id", "left").join(heads.select("doc_id", F.col("version_id").alias("head")), "doc_id", "left")
    w = W.partitionBy(*ids, "element_id")
    checks = F.array(
        F.when(F.col("found_version").isNull(), "unknown_element"),
        F.when(F.col("supported") == F.lit(False), "unsupported"),
        F.when(~F.col("base_version_id").eqNullSafe(F.col("head")), "stale_base"),
        F.when(F.length("replacement") > MAX_CHARS, "too_long"),
        F.when(F.col("times") > 1, "duplicate_target"),
    )
    found = b.withColumn("times", F.count("*").over(w)).select(*ids, "element_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("violation"))
    many = targets.groupBy(*ids).agg(F.count("*").alias("n")).where(F.col("n") > MAX_TARGETS).select(*ids, F.lit(None).cast("string").alias("element_id"), F.lit("too_many_targets").alias("violation"))
    return found.distinct().unionByName(many)


def validate_requests(ws: Workspace, requests: DataFrame, bases: DataFrame, targets: DataFrame, decisions: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(request_id, element_id, violation) of whole edit requests, a row each; a valid request has none.

    requests: request_id, set_id, source_element_id; bases: request_id, doc_id, base_version_id; targets: request_id,
    element_id, replacement, decision (on this candidate in the request, null if none), and ops, a delta, where there is
    such a column. Stored decisions (source_element_id, candidate_element_id, decision) confirm a near match too.

    Bases must be current versions of documents of the set; the source must be one of the targets, and it and they must be
    editable blocks of the bases; targets must be the source, equal to it, or confirmed near matches of its kind that reach
    the threshold; deltas must spell their replacement; replacements and targets have limits.
    """
    cols = ("doc_id", "version_id", "ordinal", "normalized_text", "context", "match_hash", "shared_state", "supported", *KIND)
    ids = requests.select(F.col("source_element_id").alias("element_id")).unionByName(targets.select("element_id"))
    now = asked_blocks(ws, ids, "doc_id", "match_hash", "shared_state", "supported", *KIND)
    side = lambda p, e: now.select(F.col("element_id").alias(e), *(F.col(c).alias(f"{p}{c}") for c in cols))
    asked = requests.select("request_id", F.col("set_id").alias("asked_set"), "source_element_id")
    base = bases.join(asked, "request_id").join(ws.documents.select("doc_id", "set_id"), "doc_id", "left").join(ws.heads.select("doc_id", F.col("version_id").alias("head")), "doc_id", "left")
    foreign = ~F.col("set_id").eqNullSafe(F.col("asked_set")) | F.col("head").isNull()
    none = F.lit(None).cast("string")
    base_rows = base.select("request_id", none.alias("element_id"), F.when(foreign, "foreign_base").when(F.col("base_version_id") != F.col("head"), "stale_base").alias("violation"))

    given = bases.select("request_id", F.col("doc_id").alias("base_doc")).distinct()
    # replacements and deltas are judged beside this, as their texts need not meet the blocks'
    met = targets.select("request_id", "element_id", "decision").join(asked, "request_id").join(side("source_", "source_element_id"), "source_element_id", "left").join(side("", "element_id"), "element_id", "left")
    met = met.join(given.withColumn("based", F.lit(True)), (met["request_id"] == given["request_id"]) & (met["doc_id"] == F.col("base_doc")), "left").drop(given["request_id"])
    is_source = F.col("element_id") == F.col("source_element_id")
    is_exact = (F.col("match_hash") == F.col("source_match_hash")) & (F.col("shared_state") == "shared") & (F.col("source_shared_state") == "shared")
    near = ~is_source & ~F.coalesce(is_exact, F.lit(False))
    met = met.withColumn("reached", pair_score(near & F.col("doc_id").isNotNull() & F.col("source_doc_id").isNotNull(), "source_", "", threshold) >= threshold)
    confirmed = F.col("decision") == "confirmed"
    if decisions is not None:
        kept = latest_decisions(decisions).where("decision = 'confirmed'").select("source_element_id", F.col("candidate_element_id").alias("element_id"), F.lit(True).alias("stored"))
        met = met.join(kept, ["source_element_id", "element_id"], "left")
        confirmed = F.coalesce(confirmed, F.lit(False)) | F.coalesce("stored", F.lit(False))
    confirmed = F.coalesce(confirmed, F.lit(False))
    checks = [
        F.when(F.col("doc_id").isNull(), "unknown_element"),
        F.when(F.col("doc_id").isNotNull() & ~F.col("set_id").eqNullSafe(F.col("asked_set")), "other_set"),
        F.when(F.col("doc_id").isNotNull() & F.col("based").isNull(), "no_base"),
        F.when(F.col("supported") == F.lit(False), "unsupported"),
        F.when(F.col("doc_id").isNotNull() & F.col("source_doc_id").isNotNull() & ~compatible("source_", ""), "incompatible"),
        F.when(near & confirmed & ~F.coalesce("reached", F.lit(False)), "below_threshold"),
        F.when(near & ~confirmed, "near_not_confirmed"),
        F.when(F.col("decision").isin("ignored", "removed"), F.concat(F.lit("match_"), F.col("decision"))),
    ]
    rows = met.select("request_id", "element_id", F.explode(F.array(*checks)).alias("violation"))
    texts = targets.join(requests.select("request_id"), "request_id", "left_semi")
    long = texts.where(F.length("replacement") > MAX_CHARS).select("request_id", "element_id", F.lit("too_long").alias("violation"))
    rows = rows.unionByName(long)
    if "ops" in targets.columns:
        spelt = texts.where(F.col("ops").isNotNull()).join(side("", "element_id").select("element_id", "element_type"), "element_id", "left")
        rows = rows.unionByName(spelt.select("request_id", "element_id", F.explode(delta_violations(F.col("ops"), F.col("replacement"), F.col("element_type"))).alias("violation")))

    held = targets.select("request_id", F.col("element_id").alias("source_element_id"), F.lit(True).alias("held")).distinct()
    source = asked.join(side("", "source_element_id"), "source_element_id", "left").join(held, ["request_id", "source_element_id"], "left")
    source_rows = source.select("request_id", F.col("source_element_id").alias("element_id"), F.when(F.col("doc_id").isNull(), "unknown_source").when(F.col("held").isNull(), "source_left_out").alias("violation"))
    twice = targets.groupBy("request_id", "element_id").agg(F.count("*").alias("n")).where("n > 1").select("request_id", "element_id", F.lit("duplicate_target").alias("violation"))
    many = targets.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_TARGETS).select("request_id", none.alias("element_id"), F.lit("too_many_targets").alias("violation"))
    out = base_rows.unionByName(rows).unionByName(source_rows).unionByName(twice).unionByName(many)
    return out.where("violation IS NOT NULL").distinct()


def preview_edit(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Before and after of every target. Writes nothing."""
    return blocks.join(targets.select("element_id", "replacement"), "element_id").select("set_id", "doc_id", "element_id", "ordinal", F.col("text").alias("before_text"), F.col("replacement").alias("after_text"))


def edit_impact(preview: DataFrame) -> DataFrame:
    """Per document: its changed places in order."""
    return preview.groupBy("doc_id").agg(F.count("*").alias("locations"), F.sort_array(F.collect_list(F.struct("ordinal", "before_text", "after_text"))).alias("changes"))


def apply_edit(ws: Workspace, targets: DataFrame, mode: str = "shared") -> Workspace:
    """A workspace with a new version of every document that has a target (element_id, replacement).

    Targeted blocks get the new text, normal form and hash, the others of these documents are copied; ids and ordinals
    stay. ``override`` detaches the targets. Heads move on, revisions count up, parents are the bases.

    Targets may have deltas (column ops, null for none), whose newline states the block's format: it sets style, type and
    alignment. Blocks that keep deltas get the target's, or their own with the new text in its first format; alignment and
    structure_hash are kept up where blocks have them.
    """
    touched = ws.blocks.join(ws.heads.select("version_id"), "version_id", "left_semi").join(targets.select("element_id", "replacement"), "element_id").select("doc_id").distinct()
    bases = ws.heads.join(touched, "doc_id", "left_semi").join(ws.versions.select("version_id", "version_number"), "version_id").select("doc_id", F.col("version_id").alias("base"), "version_number", "revision")
    numbered = bases.withColumn("new_version", F.concat(F.col("doc_id").cast("string"), F.lit(":"), (F.col("version_number") + 1).cast("string")))
    formatted = "ops" in targets.columns
    given = targets.select("element_id", "replacement", *([F.col("ops").alias("_ops")] if formatted else []))
    old = ws.blocks.join(numbered.select(F.col("base").alias("version_id"), "new_version"), "version_id").join(given, "element_id", "left")
    state = F.when(F.col("replacement").isNotNull(), F.lit("detached" if mode == "override" else "shared")).otherwise(F.col("shared_state"))
    lines = old.withColumn("version_id", F.col("new_version")).withColumn("text", F.coalesce("replacement", "text")).withColumn("shared_state", state)
    if formatted:
        lines = lines.withColumn("style", restyled(F.col("style"), F.col("_ops")))
    if "ops" in ws.blocks.columns:
        own = F.when(F.col("replacement").isNotNull(), delta_with_replacement(F.col("ops"), F.col("replacement"))).otherwise(F.col("ops"))
        lines = lines.withColumn("ops", F.coalesce("_ops", own) if formatted else own)
    if formatted and "alignment" in ws.blocks.columns:
        lines = lines.withColumn("alignment", F.coalesce(alignment_of(F.col("_ops")), "alignment"))
    typed = typed_blocks(lines)
    made = (with_structure(typed) if "structure_hash" in ws.blocks.columns else typed).select(*ws.blocks.columns)
    new_versions = numbered.join(ws.documents.select("doc_id", "set_id"), "doc_id").select(
        "set_id", "doc_id", F.col("new_version").alias("version_id"), F.col("base").alias("parent_version_id"), (F.col("version_number") + 1).alias("version_number"), F.lit(None).cast("string").alias("checksum")
    )
    moved = numbered.select("doc_id", F.col("new_version").alias("version_id"), (F.col("revision") + 1).alias("revision"))
    heads = ws.heads.join(moved.select("doc_id"), "doc_id", "left_anti").unionByName(moved)
    return Workspace(ws.documents, ws.versions.unionByName(new_versions), heads, ws.blocks.unionByName(made))


def audit_targets(ws: Workspace, targets: DataFrame, operation_id: str) -> DataFrame:
    """The log of an edit: a row for each target with base version and texts."""
    now = ws.blocks.join(ws.heads.select("version_id"), "version_id", "left_semi")
    return now.join(targets.select("element_id", "replacement"), "element_id").select(
        F.lit(operation_id).alias("operation_id"), "doc_id", "element_id", F.col("version_id").alias("base_version_id"), "ordinal", F.col("text").alias("before_text"), F.col("replacement").alias("after_text")
    )


def restore_version(ws: Workspace, requests: DataFrame) -> tuple[Workspace, DataFrame]:
    """Make old versions current again as new ones (max + 1); requests: doc_id, version_id, expected (the current one).

    The parent is the version that was current. Stale, current and foreign requests are rejected and change nothing;
    the second table says for each request whether it was taken, and the version it made (``restores`` of these rows tells
    a history where versions come from).
    """
    known = ws.versions.select("version_id", F.col("doc_id").alias("owner"))
    current = ws.heads.select("doc_id", F.col("version_id").alias("head"), "revision")
    r = requests.join(current, "doc_id", "left").join(known, "version_id", "left")
    verdict = F.when(~F.col("owner").eqNullSafe(F.col("doc_id")), "foreign").when(~F.col("expected").eqNullSafe(F.col("head")), "stale").when(F.col("version_id") == F.col("head"), "current").otherwise("ok")
    judged = r.withColumn("verdict", verdict)
    last = ws.versions.groupBy("doc_id").agg((F.max("version_number") + 1).alias("number"))
    ok = judged.where("verdict = 'ok'").join(last, "doc_id").withColumn("new_version", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("number").cast("string")))
    copied = ws.blocks.join(ok.select("version_id", "new_version"), "version_id").withColumn("version_id", F.col("new_version")).select(*ws.blocks.columns)
    old = ws.versions.select("version_id", "set_id", "checksum")
    made = ok.join(old, "version_id").select("set_id", "doc_id", F.col("new_version").alias("version_id"), F.col("head").alias("parent_version_id"), F.col("number").alias("version_number"), "checksum")
    moved = ok.select("doc_id", F.col("new_version").alias("version_id"), (F.col("revision") + 1).alias("revision"))
    heads = ws.heads.join(moved.select("doc_id"), "doc_id", "left_anti").unionByName(moved)
    return Workspace(ws.documents, ws.versions.unionByName(made), heads, ws.blocks.unionByName(copied)), judged.join(ok.select("doc_id", "version_id", F.col("new_version").alias("new_version_id")), ["doc_id", "version_id"], "left").select("doc_id", "version_id", "verdict", "new_version_id")


def restores(verdicts: DataFrame) -> DataFrame:
    """(version_id, restored_from): the versions that requests made, and the ones they copied."""
    return verdicts.where("new_version_id IS NOT NULL").select(F.col("new_version_id").alias("version_id"), F.col("version_id").alias("restored_from"))


def maintain_link_groups(groups: DataFrame, blocks: DataFrame, changed: DataFrame) -> DataFrame:
    """Groups after a change: those of changed hashes are made anew, the others stay. Equals grouping everything again."""
    return groups.join(changed, "match_hash", "left_anti").unionByName(exact_link_groups(blocks.join(changed, "match_hash", "left_semi")).select(*groups.columns))


def remove_sets(ws: Workspace, gone: DataFrame) -> Workspace:
    """A workspace without some sets (set_id, null for the set of documents without one) and all that hangs on them: their
    documents with every version, head and block. Sets that aren't there change nothing."""
    sets = gone.select(F.col("set_id").alias("_gone")).distinct()
    documents = ws.documents.join(sets, F.col("set_id").eqNullSafe(F.col("_gone")), "left_anti")
    removed = ws.documents.join(sets, F.col("set_id").eqNullSafe(F.col("_gone")), "left_semi").select("doc_id")
    kept = lambda df: df.join(removed, "doc_id", "left_anti").select(*df.columns)
    return Workspace(documents, kept(ws.versions), kept(ws.heads), kept(ws.blocks))


def remove_documents(ws: Workspace, gone: DataFrame, least: int = 2) -> DataFrame:
    """Documents left after a removal; a set that would keep fewer than ``least`` keeps all."""
    marked = ws.documents.join(gone.select("doc_id", F.lit(True).alias("gone")), "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    left_over = marked.groupBy(F.col("set_id").alias("_set")).agg(F.count_if(~F.col("gone")).alias("left_over"))
    return marked.join(left_over, F.col("set_id").eqNullSafe(F.col("_set"))).where(~F.col("gone") | (F.col("left_over") < least)).select(*ws.documents.columns)


def add_documents(ws: Workspace, docs: DataFrame, most: int | None = None, **columns) -> tuple[Workspace, DataFrame]:
    """A workspace with more documents: their first versions, heads and blocks, under names that their sets don't have yet.

    docs and ``columns`` are those of ``ingest_blocks``. A set that would have more than ``most`` documents takes none of
    them; the second table has the verdict on each new document: added, known (its id is there already) or set_full.
    """
    made = ingest_blocks(docs, **columns)
    known = ws.documents.select("doc_id", F.lit(True).alias("known"))
    new = made.documents.join(known, "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    sizes = ws.documents.select("set_id").unionByName(new.where(~F.col("known")).select("set_id")).groupBy(F.col("set_id").alias("_set")).agg(F.count("*").alias("size"))
    verdict = F.when(F.col("known"), "known").when(F.col("size") > (most if most is not None else F.lit(None).cast("long")), "set_full").otherwise("added")
    judged = new.join(sizes, F.col("set_id").eqNullSafe(F.col("_set")), "left").withColumn("verdict", verdict).select(*made.documents.columns, "verdict")
    taken = judged.where("verdict = 'added'").drop("verdict")
    # files that are there come first, so they keep their names; ids of new ones order the rest
    files = ws.documents.select("set_id", F.struct(F.lit(0).alias("late"), "doc_id").alias("upload"), "name").unionByName(taken.select("set_id", F.struct(F.lit(1).alias("late"), "doc_id").alias("upload"), "name"))
    names = unique_names(files).where("upload.late = 1").select(F.col("upload.doc_id").alias("doc_id"), F.col("unique_name").alias("name"))
    documents = taken.drop("name").join(names, "doc_id").select(*ws.documents.columns)
    ids = taken.select("doc_id")
    more = Workspace(
        ws.documents.unionByName(documents), ws.versions.unionByName(made.versions.join(ids, "doc_id", "left_semi")),
        ws.heads.unionByName(made.heads.join(ids, "doc_id", "left_semi")), ws.blocks.unionByName(made.blocks.join(ids, "doc_id", "left_semi")),
    )
    return more, judged.select("set_id", "doc_id", "verdict")


def carry_shared_state(old: DataFrame, new: DataFrame, key: list[str], override: DataFrame, reconnect: DataFrame) -> DataFrame:
    """State of new blocks: overridden ones are detached, reconnected ones shared, the others as before, else shared."""
    o, r = override.select(*key, F.lit(True).alias("o")), reconnect.select(*key, F.lit(True).alias("r"))
    state = F.when(F.col("o"), "detached").when(F.col("r"), "shared").otherwise(F.coalesce("old_state", F.lit("shared")))
    return new.join(old.select(*key, F.col("shared_state").alias("old_state")), key, "left").join(o, key, "left").join(r, key, "left").withColumn("shared_state", state).drop("old_state", "o", "r")


def legacy_state_fallback(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """State of a block by its place, else by its cell, else by its body paragraph, else shared.

    states: doc_id, location_key, table_index, row_index, column_index, paragraph_index, state; keys that don't apply are null.
    """
    steps = (["location_key"], ["table_index", "row_index", "column_index"], ["paragraph_index"])
    out = blocks
    for i, keys in enumerate(steps):
        s = states.where(F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull()).groupBy("doc_id", *keys).agg(F.min("state").alias(f"_state{i}"))
        out = out.join(s, ["doc_id", *keys], "left")
    return out.withColumn("shared_state", F.coalesce(*(F.col(f"_state{i}") for i in range(len(steps))), F.lit("shared"))).drop(*(f"_state{i}" for i in range(len(steps))))
