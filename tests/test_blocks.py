"""Golden values, quirks and properties of the block operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import edits, layout, matching, search, templates, versions
from wordloom.sources.ingest import Workspace, ingest_blocks, typed_blocks, with_structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def corpus(spark, rows):
    return ingest_blocks(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string"))


def test_normal_form_and_hash(spark):
    texts = ["Ｔhe RESIDENT   submits the safety report every month.", "the resident submits the safety report every month.", "STRASSE", "Straße", None, ""]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalise_text(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got[0] == got[1] and got[2] == got[3] == "strasse" and got[4] is None and got[5] == ""
    assert one(spark, T.exact_match_hash(F.lit("paragraph"), F.lit(got[0]))) == "33a49b0d5b5e94f821d68c00b9d2152de679e724fe096c9082ad5f3ee47cc740"
    assert one(spark, T.exact_match_hash(F.lit("list_item"), F.lit(got[0]))) == "09f502f3ada40e648669396ed07fb7e4b36f4181bc0fe3f2dfd15f57689110da"


def test_near_pair_score_and_spans(spark):
    a, b = "the caretaker completes the inspection every friday.", "the caretaker completes the inspection every monday."
    assert round(matching.ratio(a, b), 6) == 0.942308
    assert round(one(spark, matching.token_jaccard(F.lit(a), F.lit(b))), 6) == 0.714286
    assert round(one(spark, matching.position_similarity(F.lit(5), F.lit(1), F.lit(5))), 6) == 0.2
    spans = matching.spans_between(a, b)
    assert [s["kind"] for s in spans] == ["equal", "changed", "equal"]
    assert "".join(s["source_text"] for s in spans) == a and "".join(s["candidate_text"] for s in spans) == b
    assert "".join(s["text"] for s in matching.words_between(a, b)) == b


def test_search_offsets(spark):
    text = "A compatibility TEST appears after irregular   spacing."
    place = search.occurrences(F.lit(text), search.offset_map(F.lit(text)), F.lit("irregular spacing"))
    assert one(spark, place) == [(35, 54)]
    ws = corpus(spark, [("s", "Test " * 21), ("s", text), ("s", "A literal %_ marker."), ("s", None)])
    q = spark.createDataFrame([("test",), ("%_",), ("t",), ("irregular spacing",)], "query string")
    hits = search.search(matching.current_blocks(ws), q)
    assert {r["query"]: r["total"] for r in search.search_counts(hits).collect()} == {"test": 22, "%_": 1, "irregular spacing": 1}
    long = "x" * 10 + " " + "alpha " * 20 + "needle " + "omega " * 20
    s = one(spark, search.snippet(F.lit(long), F.lit(131), F.lit(137)))
    assert s["before"] == "…" + "alpha " * 11 and s["match"] == "needle" and s["after"] == " omega" * 11 + "…"


def test_pages(spark):
    units = [2, 3, 3, 3, 3, 3, 1, 25, 1]
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate(units)], "doc_id int, ordinal int, units int")
    got = [r["page"] for r in layout.paginate(df, ["doc_id"], "ordinal", "units").orderBy("ordinal").collect()]
    assert got == [1, 1, 1, 1, 1, 1, 1, 2, 3]


def test_templates_expand_once(spark):
    r = spark.createDataFrame([("A", {"a": "{{b}} $1", "b": " "})], "name string, values map<string,string>")
    assert templates.render_templates("x{{a}}y{{ b }}{{c}}", r).first()["output"] == "x{{b}} $1y "
    assert {x["field"] for x in templates.missing_values("x{{a}}y{{ b }}{{c}}", r).collect()} == {"b", "c"}


def test_names(spark):
    names = {"Care:Centre/West*": "West_", "CON": "safe_CON", "": "document.docx", "a/..": "document.docx", "con.txt": "safe_con.txt", "x" * 300 + ".docx": "x" * 250 + ".docx"}
    for name, want in names.items():
        assert one(spark, T.safe_filename(F.lit(name))) == want, name
    assert one(spark, T.safe_output_name(F.lit("Care:Centre/West*"), F.lit("r"))) == "Care-Centre-West-"
    assert one(spark, T.safe_output_name(F.lit("CON"), F.lit("r"))) == "CON-record"


def test_edit_then_restore_is_identity(spark):
    ws = corpus(spark, [("s", "Head\nshared line here\nmore"), ("s", "Other\nshared line here"), ("t", "shared line here")])
    before = matching.current_blocks(ws).select("element_id", "text").collect()
    targets = ws.blocks.where("doc_id = 0 AND ordinal = 1").select("element_id", F.lit("changed").alias("replacement"))
    edited = edits.apply_edit(ws, targets)
    assert edited.heads.where("doc_id = 0").first()["version_id"] == "0:2"
    assert {r["text"] for r in matching.current_blocks(edited).where("doc_id = 0").collect()} == {"Head", "changed", "more"}
    ask = spark.createDataFrame([(0, "0:1", "0:2"), (1, "0:1", "1:1"), (2, "2:1", "2:1")], "doc_id long, version_id string, expected string")
    restored, verdicts = edits.restore_version(edited, ask)
    assert {r["doc_id"]: r["verdict"] for r in verdicts.collect()} == {0: "ok", 1: "foreign", 2: "current"}
    assert sorted(matching.current_blocks(restored).select("element_id", "text").collect()) == sorted(before)
    assert [tuple(r) for r in edits.restores(verdicts).collect()] == [("0:3", "0:1")]
    history = versions.version_history(restored.versions, restored.heads, edits.restores(verdicts)).where("restored_from_version_id IS NOT NULL")
    assert [(r["version_id"], r["restored_from_version_id"], r["restored_from_version_number"]) for r in history.collect()] == [("0:3", "0:1", 1)]
    log = edits.audit_targets(ws, targets, "op").collect()
    assert [(r["operation_id"], r["base_version_id"], r["after_text"]) for r in log] == [("op", "0:1", "changed")]
    gone = edits.remove_sets(restored, restored.documents.where("doc_id = 0").select("set_id"))
    for t in (gone.documents, gone.versions, gone.heads, gone.blocks):
        assert t.join(restored.documents.where("doc_id = 0").select("doc_id"), "doc_id").count() == 0
    none = edits.remove_sets(restored, spark.createDataFrame([("nowhere",)], "set_id string"))
    assert none.blocks.count() == restored.blocks.count() and none.versions.count() == restored.versions.count()
    groups = matching.exact_link_groups(matching.current_blocks(ws))
    assert [(g["members"], g["documents"]) for g in groups.collect()] == [(2, 2)]
    assert matching.exact_link_groups(matching.current_blocks(edited)).count() == 0


def test_edits_carry_formatting(spark):
    none = F.lit(None).cast("map<string,string>")
    ws = corpus(spark, [("s", "Head\nplain\nmore")])
    bold = F.create_map(F.lit("bold"), F.lit("true"))
    kept = ws.blocks.withColumn("style", F.when(F.col("ordinal") == 2, "body_order:7:List Bullet").otherwise(F.col("style"))).withColumn("alignment", F.lit("right"))
    kept = with_structure(typed_blocks(kept).withColumn("ops", F.array(F.struct(F.col("text").alias("insert"), bold.alias("attributes")), F.struct(F.lit("\n").alias("insert"), none.alias("attributes")))))
    header = F.create_map(F.lit("header"), F.lit("12"))
    shape = F.when(F.col("ordinal") == 2, header)
    delta = F.array(F.struct(F.lit("new").alias("insert"), none.alias("attributes")), F.struct(F.lit("\n").alias("insert"), shape.alias("attributes")))
    targets = kept.select("element_id", F.lit("new").alias("replacement"), F.when(F.col("ordinal") != 1, delta).alias("ops"))
    after = edits.apply_edit(Workspace(ws.documents, ws.versions, ws.heads, kept), targets)
    got = {r["ordinal"]: r for r in matching.current_blocks(after).collect()}
    assert [(got[i]["style"], got[i]["element_type"], got[i]["alignment"]) for i in range(3)] == [("Normal", "paragraph", "left"), ("Normal", "paragraph", "right"), ("body_order:7:Heading 9", "heading", "left")]
    assert got[1]["ops"][0]["attributes"] == {"bold": "true"} and got[0]["ops"][0]["attributes"] is None
    again = {r["ordinal"]: r["structure_hash"] for r in with_structure(matching.current_blocks(after).drop("structure_hash")).collect()}
    assert again == {i: r["structure_hash"] for i, r in got.items()}
    assert got[1]["match_hash"] == got[0]["match_hash"] != got[2]["match_hash"]


def test_replay_and_context(spark):
    df = spark.createDataFrame([(1, 1, None, "now"), (1, 2, "t1", "now"), (1, 3, None, "now"), (1, 4, "t3", "now")], "k int, v int, before string, now string")
    got = [r["text_at_version"] for r in versions.text_at_version(df, ["k"], "v", "before", "now").orderBy("v").collect()]
    assert got == ["t1", "t3", "t3", "now"]
    b = spark.createDataFrame([("v", "e0", 0, "a"), ("v", "e1", 1, "b"), ("v", "e3", 3, "c")], "version_id string, element_id string, ordinal int, normalized_text string")
    assert {r["element_id"]: r["context"] for r in matching.neighbour_context(b).collect()} == {"e0": "a ␟ b", "e1": "a", "e3": ""}


def test_empty_tables(spark):
    ws = corpus(spark, [("s", None)])
    none = ingest_blocks(spark.createDataFrame([], "doc_id long, source string, text string"))
    assert ws.blocks.count() == 0 and none.blocks.count() == 0 and matching.exact_link_groups(matching.current_blocks(none)).count() == 0
