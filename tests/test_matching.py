"""Matching, ranks, chains, names, layout and requests against plain Python."""

from __future__ import annotations

import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import checks, edits, layout, matching, search, templates, versions
from wordloom.operators.ranks import numbered
from wordloom.sources.ingest import Workspace, ingest_blocks, positional_style


def header_style(ordinal):
    header = F.concat(F.lit("header_footer_order:0:0:header:"), (ordinal % 2).cast("string"), F.lit(":default:0:rId1"))
    return F.when(ordinal % 4 == 3, header).otherwise(positional_style(ordinal))


def corpus(spark, rows):
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    return ingest_blocks(docs, style_rule=header_style)


def lines(seed, n):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("alpha beta gamma delta safety report month every resident".split()) for _ in range(8)) for _ in range(4)]
    out = []
    for i in range(n):
        doc = []
        for _ in range(rnd.randint(1, 9)):
            words = rnd.choice(base).split()
            if rnd.random() < 0.5:
                words[rnd.randrange(8)] = rnd.choice(("daily", "Straße", "ﬁle"))
            doc.append(" ".join(words))
        out.append((rnd.choice(["s", None]), "\n".join(doc)))
    return out


def test_near_and_exact_matches_by_hand(spark):
    ws = corpus(spark, lines(1, 14))
    b = [r.asDict() for r in matching.current_blocks(ws).collect()]
    contexts = {}
    for x in b:
        near = sorted((y["ordinal"], y["normalized_text"]) for y in b if y["version_id"] == x["version_id"] and y["ordinal"] in {max(x["ordinal"] - 1, 0), x["ordinal"] + 1})
        contexts[x["element_id"]] = " ␟ ".join(t for _, t in near)
    ratio = lambda p, q: SequenceMatcher(None, p, q, autojunk=False).ratio()
    kind = lambda x: (x["set_id"], x["element_type"], x["match_context"])
    want, exact, cap = {}, set(), 6
    for x in b:
        same = sorted((y for y in b if kind(y) == kind(x)), key=lambda y: (y["name"], y["ordinal"], y["element_id"]))
        reach = max(y["ordinal"] for y in same)
        for y in [y for y in same if y is not x][:cap]:
            if y["match_hash"] == x["match_hash"]:
                continue
            p, q = set(x["normalized_text"].split()), set(y["normalized_text"].split())
            place = max(0.0, 1 - abs(x["ordinal"] - y["ordinal"]) / max(reach, 1))
            cx, cy = contexts[x["element_id"]], contexts[y["element_id"]]
            around = 1.0 if not cx and not cy else ratio(cx, cy)
            score = round(0.72 * ratio(x["normalized_text"], y["normalized_text"]) + 0.14 * len(p & q) / len(p | q) + 0.04 * place + 0.10 * around, 6)
            if score >= 0.7:
                want[x["element_id"], y["element_id"]] = score
        exact |= {(x["element_id"], y["element_id"]) for y in same if y is not x and y["match_hash"] == x["match_hash"]}
    got = matching.near_matches(ws, ws.blocks.select("element_id"), threshold=0.7, cap=cap).collect()
    assert {(r["source_element_id"], r["element_id"]): r["score"] for r in got} == want and len(want) > 20
    blocks = matching.current_blocks(ws)
    assert {(r["source_id"], r["element_id"]) for r in matching.exact_matches(blocks, blocks, 1000).collect()} == exact
    n = {x["element_id"]: sum(a == x["element_id"] for a, _ in exact) for x in b}
    assert {r["element_id"]: r["n_matches"] for r in matching.exact_classes(blocks).collect()} == n
    assert any(x["set_id"] is None for x in b) and any(x["match_context"] for x in b)
    items = matching.compare_items(matching.exact_matches(blocks, blocks, 20).withColumnRenamed("source_id", "source_element_id"), matching.near_matches(ws, ws.blocks.select("element_id"), threshold=0.7, cap=cap)).collect()
    kinds = {}
    for r in sorted(items, key=lambda r: r["n"]):
        kinds.setdefault(r["source_element_id"], []).append(r["match_type"])
    assert all(k == sorted(k) and len(k) <= 20 for k in kinds.values())


def test_headers_match_within_type_and_section(spark):
    text = "h\na\nb\nthe same header\nc\nd\ne\nthe same header"
    ws = corpus(spark, [("s", text), ("s", text)])
    groups = matching.exact_link_groups(matching.current_blocks(ws)).where("representative_text = 'the same header'").collect()
    assert [g["members"] for g in groups] == [4]  # both are in section 1
    ws = corpus(spark, [("s", "h\na\nb\nthe same header"), ("s", "h\na\nthe same header")])
    assert matching.exact_link_groups(matching.current_blocks(ws)).where("representative_text = 'the same header'").count() == 0


def test_score_without_neighbours(spark):
    pairs = spark.createDataFrame([("a", "caretaker every friday", 0, "b", "caretaker every monday", 1, 1)], "source_element_id string, source_normalized_text string, source_ordinal int, element_id string, normalized_text string, ordinal int, max_ordinal int")
    score = matching.similarity(pairs, None).first()["score"]
    assert score == round(0.8 * matching.ratio("caretaker every friday", "caretaker every monday") + 0.15 * 2 / 4 + 0.05 * 0.0, 6)


def test_decisions_hold_for_a_version(spark):
    ws = corpus(spark, [("s", "Head\nthe resident submits the report every month\nx"), ("s", "Head\nthe resident submits the report every week\ny"), ("t", "Head\nq")])
    e = {r["text"]: r["element_id"] for r in ws.blocks.collect()}
    a, b = e["the resident submits the report every month"], e["the resident submits the report every week"]
    asks = [(a, b, "confirmed"), (a, e["x"], "confirmed"), (a, e["q"], "ignored"), (a, "none", "ignored"), ("0:0", a, "ignored")]
    got = {r["candidate_element_id"]: r["verdict"] for r in matching.judged_decisions(ws, spark.createDataFrame(asks, "source_element_id string, candidate_element_id string, decision string")).collect()}
    assert got == {b: "ok", e["x"]: "below_threshold", e["q"]: "other_set", "none": "unknown", a: "incompatible"}
    pairs = spark.createDataFrame([("v1", "s", "c"), ("v2", "s", "c")], "source_version_id string, source_element_id string, element_id string")
    made = spark.createDataFrame([("v1", "s", "c", "confirmed", 1, 1), ("v1", "s", "c", "ignored", 2, 2)], "source_version_id string, source_element_id string, candidate_element_id string, decision string, updated_at int, id int")
    assert {r["source_version_id"]: r["decision"] for r in matching.attach_decisions(pairs, made).collect()} == {"v1": "ignored", "v2": "pending"}


def common_by_table(x, y):
    """Shared places in y by the full table, dropping words of y first where both ways are as long."""
    best = {}
    for i in range(len(x), -1, -1):
        for j in range(len(y), -1, -1):
            best[i, j] = 0 if i == len(x) or j == len(y) else best[i + 1, j + 1] + 1 if x[i] == y[j] else max(best[i + 1, j], best[i, j + 1])
    i, j, out = 0, 0, []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(j)
            i, j = i + 1, j + 1
        elif best[i + 1, j] > best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_shared_words():
    rnd = random.Random(3)
    for _ in range(400):
        x, y = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        assert matching.shared_words(x, y) == common_by_table(x, y), (x, y)
    assert matching.words_between("a", "a") == [{"text": "a", "kind": "shared"}]
    assert matching.words_between("", "b c") == [{"text": "b c", "kind": "different"}]
    assert matching.words_between("x", "") == [{"text": "", "kind": "different"}]
    assert matching.words_between("Every Friday at 9", "every monday at 9") == [{"text": "every ", "kind": "shared"}, {"text": "monday", "kind": "different"}, {"text": " at 9", "kind": "shared"}]
    many = "w " * 200
    assert matching.words_between(many, many + "x") == [{"text": many + "x", "kind": "different"}]


def test_bound_of_the_ratio():
    rnd = random.Random(9)
    for _ in range(2000):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30)))
        b = list(a) if rnd.random() < 0.7 else [rnd.choice("abc ") for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 5)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("abc")) if rnd.random() < 0.5 or not b else b.pop(rnd.randrange(len(b)))
        b = "".join(b)
        assert matching.most_ratio(a, b) >= matching.ratio(a, b) - 1e-12, (a, b)


def test_difference_spans(spark):
    df = spark.createDataFrame([("The lift, 3 floors.", "The old lift: 4 floors."), ("same", "same"), ("", "new")], "a string, b string")
    for a, b, spans in df.select("a", "b", matching.difference_spans(F.col("a"), F.col("b"))).collect():
        assert "".join(s["source_text"] for s in spans) == a and "".join(s["candidate_text"] for s in spans) == b
        assert all(s["kind"] in ("equal", "changed", "insert", "delete") for s in spans)
    items = spark.createDataFrame([("s", "c", "The lift, 3 floors.", "The old lift: 4 floors.")], "source_element_id string, element_id string, a string, b string").withColumn("spans", matching.difference_spans(F.col("a"), F.col("b")))
    assert "".join(r["text"] for r in matching.shared_spans(items).collect()).replace(" ", "") == "Theliftfloors."


def units_by_hand(text):
    """(character, start, end) of each character's fold, runs of blanks as one."""
    out = []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).casefold():
            if x.isspace() and out and out[-1][0] == " ":
                out[-1] = (" ", out[-1][1], i + 1)
            else:
                out.append((" " if x.isspace() else x, i, i + 1))
    return out


def test_offsets_by_hand(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aß ﬁ\t\u00a0Ｔé\u3000ſ…B😀\u0301") for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [" \x85\u2028", "", None]
    needles = [rnd.choice(["a", "ss", "fi", "t b", "..", "ab", "é", " ", "aa", "😀"]) for _ in texts]
    df = spark.createDataFrame(list(zip(texts, needles)), "text string, needle string").withColumn("units", search.offset_map(F.col("text")))
    for r in df.withColumn("hits", search.occurrences(F.col("text"), F.col("units"), F.col("needle"))).collect():
        if r["text"] is None:
            assert r["units"] is None and not r["hits"]
            continue
        units = units_by_hand(r["text"])
        assert [tuple(u) for u in r["units"]] == units, ascii(r["text"])
        folded, want, at = "".join(u[0] for u in units), [], 0
        while (at := folded.find(r["needle"], at)) >= 0:
            want.append((units[at][1], units[at + len(r["needle"]) - 1][2]))
            at += len(r["needle"])
        assert [tuple(h) for h in r["hits"]] == want, ascii(r["text"])


def test_no_python_in_plans(spark):
    """Normal form, hashes, groups and search stay in the JVM."""
    ws = corpus(spark, [("s", "Straße ﬁn"), ("s", "STRASSE fin")])
    blocks = matching.current_blocks(ws)
    hits = search.search(blocks, spark.createDataFrame([("strasse",)], "query string"))
    for df in (blocks, matching.exact_link_groups(blocks), hits):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert hits.count() == 2 and [(r["start"], r["end"]) for r in hits.where("doc_id = 0").collect()] == [(0, 6)]


def test_many_hits_and_many_queries(spark):
    ws = corpus(spark, [("s", "ab " * 3000 + "x"), ("s", None)])
    q = spark.createDataFrame([("ab",), (" ",), (None,)], "query string")
    hits = search.search(matching.current_blocks(ws), q)
    assert hits.count() == 3000 and hits.agg(F.max("start")).first()[0] == 2999 * 3
    more = spark.range(search.MOST_QUERIES + 1).select(F.concat(F.lit("qq"), "id").alias("query")).unionByName(spark.createDataFrame([("b x",), ("B",)], "query string"))
    assert [r["query"] for r in search.search(matching.current_blocks(ws), more).collect()] == ["b x"]


def test_all_characters_fold_natively(spark):
    """Each assigned character between letters, and mixtures with marks, jamo, blanks and compatibility forms."""
    known = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    rnd = random.Random(2)
    odd = [c for c in known if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c or c.isspace() or c.casefold() != c] + list("가각각ΣςİıaAß ")
    texts = ["x" + c + "Y" for c in known] + ["".join(rnd.choice(odd) for _ in range(30)) for _ in range(5000)] + ["", " \u3000\x85", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8).select("i", T.normalise_text(F.col("t")).alias("n")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = None if texts[r["i"]] is None else T.fold(texts[r["i"]])
        assert r["n"] == want, (ascii(texts[r["i"]]), ascii(r["n"]))


def test_numbered(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 5 + ["a", None]), rnd.randint(0, 50), i) for i in range(900)]
    got = numbered(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [(F.col("v"), False), (F.col("i"), True)], "place").collect()
    want = {}
    for k in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = place
    assert {r["i"]: r["place"] for r in got} == want
    assert numbered(spark.createDataFrame([], "k string, v int"), ["k"], [(F.col("v"), True)], "place").count() == 0


def test_timing(spark):
    rows = [("a", float(v)) for v in (5, 1, 4, 2, 3, 9)] + [("b", 7.0), ("b", None), (None, 1.0), (None, 3.0), ("c", None)]
    got = {r["k"]: (r["median"], r["max"], r["p95"], r["improvement"]) for r in versions.timing_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v", 10.0).collect()}
    assert got == {"a": (3.5, 9.0, 9.0, 65.0), "b": (7.0, 7.0, 7.0, 30.0), None: (2.0, 3.0, 3.0, 80.0)}


def test_lineage_to_the_end(spark):
    chain = [("d", f"v{i}", f"v{i - 1}" if i else None) for i in range(200)] + [("e", "x", "z"), ("e", "y", "x"), ("e", "z", "y"), ("f", "only", "lost")]
    v = spark.createDataFrame(chain, "doc_id string, version_id string, parent_version_id string")
    heads = spark.createDataFrame([("d", "v199"), ("e", "y"), ("f", "only")], "doc_id string, version_id string")
    got = {(r["doc_id"], r["version_id"]): r["distance"] for r in versions.lineage(v, heads).collect()}
    want = {("d", f"v{i}"): 199 - i for i in range(200)} | {("e", "y"): 0, ("e", "x"): 1, ("e", "z"): 2, ("f", "only"): 0, ("f", "lost"): 1}
    assert got == want


def one_by_one(rows, numbering):
    """unique_name of each (set, upload, name), file by file."""
    first, form = {"copy": (1, " ({})"), "output": (2, "-{}")}[numbering]
    taken, out = {}, []
    for s, _, name in rows:
        name = name or ""
        dot = name.rfind(".") if "." in name.lstrip(".") else len(name)
        names, n, new = taken.setdefault(s, set()), first, name
        while new.casefold() in names:
            new = name[:dot] + form.format(n) + name[dot:]
            n += 1
        names.add(new.casefold())
        out.append(new)
    return out


@pytest.mark.parametrize("numbering", ["copy", "output"])
def test_unique_names(spark, numbering):
    rnd = random.Random(6)
    pool = ["R.docx", "r.DOCX", "R (1).docx", "R (1) (1).docx", "R-2.docx", "Q", "q", ".hidden", "S.txt", "S.txt", "S.txt", None, "R (2).docx", "Straße.x", "STRASSE.x"]
    odd = ["R (01).docx", "R (0).docx", "R-1.docx", "R-1-2.docx", "R-2-2.docx", "T.", "T (1).", "T. (1)", "R (99999999999999999999).docx", " (1)", "..", "N\n (1)", "N\n", "R (7).docx", "R (4).docx", "R-5.docx", "R-4.docx", "R (2) (1).docx"]
    rows = [(rnd.choice(["a", None, "b"]), i, rnd.choice(pool + odd)) for i in range(400)]
    got = {r["upload"]: r["unique_name"] for r in checks.unique_names(spark.createDataFrame(rows, "set_id string, upload long, name string"), numbering).collect()}
    assert got == {i: new for (_, i, _), new in zip(rows, one_by_one(rows, numbering))}


def test_unique_names_of_files_that_come_with_many_numbers(spark):
    rnd = random.Random(9)
    rows = [("s", i, "a.txt" if rnd.random() < 0.5 else f"A ({int(rnd.paretovariate(0.4)) % 500}).txt") for i in range(1_500)]
    got = {r["upload"]: r["unique_name"] for r in checks.unique_names(spark.createDataFrame(rows, "set_id string, upload long, name string")).collect()}
    assert got == {i: new for (_, i, _), new in zip(rows, one_by_one(rows, "copy"))}
    equal = spark.createDataFrame([("s", 1, "b")] * 3 + [("s", 2, "b (2)")], "set_id string, upload long, name string")
    assert sorted(r["unique_name"] for r in checks.unique_names(equal).collect()) == ["b", "b (1)", "b (2)", "b (2) (1)"]
    assert checks.unique_names(equal.where("false")).count() == 0


def test_backfill(spark):
    files = spark.createDataFrame([(1, "f1", 10), (1, "f2", 20), (2, "g1", 5), (4, "h1", 1)], "doc_id long, file_id string, created_at int")
    known = spark.createDataFrame([(2, "o2", 1, None), (2, "gv", 3, "g1"), (4, "v2", 2, "other")], "doc_id long, version_id string, version_number int, file_id string")
    heads = spark.createDataFrame([(4, "v2")], "doc_id long, version_id string")
    got = {r["version_id"]: (r["doc_id"], r["version_number"], r["parent_version_id"], r["is_current"]) for r in versions.backfill_lineage(files, spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long"), known, heads).collect()}
    assert got == {"1": (1, 1, None, False), "f1": (1, 2, "1", False), "f2": (1, 3, "f1", True), "3": (3, 1, None, True), "4": (4, 1, None, False), "h1": (4, 3, "4", False)}


def page(rows):
    """(page, line, top, words) -> one row a word."""
    out, at = [], {}
    for p, line, top, text in rows:
        for w in text.split():
            out.append(("v", p, at.get(p, 0), line, w, top, top + 10, 100.0, 0.0, 10.0, 100.0))
            at[p] = at.get(p, 0) + 1
    return out


def test_zones_and_repeated_headers(spark):
    words = spark.createDataFrame(
        page([(1, 0, 1.0, "Site rules"), (1, 1, 30.0, "Lock up"), (1, 2, 40.0, "twice"), (1, 3, 50.0, "twice"), (1, 4, 60.0, "Page end"), (2, 0, 1.0, "Site rules"), (2, 1, 45.0, "Site rules"), (2, 2, 90.0, "Page end"), (2, 3, 97.0, "Lock up")]),
        "version_id string, page int, seq int, line int, text string, y0 double, y1 double, page_height double, x0 double, x1 double, page_width double",
    )
    rows = [("h", 0, "header_paragraph", "first_page_header", "site rules"), ("h2", 1, "header_paragraph", "default_header", "site rules"), ("p", 2, "paragraph", None, "lock up"), ("q", 3, "paragraph", None, "twice"), ("r", 4, "paragraph", None, "twice"),
            ("f", 5, "footer_paragraph", "default_footer", "page end"), ("m", 6, "paragraph", None, "missing words"), ("s", 7, "paragraph", None, "page end"), ("t", 8, "list_item", None, "page end")]
    blocks = spark.createDataFrame([("v", *r, r[0] != "p") for r in rows], "version_id string, element_id string, ordinal int, element_type string, header_footer_type string, normalized_text string, supported boolean")
    found = layout.align_phrases(blocks, words)
    places = {}
    for r in found.collect():
        places.setdefault(r["element_id"], set()).add((r["page"], r["seq"]))
    assert places == {"h": {(1, 0)}, "h2": {(1, 0), (2, 0)}, "p": {(1, 2)}, "q": {(1, 4), (1, 5)}, "r": {(1, 4), (1, 5)}, "f": {(2, 4)}, "s": {(1, 6), (2, 4)}, "t": {(1, 6), (2, 4)}}
    matches = layout.resolve_ambiguity(found, blocks)
    got = {}
    for r in matches.collect():
        got.setdefault(r["element_id"], []).append((r["page"], r["seq"], r["confidence"], r["reason"]))
    # the first page's header shares its run with the other one, which keeps the second page's
    assert got == {"h": [(None, None, None, "overlap")], "h2": [(2, 0, 0.97, None)], "p": [(1, 2, 0.99, None)], "q": [(1, 4, 0.95, None)], "r": [(1, 5, 0.95, None)], "f": [(2, 4, 0.97, None)], "m": [(None, None, None, "not_found")], "s": [(None, None, None, "ambiguous")], "t": [(None, None, None, "ambiguous")]}
    boxes = layout.line_boxes(matches, words, blocks)
    assert {r["element_id"]: r["interactive"] for r in boxes.collect()} == {"h2": True, "p": False, "q": True, "r": True, "f": True}
    assert layout.mapping_coverage(matches, boxes).first().asDict() == {"version_id": "v", "mapped": 5, "interactive": 4, "total": 9, "status": "partial"}


def test_requests(spark):
    near = "the resident submits the safety report every {}"
    ws = corpus(spark, [("s", "Head\n" + near.format("month") + "\n" + near.format("week") + "\nx\nfar away"), ("s", "Top\n" + near.format("month")), ("t", "Other\nelse")])
    ws = Workspace(ws.documents, ws.versions, ws.heads, ws.blocks.withColumn("supported", F.col("text") != "far away"))
    requests = spark.createDataFrame([("ok", "s", "0:1"), ("bad", "s", "0:1"), ("late", "s", "9:9")], "request_id string, set_id string, source_element_id string")
    bases = spark.createDataFrame([("ok", 0, "0:1"), ("ok", 1, "1:1"), ("bad", 0, "0:0"), ("bad", 2, "2:1"), ("late", 0, "0:1")], "request_id string, doc_id long, base_version_id string")
    none = None
    targets = [("ok", "0:1", "new", none), ("ok", "1:1", "new", none), ("ok", "0:2", "new", "confirmed"), ("bad", "0:2", "new", none), ("bad", "0:4", "x" * 20_001, "confirmed"), ("bad", "1:1", "new", "ignored"), ("bad", "2:1", "n", none), ("bad", "0:0", "n", none), ("bad", "7:7", "n", none), ("bad", "0:2", "new", none), ("late", "0:1", "n", none)]
    got = edits.validate_requests(ws, requests, bases, spark.createDataFrame(targets, "request_id string, element_id string, replacement string, decision string"))
    found = {(r["request_id"], r["element_id"], r["violation"]) for r in got.collect()}
    assert {x for x in found if x[0] == "ok"} == set()
    assert {x[1:] for x in found if x[0] == "bad"} == {
        (none, "stale_base"), (none, "foreign_base"), ("0:1", "source_left_out"), ("0:2", "near_not_confirmed"), ("0:2", "duplicate_target"), ("0:4", "unsupported"), ("0:4", "below_threshold"), ("0:4", "too_long"), ("0:4", "incompatible"),
        ("1:1", "no_base"), ("1:1", "match_ignored"), ("2:1", "other_set"), ("2:1", "incompatible"), ("2:1", "near_not_confirmed"), ("0:0", "incompatible"), ("0:0", "near_not_confirmed"), ("7:7", "unknown_element"), ("7:7", "near_not_confirmed"),
    }
    assert ("late", "9:9", "unknown_source") in found


def test_added_documents_keep_names_apart(spark):
    ws = corpus(spark, [("s", "a"), ("s", "b")])
    more = spark.createDataFrame([(1, "s", "again"), (7, "s", "c\nd"), (8, "t", "e"), (9, "t", "f"), (10, "t", "g")], "doc_id long, source string, text string")
    after, verdicts = edits.add_documents(ws, more, most=3)
    assert {r["doc_id"]: r["verdict"] for r in verdicts.collect()} == {1: "known", 7: "added", 8: "added", 9: "added", 10: "added"}
    assert {r["doc_id"] for r in after.documents.collect()} == {0, 1, 7, 8, 9, 10} and after.blocks.where("doc_id = 7").count() == 2
    assert {r["verdict"] for r in edits.add_documents(ws, more, most=2)[1].where("doc_id <> 1").collect()} == {"set_full"}


def test_removed_documents(spark):
    ws = corpus(spark, [("s", "a"), ("s", "b"), ("s", "c"), (None, "d"), (None, "e")])
    left = edits.remove_documents(ws, spark.createDataFrame([(0,), (3,)], "doc_id long"))
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4}


def test_batches_of_records(spark):
    r = spark.createDataFrame([(" A ", {"a": "1"}), ("a", {"a": " "}), ("", {"a": "x", "9": "y"}), ("B", None)], "name string, values map<string,string>")
    got = {(x["name"], x["violation"]) for x in templates.record_violations("{{a}}", r, most=3).collect()}
    assert got == {("A", "duplicate_name"), ("a", "missing_value"), ("", "invalid_name"), ("", "invalid_field"), ("B", "missing_value"), (None, "too_many_records")}
    assert {x["violation"] for x in templates.record_violations("{{a}}", r.limit(1)).collect()} == {"not_enough_records"}
    got = spark.createDataFrame([("{{a}}",), ("plain",), (" ",)], "t string").select(templates.template_violations(F.col("t")).alias("v")).collect()
    assert [x["v"] for x in got] == [[], ["no_placeholder"], ["empty_template", "no_placeholder"]]
    names = spark.createDataFrame([("b", 1, "Care: Centre"), ("b", 2, "care- centre"), ("b", 3, "CON"), ("b", 4, " ")], "set_id string, upload long, name string")
    assert {x["upload"]: x["file_name"] for x in templates.output_names(names).collect()} == {1: "Care- Centre.txt", 2: "care- centre-2.txt", 3: "CON-record.txt", 4: "Record-4.txt"}


def test_redaction(spark):
    line = "SESSION_TOKEN = abc, x; before_text: all of this\nkept session_cookie=z"
    assert spark.range(1).select(T.redact_log(F.lit(line)).alias("x")).first()["x"] == "SESSION_TOKEN=[REDACTED], x; before_text=[REDACTED]\nkept session_cookie=[REDACTED]"
