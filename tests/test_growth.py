"""What queries shuffle and keep, as this decides what they need on large tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wordloom.operators import edits, layout, matching, search
from wordloom.sources.ingest import ingest_blocks


def corpus(spark, n, seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8)))
    base = [" ".join(word() for _ in range(12)) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rnd.randint(2, 6)):
            words = rnd.choice(base).split()
            words[rnd.randrange(12)] = word()
            lines.append(" ".join(words))
        rows.append((i, rnd.choice(["s", "t", None]), "\n".join(lines)))
    return ingest_blocks(spark.createDataFrame(rows, "doc_id long, source string, text string"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_near_matches_meet_within_parts(spark, monkeypatch):
    ws = corpus(spark, 30)
    cols = ("source_element_id", "element_id", "place", "score", "position_in_list")
    run = lambda: matching.near_matches(ws, ws.blocks.select("element_id"), 0.7, cap=9)
    want = {tuple(r[c] for c in cols) for r in run().collect()}
    monkeypatch.setattr(matching, "TOGETHER", 4)
    assert {tuple(r[c] for c in cols) for r in run().collect()} == want and len(want) > 50
    # a pair has its score before anything is joined or shuffled
    above = plan(run()).split("MapInArrow")[0]
    assert "MapInArrow" in plan(run()) and "Join" not in above


def test_exact_matches_are_not_sorted_as_pairs(spark):
    ws = ingest_blocks(spark.createDataFrame([(i, "s", "head\nsame line") for i in range(40)], "doc_id long, source string, text string"))
    b = matching.current_blocks(ws)
    found = matching.exact_matches(b, b.select("element_id"), 3)
    rows = {}
    for r in found.collect():
        rows.setdefault(r["source_id"], []).append((r["place"], r["element_id"]))
    assert len(rows) == 80 and sorted(rows["0:1"]) == [(1, "1:1"), (2, "2:1"), (3, "3:1")] and sorted(rows["2:1"]) == [(1, "0:1"), (2, "1:1"), (3, "3:1")]
    assert "Window" not in plan(found).split("Join")[0]


def test_common_subsequence_bounds_the_ratio():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc de") for _ in range(rnd.randint(0, 40))) for _ in "xy")
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for j, y in enumerate(b):
                rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
        assert matching.common_length(a, matching._masks(b), len(b)) == rows[-1][-1]
        assert matching._text(b).most(a) >= matching.ratio(a, b) == matching._text(b).ratio(a)


def test_scores_ask_for_neighbours_of_few_pairs(spark):
    ws = corpus(spark, 20)
    b = matching.current_blocks(ws)
    pairs = matching.near_candidates(b, b.where("doc_id % 5 = 0").select("element_id"))
    got = {(r["source_element_id"], r["element_id"]): r["score"] for r in matching.similarity(pairs, b, 0.8).collect()}
    every = {(r["source_element_id"], r["element_id"]): r["score"] for r in matching.similarity(pairs, b).collect()}
    assert got == {k: v for k, v in every.items() if v >= 0.8} and 0 < len(got) < len(every)


def test_judged_texts_meet_their_neighbours_once(spark):
    ws = corpus(spark, 8)
    asks = ws.blocks.where("ordinal = 0").select(F.col("element_id").alias("source_element_id"), F.concat(F.col("doc_id").cast("string"), F.lit(":1")).alias("candidate_element_id"), F.lit("confirmed").alias("decision"))
    judged = matching.judged_decisions(ws, asks)
    assert plan(judged).count("Join") == 2 and {r["verdict"] for r in judged.collect()} == {"incompatible"}


def made_page(spark, lines, version="v"):
    """Words of one page from (line, words); a line may stand in several places."""
    rows, seq = [], 0
    for number, (line, text) in enumerate(lines):
        for at, word in enumerate(text.split()):
            rows.append((version, 1, seq, line, word, 40.0 * at, 40.0 * at + 30, 100.0 + 10 * number, 110.0 + 10 * number, 612.0, 792.0))
            seq += 1
    return spark.createDataFrame(rows, "version_id string, page int, seq int, line int, text string, x0 double, x1 double, y0 double, y1 double, page_width double, page_height double")


def blocks_of(spark, *texts):
    return spark.createDataFrame([("v", f"e{i}", i, "paragraph", t) for i, t in enumerate(texts)], "version_id string, element_id string, ordinal int, element_type string, normalized_text string")


def test_lines_meet_blocks_as_words_do(spark):
    blocks = blocks_of(spark, "a b c d", "a b", "c d", "x", "a b x")
    # on the second page line 1 comes back, and line 3's words are not numbered one after the other
    for lines in ([(1, "a b"), (2, "c d"), (3, "x")], [(1, "a b"), (2, "c d"), (1, "x"), (3, "a b")], [(None, "a b"), (2, "x")]):
        words = made_page(spark, lines)
        flat, marks = " ".join(t for _, t in lines).split(), [n for n, t in lines for _ in t.split()]
        want = set()
        for i, text in enumerate(["a b c d", "a b", "c d", "x", "a b x"]):
            k = len(text.split())
            for at in range(len(flat) - k + 1):
                begins, ends = at == 0 or marks[at - 1] != marks[at], at + k == len(flat) or marks[at + k] != marks[at + k - 1]
                if flat[at : at + k] == text.split() and begins and ends:
                    want.add((f"e{i}", at, k))
        assert {(r["element_id"], r["seq"], r["n"]) for r in layout.align_phrases(blocks, words).collect()} == want and want
    # words are summed up before they are shuffled: no word is put in order one by one
    assert plan(layout.align_phrases(blocks, made_page(spark, [(1, "a b")]))).count("own0") == 0


def test_runs_that_share_words(spark):
    blocks = blocks_of(spark, "a b c", "b c d", "q", "c d e f", "f")
    runs = [("e0", 0, 3), ("e1", 1, 3), ("e2", 9, 1), ("e3", 20, 4), ("e4", 23, 1)]
    rows = [("v", e, int(e[1]), "paragraph", "", 1, seq, n, phrase) for (e, seq, n), phrase in zip(runs, ["a b c", "b c d", "q", "c d e f", "f"])]
    found = spark.createDataFrame(rows, "version_id string, element_id string, ordinal int, element_type string, header_footer_type string, page int, seq int, n int, phrase string")
    got = layout.resolve_ambiguity(found, blocks)
    assert {r["element_id"]: r["reason"] for r in got.collect()} == {"e0": "overlap", "e1": "overlap", "e2": None, "e3": "overlap", "e4": "overlap"}


def test_boxes_of_whole_and_cut_lines(spark):
    words = made_page(spark, [(1, "a b c"), (2, "d e"), (3, "f g h i")])
    matches = spark.createDataFrame([("v", "whole", 1, 0, 5, 0.99, None), ("v", "cut", 1, 1, 3, 0.5, None), ("v", "over", 1, 7, 9, 0.99, None)], "version_id string, element_id string, page int, seq int, n int, confidence double, reason string")
    got = {(r["element_id"], r["line"]): (r["x0"], r["x1"], r["interactive"]) for r in layout.line_boxes(matches, words).collect()}
    x = lambda v: round(v / 612, 7)
    assert got == {("whole", 1): (0.0, x(110), True), ("whole", 2): (0.0, x(70), True), ("cut", 1): (x(40), x(110), False), ("cut", 2): (0.0, x(30), False), ("over", 3): (x(80), x(150), True)}
    # where all matches are of whole lines, no match is taken apart into words
    assert "sequence(lo" not in plan(layout.line_boxes(matches.where("element_id = 'whole'"), words))


def test_spans_of_a_batch_are_not_held_at_once():
    import tracemalloc

    import pyarrow as pa

    from wordloom.llm.exact_substring import _remove

    n, k = 2_000, 200
    spans = pa.array([[{"lo": 10 * j, "hi": 10 * j + 1} for j in range(k)] for _ in range(4)] * (n // 4), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["x" * 2_100] * n), spans], names=["id", "text", "spans"])
    tracemalloc.start()
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"]) for out in _remove(4, False)(iter([batch])) for r in out.select(["n_bytes", "n_removed", "n_spans"]).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(2_100, 5 * k, k)] * n
    assert most < 90_000_000, most


def test_words_and_phrases_of_a_table_of_queries(spark):
    texts = ["a filed report, filing", "report filed\nno", "the safe filing cabinet", "unfiled", "x fil", "Safe  FILING"]
    b = matching.current_blocks(ingest_blocks(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")))
    asked = ["fil", "filing", "safe filing", "d report", "port,", "no", "zz", "x", None, "fi"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    cols = ("query", "element_id", "occurrence", "start", "end")
    found = search.search(b, queries, literals=0)
    got = sorted(tuple(r[c] for c in cols) for r in found.collect())
    assert got == sorted(tuple(r[c] for c in cols) for r in search.search(b, queries).collect())
    assert {r[0] for r in got} == {"fil", "filing", "safe filing", "d report", "port,", "no", "fi"}
    # words are looked up among the different ones, so letters of texts are cut into n-grams for phrases alone
    alone = search._met_by_table(b, queries.where("query IN ('fil', 'filing')"))
    assert {r["element_id"] for r in alone.collect()} == {"0:0", "1:0", "2:0", "3:0", "4:0", "5:0"} and "arrays_zip" not in plan(alone)


def test_first_page_maps_only_its_blocks(spark):
    texts = [("the " * (i % 4 + 1)).strip() + "\nof thé  the" for i in range(30)]
    b = matching.current_blocks(ingest_blocks(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")))
    cols = ("element_id", "occurrence", "start", "end")
    whole = search.search(b, spark.createDataFrame([("the",)], "query string"))
    for limit in (1, 7, 1000):
        got = [tuple(r[c] for c in cols) for r in search.first_page(b, "The", limit).collect()]
        assert got == [tuple(r[c] for c in cols) for r in search.search_page(whole, limit).collect()] and len(got) == min(limit, whole.count())
    assert search.first_page(b, "x", 5).count() == 0


def test_requests_join_only_asked_blocks(spark):
    ws = corpus(spark, 6)
    first = ws.blocks.where("ordinal = 0")
    requests = first.select(F.col("doc_id").alias("request_id"), "set_id", F.col("element_id").alias("source_element_id"))
    bases = first.select(F.col("doc_id").alias("request_id"), "doc_id", F.col("version_id").alias("base_version_id"))
    targets = ws.blocks.where("ordinal < 2").select(F.col("doc_id").alias("request_id"), "element_id", F.when(F.col("ordinal") == 0, F.repeat(F.lit("x"), 20_001)).otherwise("new").alias("replacement"), F.lit(None).cast("string").alias("decision"))
    found = edits.validate_requests(ws, requests, bases, targets)
    got = sorted((r["request_id"], r["violation"]) for r in found.collect())
    assert got == sorted((i, v) for i in range(6) for v in ("too_long", "incompatible", "near_not_confirmed"))
    # neighbours' wording is settled for the asked blocks before they are joined
    assert "Window" not in plan(found)
