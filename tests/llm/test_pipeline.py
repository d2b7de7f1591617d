"""The pipeline's stages against plain Python over the same rows."""

from __future__ import annotations

import random
import re
from collections import Counter

from by_hand import mixed_copies
from tokenizers import Tokenizer

import corpus_pipeline
from wordloom.llm.common import written
from wordloom.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS
from wordloom.llm.queries import tokenizer_path

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7)))
    line = lambda: " ".join([*(word() for _ in range(rnd.randint(6, 14))), "the", "of"])
    shared = [line() for _ in range(3)]
    rows = [(0, None), (1, ""), (2, "too short"), (3, "a | b | c # d % e $ " * 10), (4, "SHOUT AND CRY " * 12), (5, "\n".join(["same line of the text here"] * 9))]
    bases = ["\n".join(" ".join(line() for _ in range(9)) for _ in range(rnd.randint(1, 2))) for _ in range(14)]  # edits make long lines differ
    for i in range(6, 70):
        text = rnd.choice(bases).split("\n")
        if rnd.random() < 0.2:
            text[rnd.randrange(len(text))] = line()
        if rnd.random() < 0.4:
            text.insert(rnd.randrange(len(text)), rnd.choice(shared))
        words = "\n".join(text).split(" ")
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return [(i, t, "en", rnd.choice(["a", "a", "b", None]), len(t or "")) for i, t in rows]


def kept(text):
    w, t = BLANK.findall(text or ""), text or ""
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(grams)
    repeated = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)})
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    letters = [c for c in t if c.isalpha()]
    share = lambda a, b: a / b if b else 0.0
    v = {
        "n_words": len(w), "n_stop_words": len({x.lower() for x in w} & set(STOP_WORDS)), "mean_word_chars": share(sum(map(len, w)), len(w)), "symbol_ratio": share(sum(t.count(c) for c in SYMBOLS), len(w)),
        "capital_ratio": share(sum(c.isupper() for c in letters), len(letters)), "exclamation_ratio": share(t.count("!"), len(w)), "duplicate_line_ratio": share(len(lines) - len(set(lines)), len(lines)), "repeat_ratio": share(repeated, len(w)),
    }
    return all(len(w) < r.min_words or ((r.low is None or v[r.feature] >= r.low) and (r.high is None or v[r.feature] <= r.high)) for r in RULES)


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        got.append(docs.collect())
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)

    texts = {r[0]: r[1] for r in rows if kept(r[1])}
    assert {r["doc_id"] for r in got[0]} == set(texts) and len(texts) < 67

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    first: dict[str, list[int]] = {}
    for i, t in texts.items():
        for x in t.split("\n"):
            first.setdefault(key(x), []).append(i)
    for i, t in texts.items():
        texts[i] = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or len(set(first[key(x)])) < 2 or min(first[key(x)]) == i)
    assert {r["doc_id"]: r["text"] for r in got[1]} == texts and all(r["n_chars"] == len(r["text"]) for r in got[1])

    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + min(5, len(w))]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert sorted(r["doc_id"] for r in got[2]) == sorted(i for i in comp if comp[i] == i) and len(got[2]) < len(got[1])

    times = Counter(r["doc_id"] for r in got[3])
    want = mixed_copies([(r["doc_id"], r["text"], r["source"]) for r in got[2]])
    assert times == {i: n for i, n in want.items() if n} and max(times.values()) <= 3
    coder = Tokenizer.from_file(tokenizer_path())
    ids = {i: len(coder.encode(texts[i], add_special_tokens=False).ids) + 1 for i in times}
    assert sum(r["length"] for r in got[4]) == sum(ids[i] * n for i, n in times.items())
    assert Counter(r["doc_id"] for r in got[4] if r["piece"] == 0) == times
    by: dict[int, list[tuple[int, int]]] = {}
    for r in got[4]:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got[4])


def test_results_of_a_stage_outlive_later_calls(spark, tmp_path):
    """What a stage returned can still be read after the same stage, or a whole run, has worked on other rows."""
    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs, other = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:30], schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        first = stage(spark, docs, "")
        n = first.count()
        stage(spark, other, "").count()
        assert first.count() == n, name
    one, two = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert one.count() == two.count() > 0


def test_a_run_leaves_the_tables_of_its_last_stage_alone(spark, tmp_path):
    import os

    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(top))
    corpus_pipeline.run(spark, str(tmp_path))
    new = set(os.listdir(top)) - before
    assert len(new) == 1 and new.pop().endswith("-packing")
