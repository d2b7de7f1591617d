"""The training-data operators against brute force on small tables, with nulls, ties, repeated rows and odd texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from by_hand import mixed_copies
from pyspark.sql import functions as F

from wordloom.llm import audio_fingerprint, exact_substring, jaccard_join, packing, queries
from wordloom.llm.common import word_count
from wordloom.llm.exact_substring import exact_substring_dedup
from wordloom.llm.jaccard_join import jaccard_components
from wordloom.llm.line_dedup import line_dedup
from wordloom.llm.lm_score import Model, Trainer, Vocabulary, fit, lm_scores, log_probabilities, padded
from wordloom.llm.mixing import mix_sources, repeat_rows
from wordloom.llm.packing import best_fit, pack_documents, reduce_by_dominance
from wordloom.llm.quality_rules import quality_rules
from wordloom.llm.toxicity import features, toxicity_scores
from wordloom.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def odd_texts(seed=0, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    base = [" ".join(word() for _ in range(rnd.randint(40, 120))) for _ in range(8)]
    out = [None, "", " \n\t ", "one", "one", "a b c", "x" * 3000, "ab " * 900, "\x1f\x85 z", "no\x00ul"]
    while len(out) < n:
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice((0, 0, 1, 3, 12))):
            words[rnd.randrange(len(words))] = word()
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size,percent,rare", [(4, 85, 64), (5, 80, 2), (4, 85, 1)])
def test_jaccard_components(spark, size, percent, rare):
    texts = odd_texts(3, 60)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    comp = list(range(len(texts)))
    for _ in comp:
        for a in range(len(texts)):
            for b in range(a):
                inter = len(sets[a] & sets[b])
                if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = jaccard_components(table(spark, texts), size=size, percent=percent, rare=rare, block=5, load=3000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert len(set(comp)) < len(comp) - 10


def test_jaccard_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (1, "A B c d e"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, None), (3, 1), (3, 1), (1, 1), (2, 2)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0


def removed_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    want = {}
    for i, b in enumerate(data):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("length,span", [(40, 16), (70, 48)])
def test_exact_substring(spark, length, span):
    texts = odd_texts(5, 40)
    texts += [texts[-1], "q" * 39, "pq" * 30]
    rnd = random.Random(6)
    # copies cut and changed at many places, constant and periodic texts, and a passage many documents share
    passage = " ".join(rnd.choice(texts[20].split()) for _ in range(60))
    texts += [passage[a:b] for a, b in ((0, 200), (3, 190), (50, 260), (17, 130), (100, 300))]
    texts += [passage[:k] + "#" + passage[k + 1 :] for k in (30, 75, 76, 120, 200)]
    texts += ["z" * 500, "z" * 41, "yz" * 100, "- " * 300, "abcdefghijklmnop" * 40, "x" + "z" * 60 + passage[20:90] + "z" * 60]
    got = exact_substring_dedup(table(spark, texts), length=length, span=span).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed_by_hand(texts, length)


def test_repetitive_text_is_a_few_rows():
    for text in ("a" * 200_000, "ab" * 100_000, "- " * 100_000, "abcdefghijklmnop" * 12_500):
        parts = [(*p, np.zeros(len(p[0]), dtype=np.int64), np.ones(len(p[0]), dtype=np.int64)) for p in exact_substring.Parser(400, 128).words(text.encode())]
        assert len(exact_substring._merged_words(parts)) < 60


def test_parser_parts_agree(monkeypatch):
    text = " ".join(random.Random(1).choice(("lorem", "ipsum", "dolor")) + str(i % 97) for i in range(3000)).encode()
    whole = [np.concatenate(c) for c in zip(*exact_substring.Parser(40, 16).words(text))]
    monkeypatch.setattr(exact_substring, "PART", 1000)
    parts = [np.concatenate(c) for c in zip(*exact_substring.Parser(40, 16).words(text))]
    cover = lambda w: sorted((int(n), int(q), i) for n, q, lo, hi in zip(w[0], w[2], w[3], w[4]) for i in range(lo, hi + 1))
    assert cover(whole) == cover(parts)


def test_line_dedup(spark):
    texts = ["Shared line here\nown one\n shared LINE here ", "x\nshared line here", None, "", "short\nshort", "short", "Shared line here\n\nend"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(table(spark, texts)).collect()}
    assert got[0] == (texts[0], 3, 0) and got[1] == ("x", 2, 1) and got[2] == ("", 1, 0) and got[4] == ("short\nshort", 2, 0) and got[6] == ("\nend", 3, 1)
    three = {r["doc_id"]: r["n_dropped"] for r in line_dedup(table(spark, texts), min_docs=4).collect()}
    assert set(three.values()) == {0}
    twice = line_dedup(table(spark, texts).unionByName(table(spark, texts))).where("doc_id = 1").collect()
    assert [r["n_dropped"] for r in twice] == [1, 1]


def test_quality_rules(spark):
    texts = [*odd_texts(2, 20), "the cat of and " * 30, "| a | b " * 20, "The house of the man and the tree that is in a garden by the river with the bird on it."]
    got = {r["doc_id"]: r["quality"] for r in quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = BLANK.findall(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered)), i
    assert got[len(texts) - 1]["kept"] and not got[len(texts) - 2]["kept"] and not got[0]["kept"]


def test_mixing(spark):
    rnd = random.Random(4)
    texts = [" ".join("w" for _ in range(rnd.randint(1, 40))) for _ in range(400)] + [None, ""]
    sources = ["a"] * 330 + ["b"] * 20 + ["c"] * 20 + [None] * 32
    got = mix_sources(table(spark, texts, sources))
    rows = got.collect()
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len((t or "").split())
    weight, full, target = {"a": 1, "b": 2, "c": 3, None: 1}, set(), {}
    while True:
        rest, w = sum(size.values()) - sum(3 * size[s] for s in full), sum(v for s, v in weight.items() if s not in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / w for s in weight}
        new = {s for s in weight if target[s] > 3 * size[s] + 1e-9} - full
        if not new:
            break
        full |= new
    taken = Counter()
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert full and all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(table(spark, texts, sources)).collect()))
    assert repeat_rows(got).count() == sum(r["copies"] for r in rows)
    assert mix_sources(table(spark, texts).limit(0)).count() == 0


def test_mixing_by_hand(spark):
    rnd = random.Random(12)
    texts = [rnd.choice(["w ", "#w ", "x% & "]) * rnd.randint(0, 40) for _ in range(300)] + [None, "long " * 5000]
    sources = [rnd.choice(["a", "a", "a", "b", "c", "d", None]) for _ in texts]
    got = {r["doc_id"]: r["copies"] for r in mix_sources(table(spark, texts, sources), buckets=8).collect()}
    assert got == mixed_copies([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))])


def test_word_count(spark):
    got = [r["n"] for r in table(spark, odd_texts(6, 30)).orderBy("doc_id").select(word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(BLANK.findall(t or "")) for t in odd_texts(6, 30)]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    coder = Tokenizer.from_file(path)
    texts = [*odd_texts(7, 30), "Don't. ÉCOLE! ΣΑΣ <|endoftext|> 日本語。 é é's «x».", "w " * 200]
    got = pack_documents(table(spark, texts), path, capacity=64).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    for i, t in enumerate(texts):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            r = pieces.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), (i, k)
    assert not pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        assert [a for a, _ in sorted(s)] == list(np.cumsum([0] + [n for _, n in sorted(s)])[:-1]) and sum(n for _, n in s) <= 64


def least_sets(items, cap):
    """The fewest sets by exhaustive search."""
    best = len(items)

    def go(k, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if k == len(items):
            best = len(spaces)
            return
        for i in sorted({s: i for i, s in enumerate(spaces) if s >= items[k]}.values()):
            go(k + 1, [*spaces[:i], spaces[i] - items[k], *spaces[i + 1 :]])
        go(k + 1, [*spaces, cap - items[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_the_optimum(seed):
    rnd = random.Random(seed)
    cap = rnd.choice((10, 30, 100))
    items = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))), reverse=True)
    fixed, rest = reduce_by_dominance(Counter(items), cap)
    left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(m for _, m in fixed) + (least_sets(left, cap) if left else 0) == least_sets(items, cap)


@pytest.mark.parametrize("seed", range(8))
def test_packed_lengths(seed):
    rnd = random.Random(seed)
    cap = rnd.choice((10, 50, 100))
    counts = Counter(rnd.randint(1, cap) for _ in range(rnd.randint(1, 200)))
    sets = packing.pack_lengths(counts, cap)
    assert Counter({k: sum(m * s.count(k) for s, m in sets) for k in counts}) == counts and all(sum(s) <= cap for s, _ in sets)
    assert sum(m for _, m in sets) <= sum(m for _, m in best_fit(counts, cap))


def test_url_filter(spark):
    urls = ["https://Example.com/en/x", "https://www.example.com/en/y?q#f", "http://a.b.net/es/z", "http://cheap-pills.example.org/a", "http://spamfarm.org/", "http://spam-farm.org", None, "nothing", "http://x.com", "http://net/fr/?"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df, queries.URL_RULES).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/y", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == (None, "block") and got[4][3] == "allow" and got[5][3] == "block"
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][1:3] == ("", None) and got[9][2:] == ("net/fr/", "block")


def lm_by_hand(fitted, count, words):
    """log10 of the probability of a text, token by token, with all sums written out."""
    v, m = fitted.vocabulary, fitted.model
    classes, before, total = v.classes(), [v.number(b"\n")] * 3, 0.0
    for w in words:
        n = v.number(w)
        h = sum(m.context[b] * m.position[k] for k, b in enumerate(before[::-1]))
        odds = np.exp((m.group @ h + m.offset).astype(np.float64))
        total += math.log10(odds[classes[n]] / odds.sum())
        if n < v.own:
            mates = [i for i in range(v.own) if classes[i] == classes[n]]
            odds = {i: math.exp(float(m.token[i] @ h + m.bias[i])) for i in mates}
            total += math.log10(odds[n] / sum(odds.values()))
        else:
            total += math.log10((count[w] + 1) / fitted.within[n - v.own])
        before = [*before[1:], n]
    return total


def test_lm_scores(spark):
    texts = [*odd_texts(8, 40), None]
    fitted = fit(table(spark, texts), head=50, own=30, least=3, rare=5, dim=8, warm=500)
    rows = {r["doc_id"]: r for r in lm_scores(table(spark, texts), fitted=fitted).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    c = Counter(w for i, t in enumerate(toks) if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    assert fitted.vocabulary.own > 5 and fitted.within.sum() == 5 + sum(k + 1 for w, k in c.items() if fitted.vocabulary.number(w) >= fitted.vocabulary.own)
    for i, t in enumerate(toks):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], lm_by_hand(fitted, c, t), rel_tol=1e-4)
    assert lm_scores(table(spark, texts).limit(0)).count() == 0


def test_lm_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b", 1, 2), (3, "a b", 1, 2), (3, None, 1, 2), (3, "a b", 1, 2)], "doc_id long, text string, score int, rare int")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["held_out"]) for r in lm_scores(df).collect())
    assert got == sorted([("None", 3, zlib.crc32(b"") % 7 == 2), ("3", 3, zlib.crc32(b"3") % 7 == 2), ("3", 1, zlib.crc32(b"3") % 7 == 2), ("3", 3, zlib.crc32(b"3") % 7 == 2)])


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    words = [b"w%d" % i for i in range(40)]
    v = Vocabulary({w: 60 - i for i, w in enumerate(words)}, 1000, 40, 30, 3, 4)
    m = Model(*(rng.normal(0, 1, s).astype(np.float32) for s in ((34, 6), (3, 6), (34, 6), 34, (v.groups + 4, 6), v.groups + 4)))
    for b in rng.integers(0, 34, (5, 3)):
        runs = np.array([[*b, n] for n in range(34)]).ravel()
        assert abs((10 ** log_probabilities(m, v, runs, np.tile([False, False, False, True], 34))).sum() - 1) < 1e-4


def test_lm_learns_from_three_tokens():
    """Words of two tongues: what comes before tells which one."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, 30) + 50 * rng.integers(0, 2) for _ in range(400)]
    v = Vocabulary({b"w%d" % i: 1000 - i for i in range(100)}, 12_000, 100, 100, 1, 2)
    numbers = np.concatenate([np.full(100, 120.0), [1, 1]])
    m = Model.start(numbers, v.classes(), 8, 1)
    flat, real = padded(texts, 100)
    trainer = Trainer(m, numbers, v.classes(), batch=128)
    for _ in range(3):
        trainer.run(flat, real)
    assert log_probabilities(m, v, flat, real).mean() > -2 + 0.2


def test_lm_gains_on_held_out_texts(spark):
    """On the small table held-out texts get at least 0.15 log10 a token more than from word counts."""
    path = Path("/root/testdata/sf0.01")
    if not path.exists():
        pytest.skip("no test tables")
    got = queries.op8_lm_score(spark, str(path)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.15


def test_toxicity(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    texts, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.3
        w = [word() for _ in range(rnd.randint(20, 60))]
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(("you idiot", "stupid", "blorb")))
        texts.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    texts += [None, ""]
    got = toxicity_scores(table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), trees=5).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] and 0 <= r["score"] <= 1 for r in got) and len(got) == 602
    assert sum(r["predicted"] == labels[r["doc_id"]][2] for r in held) / len(held) > 0.95
    none = toxicity_scores(table(spark, texts[:5]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert features("you 1d10t!", {"idiot": 2.0}, {})[1] == 0.5


def test_audio(spark):
    rnd = random.Random(1)
    words = lambda n: [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 5) for _ in range(n)]
    shared = words(60)
    a, b, c = " ".join(words(10) + shared), " ".join(shared + words(10)), " ".join(words(70))
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, a), (5, None), (6, "")], "id long, text string")
    prints = audio_fingerprint.fingerprints(audio_fingerprint.add_melody(df, "text"))
    assert {r["id"]: r["class_id"] for r in prints.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6}
    found = audio_fingerprint.align(prints, prints).collect()
    assert {(r["query"], r["match"], r["offset"]) for r in found} == {(1, 2, 20), (2, 1, -20)}
    samples, rate = audio_fingerprint.read_wav(audio_fingerprint.melody(c))
    noisy = samples + np.random.default_rng(0).normal(0, 60, len(samples))
    x, y = audio_fingerprint.fingerprint(samples, rate), audio_fingerprint.fingerprint(noisy, rate)
    assert np.bitwise_count(x ^ y).mean() < 3
    assert len(audio_fingerprint.read_wav(b"junk")[0]) == 0


def test_spanning_forest_and_words():
    assert len(jaccard_join._spanning(np.array([[0, 1], [1, 2], [0, 2]]), 3)) == 2
    assert packing.word_coder(queries.tokenizer_path())(b"") == b""
