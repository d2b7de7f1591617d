"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import audio_fingerprint
from wordloom.llm.exact_substring import exact_substring_dedup
from wordloom.llm.jaccard_join import jaccard_components
from wordloom.llm.line_dedup import line_dedup
from wordloom.llm.lm_score import lm_scores
from wordloom.llm.mixing import mix_sources
from wordloom.llm.packing import pack_documents
from wordloom.llm.quality_rules import quality_rules
from wordloom.llm.queries import URL_RULES, tokenizer_path
from wordloom.llm.toxicity import toxicity_scores
from wordloom.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that an operator uses inside, or appends.
NAMES = """id row key near word at lo hi doc doc2 n tokens comp token hits drops drop_id _drops _drop_id _drop_mark _mark pos m0 d0 k0 parts cut_range _last last _plan_source plan_source src range size
source_size target copies taken host path rule verdict decided terms url quality kept n_lines n_dropped held_out score predicted label_id draw maybe spans part block weight audio items digest class_id mark places""".split()


def fixture():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    long = " ".join(word() for _ in range(60_000))
    texts = ["one line\nshared by two documents here\nend", "other\nshared by two documents here", "", None, long, "w" * 300_000, "a b c d e f g h", "  \n\t ", "\x00\x1f é"]
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, "a b c d e f g h", None, None, None), (None, None, None, None, None), (5, "another text with one id", None, "s", None)]


def prints(df):
    turns = df.withColumn("text", F.substring("text", 1, 3000))
    return audio_fingerprint.fingerprints(audio_fingerprint.add_melody(turns, "text"), id_col="doc_id").drop("items", "digest")


def toxic(df):
    labels = df.sparkSession.createDataFrame([(0, 1), (1, 0), (4, 1), (6, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    return toxicity_scores(df, labels, trees=2)


#: Operator, and the columns of its result that name the row and hold the verdict.
OPERATORS = {
    "url_filter": (lambda df: url_filter(df, URL_RULES, url_col="text"), ("doc_id", "text", "host", "path", "rule", "verdict")),
    "toxicity": (toxic, ("doc_id", "held_out", "predicted")),
    "exact_substring": (lambda df: exact_substring_dedup(df, keep_text=False), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    "quality_rules": (quality_rules, ("doc_id", "text", "quality")),
    "line_dedup": (line_dedup, ("doc_id", "text", "n_lines", "n_dropped")),
    "mixing": (mix_sources, ("doc_id", "text", "size", "source_size", "target", "copies", "taken")),
    "jaccard_join": (jaccard_components, ("doc_id", "n_shingles", "component_id")),
    "lm_score": (lm_scores, ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")),
    "packing": (lambda df: pack_documents(df, tokenizer_path()), ("doc_id", "piece", "start", "length", "ids_crc32")),
    "audio_fingerprint": (prints, ("id", "seconds", "items_crc32", "class_id")),
}


def shown(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_names(spark, name):
    operator, columns = OPERATORS[name]
    rows = spark.createDataFrame(fixture(), SCHEMA)
    once = operator(rows)
    plain = shown(once, columns)
    if name != "packing":
        assert len(plain) == len(fixture())
    assert {r[0] for r in once.select(columns[0]).collect()} == {r[0] for r in fixture()}
    used = {"doc_id", "text", "lang", "source", "n_chars"}
    more = rows.select("*", *(F.lit(f"{n}!").alias(n) for n in NAMES if n not in used))
    assert shown(operator(more), columns) == plain
    # equal rows have equal results
    key = [c for c in columns if c in ("doc_id", "id")][0]
    zeros = [x for x in shown(once.where(F.col(key) == 0), columns)]
    assert len(zeros) % 2 == 0 and zeros[: len(zeros) // 2] == zeros[len(zeros) // 2 :] or name == "packing" and len(zeros) == 2
    assert operator(rows.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = spark.createDataFrame(fixture(), SCHEMA)
    out = stage(spark, rows.select("*", *(F.lit("x").alias(n) for n in ("row", "kept", "size", "component_id", "_n", "_kept"))), "")
    assert out.count() > 0
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if name == "near_duplicates":
        kept = sorted(map(str, (r["doc_id"] for r in out.collect())))
        # one of the repeated row 0, both texts of id 5, the named one of two equal texts, and all texts without words
        assert kept.count("0") == 1 and kept.count("5") == 2 and kept.count("6") == 1 and kept.count("3") == 2 and kept.count("None") == 1
    assert stage(spark, rows.limit(0), "").count() == 0


def test_sampled_rates_align(spark):
    """One melody at two rates has nearly the same integers; silence has no landmark."""
    import math

    import numpy as np

    rnd = np.random.default_rng(3)
    tones = 220 * 2 ** (rnd.integers(0, 24, 60) / 12)
    play = lambda rate: np.concatenate([np.sin(2 * math.pi * f * np.arange(int(rate * 0.2)) / rate) * 12_000 for f in tones])
    low, high = audio_fingerprint.fingerprint(play(4000), 4000), audio_fingerprint.fingerprint(play(44_100), 44_100)
    n = min(len(low), len(high))
    assert abs(len(low) - len(high)) <= 2 and np.bitwise_count(low[:n] ^ high[:n]).mean() < 3
    silence = audio_fingerprint.melody("")
    assert len(audio_fingerprint.fingerprint(np.zeros(20_000))) and audio_fingerprint.read_wav(silence)[0].size == 0


def test_repeated_ids_lose_no_alignment(spark):
    rnd = random.Random(7)
    words = lambda n: " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 5) for _ in range(n))
    a, b, c = words(60), words(60), words(20)
    df = spark.createDataFrame([(1, a), (1, b), (2, f"{b} {c}"), (3, f"{a} {c}")], "id long, text string")
    p = audio_fingerprint.fingerprints(audio_fingerprint.add_melody(df, "text"))
    got = {(r["query"], r["match"]) for r in audio_fingerprint.align(p, p).collect()}
    assert {(1, 2), (1, 3), (2, 1), (3, 1)} <= got


def test_url_terms_in_percent_codes(spark):
    urls = ["http://a.org/c%61sino", "http://a.org/%zz", "http://a.org/porn%C3%A9x", "http://a.org/free-p%6Fker"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, host string")
    got = [r["verdict"] for r in url_filter(df, [], url_col="host").orderBy("page_id").collect()]
    assert got == ["block", "allow", "block", "block"]
    shown = url_filter(df, [], url_col="host").orderBy("page_id").first()
    assert (shown["host"], shown["path"]) == ("a.org", "/c%61sino")


def test_vocabulary_against_a_plain_scan(spark):
    from wordloom.llm.url_filter import SOFT_TERMS, STRICT_TERMS

    rnd = random.Random(8)
    terms = [*STRICT_TERMS, *SOFT_TERMS]
    assert len(terms) == len(set(terms)) > 150
    urls = ["http://h.org/" + "".join(rnd.choice(terms) + rnd.choice(["-", "", "1", "/", "é", "."]) for _ in range(rnd.randint(0, 3))) for _ in range(300)]
    got = {r["u"]: (r["n_strict"], r["n_soft"], r["soft_weight"]) for r in url_filter(spark.createDataFrame([(u,) for u in set(urls)], "u string"), [], url_col="u").collect()}
    inside = set("abcdefghijklmnopqrstuvwxyz0123456789")

    def held(url, term):
        at = url.find(term)
        while at >= 0:
            if (at == 0 or url[at - 1] not in inside) and (at + len(term) == len(url) or url[at + len(term)] not in inside):
                return True
            at = url.find(term, at + 1)
        return False

    for u in set(urls):
        soft = [t for t in SOFT_TERMS if held(u, t)]
        assert got[u] == (sum(held(u, t) for t in STRICT_TERMS), len(soft), sum(SOFT_TERMS[t] for t in soft)), u


def test_near_texts_with_text_ids(spark):
    """Ids that aren't numbers: components by brute force, equal ids of different texts join theirs."""
    base = [f"w{k}" for k in range(60)]
    near = [*base[:30], "other", *base[31:]]
    far = [f"v{k}" for k in range(40)]
    rows = [("b", " ".join(base)), ("a", " ".join(near)), ("c", " ".join(far)), ("c", " ".join(near)), ("d", " ".join(far)), ("e", ""), ("e", None), (None, " ".join(base)), ("z", "lonely text of a few words")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame([(*r, 1) for r in rows], "own_id string, text string, row int"), id_col="own_id").collect()), key=str)
    assert got == sorted([("b", 57, "a"), ("a", 57, "a"), ("c", 37, "a"), ("c", 57, "a"), ("d", 37, "a"), ("e", 0, "e"), ("e", 0, "e"), (None, 57, None), ("z", 3, "z")], key=str)


@pytest.mark.parametrize("weight", [1.0, 0.5, 0.1])
def test_no_range_of_keys_is_crowded(spark, weight):
    """Whatever the weight, the range in which a budget ends has far less than a hundredth of its source."""
    from wordloom.llm.mixing import uniform

    keys = spark.range(40_000).select((-F.log(uniform(20, F.col("id"))) / weight).alias("key"))
    most = keys.groupBy(F.floor(F.log2("key") * 1024)).count().agg(F.max("count")).first()[0]
    assert most < 400 // 8


def test_mixing_with_low_weights_by_hand(spark):
    """A noisy source whose budget ends among crowded keys: the same documents as by hand."""
    from by_hand import mixed_copies

    rows = [(i, "# word " * (1 + i % 7), "ab"[i % 2] if i < 900 else "c") for i in range(1000)]
    got = {r["doc_id"]: r["copies"] for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == mixed_copies(rows)
