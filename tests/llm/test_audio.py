"""Audio fingerprints: their stride, recordings too short for one, and passages that repeat."""

from __future__ import annotations

import random
from collections import Counter

from wordloom.llm import audio_fingerprint


def prints_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    return audio_fingerprint.fingerprints(audio_fingerprint.add_melody(df, "text"))


def speaker(seed):
    rnd = random.Random(seed)
    return lambda n: [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 5) for _ in range(n)]


def test_two_frames_a_note(spark):
    words = speaker(1)
    shared = words(60)
    texts = [" ".join(words(10) + shared), " ".join(shared + words(10)), " ".join(words(10)), " ".join(words(16))]
    prints = prints_of(spark, texts)
    assert [r["n"] for r in prints.orderBy("id").selectExpr("size(items) AS n").collect()] == [122, 122, 2, 14]
    found = audio_fingerprint.align(prints, prints).collect()
    assert {(r["query"], r["match"], r["offset"]) for r in found} == {(1, 2, 20), (2, 1, -20)}


def test_copies_too_short_for_a_frame_meet(spark):
    prints = prints_of(spark, ["a bb ccc", "a bb ccc", "a bb ddd", "a", "a", "", None])
    assert {r["id"]: (len(r["items"]), r["class_id"]) for r in prints.collect()} == {1: (0, 1), 2: (0, 1), 3: (0, 3), 4: (0, 4), 5: (0, 4), 6: (0, 6), 7: (0, 7)}


def brute_force(prints, least_hits=6, most_errors=0.15):
    items = {r["id"]: [x for x in r["items"]] for r in prints.collect() if r["id"] == r["class_id"]}
    out = {}
    for q, a in items.items():
        for m, b in items.items():
            hits = Counter(i - j for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i : i + 2] == b[j : j + 2]) if q != m else {}
            for offset, n in hits.items():
                over = [(x ^ b[i - offset]).bit_count() for i, x in enumerate(a) if 0 <= i - offset < len(b)]
                errors = sum(over) / (32 * len(over))
                if n >= least_hits and errors <= most_errors:
                    out[q, m] = min(out.get((q, m), (0,)), (-n, errors, abs(offset), -offset))
    return {k: (-v[3], -v[0], v[1]) for k, v in out.items()}


def test_passage_that_repeats(spark):
    words = speaker(2)
    passage, between, end = words(40), words(20), words(36)
    texts = [passage + between + passage + end, passage + end, ["aa"] * 60, ["aa"] * 50 + words(4), ["b", "cc"] * 30, words(3) + ["b", "cc"] * 25]
    prints = prints_of(spark, [" ".join(t) for t in texts])
    got = {(r["query"], r["match"]): (r["offset"], r["hits"], r["bit_errors"]) for r in audio_fingerprint.align(prints, prints).collect()}
    assert got[1, 2][0] == 120 and got[2, 1][0] == -120
    assert got == brute_force(prints)
