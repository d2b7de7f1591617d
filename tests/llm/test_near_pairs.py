"""What the Jaccard join reads again and pairs: little else than it has to, and no link less."""

from __future__ import annotations

import random

import pytest

from wordloom.llm import jaccard_join
from wordloom.llm.jaccard_join import jaccard_components


def near_texts(seed: int, families: int, members: int, changes: tuple[int, int]) -> list[str]:
    """Families of texts of about 60 words, a number of words of each changed."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(10**6)}"
    out = []
    for _ in range(families):
        base = [word() for _ in range(rnd.randint(40, 80))]
        for _ in range(members):
            w = list(base)
            for k in rnd.sample(range(len(w)), rnd.randint(*changes)):
                w[k] = word()
            out.append(" ".join(w[: len(w) - rnd.randint(0, 4)]))
    return out


def test_whole_sets_are_read_of_the_ids_asked_for(spark):
    """Ids are row numbers here, whose low bits are the same in each of 64 partitions."""
    rnd = random.Random(3)
    ids = [(p << 33) + n for p in range(64) for n in range(60)]
    docs = spark.createDataFrame([(i, f"a b c d {i}") for i in ids], "id long, text string")
    asked = rnd.sample(ids, 400)
    got = {r["id"] for r in jaccard_join._read_again(docs, spark.createDataFrame([(i,) for i in asked], "id long"), 4).collect()}
    assert got >= set(asked) and len(got) < 500


def test_documents_that_cannot_link_are_not_paired(spark, monkeypatch):
    """Three texts each share the five tokens that end their prefixes, where a link takes seven of them."""
    rnd, tables = random.Random(5), {}
    texts = [[f"own {i} {k}" for k in range(8)] + [f"three {i % 13} {k}" for k in range(5)] + rnd.sample([f"all {k}" for k in range(100)], 41) for i in range(39)]
    plain = jaccard_join.written

    def written(df, label, *more):
        tables[label] = plain(df, label, *more)
        return tables[label]

    monkeypatch.setattr(jaccard_join, "written", written)
    sets = spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>").selectExpr("id", "cast(size(words) as long) AS n", "transform(words, w -> xxhash64(w)) AS tokens")
    assert jaccard_join._linked(sets, 80, 64, 1024, 10**6).count() == 0
    assert tables["open-keys"].count() == 39 * 5 and tables["pairs"].count() == 0


@pytest.mark.parametrize(("size", "percent", "rare", "changes"), [(1, 80, 64, (1, 6)), (5, 80, 64, (0, 3)), (5, 80, 3, (0, 3)), (1, 85, 4, (2, 6)), (1, 75, 2, (2, 8))])
def test_links_near_the_threshold(spark, size, percent, rare, changes):
    texts = near_texts(size + rare, 12, 9, changes)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    comp = list(range(len(texts)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, size=size, percent=percent, rare=rare, block=5, load=3000).collect()}
    assert got == dict(enumerate(comp)) and len(links) > 10 and len(set(comp)) > 20
