"""Embedding near-dedup, conversation repair and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import conversation_repair, periodic_runs, queries
from wordloom.llm.conversation_repair import ConversationRepair, cheapest
from wordloom.llm.embedding_dedup import Tables, learn_rotation, near_vectors

# ---- embeddings


def brute_links(rows):
    """(id, vector) rows -> (id, n_links, component_id) of each, by all pairs."""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return out


def group(rnd, n, dims, noise):
    c = rnd.standard_normal(dims)
    c /= np.linalg.norm(c)
    return [(c + noise * rnd.standard_normal(dims) / math.sqrt(dims)).astype(np.float32) for _ in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(3)
    vs = [v for n, noise in ((60, 0.1), (40, 0.2), (30, 0.23), (8, 0.02), (2, 0.05), (2, 0.2)) for v in group(rnd, n, 32, noise)]
    vs += list(rnd.standard_normal((120, 32)).astype(np.float32))
    vs += [vs[0], vs[0], 7 * vs[1]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    odd = [None, [], [0.0] * 32, [math.nan] * 32, [math.inf] + [1.0] * 31, [None] + [1.0] * 31, rows[0][1][:31]]
    return rows + [(1000 + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors_equal_all_pairs(spark, vectors, block):
    """Of threshold pairs one in a hundred may be missed; on these rows none is, in whole buckets and in blocks."""
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, miss=1e-6, block=block).collect()}
    want = {i: (n, c, i == c) for i, n, c in brute_links([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in vectors])}
    assert got == want
    assert max(n for n, *_ in got.values()) > 30


def test_near_vectors_with_text_ids_repeated_rows_and_equal_ids(spark):
    rnd = np.random.default_rng(4)
    a, b = ([float(x) for x in v] for v in group(rnd, 2, 16, 0.01))
    far = [float(x) for x in np.float32(rnd.standard_normal(16))]
    df = spark.createDataFrame([("b", a), ("b", a), ("c", b), ("a", far), ("c", far), (None, b)], "id string, v array<double>")
    got = sorted(map(tuple, near_vectors(df, vec_col="v", id_col="id").collect()), key=str)
    assert got == sorted([("b", 3, "b", True), ("b", 3, "b", True), ("c", 3, "b", False), ("a", 1, "a", True), ("c", 1, "a", False), (None, 3, "b", False)], key=str)


def test_near_vectors_of_an_empty_table_and_of_none_that_count(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).collect() == []
    none = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(none).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_rotation_is_orthogonal_and_lowers_the_quantisation_error():
    rnd = np.random.default_rng(5)
    x = np.concatenate([np.stack(group(rnd, 100, 16, 0.6)) for _ in range(6)]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    error = lambda r: ((np.sign(x @ r) - x @ r) ** 2).sum()
    first, last = learn_rotation(x, 16, 0, rounds=0), learn_rotation(x, 16, 0)
    assert np.allclose(last.T @ last, np.eye(16)) and error(last) < error(first)


def test_more_items_have_wider_tables_and_more_of_them():
    small, large = Tables(1_000, 0.95, 0.01), Tables(10**9, 0.95, 0.01)
    assert small.width < large.width and small.tables < large.tables


def test_recall_of_pairs_at_the_threshold(spark):
    """Vectors at the threshold itself: at least nine of ten links are found, and none below it."""
    rnd = np.random.default_rng(6)
    rows = []
    for i in range(400):
        a = rnd.standard_normal(64)
        b = rnd.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        cos = rnd.uniform(0.94, 0.96)
        rows += [(2 * i, [float(x) for x in a]), (2 * i + 1, [float(x) for x in cos * a + math.sqrt(1 - cos * cos) * b])]
    got = {r[0]: r[1] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: n for i, n, _ in brute_links(rows)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.95 * sum(want.values())


# ---- conversations


def by_all_ways(rows, states=(0,)):
    """Least (cost, audit) by a table of all prefixes, rows as (initial, must go, truncated)."""
    expected, after = "uuau", (2, 2, 3, 2)
    ways = {s: (0, "") for s in states}

    def inserted(ways):
        for _ in range(8):
            for s, (c, a) in list(ways.items()):
                new = (c + 2, a + "I")
                if after[s] not in ways or new < ways[after[s]]:
                    ways[after[s]] = new
        return ways

    for initial, forced, cut in rows:
        new: dict = {}
        for s, (c, a) in inserted(ways).items():
            options = [(s, 3, "D")]
            if not forced:
                options.append((after[s], 2 + cut, "R"))
                if initial == "s" and s == 0:
                    options.append((1, cut, "K"))
                if initial == expected[s]:
                    options.append((after[s], cut, "K"))
            for t, more, letter in options:
                if t not in new or (c + more, a + letter) < new[t]:
                    new[t] = (c + more, a + letter)
        ways = new
    return min(w for s, w in inserted(ways).items() if s in (0, 3))


def test_search_equals_the_best_of_all_short_conversations():
    rows = list(product("sux", (False, True), (False, True)))
    for n in range(4):
        for some in product(rows, repeat=n):
            assert cheapest(list(some), 0, conversation_repair._FINISH) == by_all_ways(some)


def test_search_equals_the_best_on_long_conversations_and_stays_linear():
    rnd = random.Random(2)
    for _ in range(200):
        rows = [(rnd.choice("suuaax"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(4, 60))]
        assert cheapest(rows, 0, conversation_repair._FINISH) == by_all_ways(rows)
    for initials in ("s", "u", "a", "sua", "uuaa"):
        rows = [(initials[i % len(initials)], False, i % 3 == 0) for i in range(1000)]
        assert cheapest(rows, 0, conversation_repair._FINISH) == by_all_ways(rows)


def repaired_by_hand(turns):
    """(conv, turn, role, text) rows -> conv -> counts, cost, audit and digest."""
    out = {}
    for conv in {c for c, *_ in turns}:
        rows = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns if c == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        given = [t for t, *_ in rows if t is not None]
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = by_all_ways([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(rows, faults)])
        lines, state, todo = [], 0, list(rows)
        for edit in audit:
            if edit == "I":
                lines.append(("uuau"[state] == "u" and "user" or "assistant") + ":")
            else:
                _, role, text = todo.pop(0)
                if edit == "D":
                    continue
                lines.append((role if edit == "K" else "user" if "uuau"[state] == "u" else "assistant") + ":" + text)
            state = 1 if edit == "K" and role[:1] == "s" and state == 0 else (2, 2, 3, 2)[state]
        out[conv] = (
            max(given) - min(given) + 1 - len(set(given)) if given else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations():
    rnd = random.Random(7)
    texts = ["Yes.", "No!", "cut of", "", " \n", "Why? \t", "x" * 100_000, "Good. ", None]
    rows = []
    for conv in [*range(80), None]:
        for turn in range(rnd.choice([1, 2, 5, 9, 40])):
            rows.append((conv, turn + (turn > 3), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rnd.choice(texts)))
    rows.append((3, None, "user", "First."))
    return rows


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize("fragment", [1024, 3])
def test_query_equals_repair_by_hand(spark, tmp_path, monkeypatch, fragment):
    rows = conversations()
    spark.createDataFrame([(*r, i, "row") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, place int, plans string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = repaired_by_hand(damaged_by_hand(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    if fragment == 1024:
        found = queries.op12_conversation_repair(spark, str(tmp_path))
        assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert {r[0]: tuple(r)[1:] for r in found.collect()} == {c: want.get(c, nothing) for c, *_ in rows}
        return
    # short fragments, as a task sees them of long conversations
    monkeypatch.setattr(conversation_repair, "FRAGMENT", fragment)
    by_conv: dict = {}
    for conv, *row in sorted(damaged_by_hand(rows), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        by_conv.setdefault(conv, []).append(row)
    for conv, own in by_conv.items():
        chain, seen = conversation_repair._Chain(conv), set()
        for lo in range(0, len(own), fragment):
            part = conversation_repair._Fragment(conv, (0, 0, 0, 0))
            for turn, role, text in own[lo : lo + fragment]:
                bare = text.strip(" \t\n\x0b\x0c\r")
                part.add(turn, role[:1], not bare, (role, text) in seen, not bare or bare[-1] not in ".!?")
                seen.add((role, text))
            r = part.row(False)
            chain.add(tuple(r[k] for k in ("blank", "duplicate", "truncated", "illegal")), *(r[k] for k in ("turns", "first", "last", "low", "high")), r["plans"])
        assert tuple(chain.row().values())[1:] == want[conv][:7]


def test_repair_of_an_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    repair = ConversationRepair(empty)
    plans = repair.plans()
    assert plans.collect() == [] and repair.repaired(plans).collect() == []
    repair = ConversationRepair(spark.createDataFrame([("k", 0, "user", "Hello."), ("k", 1, "user", "Hello.")], "conv_id string, turn int, role string, text string"))
    plans = repair.plans()
    assert [tuple(r) for r in plans.collect()] == [("k", 0, 0, 1, 0, 1, 5, "KDI")]
    assert [tuple(r) for r in repair.repaired(plans).collect()] == [("k", 0, "K", "user", "Hello."), ("k", 1, "I", "assistant", "")]


def test_one_conversation_over_many_tasks(spark):
    """A conversation with most of the rows is cut by ranges of turns and chained again."""
    rnd = random.Random(8)
    rows = [("hot", i, rnd.choice(["user", "assistant"]), f"Text {i}.") for i in range(4000)] + [(f"c{i}", 0, "user", "Hi.") for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plans = ConversationRepair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).plans()
        got = {r["conv_id"]: tuple(r)[1:] for r in plans.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["hot"][5:] == by_all_ways([(r[2][0], False, False) for r in rows[:4000]]) and len(got) == 51


# ---- runs


def runs_by_hand(w):
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                own = w[i : j + q]
                if not any(all(own[k] == own[k + p] for k in range(len(own) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_equal_those_by_hand(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        w: list[int] = []
        while len(w) < rnd.randint(0, 120):
            part = [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))]
            w += part * rnd.choice([1, 1, 1, 4, 6]) + part[: rnd.randint(0, len(part))]
        assert periodic_runs.runs_of(np.array(w, dtype=np.int64)) == runs_by_hand(w)


def test_suffix_array_and_lcp():
    rnd = random.Random(9)
    for n in (1, 2, 7, 64, 200):
        t = [rnd.randrange(2) for _ in range(n)]
        sa, isa, lcp = periodic_runs.suffix_array(np.array(t))
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:]) and all(isa[sa[k]] == k for k in range(n))
        for k in range(1, n):
            a, b = t[sa[k - 1] :], t[sa[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_one_word_over_and_over_is_one_run():
    assert periodic_runs.runs_of(np.zeros(60_000, dtype=np.int64)) == [(0, 60_000, 1)]
    t = np.tile(np.arange(500), 100)
    assert periodic_runs.runs_of(t) == [(0, 50_000, 500)]


def test_query_equals_runs_by_hand(spark, tmp_path, monkeypatch):
    rnd = random.Random(10)
    word = lambda: rnd.choice(["a", "b", "é", "the", "\x00"])
    texts = [" ".join(word() for _ in range(rnd.randint(0, 80))) for _ in range(120)] + [None, "", " \t\n", "w " * 50, "a\tb\n" * 30, "x" * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows.append(rows[3])
    spark.createDataFrame([(*r, "id") for r in rows], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_by_hand(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
        want.append((i, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x.decode() for k, x in enumerate(w) if k not in gone))))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(r[1] for r in want) > 10


def test_runs_of_an_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert periodic_runs.periodic_runs(docs).collect() == []
    docs = spark.createDataFrame([(None, "a a a a a a b")] * 2, "doc_id string, text string")
    got = periodic_runs.periodic_runs(docs).select("doc_id", "n_words", F.size("runs"), "collapsed").collect()
    assert [tuple(r) for r in got] == [(None, 7, 1, "a b")] * 2
