"""Periodic runs of words by an enhanced suffix array, document by document.

A run of period q ends in one square of q + q words that no further word extends: its halves start at two suffixes of one
LCP interval of depth q, in different children of it (a branching tandem repeat). For each interval the suffixes of all
children but the largest look up the inverse suffix array q places ahead and behind; there are no tree nodes, only an
interval's bounds. A square found is rotated to the left as long as it stays one, which gives the run; squares of a
multiple of a known run's period that end with it merge into it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many periods at least, and this many words.
PERIODS, WORDS = 4, 6
#: Words of documents that are looked at together for repeated strings.
BATCH = 200_000
#: A run has two equal strings of this many words, as it is WORDS long or PERIODS periods of two words or more.
REPEATED = min(WORDS - 1, 2 * (PERIODS - 1))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sa, isa, lcp) of a sequence; lcp[i] is that of the suffixes at i - 1 and i in order, lcp[0] is 0."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    levels, k = [], 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32))
        key = rank * (n + 1)
        key[: max(n - k, 0)] += rank[k:] + 1
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if rank[sa[-1]] == n - 1:
            break
        k *= 2
    x, y = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        # equal ranks of different suffixes: neither ends within these words
        step = (levels[level][np.minimum(x, n)] == levels[level][np.minimum(y, n)]).astype(np.int64) << level
        step[np.maximum(x, y) >= n] = 0
        lcp[1:] += step
        x += step
        y += step
    return sa, rank, lcp


def small_children(lcp: np.ndarray) -> np.ndarray:
    """(child begin, child end, interval begin, interval end, depth) of every child but the largest of each LCP interval
    that PERIODS suffixes share."""
    out: list[tuple[int, int, int, int, int]] = []
    depths, children = [0], [[0]]
    for i, h in enumerate([*lcp[1:].tolist(), 0], 1):
        begin = i - 1
        while depths[-1] > h:
            d, starts = depths.pop(), children.pop()
            begin = starts[0]
            if i - begin >= PERIODS:
                ends = [*starts[1:], i]
                largest = max(range(len(starts)), key=lambda c: ends[c] - starts[c])
                out += [(a, b, begin, i, d) for c, (a, b) in enumerate(zip(starts, ends)) if c != largest]
        if h > depths[-1]:
            depths.append(h)
            children.append([begin, i])
        elif h > 0:
            children[-1].append(i)
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def _squares(sa: np.ndarray, isa: np.ndarray, child: np.ndarray) -> np.ndarray:
    """(start, period) of branching squares with PERIODS - 2 more periods before them, for some children."""
    n, sizes = len(sa), child[:, 1] - child[:, 0]
    which = np.repeat(np.arange(len(child)), sizes)
    at = sa[np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + child[which, 0]]
    lo, hi, begin, end, d = child[which].T

    def inside(place: np.ndarray, ok: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        r = isa[np.where(ok, place, 0)]
        return ok & (b <= r) & (r < e)

    found = []
    for first, partner in ((at, at + d), (at - d, at - d)):
        ok = (partner >= 0) & (partner < n)
        hit = inside(partner, ok, begin, end) & ~inside(partner, ok, lo, hi)
        for k in range(1, PERIODS - 1):
            hit &= inside(first - k * d, first - k * d >= 0, begin, end)
        found.append(np.stack([first[hit], d[hit]], axis=1))
    return np.concatenate(found)


def _rotated(t: np.ndarray, start: int, period: int) -> int:
    """The first word of the run that the square at start belongs to."""
    width = 64
    while start > 0:
        lo = max(0, start - width)
        differ = np.flatnonzero(t[lo:start] != t[lo + period : start + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        start, width = lo, width * 2
    return 0


def runs_of(t: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period."""
    if len(t) < WORDS:
        return []
    sa, isa, lcp = suffix_array(t)
    child = small_children(lcp)
    parts = np.cumsum(child[:, 1] - child[:, 0]) // (4 * BATCH)
    cuts = np.flatnonzero(np.diff(parts)) + 1
    found = np.concatenate([np.empty((0, 2), np.int64), *(_squares(sa, isa, c) for c in np.split(child, cuts))])
    found = np.unique(found[:, ::-1], axis=0)  # by period, then start
    known: dict[int, list[tuple[int, int]]] = {}
    for d, at in found.tolist():
        end = at + 2 * d
        if any(d % q == 0 and first <= at for q, first in known.get(end, ())):
            continue
        first = _rotated(t, at, d)
        if end - first >= max(WORDS, PERIODS * d):
            known.setdefault(end, []).append((d, first))
    return sorted((first, end - first, q) for end, of in known.items() for q, first in of)


def _repeating(t: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which of n documents have a string of REPEATED words twice; equal hashes of different strings do no harm."""
    width = len(t) - REPEATED + 1
    if width < 2:
        return np.zeros(n, dtype=bool)
    h = doc[:width].astype(np.uint64)
    for k in range(REPEATED):
        h = (h ^ t[k : k + width].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    own = doc[:width] == doc[REPEATED - 1 :]
    order = np.argsort(h, kind="stable")
    same = order[1:][(h[order][1:] == h[order][:-1]) & own[order][1:] & own[order][:-1]]
    out = np.zeros(n, dtype=bool)
    out[doc[same]] = True
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _settled(ids: list, split: list[list[bytes]], keep_text: bool, id_type: pa.DataType) -> pa.RecordBatch:
    """Runs and collapsed texts of some documents; words are numbered here alone."""
    number: dict[bytes, int] = {}
    sizes = [len(w) for w in split]
    flat = np.fromiter((number.setdefault(x, len(number)) for w in split for x in w), dtype=np.int64, count=sum(sizes))
    doc, ends = np.repeat(np.arange(len(split)), sizes), np.cumsum(sizes)
    repeating = _repeating(flat, doc, len(split))
    spans, texts, digests = [], [], []
    for i, words in enumerate(split):
        runs = runs_of(flat[ends[i] - sizes[i] : ends[i]]) if repeating[i] else []
        kept = words
        if runs:
            stays = np.ones(len(words), dtype=bool)
            for start, length, q in runs:
                stays[start + q : start + length] = False
            kept = [words[k] for k in np.flatnonzero(stays)]
        text = b" ".join(kept)
        spans.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
        digests.append(hashlib.sha256(text).hexdigest())
        texts.append(text if keep_text else None)
    cols = [pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(spans, _SPAN), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "runs", "collapsed", "collapsed_sha256"])


def _detect(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            held, split, size = [], [], 0
            for i, text in zip(ids.to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = (text.as_py() or b"").split()  # of bytes: ASCII white space alone
                held.append(i)
                split.append(words)
                size += len(words)
                if size >= BATCH:
                    yield _settled(held, split, keep_text, ids.type)
                    held, split, size = [], [], 0
            if held:
                yield _settled(held, split, keep_text, ids.type)

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """One row per input row: (id, n_words, runs, collapsed, collapsed_sha256).

    Words are those between ASCII white space. ``runs`` lists (start, length, period) by start and period: stretches of
    words with smallest period q, of at least max(6, 4 * q) words, that no neighbouring word extends. ``collapsed`` has
    the words that no run holds after its first period, joined by single spaces (null without ``keep_text``).

    A null or empty text has no words, no runs and an empty collapsed text. Rows stand for themselves: repeated rows and
    rows with equal or null ids each give a row. Overlapping runs of different periods are all listed. Other columns are
    left behind, whatever their names; an empty table gives an empty table.

    Scale: no shuffle. A task holds one Arrow batch and the suffix array of one document; texts are taken whole, in
    n log n steps even if they are one word over and over. Documents without any repeated string of five words have no run
    and need no suffix array.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string, collapsed_sha256 string"
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_detect(keep_text), schema).withColumnRenamed("id", id_col)
