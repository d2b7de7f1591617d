"""N-gram Jaccard join by token-combination prefixes.

Tokens are the word shingles of a document, as 64-bit hashes. Two documents link when the Jaccard similarity of their
token sets reaches the threshold t. With m = n - ceil(t * n) tokens at most missing from a partner, the first m + k
tokens of two linked documents, in any order common to all documents, share at least k tokens:

* k above m / 2 filters documents: one whose extended prefix shares too few tokens with other prefixes has no link.
* k = 3 indexes the rest, in ascending frequency: rare tokens one by one, frequent ones in combinations of two. Of three
  shared tokens two are rare, so that the pair is met twice, or two are frequent, so that it is met under their combination.

Copies are linked by stars around a few documents first; pairs are then made and verified only across components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import BitFilter, discard, written
from wordloom.llm.graph import components

REMEMBERED_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.int64((1 << 48) - 1)
#: Tokens of their prefixes that two linked sets share.
SHARED = 3


def missing(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that a linked partner can lack: n - ceil(percent * n / 100)."""
    return n - -(-percent * n // 100)


class Shingler:
    """Turns whole texts into sorted arrays of distinct 64-bit shingle hashes; remembers words, a bounded number."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            return np.array([known[w] for w in words], dtype=np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
        if not words:
            return np.empty(0, np.int64)
        h = self._hashes(words)
        width = min(self.size, len(words))
        acc = np.full(len(words) - width + 1, np.uint64(width), dtype=np.uint64)
        for k in range(width):
            acc = (acc ^ h[k : len(h) - width + 1 + k]) * _MIX
            acc ^= acc >> np.uint64(29)
        return np.unique(acc.view(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _shingled(size: int, percent: int):
    """mapInArrow function over (id, text): id, n, key of the set, and the extended prefix that filters, cut to 48 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            ids, texts = _column(batch, "id"), _column(batch, "text").cast(pa.large_binary())
            for lo in range(0, len(ids), 512):
                ns, keys, lists = [], [], []
                for t in texts[lo : lo + 512]:
                    s = shingle(t.as_py())
                    m = missing(len(s), percent)
                    ns.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    lists.append(s[: m + m // 2 + 1] & _LOW48)
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), _lists(lists)], names=["id", "n", "key", "tokens"])

    return run


def _whole_sets(size: int, able: BitFilter):
    """mapInArrow function over (id, text, spread): id, key and tokens of the whole set, where the filter may hold spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            sel = np.flatnonzero(able.may_hold(_column(batch, "spread").to_numpy()))
            ids, texts = _column(batch, "id").take(pa.array(sel)), _column(batch, "text").take(pa.array(sel)).cast(pa.large_binary())
            for lo in range(0, len(ids), 128):
                lists = [shingle(t.as_py()) for t in texts[lo : lo + 128]]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in lists]
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 128], pa.array(keys, pa.binary()), _lists(lists)], names=["id", "key", "tokens"])

    return run


def _read_again(docs: DataFrame, able: DataFrame, size: int) -> DataFrame:
    """Whole sets (id, key, tokens) of the documents whose ids are in ``able``, and of few others.

    Ids are told by their hash, as row numbers of several partitions have the same low bits.
    """
    spread = F.xxhash64("id").alias("spread")
    return docs.select("id", "text", spread).mapInArrow(_whole_sets(size, BitFilter(able.select(spread), "spread")), "id long, key binary, tokens array<long>")


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given links."""
    root = np.arange(n)
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a), int(b)))
    return out


def _links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs with 100 * |intersection| >= percent * |union|; only across sides, if there are two."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, where, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), sizes)
    shared = df[where] > 1
    doc, col = doc[shared], where[shared]
    _, col = np.unique(col, return_inverse=True)
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    width = max(1, 4_000_000 // n)  # columns at a time: 16 MB
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((n, int(col[b - 1]) - lo + 1), dtype=np.float32)
        m[doc[a:b], col[a:b] - lo] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    link = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    link &= np.triu(np.ones((n, n), dtype=bool), 1)
    if len(np.unique(side)) > 1:
        link &= side[:, None] != side[None, :]
    return np.argwhere(link)


def _blocks(percent: int):
    """applyInArrow function over one pair of blocks of a group: a spanning forest of its links."""

    def run(batch: pa.Table) -> pa.Table:
        ids = batch["id"].to_numpy()
        sets = [x.values.to_numpy() for x in batch["tokens"].combine_chunks()]
        edges = _spanning(_links(sets, batch["block"].to_numpy(), percent), len(ids)) if len(ids) > 1 else []
        a, b = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return run


def _meet(percent: int):
    """mapInArrow function over (a, part, b, mine, tokens), each part led by a's own set: the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.int64)
        for batch in batches:
            a, b, mine = (_column(batch, k).to_numpy(zero_copy_only=False) for k in ("a", "b", "mine"))
            lists = _column(batch, "tokens")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            hit = np.zeros(len(a), dtype=bool)
            for i in range(len(a)):
                s = flat[ends[i] : ends[i + 1]]
                if mine[i]:
                    own = s.copy()
                    continue
                at = np.searchsorted(own, s)
                at[at == len(own)] = 0
                common = int(np.count_nonzero(own[at] == s))
                hit[i] = 100 * common >= percent * (len(own) + len(s) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[hit], pa.int64()), pa.array(b[hit], pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, load: int) -> DataFrame:
    """The pairs (a, b) that link. b's set travels to a's, once a pair; partners of a with more than ``load`` tokens
    together are dealt to several tasks, each of which gets a's set."""
    parts = pairs.join(sets.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(F.sum("n") / load).cast("int").alias("parts"))
    partners = pairs.join(parts, "a").join(sets.select(F.col("id").alias("b"), "tokens"), "b")
    partners = partners.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.lit(False).alias("mine"), "tokens")
    own = parts.join(sets.select(F.col("id").alias("a"), "tokens"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), F.lit(True).alias("mine"), "tokens")
    return own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.desc("mine")).mapInArrow(_meet(percent), "a long, b long")


def _close(percent: int, n: str = "n", other: str = "m") -> Column:
    """Sets of these sizes can link."""
    return F.least(n, other) * 100 >= F.greatest(n, other) * percent


def _enough(common: Column, percent: int) -> Column:
    """Sets of n and m tokens with so many in common link."""
    return common * (100 + percent) >= (F.col("n") + F.col("m")) * percent


def _pairs(index: DataFrame, percent: int) -> DataFrame:
    """(a, b) and its parts for the meetings of two documents of different components that can link, under each key.

    Two documents have in common at most the lesser ``upto`` of their prefixes up to the key's place, and the lesser rest
    after it; and at most the lesser ``open`` in their prefixes, and the greater rest after those.
    """
    x = index.select("key", F.col("id").alias("a"), "n", F.col("comp").alias("c"), "place", "upto", "open", "often", "after")
    y = index.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("comp").alias("d"), *(F.col(k).alias(k + "2") for k in ("place", "upto", "open", "often", "after")))
    here = _enough(F.least("upto", "upto2") + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place2")), percent)
    in_all = _enough(F.least("open", "open2") + F.greatest("after", "after2"), percent)
    return x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & _close(percent) & here & in_all)


def _placed(index: DataFrame, percent: int, rare: int) -> DataFrame:
    """Rows of open keys with how many of them the document has up to this one, in all, and frequent ones, and the number
    of its tokens after the prefix. Documents with less than SHARED are left out, as they have no link that is not known."""
    by_id = W.partitionBy("id")
    placed = index.withColumn("upto", F.row_number().over(by_id.orderBy("place"))).withColumn("open", F.count("*").over(by_id))
    placed = placed.withColumn("often", F.count_if(F.col("posting") > rare).over(by_id)).where(F.col("open") >= SHARED)
    return placed.withColumn("after", F.greatest(F.ceil(F.col("n") * percent / 100) - SHARED, F.lit(0)))


def _open(index: DataFrame) -> DataFrame:
    """Rows (key, id, n, comp) of keys that documents of several components share, with the number of those documents."""
    keys = index.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("posting")).where("c0 < c1").select("key", "posting")
    return index.join(keys, "key")


def _grouped_links(index: DataFrame, sets: DataFrame, percent: int, block: int, load: int) -> DataFrame:
    """Links among documents that crowded keys connect, block against block, so that no pair leaves a task."""
    first = index.groupBy("key").agg(F.min("id").alias("first"))
    stars = index.join(first, "key").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    groups = written(components(stars).withColumnsRenamed({"v": "id", "comp": "grp"}).join(sets.select("id", "n"), "id"), "groups")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / load)).cast("int")
    placed = sets.select("id", "tokens").join(groups.join(groups.groupBy("grp").agg(blocks.alias("blocks")), "grp"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "tokens", "block", "grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    return dealt.groupBy("grp", "lo", "hi").applyInArrow(_blocks(percent), "a long, b long")


def _linked(sets: DataFrame, percent: int, rare: int, block: int, load: int) -> DataFrame:
    """Links between different sets (id, n, tokens) whose components are those of all links.

    The order of tokens is ascending frequency among these documents; tokens of one document come first and index nothing.
    """
    tokens = sets.select("id", "n", F.explode("tokens").alias("token"))
    often = written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token-counts")
    by_id = W.partitionBy("id")
    ranked = tokens.join(often, "token").withColumn("rank", F.row_number().over(by_id.orderBy("df", "token"))).withColumn("alone", F.col("n") - F.count("*").over(by_id))
    lacking = F.col("n") + F.floor(-F.col("n") * percent / 100)
    place = F.col("alone") + F.col("rank")
    prefix = written(ranked.where(place <= lacking + SHARED).select(F.col("token").alias("key"), "id", "n", place.alias("place")), "token-prefixes")
    discard(often)

    # stars first: most copies link with one of two documents of their tokens, the first and one drawn by a hash
    heads = prefix.groupBy("key").agg(F.min(F.struct("id", F.col("n").alias("m"))).alias("x"), F.min(F.struct(F.xxhash64("id").alias("h"), "id", F.col("n").alias("m"))).alias("y"), F.count("*").alias("k")).where("k > 1")
    heads = heads.select("key", F.explode(F.array("x", F.struct("y.id", "y.m"))).alias("x"))
    met = prefix.join(heads, "key").select(F.col("x.id").alias("a"), F.col("id").alias("b"), "n", "x.m").where((F.col("a") != F.col("b")) & _close(percent)).groupBy("a", "b").agg(F.count("*").alias("k"))
    best = met.where("k > 1").withColumn("place", F.row_number().over(W.partitionBy("b").orderBy(F.desc("k"), "a"))).where("place <= 3")
    stars = written(_verified(written(best.select("a", "b"), "star-pairs"), sets, percent, load), "star-links")

    # then exactly what the stars leave open: keys that documents of several components share. A pair is made if what it
    # has in common can be enough: under rare keys it meets as often as it shares them, and it shares no more frequent ones
    # than either has
    comps = components(stars)
    labelled = prefix.join(comps, F.col("id") == F.col("v"), "left").select("key", "id", "n", "place", F.coalesce("comp", "id").alias("comp"))
    left = written(_placed(_open(labelled), percent, rare), "open-keys")
    met = _pairs(left.where(F.col("posting") <= rare), percent).groupBy("a", "b").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("n", "m", "often", "often2", "after", "after2")))
    single = met.where((F.col("k") > 1) & _enough(F.col("k") + F.least("often", "often2") + F.greatest("after", "after2"), percent)).select("a", "b")
    often = left.where(F.col("posting") > rare).drop("posting")
    two = often.join(often.select("id", F.col("key").alias("other"), F.col("place").alias("place2"), F.col("upto").alias("upto2")), "id").where("key < other")
    combined = two.select(F.xxhash64("key", "other").alias("key"), "id", "n", "comp", F.greatest("place", "place2").alias("place"), F.greatest("upto", "upto2").alias("upto"), "open", "often", "after")
    combined = written(_open(combined), "open-combinations")
    pairs = written(single.unionByName(_pairs(combined.where(F.col("posting") <= rare), percent).select("a", "b")).distinct(), "pairs")
    links = stars.unionByName(_verified(pairs, sets, percent, load))
    crowded = combined.where(F.col("posting") > rare)
    return links if crowded.isEmpty() else links.unionByName(_grouped_links(crowded, sets, percent, block, load))


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 4, percent: int = 85, rare: int = 64, block: int = 1024, load: int = 2_000_000) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id), the smallest id reachable over links.

    Words are those between ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of ``size``
    words, or its whole sequence as one if it is shorter. Documents link when 100 * |intersection| >= percent * |union|;
    ``percent`` is 75 at least, as two different sets that link then share three tokens. Links between different sets are
    verified on the whole sets; documents with equal sets are one vertex.

    Ids are of any type that has an order; those that aren't whole numbers have rows numbered beside them. Null and empty
    texts have no shingle and link with nothing. Rows with equal ids are one document if their sets are
    equal, and else stand each for the id, which joins their components. A null id has no component. Ties in frequency
    are ordered by token. Other columns are left behind, whatever their names. An empty table gives an empty table. Texts
    of any length are taken whole; a task holds one long text and at most ``load`` tokens of others.

    Scale: a text is shingled once, and once more if it can still have a link; of all texts only the filter's prefixes are
    shuffled. A key with more than ``rare`` documents is frequent and indexed in combinations of two. Pairs are made only
    under keys of at most ``rare`` documents, between documents that no verified link connects yet, and once each; the
    crowded combinations that are left go to blocks of at most about ``block`` documents and ``load`` tokens.
    """
    if percent < 75:
        raise ValueError("percent below 75: two sets that link may share less than three tokens")
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return _by_number(docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")), size, percent, rare, block, load).withColumnRenamed("own_id", id_col)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, key binary, tokens array<long>"
    named_docs = slim.where(F.col("id").isNotNull())
    whole = written(named_docs.mapInArrow(_shingled(size, percent), schema), "filter-prefixes")
    heads = written(whole.select("id", "n", "key"), "heads")
    rows = whole.select("id", F.explode("tokens").alias("token"))
    counts = written(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "repeated-tokens")
    lacking = lambda n: n + F.floor(-n * percent / 100)
    # a partner of a set of n tokens has at least percent * n / 100 of them, and so shares this many of its prefix
    need = F.floor(lacking(-F.floor(-F.col("n") * percent / 100)) / 2) + 1
    hits = rows.join(counts, "token").groupBy("id").agg(F.count("*").alias("hits"))
    filled = heads.select("id", "n", "key").where("n > 0")
    able = filled.join(hits, "id").where(F.col("hits") >= need)
    able = written(able.groupBy("key", "n").agg(F.min("id").alias("id")), "able")
    discard(whole)
    discard(counts)
    # whole sets of one document for each set that is left
    again = _read_again(named_docs, able, size)
    sets = written(again.join(able, ["id", "key"]).select("id", "n", "tokens", "key").dropDuplicates(["id", "key"]).drop("key"), "sets")
    links = _linked(sets, percent, rare, block, load)

    # documents with equal sets, and rows with equal ids, are joined to one another by stars around the smallest id
    firsts = filled.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
    twins = filled.join(firsts, "key").select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = components(links.unionByName(twins))
    out = heads.select("id", "n").join(found, F.col("id") == F.col("v"), "left")
    named = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
    unnamed = slim.where(F.col("id").isNull()).mapInArrow(_shingled(size, percent), schema)
    return named.unionByName(unnamed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def _by_number(docs: DataFrame, size: int, percent: int, rare: int, block: int, load: int) -> DataFrame:
    """(own_id, text) with ids of any type: found by row number, and told by the smallest id of a component.

    Components that rows of one id are in are one, as they are for whole numbers.
    """
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = written(jaccard_components(rows, "text", "row", size, percent, rare, block, load), "by-number")
    placed = found.join(rows.select("row", "own_id"), "row")
    firsts = placed.where("own_id IS NOT NULL").groupBy("own_id").agg(F.min("component_id").alias("b"))
    joined = components(placed.join(firsts, "own_id").select(F.col("component_id").alias("a"), "b"))
    placed = placed.join(joined, F.col("component_id") == F.col("v"), "left").select("own_id", "n_shingles", F.coalesce("comp", "component_id").alias("comp"))
    names = placed.groupBy("comp").agg(F.min("own_id").alias("component_id"))
    named = placed.join(names, "comp").select("own_id", "n_shingles", F.when(F.col("own_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return named
