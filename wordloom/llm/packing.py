"""Best-fit packing of token sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import written

#: A worker forgets its remembered words beyond this many.
REMEMBERED_WORDS = 300_000

PIECES = "piece int, start long, length int, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordCoder:
    """word (bytes between ASCII white space) -> its ids as little-endian 32-bit numbers; remembers a bounded number.

    No merge and no normal form of the vocabulary reaches over white space, so words can be coded one by one. A word of
    Latin letters, with or without full stops and the like after it, goes to the merges directly: it is one piece, and
    what follows another. Every other word goes through the whole tokenizer.
    """

    ENDS = b".,;:!?"

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(tokenizer)
        self.model = self.coder.model
        self.known: dict[bytes, bytes] = {}
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def _merged(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(piece)], dtype="<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        slow = []
        for w in set(words):
            if w in known:
                continue
            core = w.rstrip(self.ENDS)
            text = core.decode()
            low = text.lower()
            if text and low.isalpha() and text.isalpha() and max(text) < "\u0250":
                ids = known.get(core) or self._merged(low.encode().decode("latin-1").translate(self.letters))
                known[core] = ids
                if len(core) < len(w):
                    known[w] = ids + self._merged(w[len(core) :].decode())
            else:
                slow.append(w)
        for i in range(0, len(slow), 1024):
            part = slow[i : i + 1024]
            for w, e in zip(part, self.coder.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        words = text.lower().split()  # of bytes: A-Z alone, which the tokenizer lower-cases too
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            self.learn(words)
            return b"".join([self.known[w] for w in words])


_CODERS: dict[str, WordCoder] = {}


def word_coder(tokenizer: str) -> WordCoder:
    """The worker's own coder, kept from task to task."""
    if tokenizer not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        _CODERS[tokenizer] = WordCoder(tokenizer)
    return _CODERS[tokenizer]


def _pieces(tokenizer: str, end_id: int, limit: int, passed: list[str], text_col: str, keep_ids: bool):
    """mapInArrow function: documents -> pieces of at most `limit` ids, each document ended by end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * limit
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
            for lo in range(0, len(texts), 256):
                rows, out = [], []
                for i in range(lo, min(lo + 256, len(texts))):
                    ids = coder(texts[i].as_py() or b"") + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append(i)
                        out.append((k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                take = pa.array(rows, pa.int64())
                cols = [batch.column(batch.schema.get_field_index(c)).take(take) for c in passed]
                values = list(zip(*out))
                cols += [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
                if keep_ids:
                    cols.append(pa.array(values[4], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*passed, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return run


def tokenize_pieces(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for every document: its token ids and end_id, cut each `limit` ids.

    A null or empty text is the single id end_id. Repeated rows give repeated pieces.
    """
    schema = f"{docs.select(id_col).schema[0].name} {docs.schema[id_col].dataType.simpleString()}, {PIECES}" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(_pieces(tokenizer, end_id, limit, [id_col], text_col, keep_ids), schema)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction on a histogram of lengths: fixed sets with their multiplicity, and what is left.

    Take the longest length j. A set with j that dominates every other one may be fixed for good, as the others' members
    can be dealt to its members without being longer: j alone if not even the shortest fits beside it; j with the longest
    partner k that fits if it fills the space exactly, or if no three others fit and the best two that do are no longer
    than k. Otherwise j is left to best fit. Work is bounded by the square of the capacity, whatever the counts.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    fixed: list[tuple[tuple[int, ...], int]] = []

    def best_two(space: int) -> int:
        lengths = np.flatnonzero(left[: space + 1])
        if not len(lengths):
            return 0
        at = np.searchsorted(lengths, space - lengths, side="right") - 1
        alone = (at >= 0) & (lengths[at] == lengths) & (left[lengths] < 2)  # a length can't be its own partner then
        at = at - alone
        return int(np.max(np.where(at >= 0, lengths + lengths[at], 0)))

    def least_three() -> int:
        shortest = np.flatnonzero(left)[:3]
        three = np.repeat(shortest, np.minimum(left[shortest], 3))[:3]
        return int(three.sum()) if len(three) == 3 else 1 << 62

    for j in map(int, np.flatnonzero(left)[::-1]):
        while left[j]:
            left[j] -= 1  # the one to be placed
            space = capacity - j
            fit = np.flatnonzero(left[: space + 1])
            k = int(fit[-1]) if len(fit) else 0
            if not k:
                fixed.append(((j,), 1 + int(left[j])))
                left[j] = 0
            elif k == space or (least_three() > space and best_two(space) <= k):
                # true for every one of the m sets: while k is there, what else fits only becomes less
                m = int((left[j] + 1) // 2 if k == j else min(left[j] + 1, left[k]))
                fixed.append(((j, k), m))
                left[j] += 1 - m
                left[k] -= m
            else:
                left[j] += 1  # left to best fit, and still a partner of shorter ones
                break
    return fixed, {int(x): int(left[x]) for x in np.flatnonzero(left)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: sets with their multiplicity. Each length splits one class of sets at most."""
    open_sets: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, dtype=bool)

    def put(space: int, pattern: tuple[int, ...], m: int) -> None:
        if m:
            open_sets[space].append((pattern, m))
            spaces[space] = True

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fit = np.flatnonzero(spaces[length:])
            if not len(fit):
                each = capacity // length
                put(capacity - each * length, (length,) * each, n // each)
                put(capacity - (n % each) * length, (length,) * (n % each), int(n % each > 0))
                break
            space = length + int(fit[0])
            pattern, m = open_sets[space].pop()
            spaces[space] = bool(open_sets[space])
            used = min(n, m)
            put(space - length, (*pattern, length), used)
            put(space, pattern, m - used)
            n -= used
    return [x for sets in open_sets.values() for x in sets]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets of the reduction with best fit of what it leaves; or best fit of all, should that ever take fewer."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return min((fixed + best_fit(rest, capacity), best_fit(counts, capacity)), key=lambda sets: sum(m for _, m in sets))


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first set, members of the length in a set, offset of the first) of each class of sets."""
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first_set = 0
    for pattern, m in patterns:
        at = 0
        for length in dict.fromkeys(pattern):
            a = pattern.count(length)
            found[length].append((taken[length], first_set, a, at))
            taken[length] += a * m
            at += a * length
        first_set += m
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in found.items()}


def _placer(slots: Broadcast):
    """mapInArrow function: pieces with their rank within their length -> their place in the table of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                here = np.flatnonzero(n == length)
                first, first_set, members, at = slots.value[int(length)]
                cls = np.searchsorted(first, r[here], side="right") - 1
                within = r[here] - first[cls]
                seq[here] = first_set[cls] + within // members[cls]
                off[here] = at[cls] + (within % members[cls]) * length
            rest = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(seq), pa.array(off)], names=[*rest, "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 4096, shares: int = 1024) -> DataFrame:
    """Append sequence_id and offset to pieces with a length: sequences of at most `capacity`, gapless from 0.

    Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver. There the reduction fixes sets of
    lengths, best fit places the rest, and the outcome is a bounded table: classes of equal sets. Pieces are ranked
    within their length, by shares of a hash so that a frequent length isn't ordered in one task, and a rank finds its
    place in the table by binary search.

    Equal pieces are interchangeable, so ties don't change the sets. Nulls: a null id is an id like others.
    Columns sequence_id and offset are replaced; an empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.drop("sequence_id", "offset").withColumn("_share", F.pmod(F.xxhash64(F.col(id_col), F.col("piece"), F.col("ids_crc32")), F.lit(shares)).cast("int")), "pieces")
    shared = written(pieces.groupBy("length", "_share").agg(F.count("*").alias("n")), "piece-lengths")
    counts = {r["length"]: r["n"] for r in shared.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(pack_lengths(counts, capacity)))

    before = W.partitionBy("length").orderBy("_share").rowsBetween(W.unboundedPreceding, -1)
    starts = shared.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most capacity * shares rows; where that is many, Spark doesn't broadcast it
    rank = F.row_number().over(W.partitionBy("length", "_share").orderBy(id_col, "piece", "ids_crc32", "start"))
    # a stage of its own: windows and Python side by side would need both memories at once
    ranked = written(pieces.withColumn("_within", rank - 1), "ranked-pieces")
    placed = ranked.join(starts, ["length", "_share"]).withColumn("_rank", F.col("_before") + F.col("_within")).drop("_share", "_within", "_before")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.drop("_rank").schema)
    return placed.mapInArrow(_placer(slots), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Tokenize every whole text, cut only documents longer than `capacity`, and pack the pieces."""
    return pack_pieces(tokenize_pieces(docs, tokenizer, text_col, id_col, capacity, end_id, keep_ids), id_col, capacity)
