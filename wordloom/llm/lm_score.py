"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

The model predicts a token from the three before it: its context vector h is the sum of their vectors, each scaled by the
vector of its position. A token's probability has two levels, the class given h and the token given its class and h, both
softmaxes of h against learnt vectors; so it is normalised by two matrix products of about the root of the vocabulary.

Tokens seen ``least`` times are the model's own, in classes by frequency; their number grows with the corpus up to a bound
of memory. Others fall into classes by their last letters, in which they share the class's probability by their counts
plus one, one more share being kept for tokens never seen. So every token has a normalised probability.

Training reads all training texts where they are. A model warmed up on one part is trained on in every part, by steps of
noise-contrastive estimation over its tokens, and the parts' models are averaged, each vector by how often it was moved.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

#: The end of a text, as a token no word can be.
END = b"\n"
#: Tokens that the model looks back on.
REACH = 3
#: Bytes at the end of a word that tell the class of a word which is not the model's own.
ENDING = 3
LOG10 = math.log(10)


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, then one end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


#: Bytes of texts whose words are numbered together; a longer text is taken by itself.
TOGETHER = 1 << 22


def _pieces(texts: pa.Array, together: int) -> Iterator[tuple[int, int]]:
    """(first, end) of texts in a row with so many bytes: only these are copied at once, never a whole batch."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + together, "right")) - 1)
        yield lo, hi
        lo = hi


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().dictionary_encode()
    code, ends = words.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
    empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()  # at either end of a text
    if empty >= 0:
        there = code != empty
        code, ends = code[there], np.concatenate([[0], np.cumsum(there)])[ends]
    return words.dictionary.cast(pa.large_binary()), code, ends


def _cut(texts: pa.Array, together: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(different words, all words as places among these, where each text's words end) of texts in
    a row. Words are those of ``tokens``, cut and told apart by Arrow; null texts are empty."""
    for lo, hi in _pieces(texts, together):
        yield _split(texts[lo:hi])
        pa.default_memory_pool().release_unused()  # workers live on, and Arrow would keep it


def _bytes(words: pa.Array) -> list[bytes]:
    """The values of a binary array, which to_pylist gives too, but slowly."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8).tolist()
    data = words.buffers()[2].to_pybytes() if len(words) else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def coded(texts: pa.Array) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """(different tokens, for each text its tokens as places among these) of texts in a row."""
    for words, code, ends in _cut(texts, TOGETHER):
        code = np.insert(code, ends, len(words))
        yield [*_bytes(words), END], np.split(code, (ends + np.arange(1, len(ends) + 1))[:-1])


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % folds == fold


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-ENDING:]) % rare


class Vocabulary:
    """The head of the counts, most frequent first: word -> place. The first ``own`` of them are the model's own; numbers
    from ``own`` on are the classes of all other words."""

    def __init__(self, counts: dict[bytes, int], total: int, distinct: int, own: int, least: int, rare: int) -> None:
        self.words = sorted(counts, key=lambda w: (-counts[w], w))
        self.counts = np.array([counts[w] for w in self.words], dtype=np.int64)
        self.total, self.distinct, self.rare = total, distinct, rare
        self.own = min(own, int((self.counts >= least).sum()))
        self.place = {w: i for i, w in enumerate(self.words)}
        # classes of own tokens hold equal parts of the roots of their shares, which makes the two products of a
        # token, over the classes and over those of its class, smallest; as many classes as make both alike
        root = np.cumsum(np.sqrt(self.counts[: self.own] / max(1, self.counts[: self.own].sum())))
        part = root[-1] / max(1, round(root[-1])) if self.own else 1.0
        _, group = np.unique(np.floor((root - 1e-9) / part), return_inverse=True)
        self.groups = int(group.max()) + 1 if self.own else 0
        #: Class -> its first own token; the end of the last one.
        self.edges = np.searchsorted(group, np.arange(self.groups + 1))

    def number(self, word: bytes) -> int:
        i = self.place.get(word, self.own)
        return i if i < self.own else self.own + rare_class(word, self.rare)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.place.get, words, repeat(self.own)), np.int64, len(words))
        others = np.flatnonzero(at >= self.own).tolist()
        at[others] = [self.own + rare_class(words[i], self.rare) for i in others]
        return at

    def classes(self) -> np.ndarray:
        """Number -> class: own tokens by frequency, then a class for each of the others' numbers."""
        return np.concatenate([np.repeat(np.arange(self.groups), np.diff(self.edges)), self.groups + np.arange(self.rare)]).astype(np.int64)


@dataclass
class Model:
    """Vectors of context tokens, positions, tokens and classes, with the biases of the last two."""

    context: np.ndarray
    position: np.ndarray
    token: np.ndarray
    bias: np.ndarray
    group: np.ndarray
    offset: np.ndarray

    PARTS = ("context", "position", "token", "bias", "group", "offset")

    @classmethod
    def start(cls, numbers: np.ndarray, classes: np.ndarray, dim: int, seed: int) -> Model:
        """A model that gives each token its share of ``numbers``, how often each occurs."""
        rng = np.random.default_rng(seed)
        p = (numbers + 1.0) / (numbers + 1.0).sum()
        q = np.bincount(classes, weights=p)
        draw = lambda n: rng.normal(0, 0.2, (n, dim)).astype(np.float32)
        scale = np.array([[1.0], [0.8], [0.6]], dtype=np.float32)[:REACH]
        return cls(draw(len(p)), np.broadcast_to(scale, (REACH, dim)).copy(), draw(len(p)) * 0.1, np.log(p).astype(np.float32), draw(len(q)) * 0.1, np.log(q).astype(np.float32))

    def contexts(self, flat: np.ndarray) -> np.ndarray:
        """h for each place of a run of numbers but the first REACH."""
        e = self.context.take(flat, axis=0)
        n = len(flat) - REACH
        h = e[REACH - 1 : REACH - 1 + n] * self.position[0]
        for k in range(2, REACH + 1):
            h += e[REACH - k : REACH - k + n] * self.position[k - 1]
        return h


def padded(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of numbers, REACH ends before each of them, and which places are tokens of a text."""
    pad, no = np.full(REACH, end, dtype=np.int64), np.zeros(REACH, dtype=bool)
    return np.concatenate([x for t in texts for x in (pad, t)]), np.concatenate([x for t in texts for x in (no, np.ones(len(t), dtype=bool))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place; exp may overflow to infinity, which gives 0."""
    with np.errstate(over="ignore"):
        np.negative(x, out=x)
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that brings equal rows together, where each begins in it, the different rows)."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort; numbers stay below 2^16
    rows = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return order, first, rows.take(first)


class Trainer:
    """Noise-contrastive estimation by Adagrad: each token, and its class, is told from draws of the unigram distribution.

    A draw of noise serves a whole batch, so that its scores are one matrix product.
    """

    def __init__(self, model: Model, numbers: np.ndarray, classes: np.ndarray, noise: tuple[int, int] = (64, 16), batch: int = 512, rate: float = 0.15, seed: int = 0) -> None:
        self.m, self.classes, self.batch, self.rate = model, classes, batch, rate
        self.rng = np.random.default_rng(seed)
        p = (numbers + 1.0) / (numbers + 1.0).sum()
        q = np.bincount(classes, weights=p)
        self.levels = []
        for share, k, vectors, biases in ((p, noise[0], "token", "bias"), (q, noise[1], "group", "offset")):
            self.levels.append((k, np.cumsum(share), np.log(k * share).astype(np.float32), vectors, biases))
        self.grown = {k: np.full(len(getattr(model, k)), 1e-2, dtype=np.float32) for k in Model.PARTS}
        self.moved = {k: np.zeros(len(getattr(model, k)), dtype=np.float32) for k in Model.PARTS}

    def _move(self, name: str, rows: np.ndarray, gradient: np.ndarray, order: tuple[np.ndarray, ...] | None = None) -> None:
        """Take a step on these rows, which may repeat (``order``: their _groups); vectors are scaled by their own history."""
        order, first, rows = _groups(rows) if order is None else order
        summed = np.add.reduceat(gradient.take(order, axis=0), first, axis=0)
        x, grown = getattr(self.m, name), self.grown[name]
        grown[rows] += np.einsum("ij,ij->i", summed, summed) / summed.shape[1] if summed.ndim == 2 else summed * summed
        step = self.rate / np.sqrt(grown[rows])
        x[rows] -= summed * (step[:, None] if summed.ndim == 2 else step)
        self.moved[name][rows] += np.diff(np.append(first, len(order)))

    def step(self, pieces: np.ndarray, real: np.ndarray) -> None:
        """One step on pieces of text, REACH numbers of context before the tokens of each."""
        m = self.m
        e = m.context.take(pieces, axis=0)
        n = pieces.shape[1] - REACH
        before = [slice(REACH - k, REACH - k + n) for k in range(1, REACH + 1)]
        h = e[:, before[0]] * m.position[0]
        for k in range(1, REACH):
            h += e[:, before[k]] * m.position[k]
        shape, h = h.shape, h.reshape(-1, h.shape[2])
        target, real = pieces[:, REACH:].ravel(), real.ravel().astype(np.float32)
        back = np.zeros_like(h)
        for (k, sums, odds, v, b), true in zip(self.levels, (target, self.classes[target])):
            vectors, biases = getattr(m, v), getattr(m, b)
            drawn = np.minimum(np.searchsorted(sums, self.rng.random(k)), len(odds) - 1)
            own, other = vectors.take(true, axis=0), vectors.take(drawn, axis=0)
            g = (_sigmoid(np.einsum("ij,ij->i", h, own) + biases[true] - odds[true]) - 1) * real
            noise = _sigmoid(h @ other.T + (biases[drawn] - odds[drawn]))
            noise *= real[:, None]
            own *= g[:, None]
            back += own
            back += noise @ other
            rows = np.concatenate([true, drawn])
            order = _groups(rows)
            self._move(v, rows, np.concatenate([h * g[:, None], noise.T @ h]), order)
            self._move(b, rows, np.concatenate([g, np.ones(len(noise), dtype=noise.dtype) @ noise]), order)
        back = back.reshape(shape)
        turned = np.zeros_like(e)
        positions = np.empty_like(m.position)
        for k in range(REACH):
            positions[k] = np.einsum("ijk,ijk->k", e[:, before[k]], back)
            turned[:, before[k]] += back * m.position[k]
        self._move("position", np.arange(REACH), positions)
        self._move("context", pieces.ravel(), turned.reshape(-1, turned.shape[2]))

    def run(self, flat: np.ndarray, real: np.ndarray) -> None:
        """One pass over a run of numbers, in pieces of up to 64 tokens whose order is drawn anew."""
        size = min(64, self.batch)
        n = -(-(len(flat) - REACH) // size)
        spare = n * size + REACH - len(flat)
        flat, real = np.append(flat, np.zeros(spare, dtype=np.int64)), np.append(real, np.zeros(spare, dtype=bool))
        pieces = np.lib.stride_tricks.sliding_window_view(flat, size + REACH)[::size]
        tokens_of = real[REACH:].reshape(n, size)
        order = self.rng.permutation(n)
        per = max(1, self.batch // size)
        for lo in range(0, n, per):
            part = order[lo : lo + per]
            self.step(pieces[part], tokens_of[part])


def log_probabilities(m: Model, vocabulary: Vocabulary, flat: np.ndarray, real: np.ndarray, block: int = 131_072) -> np.ndarray:
    """log10 of the normalised probability of each token of a padded run, of its class where it is not the model's own."""
    v, classes, out = vocabulary, vocabulary.classes(), []
    # a column of ones brings the biases into the products
    groups = np.vstack([m.group.T, m.offset])
    own = np.vstack([m.token.T, m.bias])
    # the longest vector and the greatest bias, of all classes and of the tokens of each
    reach = _reach(m.group, m.offset)
    reaches = [_reach(m.token[a:b], m.bias[a:b]) for a, b in zip(v.edges[:-1], v.edges[1:])]
    for lo in range(REACH, len(flat), block):
        here = np.flatnonzero(real[lo : lo + block])
        t = flat[lo : lo + block][here]
        c = classes[t]
        order = np.argsort(c.astype(np.uint16), kind="stable")
        end = min(lo + block, len(flat))
        place = np.empty(end - lo, dtype=np.int64)
        place[here[order]] = np.arange(len(here))
        h = np.ones((len(here), m.context.shape[1] + 1), dtype=np.float32)
        for a in range(lo, end, 4096):
            b = min(a + 4096, end)
            h[place[a - lo : b - lo][real[a:b]], :-1] = m.contexts(flat[a - REACH : b])[real[a:b]]
        t, c, score = t[order], c[order], np.empty(len(t), dtype=np.float32)
        long = np.sqrt(np.einsum("ij,ij->i", h[:, :-1], h[:, :-1]))
        for a in range(0, len(t), 512):  # of a size that stays in the processor's cache
            s = h[a : a + 512] @ groups
            score[a : a + 512] = s[np.arange(len(s)), c[a : a + 512]] - _log_sum(s, _small(long[a : a + 512], reach))
        edges = np.searchsorted(c, np.arange(v.groups + 1))
        for g in range(v.groups):
            first, last = v.edges[g], v.edges[g + 1]
            for a in range(edges[g], edges[g + 1], 512):
                b = min(a + 512, edges[g + 1])
                s = h[a:b] @ own[:, first:last]
                score[a:b] += s[np.arange(b - a), t[a:b] - first] - _log_sum(s, _small(long[a:b], reaches[g]))
        back = np.empty(len(t), dtype=np.float64)
        back[order] = score
        out.append(back)
    return np.concatenate(out) / LOG10 if out else np.empty(0)


def _reach(vectors: np.ndarray, biases: np.ndarray) -> tuple[float, float]:
    return float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0))), float(abs(biases.max(initial=-np.inf))) if len(biases) else 0.0


def _small(long: np.ndarray, reach: tuple[float, float]) -> bool:
    """No score is above the greatest bias by more than the product of two lengths, and the one with that bias is not below
    it by more; so sums of their powers are far from both ends of a float."""
    return float(long.max(initial=0)) * reach[0] + reach[1] < 60


def _log_sum(s: np.ndarray, small: bool) -> np.ndarray:
    """log of the sum of exp over rows; overwrites s."""
    if small:  # as a product, which is faster than a sum over short rows
        return np.log(np.exp(s, out=s) @ np.ones(s.shape[1], dtype=s.dtype))
    top = s.max(1, keepdims=True)
    s -= top
    return np.log(np.exp(s, out=s).sum(1)) + top[:, 0]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _training_texts(batches: Iterator[pa.RecordBatch], folds: int, fold: int, together: int) -> Iterator[pa.Array]:
    for batch in batches:
        texts = _column(batch, "text")
        learnt = pa.array([not held_out(i, folds, fold) for i in _column(batch, "id").to_pylist()], pa.bool_())
        for lo, hi in _pieces(texts, together):
            yield texts[lo:hi].filter(learnt[lo:hi])


def _count_words(folds: int, fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for texts in _training_texts(batches, folds, fold, 2 * TOGETHER):
            ends += len(texts)
            for words, code, _ in _cut(texts, 2 * TOGETHER):
                n = np.bincount(code, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(n > 0)).cast(pa.binary()), pa.array(n[n > 0], pa.int64())], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END][: min(ends, 1)], pa.binary()), pa.array([ends][: min(ends, 1)], pa.int64())], names=["word", "n"])

    return run


def _numbered(texts: Iterator[pa.Array], vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    for part in texts:
        for known, codes in coded(part):
            n = vocabulary.numbers(known)
            yield from (n[c] for c in codes)


def _chunks(texts: Iterator[np.ndarray], end: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Padded runs of at least ``size`` tokens, but the last one."""
    held: list[np.ndarray] = []
    k = 0
    for n in texts:
        held.append(n)
        k += len(n)
        if k >= size:
            yield padded(held, end)
            held, k = [], 0
    if held:
        yield padded(held, end)


#: Rows of a table of vectors that travel together.
BLOCK = 1024
_MOVES = "part int, block int, salt int, weight binary, moves binary"


def _train(start, epochs: int, batch: int, rate: float, folds: int, fold: int):
    """mapInArrow function over texts: how far, and how often, a copy of the starting model was moved by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, model, numbers = start.value
        model = Model(*(getattr(model, k).copy() for k in Model.PARTS))
        task = TaskContext.get().partitionId()
        trainer = Trainer(model, numbers, vocabulary.classes(), noise=(48, 16), batch=batch, rate=rate, seed=task)
        runs = _chunks(_numbered(_training_texts(batches, folds, fold, TOGETHER), vocabulary), vocabulary.number(END), 65_536)
        if epochs == 1:
            for flat, real in runs:
                trainer.run(flat, real)
        else:  # a bounded part, held in memory
            parts = list(runs)
            for _ in range(epochs):
                for flat, real in parts:
                    trainer.run(flat, real)
        for k, name in enumerate(Model.PARTS):
            weight = trainer.moved[name]
            first, now = getattr(start.value[1], name), getattr(model, name)
            moves = (now - first) * (weight[:, None] if now.ndim == 2 else weight)
            for lo in range(0, len(weight), BLOCK):
                w = weight[lo : lo + BLOCK]
                if w.any():
                    row = [[k], [lo // BLOCK], [task % 16], [w.astype("<f4").tobytes()], [moves[lo : lo + BLOCK].astype("<f4").tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "block", "salt", "weight", "moves"])

    return run


def _add_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the moves of equal (part, block, salt), which come one after another; one sum is held at a time."""
    key = weight = moves = None

    def out() -> pa.RecordBatch:
        row = [[key[0]], [key[1]], [key[2]], [weight.tobytes()], [moves.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "block", "salt", "weight", "moves"])

    for batch in batches:
        keys = zip(*(_column(batch, k).to_pylist() for k in ("part", "block", "salt")))
        for k, w, m in zip(keys, _column(batch, "weight"), _column(batch, "moves")):
            w, m = np.frombuffer(w.as_buffer(), dtype="<f4"), np.frombuffer(m.as_buffer(), dtype="<f4")
            if k == key:
                weight, moves = weight + w, moves + m
                continue
            if key is not None:
                yield out()
            key, weight, moves = k, w.copy(), m.copy()
    if key is not None:
        yield out()


def _summed(rows: DataFrame) -> DataFrame:
    return rows.repartition("part", "block", "salt").sortWithinPartitions("part", "block", "salt").mapInArrow(_add_moves, _MOVES)


def _moved(model: Model, rows: DataFrame) -> Model:
    """The model with every vector moved by the mean of its moves; sums are made by 16 salts first, then of those."""
    out = Model(*(getattr(model, k).copy() for k in Model.PARTS))
    for r in _summed(_summed(rows).withColumn("salt", F.lit(0))).toArrow().to_pylist():
        x = getattr(out, Model.PARTS[r["part"]])
        weight = np.frombuffer(r["weight"], dtype="<f4")
        moves = np.frombuffer(r["moves"], dtype="<f4").reshape(len(weight), -1) / np.maximum(weight, 1)[:, None]
        lo = r["block"] * BLOCK
        x[lo : lo + len(weight)] += moves if x.ndim == 2 else moves[:, 0]
    return out


@dataclass
class Fitted:
    """A trained model, the counts of all training words as a table, and the counts plus one of each class of rare words."""

    vocabulary: Vocabulary
    model: Model
    within: np.ndarray
    counts: DataFrame


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folds: int = 7, fold: int = 2, own: int = 65_000, least: int = 16, rare: int = 64, head: int = 200_000, dim: int = 24, warm: int = 300_000, seed: int = 20) -> Fitted:
    """Count the words of all training texts and train on them.

    ``own``, below 2^16, and ``head`` bound what is broadcast: the model's vectors (12 MB) and the most frequent words with
    their counts. Training starts on texts with about ``warm`` tokens, drawn by a hash of the id, in one task; from there
    every part of the input trains on all its texts. Moves are summed in Spark; the driver gets one model.
    """
    if own + rare > 1 << 16:
        raise ValueError("own + rare beyond 65,536")
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = written(slim.mapInArrow(_count_words(folds, fold), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    # the head is cut where a step of a logarithmic scale of counts begins: a histogram of fixed size finds it, no sort
    step = F.floor(F.log2("n") * 64).cast("int")
    cut, room = None, head
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["s"]):
        room -= r["k"]
        if room < 0:
            break
        cut = r["s"]
    top = counts.where(step >= cut if cut is not None else F.lit(False)).toArrow()
    vocabulary = Vocabulary(dict(zip((bytes(w) for w in top["word"].to_pylist()), top["n"].to_pylist())), facts["total"], facts["distinct"], own, least, rare)
    # what shares the classes of rare words: their counts, and one more for a word never seen
    # as an Arrow table, since a list's rows pass through Python workers of another kind, which stay
    own_words = spark.createDataFrame(pa.table({"word": pa.array(vocabulary.words[: vocabulary.own], pa.binary())}))
    within, seen = np.ones(rare), np.zeros(rare)
    others = counts.join(F.broadcast(own_words), "word", "left_anti")
    for r in others.groupBy((F.crc32(F.substring("word", -ENDING, ENDING)) % rare).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        seen[r["c"]] = r["n"]
        within[r["c"]] += r["n"] + r["k"]
    numbers = np.concatenate([vocabulary.counts[: vocabulary.own], seen]).astype(np.float64)
    model = Model.start(numbers, vocabulary.classes(), dim, seed)
    share = min(1.0, warm / max(facts["total"], 1))
    drawn = slim.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    first = spark.sparkContext.broadcast((vocabulary, model, numbers))
    model = _moved(model, drawn.repartition(1).sortWithinPartitions("id", "text").mapInArrow(_train(first, 2, 512, 0.15, folds, fold), _MOVES))
    warmed = spark.sparkContext.broadcast((vocabulary, model, numbers))
    model = _moved(model, slim.mapInArrow(_train(warmed, 1, 2048, 0.04, folds, fold), _MOVES))
    return Fitted(vocabulary, model, within, counts)


def _score(shared, folds: int, fold: int):
    """Per document: what the head of the counts explains, and the other distinct words, to be joined with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model, within = shared.value
        own, end, place = v.own, v.number(END), v.place.get
        logs, logs_within = np.log10(v.counts + 1.0), np.log10(within)
        numbers = np.concatenate([np.arange(own), [v.number(w) for w in v.words[own:]]]).astype(np.int64)
        # of a class's probability: all of it for the model's own, the share of the counts for others
        shares = np.concatenate([np.zeros(own), logs[own:] - logs_within[numbers[own:] - own]])
        bottom = math.log10(v.total + v.distinct + 1)

        def placed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
            """Of each text the places of its tokens in the head, their numbers, and the tokens that have no place."""
            for different, codes in coded(texts):
                every = np.fromiter(map(place, different, repeat(-1)), np.int64, len(different))
                number = numbers[every] if len(numbers) else np.empty(len(every), dtype=np.int64)
                odd = np.flatnonzero(every < 0).tolist()
                number[odd] = [own + rare_class(different[i], v.rare) for i in odd]
                for c in codes:
                    yield every[c], number[c], [different[i] for i in c[every[c] < 0].tolist()]

        def scored(ids: list, texts: list[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> pa.RecordBatch:
            others, known, base, model_part, rows = [], [], [], [], []
            for at, n, unplaced in texts:
                found, odd = at[at >= 0], at < 0
                others.append(Counter(unplaced))
                rows.append(n)
                known.append(len(found))
                base.append(float(logs[found].sum()) - len(at) * bottom)
                model_part.append(float(shares[found].sum() - logs_within[n[odd] - own].sum()))
            steps = log_probabilities(model, v, *padded(rows, end))
            sizes = np.array([len(x) for x in rows])
            sums = np.add.reduceat(steps, np.concatenate([[0], np.cumsum(sizes)[:-1]])) + model_part
            ends = np.cumsum([0, *map(len, others)])
            words = pa.array([w for x in others for w in x], pa.binary())
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array([k for x in others for k in x.values()], pa.int32())], names=["word", "k"]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([held_out(i, folds, fold) for i in ids], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums, pa.float64()), rare],
                names=["id", "held_out", "n_tokens", "n_known", "base", "model", "rare"],
            )

        for batch in batches:
            id_type = _column(batch, "id").type
            ids, texts, size = [], [], 0
            for i, t in zip(_column(batch, "id").to_pylist(), placed(_column(batch, "text"))):
                ids.append(i)
                texts.append(t)
                size += len(t[0])
                if size >= 131_072:
                    yield scored(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield scored(ids, texts)

    return run


def lm_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folds: int = 7, fold: int = 2, fitted: Fitted | None = None, **sizes) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Training texts are those whose crc32(id as text) mod ``folds`` is not ``fold``; a null id counts as an empty text.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) over the tokens, with the token's count c, all N and the V distinct
    ones in training; ``score`` is the model's log10 probability of the text; n_known counts tokens with c > 0. ``sizes``
    are those of ``fit``, whose result can be given as ``fitted``.

    A null or empty text is its end alone. Rows with equal ids are scored each by itself. Other columns are left behind,
    whatever their names. Words with equal counts are ordered by their bytes; of those at the edge of the head all or none
    are in it, and both ways have one result. A long text is scored whole, about 131,072 tokens at a time. An empty table
    gives an empty table; without training texts every token is new.

    Scale: counts of all words stay in a table; the most frequent ones are broadcast, and the other words of a document
    are joined with the table, in which no word is frequent any more.
    """
    spark = docs.sparkSession
    f = fit(docs, text_col, id_col, folds, fold, **sizes) if fitted is None else fitted
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast((f.vocabulary, f.model, f.within))
    scanned = slim.mapInArrow(_score(shared, folds, fold), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<struct<word: binary, k: int>>")
    scanned = written(scanned.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = scanned.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k").join(f.counts, "word")
    sums = rare.groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"))
    out = scanned.drop("rare").join(sums, "row", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(f.vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
