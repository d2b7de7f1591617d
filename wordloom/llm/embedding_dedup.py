"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a sample so that the signs of rotated vectors are balanced codes with little quantisation error.
The bits of several rotations are one long code, cut into substrings, each with a table of its own: vectors that meet in a
table are candidates, those at a small Hamming distance are compared again with their original vectors.

Equal vectors are one item. Vectors within half the angle of a common one are linked with one another whatever lies between
them, so they are counted as a ball; only pairs across balls are compared, within tasks, and no pair leaves a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written
from wordloom.llm.graph import components

#: Rounds of learning a rotation.
ROUNDS = 30
#: Standard deviations of the Hamming distance of a pair at the threshold that a candidate may lie beyond its mean.
SPREAD = 4.0


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Principal directions of unit vectors, then the rotation that brings the signs of their projections nearest to them."""
    dims = x.shape[1]
    _, vectors = np.linalg.eigh(x.T @ x)
    principal = vectors[:, ::-1][:, :bits]
    v = x @ principal
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    return (principal @ rotation).reshape(dims, bits)


class Tables:
    """How codes are cut: ``tables`` substrings of ``width`` bits, so that a pair at the threshold is missed at most so often."""

    def __init__(self, items: int, cosine: float, miss: float) -> None:
        same = 1 - math.acos(cosine) / math.pi  # of one bit of a pair at the threshold
        self.width = min(31, max(6, math.ceil(math.log2(max(items, 2))) - 4))
        self.tables = max(1, math.ceil(math.log(miss) / math.log(1 - same**self.width)))
        bits = self.width * self.tables
        self.radius = math.ceil(bits * (1 - same) + SPREAD * math.sqrt(bits * same * (1 - same)))

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """(items, tables): the substrings of codes given as rows of 0 and 1."""
        cut = bits[:, : self.width * self.tables].reshape(len(bits), self.tables, self.width).astype(np.int64)
        return cut @ (1 << np.arange(self.width, dtype=np.int64))


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The vectors of a list column in double precision; None for those without a direction."""
    for v in column:
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                yield x
                continue
        yield None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()  # first, so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum())


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec) -> (id, v, vec): v names the vector by its components, null for one that links with nothing."""
    for batch in batches:
        names = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in _lists(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), batch.column(1)], names=["id", "v", "vec"])


def _coded(rotations: np.ndarray, tables: Tables):
    """(id, v, vec) -> (id, v, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[bytes | None] = [None] * batch.num_rows
            given = [(i, _unit(x)) for i, x in enumerate(_lists(batch.column(2))) if x is not None]
            for lo in range(0, len(given), 2048):
                part = given[lo : lo + 2048]
                x = np.zeros((len(part), rotations.shape[0]))
                for k, (_, u) in enumerate(part):
                    x[k, : len(u)] = u
                packed = np.packbits(x @ rotations > 0, axis=1)
                for (i, _), code in zip(part, packed):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=["id", "v", "code"])

    return run


def _bits(codes: list[bytes], tables: Tables) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
    return np.unpackbits(packed, axis=1)[:, : tables.width * tables.tables]


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _indexed(tables: Tables):
    """Rows with a code -> a row for each table, with its bucket and all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys = tables.keys(_bits(_column(part, "code").to_pylist(), tables))
                take = pa.array(np.repeat(np.arange(part.num_rows), tables.tables))
                bucket = pa.array((keys + (np.arange(tables.tables, dtype=np.int64) << 32)).ravel())
                yield pa.RecordBatch.from_arrays([bucket, *(c.take(take) for c in part.columns)], names=["bucket", *part.schema.names])

    return run


def _near_heads(tables: Tables):
    """(v, code, head, head_code) -> (v, head) at a small Hamming distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_bits(_column(batch, k).to_pylist(), tables) for k in ("code", "head_code"))
            hit = pa.array(np.count_nonzero(a != b, axis=1) <= tables.radius)
            yield pa.RecordBatch.from_arrays([_column(batch, "v").filter(hit), _column(batch, "head").filter(hit)], names=["v", "head"])

    return run


def _within(angle: float):
    """(v, head, vec, head_vec) -> (v, head) within an angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(_lists(_column(batch, "vec")), _lists(_column(batch, "head_vec"))):
                # chord, not cosine: exact for small angles
                hit.append(len(x) == len(y) and 2 * math.asin(min(1.0, float(np.sqrt(((_unit(x) - _unit(y)) ** 2).sum())) / 2)) <= angle)
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([_column(batch, "v").filter(keep), _column(batch, "head").filter(keep)], names=["v", "head"])

    return run


class _Meeting:
    """The rows of one bucket, or of two blocks of it, as numpy has them."""

    def __init__(self, rows: pa.Table, tables: Tables) -> None:
        self.rows = rows
        self.bits = _bits(_column(rows, "code").to_pylist(), tables)
        labels = np.array(_column(rows, "label").to_pylist(), dtype=object)
        _, self.label = np.unique(labels, return_inverse=True)
        self.other = self.label[:, None] != self.label[None, :]
        side = _column(rows, "side").to_numpy()
        if side.any() and not side.all():
            self.other &= side[:, None] != side[None, :]

    def close(self, radius: int) -> np.ndarray:
        """Pairs across labels, and across blocks if there are two, within a Hamming distance."""
        signs = self.bits.astype(np.float32) * 2 - 1
        return self.other & (signs @ signs.T >= self.bits.shape[1] - 2 * radius)


def _met(work: Callable[[pa.Table], pa.RecordBatch | None]):
    """mapInArrow function over rows sorted by (bucket, lo, hi): the work on each group of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([_column(batch, k).to_numpy() for k in ("bucket", "lo", "hi")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if last is not None and tuple(keys[a]) != last:
                    if (out := _worked(held, work)) is not None:
                        yield out
                    held = []
                last = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held and (out := _worked(held, work)) is not None:
            yield out

    return run


def _worked(held: list[pa.RecordBatch], work: Callable) -> pa.RecordBatch | None:
    rows = pa.Table.from_batches(held).combine_chunks()
    return work(rows) if rows.num_rows > 1 else None


def _open_rows(tables: Tables):
    """The items that have a candidate outside their ball."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        hit = _Meeting(rows, tables).close(tables.radius).any(axis=1)
        return pa.RecordBatch.from_arrays([_column(rows, "v").combine_chunks().filter(pa.array(hit))], names=["v"]) if hit.any() else None

    return work


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def _linked(tables: Tables, cosine: float):
    """Reranked links across balls: for each item the vectors it gains, and a spanning forest of the links.

    A pair counts in the first table whose bucket it shares, so it counts once.
    """

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        meeting = _Meeting(rows, tables)
        close = np.triu(meeting.close(tables.radius))
        if not close.any():
            return None
        here = int(_column(rows, "bucket")[0].as_py()) >> 32
        keys = tables.keys(meeting.bits)
        for t in range(here):
            close &= keys[:, None, t] != keys[None, :, t]
        sizes = np.array([len(x) for x in _column(rows, "vec")])
        close &= sizes[:, None] == sizes[None, :]
        vec = np.zeros((len(sizes), sizes.max()))
        for i, x in enumerate(_lists(_column(rows, "vec").combine_chunks())):
            vec[i, : len(x)] = _unit(x)
        link = close & (vec @ vec.T >= cosine)
        if not link.any():
            return None
        m = _column(rows, "m").to_numpy()
        gain = link.astype(np.float64) @ m + link.T.astype(np.float64) @ m
        forest = np.array(_spanning(np.argwhere(link), len(m)))
        some = np.flatnonzero(gain)
        v = _column(rows, "v").combine_chunks()
        none = pa.nulls(len(some), pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([v.take(pa.array(some)), v.take(pa.array(forest[:, 0]))]),
                pa.concat_arrays([none, v.take(pa.array(forest[:, 1]))]),
                pa.array(np.concatenate([gain[some].astype(np.int64), np.zeros(len(forest), dtype=np.int64)])),
            ],
            names=["v", "w", "gain"],
        )

    return work


def _dealt(index: DataFrame, block: int) -> DataFrame:
    """Rows of buckets -> rows of (bucket, lo, hi, side), tasks of at most about two blocks.

    A bucket of more than ``block`` rows is cut into blocks, of one large ball or of all else; blocks of the same ball
    don't meet, as nothing is open between them.
    """
    hot = index.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select("bucket")
    hot = written(hot, "hot-buckets")
    plain = index.join(hot, "bucket", "left_anti").withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(0)})
    if hot.isEmpty():
        return plain
    crowded = index.join(hot, "bucket")
    balls = crowded.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    grouped = balls.withColumn("ball", F.when(F.col("n") > block, F.col("label")))
    sizes = grouped.groupBy("bucket", "ball").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    large = written(sizes, "blocks")
    # the blocks of a bucket in one row: a number for each `block` rows of it
    listed = large.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("ball", "blocks"))).alias("list"))
    listed = listed.withColumn("list", F.expr("transform(list, (x, i) -> struct(x.ball AS ball, x.blocks AS blocks, aggregate(slice(list, 1, i), 0, (s, y) -> s + y.blocks) AS first))"))
    own = listed.select("bucket", "list", F.explode("list").alias("x")).select("bucket", "list", F.col("x.ball").alias("ball"), "x.blocks", "x.first")
    balled = crowded.join(large.where("ball IS NOT NULL").select("bucket", F.col("ball").alias("label"), F.lit(True).alias("is_ball")), ["bucket", "label"], "left")
    balled = balled.withColumn("ball", F.when(F.col("is_ball"), F.col("label"))).drop("is_ball")
    placed = balled.alias("r").join(own.alias("o"), (F.col("r.bucket") == F.col("o.bucket")) & F.col("r.ball").eqNullSafe(F.col("o.ball")))
    placed = placed.select("r.*", "o.list", "o.first", (F.col("o.first") + F.pmod(F.xxhash64("r.v"), F.col("o.blocks"))).cast("int").alias("mine"))
    # every block of another ball, and every block of the rest if the row is of the rest
    meets = F.expr("flatten(transform(filter(list, x -> x.ball IS NULL OR ball IS NULL OR x.ball <> ball), x -> sequence(x.first, x.first + x.blocks - 1)))")
    apart = placed.withColumn("other", F.explode(meets)).select(
        *index.columns, F.least("mine", "other").cast("int").alias("lo"), F.greatest("mine", "other").cast("int").alias("hi"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    return plain.unionByName(apart)


def _in_order(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def near_vectors(
    rows: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", cosine: float = 0.95, sample: int = 20_000, miss: float = 0.01, block: int = 1024
) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Two vectors link when their cosine, in double precision, is at least ``cosine``. ``n_links`` is the number of other
    rows whose vector links with the row's own, ``component_id`` the smallest id reachable over links, and ``kept`` marks
    the rows with that id. Rotations are learned on about ``sample`` vectors drawn by a hash of their components; every
    vector is indexed. A pair at the threshold is missed with a chance of about ``miss`` (closer ones less often); no pair
    below the threshold links. No bucket has a cap.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    length don't link. Rows with equal vectors link with each other; rows with equal ids and different vectors are
    vectors of their own. A null id has no component of its own, and the smallest id that is there otherwise. Ids are of
    any type that has an order. Other columns are left behind, whatever their names; an empty table gives an empty table.

    Scale: vectors are shuffled once for each table only where they have candidates outside their ball; else only codes
    are. Buckets above ``block`` rows are met block by block in tasks of at most two blocks, without the pairs within a ball.
    """
    id_type, vec_type = (rows.schema[c].dataType.simpleString() for c in (id_col, vec_col))
    slim = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    named = slim.mapInArrow(_vectors, f"id {id_type}, v binary, vec {vec_type}")
    known = written(named.select("v", F.size("vec").alias("d")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("m"), F.max("d").alias("d")), "vectors")
    items, dims = known.agg(F.count("*"), F.max("d")).first()
    tables = Tables(items, cosine, miss)
    rotations = _learned(named, items, dims or 1, sample, tables)
    coded = written(named.mapInArrow(_coded(rotations, tables), f"id {id_type}, v binary, code binary"), "codes")
    item = coded.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("m"), F.min("code").alias("code"), F.min("id").alias("id"))
    item = written(item, "items")

    # balls: the first item of a bucket holds those of it that lie within half the angle
    index = item.select("v", "code").mapInArrow(_indexed(tables), "bucket long, v binary, code binary")
    heads = index.groupBy("bucket").agg(F.min(F.struct("v", "code")).alias("h"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("h.v").alias("head"), F.col("h.code").alias("head_code"))
    near = index.join(heads, "bucket").where("v <> head").mapInArrow(_near_heads(tables), "v binary, head binary")
    near = written(near.groupBy("v").agg(F.min("head").alias("head")), "near-heads")
    vectors = named.select("v", "vec")
    asked = near.select(F.explode(F.array("v", "head")).alias("v")).distinct()
    some = written(vectors.join(asked, "v").groupBy("v").agg(F.first("vec").alias("vec")), "near-vectors")
    pairs = near.join(some, "v").join(some.select(F.col("v").alias("head"), F.col("vec").alias("head_vec")), "head")
    balls = pairs.mapInArrow(_within(math.acos(cosine) / 2 - 1e-9), "v binary, head binary")
    labelled = item.select("v", "m", "code").join(written(balls, "balls"), "v", "left")
    labelled = written(labelled.select("v", "m", "code", F.coalesce("head", "v").alias("label")), "labelled")

    # then the pairs across balls: codes tell who has any, and those meet with their vectors
    index = labelled.mapInArrow(_indexed(tables), "bucket long, v binary, m long, code binary, label binary")
    opened = written(_in_order(_dealt(index, block)).mapInArrow(_met(_open_rows(tables)), "v binary").distinct(), "open")
    vec = vectors.join(opened, "v").groupBy("v").agg(F.first("vec").alias("vec"))
    full = written(labelled.join(vec, "v"), "open-vectors")
    index = full.mapInArrow(_indexed(tables), f"bucket long, v binary, m long, code binary, label binary, vec {vec_type}")
    found = written(_in_order(_dealt(index, block)).mapInArrow(_met(_linked(tables, cosine)), "v binary, w binary, gain long"), "links")

    gains = found.groupBy("v").agg(F.sum("gain").alias("gain"))
    weights = labelled.groupBy("label").agg(F.sum("m").alias("weight"))
    counted = labelled.join(weights, "label").join(gains, "v", "left").select("v", (F.col("weight") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"))
    edges = found.where("w IS NOT NULL").select(F.col("v").alias("a"), F.col("w").alias("b")).unionByName(labelled.where("v <> label").select(F.col("v").alias("a"), F.col("label").alias("b")))
    comps = components(edges).withColumnRenamed("v", "u")
    placed = item.select("v", "id").join(comps, F.col("v") == F.col("u"), "left").select("v", "id", F.coalesce("comp", "v").alias("comp"))
    firsts = placed.groupBy("comp").agg(F.min("id").alias("component_id"))
    settled = written(counted.join(placed.select("v", "comp"), "v").join(firsts, "comp").select(F.col("v").alias("u"), "n_links", "component_id"), "settled")
    out = coded.select("id", "v").join(settled, F.col("v") == F.col("u"), "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _learned(named: DataFrame, items: int, dims: int, sample: int, tables: Tables) -> np.ndarray:
    """Rotations side by side, as many as the tables need bits; learned on distinct vectors drawn by their names."""
    drawn = named.where("v IS NOT NULL")
    if items > sample:
        share = int(sample / items * (1 << 24))
        drawn = drawn.where(F.conv(F.hex(F.substring("v", 1, 3)), 16, 10).cast("long") < share)
    seen = drawn.groupBy("v").agg(F.first("vec").alias("vec")).toArrow()
    x = np.zeros((seen.num_rows, dims))
    for i, v in enumerate(_lists(seen.column("vec").combine_chunks())):
        x[i, : len(v)] = _unit(v)
    bits = min(dims, 256)
    return np.concatenate([learn_rotation(x, bits, seed) for seed in range(-(-tables.width * tables.tables // bits))], axis=1)
