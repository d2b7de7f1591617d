"""Chroma fingerprints of an audio column, and their alignment.

A recording becomes frames of twelve pitch classes. Filters over the integral image of those frames compare areas, each
answer takes two bits, and sixteen of them are packed into a 32-bit integer for every frame. Recordings align at the
offset at which most of their landmarks (two integers in a row) meet, judged by the share of differing bits.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import BitFilter, written

RATE, FRAME, HOP = 4000, 512, 128
#: Samples of a note in a melody.
NOTE = 256
FILTERS = 16
#: Frames under a filter.
REACH = 16
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of each filter, from a rule that spreads them evenly."""
    return [(i % 4, (i * 5) % 9, 3 + (i // 4) % 2 * 3 if (i * 5) % 9 <= 6 else 3, (4, 8, 12, 16)[(i // 4 + i) % 4]) for i in range(FILTERS)]


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples at RATE, as shares of full scale: averaged over a new sample's time, then read between the old ones."""
    x = np.asarray(samples, dtype=np.float64) / 32768
    if rate == RATE or not len(x):
        return x.astype(np.float32)
    width = max(1, round(rate / RATE))
    sums = np.concatenate([[0.0], np.cumsum(x)])
    lo = np.clip(np.arange(len(x)) - width // 2, 0, len(x))
    hi = np.clip(lo + width, 0, len(x))
    even = (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)
    return np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), even).astype(np.float32)


def _fold() -> np.ndarray:
    """Frequency -> pitch class, for those a chroma takes in."""
    hz = np.arange(1, FRAME // 2 + 1) * RATE / FRAME
    fold = np.zeros((FRAME // 2 + 1, 12), dtype=np.float32)
    ok = (hz >= 100) & (hz <= 1800)
    fold[np.flatnonzero(ok) + 1, np.round(12 * np.log2(hz[ok] / 440)).astype(int) % 12] = 1
    return fold


FOLD, WINDOW = _fold(), np.hanning(FRAME).astype(np.float32)


def chroma(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(frames x 12, frames of each recording): the energy of each pitch class, frames scaled to length 1, silent ones 0."""
    counts = np.array([max(0, (len(x) - FRAME) // HOP + 1) for x in recordings], dtype=np.int64)
    out = np.zeros((counts.sum(), 12), dtype=np.float32)
    at = 0
    buffer: list[np.ndarray] = []

    def spectra() -> None:
        nonlocal at
        frames = np.concatenate(buffer)
        f = np.fft.rfft(frames * WINDOW)
        out[at : at + len(frames)] = (f.real * f.real + f.imag * f.imag).astype(np.float32) @ FOLD
        at += len(frames)
        buffer.clear()

    held = 0
    for x in recordings:
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] if len(x) >= FRAME else np.empty((0, FRAME), np.float32)
        for lo in range(0, len(frames), 1024):  # bounded memory for long recordings
            buffer.append(frames[lo : lo + 1024])
            held += len(buffer[-1])
            if held >= 1024:
                spectra()
                held = 0
    if buffer:
        spectra()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-4, out / np.maximum(norm, 1e-9), 0), counts


def fingerprints_of(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """One 32-bit integer for each frame of each recording that has REACH - 1 frames after it."""
    c, counts = chroma(recordings)
    # one integral image for all: areas are differences within it, and none crosses recordings
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0, dtype=np.float64).cumsum(1)
    ends = np.cumsum(counts)
    sizes = np.maximum(counts - REACH + 1, 0)
    t = np.repeat(ends - counts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros(len(t), dtype=np.uint32)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    for kind, y, h, w in filters():
        half, mid, third = w // 2, y + (h + 1) // 2, max(w // 3, 1)
        if kind == 0:  # all of it against nothing
            a, b = area(0, w, y, y + h), np.full(len(t), w * h / 6.0)
        elif kind == 1:  # lower classes against upper ones
            a, b = area(0, w, y, mid), area(0, w, mid, y + h)
        elif kind == 2:  # before against after
            a, b = area(0, half, y, y + h), area(half, w, y, y + h)
        else:  # the middle against both sides
            a, b = area(third, w - third, y, y + h), area(0, third, y, y + h) + area(w - third, w, y, y + h)
        v = np.round(np.log((1 + a) / (1 + b)), 6)
        out = (out << np.uint32(2)) | _GRAY[(v >= -0.25).astype(np.int8) + (v >= 0) + (v >= 0.25)]
    return np.split(out, np.cumsum(sizes)[:-1])


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The integers of one recording."""
    return fingerprints_of([resampled(samples, rate)])[0]


def _notes() -> np.ndarray:
    """The samples of 25 notes, two octaves of semitones."""
    hz = 220 * 2 ** (np.arange(25) / 12)
    sound = np.sin(2 * math.pi * hz[:, None] * (np.arange(NOTE) / RATE)[None, :]) * np.hanning(NOTE)[None, :]
    return (sound * 20000).astype("<i2")


NOTES = _notes()


def melody(text: str | None) -> bytes:
    """A WAV file that plays a text: a note for each word, its pitch from a digest of the word."""
    words = (text or "").encode().split()
    notes = np.array([zlib.crc32(w) % len(NOTES) for w in words], dtype=np.int64)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(NOTES[notes].tobytes())
    return out.getvalue()


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a 16-bit WAV file; nothing for a null or for bytes that are no such file."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            if f.getsampwidth() != 2:
                return np.empty(0, np.int16), RATE
            x = np.frombuffer(f.readframes(f.getnframes()), dtype="<i2").reshape(-1, f.getnchannels())
            return x.mean(1), f.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.empty(0, np.int16), RATE


def add_melody(df: DataFrame, text_col: str, out: str = "audio") -> DataFrame:
    """Append a media column with the text as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.append_column(out, pa.array([melody(t) for t in texts], pa.binary()))

    return df.drop(out).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(out).schema) + f", `{out}` binary")


def _digest(items: np.ndarray, samples: np.ndarray, rate: int) -> bytes | None:
    """What equal recordings share: their integers, or their samples where they are too short for one; none without samples."""
    if len(items):
        return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    if len(samples):
        return hashlib.blake2b(np.asarray(samples, dtype="<f8").tobytes(), digest_size=16, person=str(rate).encode()[:16]).digest()
    return None


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "seconds", "items", "items_crc32", "digest"]
    for batch in batches:
        ids, audio = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "audio"))
        held: list[tuple[np.ndarray, int]] = []
        first = size = 0

        def out(last: int) -> pa.RecordBatch:
            items = fingerprints_of([resampled(*x) for x in held])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(items).astype(np.int64), pa.int64()))
            seconds = [len(x) / rate for x, rate in held]
            digests = [_digest(x, *h) for x, h in zip(items, held)]
            return pa.RecordBatch.from_arrays([ids[first:last], pa.array(seconds, pa.float64()), lists, pa.array([zlib.crc32(x.tobytes()) for x in items], pa.int64()), pa.array(digests, pa.binary())], names=names)

        for i, data in enumerate(audio):
            held.append(read_wav(data.as_py()))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield out(i + 1)
                held, first, size = [], i + 1, 0
        if held:
            yield out(len(batch))


def _landmarks(silent: int, keep: BitFilter | None = None):
    """(key, items), a row for each recording -> (key, mark, places), a row for each of its landmarks.

    A landmark is two integers in a row. Where nothing sounds there is none; with ``keep`` only those stay that it may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                keys, items = (part.column(part.schema.get_field_index(c)) for c in ("key", "items"))
                ends = np.cumsum([0, *(len(x) for x in items)])
                flat = items.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
                row = np.repeat(np.arange(len(part)), np.diff(ends))
                at = np.flatnonzero((row[:-1] == row[1:]) & ((flat[:-1] != silent) | (flat[1:] != silent))) if len(row) else np.empty(0, dtype=np.int64)
                marks = ((flat[at] << np.uint64(32)) | flat[at + 1]).view(np.int64) if len(at) else np.empty(0, dtype=np.int64)
                if keep is not None and len(marks):
                    some = keep.may_hold(marks)
                    at, marks = at[some], marks[some]
                if not len(at):
                    continue
                row = row[at]
                order = np.lexsort((at, marks, row))
                marks, row, at = marks[order], row[order], (at - ends[row])[order]
                first = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[first])), pa.array(marks[first]), lists], names=["key", "mark", "places"])

    return run


def _differences(a: list[int] | None, b: list[int] | None) -> list[dict] | None:
    """How often each difference between a place in a and a place in b occurs; nothing for nulls."""
    if a is None or b is None:
        return None
    x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    least = x.min() - y.max()
    found = np.zeros(x.max() - y.min() - least + 1, dtype=np.int64)
    for place in y:  # in each round the differences differ, so plain addition counts them
        found[x - place - least] += 1
    return [{"offset": int(i + least), "hits": int(found[i])} for i in np.flatnonzero(found)]


def bit_errors(a: Column, b: Column, offset: Column) -> Column:
    """The share of differing bits where b, moved by offset, lies over a; 1 where it doesn't."""
    i, j = F.greatest(offset, F.lit(0)), F.greatest(-offset, F.lit(0))
    n = F.greatest(F.least(F.size(a) - i, F.size(b) - j), F.lit(0))
    bits = F.zip_with(F.slice(a, i + 1, n), F.slice(b, j + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.when(n == 0, 1.0).otherwise(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x) / (F.greatest(n, F.lit(1)) * 32))


def fingerprints(media: DataFrame, audio_col: str = "audio", id_col: str = "id") -> DataFrame:
    """(id, seconds, items, items_crc32, digest, class_id): the packed integers, their checksum as little-endian unsigned
    32-bit numbers, a digest that equal recordings share, and the smallest id among them.

    Audio of any rate is brought to RATE first. Recordings under REACH frames have no items; their class is the smallest
    id with the same samples and rate. A null column, bytes that are no 16-bit WAV file and files without samples have no
    digest and are each a class of their own. Rows with equal ids are kept, each with its own class. Other columns are
    left behind, whatever their names. An empty table gives an empty table. A long recording is taken whole by one task.
    """
    id_type = media.schema[id_col].dataType.simpleString()
    found = media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInArrow(_prints, f"id {id_type}, seconds double, items array<long>, items_crc32 long, digest binary")
    prints = written(found, "prints")
    # only digests that several recordings share are joined back: written, so that the join can split a hot one
    first = written(prints.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "print-classes")
    return prints.join(first, "digest", "left").select("id", "seconds", "items", "items_crc32", "digest", F.coalesce("first", "id").alias("class_id"))


def align(prints: DataFrame, queries: DataFrame, least_hits: int = 6, most_errors: float = 0.15) -> DataFrame:
    """(query, match, offset, hits, bit_errors, digest) for classes of queries (a column id) against all other classes.

    Landmarks are two integers in a row, unless both are those of silence. All their meetings are counted by offset, every
    place of one with every place of the other. Each offset with at least ``least_hits`` meetings is judged by its bit
    errors over the overlap; of those with at most ``most_errors`` the one with most meetings stays for a pair, then the
    one with fewest errors, then the shortest way, then the later one. Equal recordings are one class and never paired;
    classes are told by their digests, so rows with equal ids lose nothing; query and match are their smallest ids, and
    digest is the query's.

    Only landmarks of queries are joined: a bit array of theirs keeps the others from the shuffle. The places of a landmark
    in a recording are one row. Where two rows would make many pairs of places, their differences are counted before rows
    are made of them, so that a row comes out for each offset.
    """
    items = prints.where("digest IS NOT NULL AND size(items) > 1").select("digest", "class_id", "items")
    classes = items.groupBy("digest").agg(F.min("class_id").alias("class_id"), F.any_value("items").alias("items")).withColumnRenamed("digest", "key")
    classes = written(classes, "print-items")
    asked = prints.join(queries.select("id").distinct(), "id", "left_semi").where("digest IS NOT NULL").select(F.col("digest").alias("key")).distinct()
    silent = int(fingerprint(np.zeros(FRAME + REACH * HOP))[0])
    kind = "key binary, mark long, places array<int>"
    mine = written(classes.join(asked, "key", "left_semi").select("key", "items").mapInArrow(_landmarks(silent), kind), "landmarks")
    keep = BitFilter(mine.select("mark").distinct(), "mark")
    theirs = classes.select("key", "items").mapInArrow(_landmarks(silent, keep), kind)
    both = mine.select(F.col("key").alias("q"), F.col("places").alias("a"), "mark").join(theirs.select(F.col("key").alias("m"), F.col("places").alias("b"), "mark"), "mark").where("q <> m")
    many = F.size("a").cast("long") * F.size("b") > 16
    few = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.struct((x - y).alias("offset"), F.lit(1).cast("long").alias("hits")))))
    counted = F.udf(_differences, "array<struct<offset:int,hits:long>>", useArrow=True)(F.when(many, F.col("a")), F.when(many, F.col("b")))
    met = both.select("q", "m", F.explode(F.when(many, counted).otherwise(few)).alias("o")).groupBy("q", "m", F.col("o.offset").alias("offset")).agg(F.sum("o.hits").alias("hits")).where(F.col("hits") >= least_hits)
    side = lambda key, name, who: classes.select(F.col("key").alias(key), F.col("items").alias(name), F.col("class_id").alias(who))
    judged = met.join(side("q", "a", "query"), "q").join(side("m", "b", "match"), "m").withColumn("bit_errors", bit_errors(F.col("a"), F.col("b"), F.col("offset")))
    best = F.min(F.struct((-F.col("hits")).alias("h"), "bit_errors", F.abs("offset").alias("way"), (-F.col("offset")).alias("o"))).alias("x")
    out = judged.where(F.col("bit_errors") <= most_errors).groupBy("q", "m", "query", "match").agg(best)
    return out.select("query", "match", (-F.col("x.o")).alias("offset"), (-F.col("x.h")).alias("hits"), "x.bit_errors", F.col("q").alias("digest"))
