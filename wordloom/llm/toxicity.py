"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Training labels fall into three parts by a hash of the id: one for the lexicon, one for the trees, one for the
calibration, so that no part judges what it was made from. Each part is a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

# Insults, and second-person words of four languages.
INSULTS = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb fool liar coward imbecile crétin abruti idiote dumm trottel depp idiota estúpido imbécil".split())
SECOND_PERSON = frozenset("you your yours you're u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ihr tú ti usted ustedes vuestro vosotros".split())
EDGES = ".,;:!?\"'()[]{}<>*_-…«»„“”¿¡|#$%&/\\~`+="
PLAIN = str.maketrans("013457@$€!", "oieastasei")
_INNER = re.compile(r"[^\W\d_][\d@$*!.\-_]+[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")
STEM = 5
#: Distance in words that counts as close.
NEAR = 5

FEATURES = (
    "log_words", "lexicon_density", "lexicon_hits", "lexicon_distinct", "lexicon_weight", "lexicon_weight_most", "stem_density", "stem_weight", "insult_density", "second_person_density",
    "near_second_person", "capital_ratio", "shouted_words", "exclamation_rate", "question_rate", "punctuation_rate", "obfuscation_rate", "run_rate",
)
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def bare_words(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def features(text: str | None, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The dense features of a whole text; all 0 for an empty one."""
    text = text or ""
    low = bare_words(text)
    n = len(low)
    if not n:
        return [0.0] * len(FEATURES)
    odd = [(i, w) for i, w in enumerate(low) if w and not w.isalpha()]
    hidden = 0
    for i, w in odd:
        if _INNER.search(w):
            hidden += 1
            plain = re.sub(r"[^\w]", "", w.translate(PLAIN))
            if plain in words or plain in INSULTS:
                low[i] = plain
    hits = [i for i, w in enumerate(low) if w in words]
    weights = [words[low[i]] for i in hits]
    stem = [stems[s] for w in low if (s := w[:STEM]) in stems]
    insults = [i for i, w in enumerate(low) if w in INSULTS]
    you = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = 0
    marks = sorted({*hits, *insults})
    if you and marks:
        y = np.array(you)
        at = np.searchsorted(y, marks)
        gap = np.minimum(np.abs(y[np.minimum(at, len(y) - 1)] - marks), np.abs(y[np.maximum(at - 1, 0)] - marks))
        near = int((gap <= NEAR).sum())
    b = text.encode()
    letters = len(b) - len(b.translate(None, LETTERS))
    bangs, asks = text.count("!"), text.count("?")
    points = sum(text.count(x) for x in ".,;:") + bangs + asks
    return [
        math.log1p(n), len(hits) / n, math.log1p(len(hits)), math.log1p(len({low[i] for i in hits})), sum(weights) / n, max(weights, default=0.0), len(stem) / n, sum(stem) / n, len(insults) / n, len(you) / n,
        near / n, (len(b) - len(b.translate(None, UPPER))) / max(letters, 1), sum(map(str.isupper, text.split())) / n, bangs / n, asks / n, points / n, hidden / n, sum(1 for _, w in odd if _RUN.search(w)) / n,
    ]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _featurise(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = lexicon.value
        for batch in batches:
            rows = [features(t.as_py(), words, stems) for t in _column(batch, "text")]
            rest = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(_column(batch, x) for x in rest), pa.array(rows, pa.list_(pa.float64()))], names=[*rest, "x"])

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a word, or a longer word's first letters."""
    found: dict[int, Counter[tuple[str, bool]]] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(_column(batch, "text"), _column(batch, "toxic").to_pylist()):
            words = set(bare_words(text.as_py() or ""))
            found[toxic].update((w, False) for w in words if len(w) > 1)
            found[toxic].update({(w[:STEM], True) for w in words if len(w) > STEM})
    keys = list({*found[0], *found[1]})
    for lo in range(0, len(keys), 50_000):
        part = keys[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.bool_()), pa.array([found[1][k] for k in part], pa.int64()), pa.array([found[0][k] for k in part], pa.int64())], names=["term", "stem", "bad", "good"]
        )


def _sample(labels: DataFrame, bounds: dict[str, int], seed: int) -> DataFrame:
    """Labelled training rows by part, at most about the bound of each (chosen by a hash)."""
    part = F.when(F.col("draw") < 2, "lexicon").when(F.col("draw") == 2, "trees").otherwise("calibration")
    labelled = labels.withColumn("part", part)
    sizes = {r["part"]: r["n"] for r in labelled.groupBy("part").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for part, n in sizes.items():
        share = F.when(F.col("part") == part, F.lit(min(1.0, bounds[part] / n))).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)


def id_sum(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fold_of(doc_id: Column, folds: int) -> Column:
    return id_sum(doc_id) % folds


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", folds: int = 5, bounds: dict[str, int] | None = None, terms: int = 4000, trees: int = 20, depth: int = 4, seed: int = 20
) -> DataFrame:
    """One row per input row: (id, held_out, score, predicted).

    Labels are read only where crc32(id as text) mod ``folds`` is not 0 (``held_out`` is true where it is 0). ``bounds``
    limits the labelled rows used for the lexicon, the trees and the calibration (20,000, 40,000 and 20,000); the
    lexicon has at most ``terms`` words and word beginnings. Scores come from the text alone.

    Of the labels half teach the lexicon, a quarter the trees and a quarter the calibration, by a draw from the same crc32.
    Null and empty texts are scored like others, with all features 0; a text of any length is taken whole. Terms that tie
    for the last place in the lexicon are ordered by themselves. An id with several labels is toxic if one says so;
    null labels and ids are not learned from. Without both classes among the training labels every score is the share of
    toxic labels (0 without any). Rows with equal ids are scored each by itself; other columns are left behind, whatever their names; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    bounds = {"lexicon": 20_000, "trees": 40_000, "calibration": 20_000} | (bounds or {})
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).where("label_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic")).where(fold_of(F.col("label_id"), folds) != 0)
    known = known.withColumn("draw", F.floor(id_sum(F.col("label_id")) / folds) % 4)
    chosen = written(_sample(known, bounds, seed).select("label_id", "toxic", "part"), "labels")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most the sum of the bounds: a size known beforehand
    taught = slim.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))

    totals = {r["toxic"]: r["n"] for r in chosen.where("part = 'lexicon'").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counted = taught.where("part = 'lexicon'").select("text", "toxic").mapInArrow(_document_counts, "term string, stem boolean, bad long, good long")
    odds = F.log((F.col("bad") + 0.5) / (totals.get(1, 0) + 1)) - F.log((F.col("good") + 0.5) / (totals.get(0, 0) + 1))
    summed = counted.groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("w", odds)
    best = summed.where("bad >= 3 AND w > 1.5").orderBy(F.desc(F.col("w") * F.sqrt("bad")), "term", "stem").limit(terms).collect()
    lexicon = spark.sparkContext.broadcast(tuple({r["term"]: r["w"] for r in best if r["stem"] == s} for s in (False, True)))

    id_type = docs.schema[id_col].dataType.simpleString()
    train = taught.where("part <> 'lexicon'").select("text", "toxic", "part").mapInArrow(_featurise(lexicon), "toxic int, part string, x array<double>")
    train = written(train, "toxicity-features").withColumn("features", array_to_vector("x")).withColumn("toxic", F.col("toxic").cast("double"))
    seen = {(r["part"], int(r["toxic"])): r["n"] for r in train.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    scored = slim.mapInArrow(_featurise(lexicon), f"id {id_type}, x array<double>")
    if not (seen.get(("trees", 0)) and seen.get(("trees", 1))):
        n = sum(seen.values())
        scored = scored.withColumn("score", F.lit(float(sum(v for k, v in seen.items() if k[1]) / n) if n else 0.0))
    else:
        fit = train.where("part = 'trees'").select("features", "toxic").coalesce(8).cache()
        model = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(fit)
        fit.unpersist()
        raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])
        scored = raw(scored.withColumn("features", array_to_vector("x")))
        score = F.col("raw")
        if seen.get(("calibration", 0)) and seen.get(("calibration", 1)):
            # the scores in a thousand bins with their sizes: a bounded table, whatever the sample
            bins = raw(train.where("part = 'calibration'")).groupBy(F.floor(F.col("raw") * 1000).alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("toxic").alias("toxic"), F.count("*").cast("double").alias("n"))
            curve = IsotonicRegression(featuresCol="raw", labelCol="toxic", weightCol="n", predictionCol="level").fit(bins)
            scored = curve.transform(scored.drop("prediction"))
            score = F.col("level") * 0.999 + F.col("raw") * 0.001  # within a level the trees' order stays
        scored = scored.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return scored.select(F.col("id").alias(id_col), (fold_of(F.col("id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
