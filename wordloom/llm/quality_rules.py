"""Quality rules: a threshold table compiled into one Spark projection.

Every feature is a built-in Spark expression over the whole text; no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import BLANKS, UPPER, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are or from at an not "
    "de la le et les des en un une du que est pour dans qui par sur pas au "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch er "
    "el los se del las por con para su al lo como una"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A feature and the closed range it must lie in; checked on texts of at least min_words words."""

    name: str
    feature: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("length", "n_words", low=10),
    Rule("repetition", "repeat_ratio", high=0.20),
    Rule("mean_word", "mean_word_chars", low=1.5, high=25.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("capitals", "capital_ratio", high=0.60, min_words=20),
    Rule("exclamation", "exclamation_ratio", high=0.35, min_words=20),
    Rule("stop_words", "n_stop_words", low=1, min_words=60),
    Rule("duplicate_lines", "duplicate_line_ratio", high=0.50, min_words=20),
)


def _repeated(words: str, grams: str) -> Column:
    """Words covered by five-word windows whose content is found at least twice in the array of window hashes."""
    size = F.size(grams)
    ranked = F.sort_array(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twin = F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                    x["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.sort_array(twin)

    # transform() over a one-element array binds the sorted hashes once for the whole expression
    covered = F.aggregate(
        F.flatten(F.transform(F.array(ranked), starts)),
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(size == F.size(F.array_distinct(F.col(grams))), F.lit(0)).otherwise(covered).cast("long")


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append a struct column ``quality`` with every feature, the failed rules and the verdict.

    Features: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and the ratios the rules name.
    ``base_failed`` holds if there are fewer than 10 words or over 20 % of them stand in repeated five-word windows;
    ``kept`` is false then, else true if no rule failed.

    Nulls and empty texts have no words, so they fail. Very long texts are evaluated whole: the work is linear but
    for one in-row sort of window hashes, made only where some window repeats. Equal rows get equal results; all input
    columns stay, a clashing ``quality`` column is replaced; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("quality", F.struct(words_of(F.col(text_col)).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines")))
    base = base.withColumn("quality", F.struct(
        "quality.*",
        F.transform("quality.words", lambda w: F.xxhash64(w)).alias("hashes"),
    ))
    n = F.size("quality.hashes")
    base = base.withColumn("quality", F.struct(
        "quality.*",
        F.when(n >= 5, F.transform(
            F.slice(F.col("quality.hashes"), 1, F.greatest(n - 4, F.lit(0))),
            lambda h, i: F.xxhash64(h, *(F.get(F.col("quality.hashes"), i + k) for k in range(1, 5))),
        )).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    ))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    base = base.withColumn("quality", F.struct(
        F.size("quality.words").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("quality.lines").cast("long").alias("n_lines"),
        (F.size("quality.lines") - F.size(F.array_distinct("quality.lines"))).cast("long").alias("n_dup_lines"),
        _repeated("quality.words", "quality.grams").alias("n_repeat_words"),
        F.size(F.array_intersect(F.transform("quality.words", lambda w: F.lower(w)), F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclamations"),
        (F.length(text) - F.length(F.translate(text, UPPER + "ÀÂÄÇÈÉÊËÎÏÑÓÔÖÚÙÛÜ", ""))).cast("long").alias("n_capitals"),
        letters.cast("long").alias("n_letters"),
    ))
    q = F.col("quality")
    share = lambda a, b: F.coalesce(q[a] / F.nullif(q[b], F.lit(0)), F.lit(0.0))
    values = {
        "n_words": q["n_words"],
        "n_stop_words": q["n_stop_words"],
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "capital_ratio": share("n_capitals", "n_letters"),
        "exclamation_ratio": share("n_exclamations", "n_words"),
        "duplicate_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
    }
    broken = []
    for rule in rules:
        v = values[rule.feature]
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (v < rule.low)
        if rule.high is not None:
            bad = bad | (v > rule.high)
        broken.append(F.when((q["n_words"] >= rule.min_words) & bad, F.lit(rule.name)))
    base_failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    failed = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return base.withColumn("quality", F.struct("quality.*", failed.alias("failed_rules"), base_failed.alias("base_failed"), (~base_failed & (F.size(failed) == 0)).alias("kept")))
