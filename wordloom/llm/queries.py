"""The registered queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.audio_fingerprint import add_melody, align, fingerprints
from wordloom.llm.common import table, word_count, words_of
from wordloom.llm.conversation_repair import ConversationRepair
from wordloom.llm.embedding_dedup import near_vectors
from wordloom.llm.exact_substring import exact_substring_dedup
from wordloom.llm.jaccard_join import jaccard_components
from wordloom.llm.line_dedup import line_dedup
from wordloom.llm.lm_score import lm_scores
from wordloom.llm.mixing import NOISE, mix_sources
from wordloom.llm.packing import pack_documents
from wordloom.llm.periodic_runs import periodic_runs
from wordloom.llm.quality_rules import STOP_WORDS, quality_rules
from wordloom.llm.toxicity import toxicity_scores
from wordloom.llm.url_filter import SOFT_LIMIT, SOFT_TERMS, STRICT_TERMS, url_filter

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: DuckDB: the words of a text.
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
UPPERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _op1_sql() -> str:
    hit = lambda t: f"(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])'))::int"
    fits = []
    for verdict, text in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, slash, path = text.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')", text, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    return f"""
    WITH p AS (
      SELECT page_id, translate(url_decode(coalesce(url, '')), {UPPERS}) AS u,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {UPPERS}) AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    t AS (
      SELECT *, {case(1)} AS rule, {case(2)} AS decided,
             {" + ".join(map(hit, STRICT_TERMS))} AS n_strict,
             {" + ".join(map(hit, SOFT_TERMS))} AS n_soft,
             {" + ".join(f"{w} * {hit(x)}" for x, w in SOFT_TERMS.items())} AS weight
      FROM p)
    SELECT page_id, host, path, rule,
           coalesce(decided, CASE WHEN n_strict > 0 OR (n_soft >= 2 AND weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
           n_strict::int AS n_strict, n_soft::int AS n_soft
    FROM t"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_substring_dedup(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    q = quality_rules(docs)
    return q.select("doc_id", *(f"quality.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def _op4_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("text")} AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
    f AS (
      SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains([{stops}], x)))) AS n_stop,
             length(text) - length(replace(text, '!', '')) AS n_excl,
             length(text) - length(regexp_replace(text, '[A-ZÀÂÄÇÈÉÊËÎÏÑÓÔÖÚÙÛÜ]', '', 'g')) AS n_caps,
             length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters
      FROM d LEFT JOIN c USING (doc_id)),
    v AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
           n_repeat_words::bigint AS n_repeat_words, base_failed,
           NOT base_failed
           AND word_chars::double / n_words BETWEEN 1.5 AND 25.0
           AND n_symbols::double / n_words <= 0.25
           AND NOT (n_words >= 20 AND n_letters > 0 AND n_caps::double / n_letters > 0.60)
           AND NOT (n_words >= 20 AND n_excl::double / n_words > 0.35)
           AND NOT (n_words >= 60 AND n_stop < 1)
           AND NOT (n_words >= 20 AND n_lines > 0 AND n_dup_lines::double / n_lines > 0.50) AS kept
    FROM v"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPERS}) AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (gone)::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len({WORDS.format("text")})::bigint AS size,
         (('0x' || substr(md5('20|' || doc_id::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / greatest(0.1::double, 1.0::double - 5.0::double * (length(t) - length(translate(t, '{NOISE}', ''))) / greatest(length(t), 1)) AS key FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size FROM k GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::double
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::double AS level
  FROM r WINDOW o AS (ORDER BY 3 * source_size / w::double, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(3.0::double * source_size, w * (
    SELECT level FROM l WHERE level <= 3 * source_size / w::double ORDER BY 3 * source_size / w::double, source NULLS LAST LIMIT 1)) AS target FROM l),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint AS epochs FROM t),
c AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id::varchar ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (least(3, epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::bigint AS taken
FROM c
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPERS}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT a AS v, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    packed = pack_documents(docs, tokenizer_path())
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op10_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn played as audio; queries are the turns of conversations divisible by 100."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.struct("conv_id", "turn").alias("id"), "text")
    prints = fingerprints(add_melody(turns, "text"))
    found = align(prints, prints.where("id.conv_id % 100 = 0"))
    best = found.groupBy(F.col("digest").alias("asked")).agg(F.count("*").alias("n_matches"), F.min(F.struct("bit_errors", "match", "offset")).alias("best"))
    return prints.join(best, F.col("digest") == F.col("asked"), "left").select(
        "id.conv_id", "id.turn", F.size("items").cast("long").alias("n_items"), "items_crc32", F.col("class_id.conv_id").alias("class_conv_id"), F.col("class_id.turn").alias("class_turn"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.col("best.match.conv_id").alias("match_conv_id"), F.col("best.match.turn").alias("match_turn"),
        F.col("best.offset").cast("long").alias("match_offset"), F.col("best.bit_errors").alias("bit_errors"),
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user, by a hash of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("kind")
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    repair = ConversationRepair(damaged(turns))
    plans = repair.plans()
    digests = repair.digests(repair.repaired(plans)).withColumnRenamed("conv_id", "digest_of")
    found = plans.join(digests, F.col("conv_id").eqNullSafe(F.col("digest_of")), "left").withColumnRenamed("conv_id", "found")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repetitive(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a hash of the id, with a period of their words repeated from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    n = word_count(F.col("text"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, n).otherwise(0).alias("n"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    words = words_of(F.col("text"))
    whole = F.slice(words, 1, F.col("a").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (F.col("a") + 1).cast("int"), F.col("p").cast("int")), times))
    text = F.array_join(F.concat(whole, F.slice(tail, 1, (F.col("n") - F.col("a")).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repetitive(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic_runs(docs, keep_text=False)
    # greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_line_dedup": op5_line_dedup,
        "op6_mix_sources": op6_mix_sources,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_lm_score": op8_lm_score,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_audio_fingerprint": op10_audio_fingerprint,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _op1_sql(), "op4_quality_rules": _op4_sql(), "op5_line_dedup": OP5_SQL, "op6_mix_sources": OP6_SQL, "op7_jaccard_join": OP7_SQL}
