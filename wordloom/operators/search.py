"""Search: every occurrence of every query, with offsets into the original text and snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import SPACES, fold, full_fold, nfkc, normalise_text
from wordloom.sources.store import stored

#: As many folded queries at most are literals of one pass over the blocks; more of them meet the blocks under n-grams.
MOST_QUERIES = 256
#: Characters of an n-gram; queries of two characters have one of two.
GRAM = 3
_UNIT = "array<struct<character:string,start:int,end:int>>"


def offset_map(text: Column) -> Column:
    """A text's characters, each folded by itself, with where each one starts and ends in it; a run of blanks is one.

    A character that folds to several has the same place for each of them. No array is read in place of another's element,
    so a text costs what its length costs.
    """
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    folded = F.transform(characters, lambda c, i: F.struct(F.split(full_fold(nfkc(c)), "").alias("parts"), i.alias("at")))
    each = F.flatten(F.transform(folded, lambda f: F.transform(f["parts"], lambda c: F.struct(F.when(F.contains(F.lit(SPACES), c), " ").otherwise(c).alias("character"), f["at"].alias("at")))))
    # beside each one the one before it; where a run of blanks begins, and where it ends, is told by its neighbour alone
    nothing = F.array(F.struct(F.lit("").alias("character"), F.lit(-1).alias("at")))
    beside = lambda left, right: F.filter(F.zip_with(left, right, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: ~((z["x"]["character"] == " ") & (z["y"]["character"] == " ")))
    pairs = beside(F.concat(nothing, each), F.concat(each, nothing))
    starts = F.filter(F.transform(pairs, lambda z: z["y"]), lambda y: y["at"] >= 0)
    ends = F.filter(F.transform(pairs, lambda z: z["x"]), lambda x: x["at"] >= 0)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["character"].alias("character"), a["at"].cast("int").alias("start"), (b["at"] + 1).cast("int").alias("end"))).cast(_UNIT)


def is_steady(text: Column) -> Column:
    """Text that folding leaves in place: ASCII without runs of blanks or blanks at its ends."""
    return text.rlike(r"^[\x21-\x7E][\x20-\x7E]*$") & ~text.contains("  ") & ~text.endswith(" ")


def places(folded: Column, needle: Column) -> Column:
    """Where a needle stands in a folded text, left to right and not overlapping, counted from 0.

    Folded text has no tabs, so one is put before every hit; the k-th tab stands k characters further on than its hit.
    """
    marked = F.split(F.replace(folded, needle, F.concat(F.lit("\t"), needle)), "")
    tabs = F.filter(F.transform(marked, lambda c, i: F.when(c == "\t", i)), lambda i: i.isNotNull())
    return F.transform(tabs, lambda i, k: i - k)


def occurrences(text: Column, units: Column, needle: Column) -> Column:
    """Non-overlapping places (start, end) of a folded query: in the text's map of offsets, or where that is null in the text."""
    folded = F.coalesce(F.array_join(F.transform(units, lambda u: u["character"]), ""), F.lower(text))
    first, last = lambda i: F.get(units, i)["start"], lambda i: F.get(units, i + F.length(needle) - 1)["end"]
    found = F.transform(places(folded, needle), lambda i: F.struct(F.coalesce(first(i), i).alias("start"), F.coalesce(last(i), i + F.length(needle)).alias("end")))
    return found.cast("array<struct<start:int,end:int>>")


def snippet(text: Column, start: Column, end: Column, radius: int = 72) -> Column:
    """What stands before and after a hit, at most ``radius`` characters, cut at blanks, with marks where it is cut."""
    n = F.length(text)
    lo, hi = F.greatest(F.lit(0), start - radius), F.least(n, end + radius)
    before, after = F.substr(text, lo + 1, start - lo), F.substr(text, end + 1, hi - end)
    first, last = F.instr(before, " "), F.length(after) - F.instr(F.reverse(after), " ")
    b = F.when((lo > 0) & (first > 0), F.substr(before, first + 1)).otherwise(before)
    a = F.when((hi < n) & (F.instr(after, " ") > 0), F.substr(after, F.lit(1), last)).otherwise(after)
    cut_l = (lo > 0) | (F.length(b) < start)
    cut_r = (hi < n) | (F.length(a) < n - end)
    return F.struct(F.concat(F.when(cut_l, "…").otherwise(""), b).alias("before"), F.substr(text, start + 1, end - start).alias("match"), F.concat(a, F.when(cut_r, "…").otherwise("")).alias("after"))


def _grams(text: Column, size: int) -> Column:
    """The distinct n-grams of a text: its characters beside those that follow them."""
    characters = F.split(text, "")
    beside = F.arrays_zip(*(F.slice(characters, k + 1, F.greatest(F.size(characters) - size + 1, F.lit(0))).alias(f"c{k}") for k in range(size)))
    return F.array_distinct(F.transform(beside, lambda g: F.concat(*(g[f"c{k}"] for k in range(size)))))


def _met_by_literals(blocks: DataFrame, asked: list[str]) -> DataFrame:
    """Blocks with the queries that their normal form contains, in one pass without a join."""
    pairs = sorted((q, n) for q in asked if len(n := fold(q)) >= 2)
    literals = F.array(*(F.struct(F.lit(q).alias("query"), F.lit(n).alias("needle")) for q, n in pairs)) if pairs else F.array().cast("array<struct<query:string,needle:string>>")
    met = blocks.withColumn("_q", F.explode(F.filter(literals, lambda q: F.contains(F.col("normalized_text"), q["needle"]))))
    return met.select("_q.query", "_q.needle", *_BLOCK)


def _met_by_grams(blocks: DataFrame, needles: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks with the needles (query, needle) in their normal form: a needle meets the blocks that hold its rarest n-gram,
    and is verified.

    Only n-grams of needles leave a block, and only chosen ones are shuffled with its text. Counting them is one more pass,
    and combines within tasks. A block meets a needle once, as its n-grams are distinct.
    """
    size = F.least(F.length("needle"), F.lit(GRAM))
    met = []
    for k in range(2, GRAM + 1):
        own = needles.where(size == k)
        if own.isEmpty():
            continue
        grams = own.select("query", "needle", F.explode(_grams(F.col("needle"), k)).alias("gram"))
        wanted = grams.select("gram").distinct()
        held = blocks.select(F.explode(_grams(F.col("normalized_text"), k)).alias("gram"))
        often = held.join(wanted, "gram").groupBy("gram").agg(F.count("*").alias("n"))
        # a needle with an n-gram that no block has is found nowhere
        counted = grams.join(often, "gram", "left").groupBy("query", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        chosen = stored(counted.where("rarest.n > 0").select("query", "needle", F.col("rarest.gram").alias("gram")))
        postings = blocks.select(*dict.fromkeys((*columns, "normalized_text")), F.explode(_grams(F.col("normalized_text"), k)).alias("gram"))
        met.append(postings.join(chosen, "gram").where(F.contains("normalized_text", F.col("needle"))).select("query", "needle", *columns))
    none = blocks.select(F.lit("").alias("query"), F.lit("").alias("needle"), *columns).limit(0)
    return reduce(DataFrame.unionByName, met) if met else none


def _met_by_words(blocks: DataFrame, needles: DataFrame) -> DataFrame:
    """The same for needles without a blank, which stand within a word: they are looked for among the different words, and
    the words that hold one lead to the blocks. A block meets a needle by its first word that holds it."""
    words = F.filter(F.split("normalized_text", " "), lambda w: F.length(w) >= 2)
    different = stored(blocks.select(F.explode(words).alias("normalized_text")).distinct())
    holding = stored(_met_by_grams(different, needles, ["normalized_text"]).withColumnRenamed("normalized_text", "word"))
    each = blocks.select(*_BLOCK, "normalized_text", F.explode(F.array_distinct(words)).alias("word")).join(holding, "word")
    first = F.get(F.filter(F.split("normalized_text", " "), lambda w: F.contains(w, F.col("needle"))), F.lit(0))
    return each.where(first == F.col("word")).select("query", "needle", *_BLOCK)


def _met_by_table(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks with the queries of a table of any size that their normal form contains."""
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    needles = stored(asked.select("query", normalise_text(F.col("query")).alias("needle")).where(F.length("needle") >= 2))
    one = ~F.contains("needle", F.lit(" "))
    met = _met_by_grams(blocks, needles.where(~one), list(_BLOCK))
    return met if needles.where(one).isEmpty() else met.unionByName(_met_by_words(blocks, needles.where(one)))


_BLOCK = ("set_id", "doc_id", "name", "element_id", "ordinal", "text")


def search(blocks: DataFrame, queries: DataFrame, radius: int = 72, literals: int = MOST_QUERIES) -> DataFrame:
    """(query, text) hits of all queries in all blocks, numbered in each block from 1.

    Queries are folded first; shorter than two characters they find nothing. They are taken word for word, in any number:
    up to ``literals`` of them are looked for in one pass over the blocks, more are joined by the words that hold them, or by
    their rarest n-gram if they have several words. Both look in the normal form. Only blocks found there are searched for
    places; plain text needs no map of offsets for it.
    """
    asked = [r["query"] for r in queries.select("query").where("query IS NOT NULL").distinct().limit(literals + 1).collect()]
    return _hits(_met_by_literals(blocks, asked) if len(asked) <= literals else _met_by_table(blocks, queries), radius)


def _hits(met: DataFrame, radius: int) -> DataFrame:
    """Every place of a query in each block that holds it."""
    mapped = met.withColumn("_units", F.when(~is_steady(F.col("text")), offset_map(F.col("text"))))
    found = occurrences(F.col("text"), F.col("_units"), F.col("needle"))
    hits = mapped.select("query", "set_id", "doc_id", "name", "element_id", "ordinal", "text", F.posexplode(found).alias("at", "hit"))
    return hits.select("query", "set_id", "doc_id", "name", "element_id", "ordinal", (F.col("at") + 1).alias("occurrence"), "hit.start", "hit.end", snippet(F.col("text"), F.col("hit.start"), F.col("hit.end"), radius).alias("snippet"))


def search_counts(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Per query: all hits, documents hit, and whether a page of ``limit`` leaves some out."""
    out = hits.groupBy("query").agg(F.count("*").alias("total"), F.countDistinct("doc_id").alias("documents"))
    return out.withColumn("truncated", F.col("total") > limit if limit else F.lit(False))


def search_page(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits by document name, ordinal and occurrence."""
    return hits.orderBy(F.lower("name"), "ordinal", "occurrence").limit(limit)


def first_page(blocks: DataFrame, query: str, limit: int, radius: int = 72) -> DataFrame:
    """The same for one query, without the other blocks' places: hits go block by block, so those of the first blocks that
    hold the query make the page. Should some of them have no place for it, more blocks are taken."""
    taken = limit
    while True:
        met = stored(_met_by_literals(blocks, [query]).orderBy(F.lower("name"), "ordinal").limit(taken))
        page = search_page(_hits(met, radius), limit)
        if met.count() < taken or page.count() >= limit:
            return page
        taken *= 8
