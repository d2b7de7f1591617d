"""Blocks on pages: alignment with positioned words, line boxes, pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.sources.store import stored


def word_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


#: Where on a page, as shares of its height, the middle of a header's, a footer's and other wording may be.
HEADER_ZONE, FOOTER_ZONE, BODY_ZONE = 0.28, 0.72, (0.055, 0.955)


def in_zone(element_type: Column, header_footer_type: Column, middle: Column, page: Column) -> Column:
    """Wording of this type can stand at this height of this page (pages count from 1)."""
    height = F.when(element_type == "header_paragraph", middle <= HEADER_ZONE).when(element_type == "footer_paragraph", middle >= FOOTER_ZONE).otherwise(middle.between(*BODY_ZONE))
    kind = F.coalesce(header_footer_type, F.lit(""))
    return height & F.when(kind.startswith("first_page_"), page == 1).when(kind.startswith("even_page_"), page % 2 == 0).otherwise(True)


def _wording(phrase: Column) -> dict[str, Column]:
    """128 bits that stand for a phrase where only its equality counts."""
    return {"phrase0": F.xxhash64(phrase), "phrase1": F.xxhash64(F.lit(20), phrase)}


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with tokens and phrase; a header_footer_type where there is none yet."""
    b = blocks if "header_footer_type" in blocks.columns else blocks.withColumn("header_footer_type", F.lit(""))
    b = b.withColumn("tokens", word_tokens(F.col("normalized_text"))).withColumn("n", F.size("tokens")).where("n > 0")
    return b.withColumn("header_footer_type", F.coalesce("header_footer_type", F.lit(""))).withColumn("phrase", F.array_join("tokens", " ")).withColumns(_wording(F.col("phrase")))


#: Fixed primes and bases of the two hashes of a run of words.
_PRIMES, _BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)


def _code(word: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(_PRIMES[k]))


def _power(base: int, exponent: Column, prime: int) -> Column:
    """base ** exponent modulo a prime, exponents below 2 ** 24: a small table of powers for each of its hex digits, so that
    plans stay small."""
    out = None
    for shift in range(0, 24, 4):
        powers = F.expr("array(" + ", ".join(f"{pow(base, digit << shift, prime)}L" for digit in range(16)) + ")")
        factor = F.get(powers, F.shiftright(exponent, shift).bitwiseAND(F.lit(15)).cast("int"))
        out = factor if out is None else out * factor % prime
    return out


def _spelled(tokens: Column, k: int) -> Column:
    """The hash of a block's words: each by its code, times the base for every word before it."""
    return F.aggregate(F.reverse(tokens), F.lit(0).cast("long"), lambda h, w: (h * _BASES[k] + _code(w, k)) % _PRIMES[k])


def _own(place: Column) -> dict[str, Column]:
    return {f"own{k}": _code(F.col("token"), k) * _power(_BASES[k], place, _PRIMES[k]) % _PRIMES[k] for k in (0, 1)}


def _hashed_words(words: DataFrame) -> DataFrame:
    """Words with their places on the page and, for each hash, the sum of all words of the page up to them."""
    by_page = W.partitionBy("version_id", "page").orderBy("seq")
    w = words.withColumn("token", F.lower("text")).withColumn("place", (F.row_number().over(by_page) - 1).cast("long"))
    w = w.withColumn("starts", ~F.col("line").eqNullSafe(F.lag("line").over(by_page))).withColumn("ends", ~F.col("line").eqNullSafe(F.lead("line").over(by_page)))
    w = w.withColumns(_own(F.col("place")))
    return w.withColumns({f"upto{k}": F.sum(f"own{k}").over(by_page.rowsBetween(W.unboundedPreceding, 0)) for k in (0, 1)})


def _lines(words: DataFrame, **more: Column) -> DataFrame:
    """A row for each line of a page: its first and last word (lo, hi) and more aggregates. ``loose`` pages are those whose
    words aren't numbered from 0 without gaps, line by line, so that a line isn't all words from lo to hi."""
    each = words.groupBy("version_id", "page", "line").agg(F.min("seq").cast("long").alias("lo"), F.max("seq").cast("long").alias("hi"), F.count("*").alias("n_words"), *(v.alias(k) for k, v in more.items()))
    page = W.partitionBy("version_id", "page")
    follows = (F.col("lo") == F.coalesce(F.lag("hi").over(page.orderBy("lo")) + 1, F.lit(0))) & (F.col("n_words") == F.col("hi") - F.col("lo") + 1)
    return each.withColumn("_bad", ~F.coalesce(follows, F.lit(False))).withColumn("loose", F.max("_bad").over(page)).drop("_bad", "n_words")


def _ends_of_lines(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beginnings and ends of lines with the prefix sums of both hashes there.

    Words are added up line by line, and lines within their page; only words of loose pages are put in order one by one.
    """
    by_seq = {"top": F.min_by("y0", "seq"), "bottom": F.max_by("y1", "seq"), "page_height": F.min_by("page_height", "seq"), "first": F.min_by("code", "seq")}
    w = words.withColumn("token", F.lower("text")).withColumn("code", F.xxhash64("token")).withColumns(_own(F.col("seq").cast("long")))
    lines = _lines(w, **by_seq, **{f"sum{k}": F.sum(f"own{k}") for k in (0, 1)})
    before = W.partitionBy("version_id", "page").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    lines = stored(lines.withColumns({f"before{k}": F.coalesce(F.sum(f"sum{k}").over(before), F.lit(0)) for k in (0, 1)}))
    neat = lines.where("NOT loose")
    heads = neat.select("version_id", "page", F.col("lo").alias("seq"), F.col("lo").alias("place"), "top", "page_height", "first", "before0", "before1")
    tails = neat.select("version_id", "page", F.col("hi").alias("last"), "bottom", *((F.col(f"before{k}") + F.col(f"sum{k}")).alias(f"upto{k}") for k in (0, 1)))
    loose = lines.where("loose").select("version_id", "page").distinct()
    if loose.isEmpty():
        return heads, tails
    w = _hashed_words(_on_pages(words, loose))
    sums = {f"before{k}": F.col(f"upto{k}") - F.col(f"own{k}") for k in (0, 1)}
    more = w.where("starts").withColumns(sums).select("version_id", "page", F.col("seq").cast("long").alias("seq"), "place", F.col("y0").alias("top"), "page_height", F.xxhash64("token").alias("first"), "before0", "before1")
    return heads.unionByName(more), tails.unionByName(w.where("ends").select("version_id", "page", F.col("place").alias("last"), F.col("y1").alias("bottom"), "upto0", "upto1"))


def _on_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    p = pages.select(F.col("version_id").alias("_v"), F.col("page").alias("_p"))
    return words.join(p, F.col("version_id").eqNullSafe(F.col("_v")) & F.col("page").eqNullSafe(F.col("_p")), "left_semi")


def align_phrases(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Runs of a page's words that spell a block, begin and end at line boundaries, and stand where its type may.

    blocks: version_id, element_id, ordinal, element_type, normalized_text; words: version_id, page (1..), seq (0.. without
    gaps), line, text, y0, y1, page_height. A run is two numbers, the difference of its ends' prefix hashes brought back to
    the page's first place; runs from a line's beginning to a line's end that begin with the first word of some block of the
    version, and are as long, meet the blocks by equality of version, length and both numbers, which tells words apart by
    62 bits within a version. No array of a page's words is made, and only lines are shuffled. Pages have less than 2 ** 24
    words.
    """
    b = _placed(blocks).withColumns({f"h{k}": _spelled(F.col("tokens"), k) for k in (0, 1)}).withColumn("first", F.xxhash64(F.col("tokens")[0]))
    heads, tails = _ends_of_lines(words)
    lengths = b.select("version_id", "first", "n").distinct()
    runs = heads.join(lengths, ["version_id", "first"]).drop("first").withColumn("last", F.col("place") + F.col("n") - 1).join(tails, ["version_id", "page", "last"])
    back = lambda k: _power(pow(_BASES[k], -1, _PRIMES[k]), F.col("place"), _PRIMES[k])
    runs = runs.withColumns({f"h{k}": (F.col(f"upto{k}") - F.col(f"before{k}")) % _PRIMES[k] * back(k) % _PRIMES[k] for k in (0, 1)})
    met = runs.drop("place", "last", "before0", "before1", "upto0", "upto1").join(b, ["version_id", "n", "h0", "h1"])
    allowed = in_zone(F.col("element_type"), F.col("header_footer_type"), (F.col("top") + F.col("bottom")) / 2 / F.col("page_height"), F.col("page"))
    return met.where(allowed).select("version_id", "element_id", "ordinal", "element_type", "header_footer_type", "page", F.col("seq").cast(words.schema["seq"].dataType).alias("seq"), "n", "phrase", "phrase0", "phrase1")


def resolve_ambiguity(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Which runs belong to which block: a row for each run that does, and one with a reason for a block without any.

    Blocks of a version with equal wording, type and header or footer type are a group. A header or footer that is alone
    in it has all runs (.97); else one run goes to one block (.99) and as many runs as blocks go in order (.95). Runs that
    share a word with another block's run go afterwards: then one of the two has the word that the other begins with, so
    runs are laid over the places where some run begins. Phrases stand as 128 bits.
    """
    g = ["version_id", "phrase0", "phrase1", "element_type", "header_footer_type"]
    candidates = candidates if "phrase0" in candidates.columns else candidates.withColumns(_wording(F.col("phrase")))
    b = _placed(blocks)
    owners = b.select(*g, "element_id", F.row_number().over(W.partitionBy(*g).orderBy("ordinal")).alias("k"), F.count("*").over(W.partitionBy(*g)).alias("n_blocks"))
    runs = candidates.select(*g, "page", "seq", "n").distinct()
    runs = runs.select(*g, "page", "seq", "n", F.row_number().over(W.partitionBy(*g).orderBy("page", "seq")).alias("run"), F.count("*").over(W.partitionBy(*g)).alias("n_runs"))
    repeated = F.col("element_type").isin("header_paragraph", "footer_paragraph") & (F.col("n_blocks") == 1)
    fits = owners.join(runs, g).where(repeated | ((F.col("n_blocks") == F.col("n_runs")) & (F.col("k") == F.col("run"))))
    fits = fits.withColumn("confidence", F.when(repeated, 0.97).when(F.col("n_blocks") == 1, 0.99).otherwise(0.95)).select("version_id", "element_id", "page", "seq", "n", "confidence")
    fits = stored(fits)
    run = ["version_id", "element_id", "page", "seq"]
    at = fits.select(*run, F.explode(F.array(F.struct(F.col("seq").cast("long").alias("at"), F.lit(0).alias("end")), F.struct((F.col("seq") + F.col("n") - 1).cast("long").alias("at"), F.lit(1).alias("end")))).alias("e")).select(*run, "e.*")
    by_page = W.partitionBy("version_id", "page").orderBy("at", "end")
    at = at.withColumn("new", ((F.col("end") == 0) & ~(F.lag(F.struct("at", "end")).over(by_page)).eqNullSafe(F.struct("at", "end"))).cast("int"))
    at = at.withColumn("place", F.sum("new").over(by_page.rowsBetween(W.unboundedPreceding, 0)))
    ends = at.groupBy(*run).agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    covered = ends.select(*run, F.explode(F.sequence("lo", "hi")).alias("place"))
    by_place = W.partitionBy("version_id", "page", "place")
    unsafe = covered.withColumn("e0", F.min("element_id").over(by_place)).withColumn("e1", F.max("element_id").over(by_place)).where("e0 < e1").select(*run).distinct()
    safe = fits.join(unsafe, ["version_id", "element_id", "page", "seq"], "left_anti")
    found = runs.groupBy(*g).agg(F.max("n_runs").alias("runs"))
    fitted = fits.select("version_id", "element_id").distinct().withColumn("fitted", F.lit(True))
    blocked = owners.join(found, g, "left").join(fitted, ["version_id", "element_id"], "left").select("version_id", "element_id", "runs", "fitted").join(safe, ["version_id", "element_id"], "left")
    why = F.when(F.col("runs").isNull(), "not_found").when(F.col("fitted").isNull(), "ambiguous").when(F.col("seq").isNull(), "overlap")
    return blocked.select("version_id", "element_id", "page", "seq", "n", "confidence", why.alias("reason"))


def line_boxes(matches: DataFrame, words: DataFrame, supported: DataFrame | None = None, threshold: float = 0.9) -> DataFrame:
    """One box for each line of a match, as shares of the page, clipped to it, 7 decimals.

    A box is interactive if the match's confidence reaches the threshold and its block (version_id, element_id,
    supported) can be edited; all can where no such table is given. Words become boxes line by line before they meet the
    matches.
    """
    m = matches.where("seq IS NOT NULL")
    able = F.col("confidence") >= threshold
    if supported is not None:
        m = m.join(supported.select("version_id", "element_id", "supported"), ["version_id", "element_id"], "left")
        able = able & F.coalesce("supported", F.lit(False))
    part = lambda v, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(v) / F.col(size))), 7)
    sides = {"x0": F.min(part("x0", "page_width")), "y0": F.min(part("y0", "page_height")), "x1": F.max(part("x1", "page_width")), "y1": F.max(part("y1", "page_height"))}
    page = ["version_id", "page"]
    lines = _lines(words, **sides).where("NOT loose").withColumn("number", F.row_number().over(W.partitionBy(*page).orderBy("lo")))
    lines = stored(lines.select(*page, "line", "number", "lo", "hi", *sides))
    m = m.select(*page, "element_id", "confidence", able.alias("interactive"), F.col("seq").cast("long").alias("lo"), (F.col("seq") + F.col("n") - 1).cast("long").alias("hi"))
    m = m.join(lines.select(*page, "lo", F.col("number").alias("first")), [*page, "lo"], "left").join(lines.select(*page, "hi", F.col("number").alias("last")), [*page, "hi"], "left")
    m = stored(m.withColumn("whole", F.coalesce(F.col("first") <= F.col("last"), F.lit(False))))
    keep = [*page, "element_id", "confidence", "interactive"]
    boxed = m.where("whole").select(*keep, F.explode(F.sequence("first", "last")).alias("number")).join(lines, [*page, "number"]).select(*keep, "line", *sides)
    cut = m.where("NOT whole")
    if not cut.isEmpty():
        # matches that begin or end within a line meet their words one by one
        each = words.join(cut.select(*keep, F.explode(F.sequence("lo", "hi")).alias("seq")), [*page, "seq"])
        boxed = boxed.unionByName(each.groupBy(*keep, "line").agg(*(v.alias(k) for k, v in sides.items())))
    return boxed.groupBy("version_id", "element_id", "page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("confidence").alias("confidence"), F.max("interactive").alias("interactive"))


def mapping_coverage(matches: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Per version: blocks mapped, interactive (with boxes), all, and completed, partial or failed."""
    blocks = matches.groupBy("version_id", "element_id").agg(F.max(F.col("reason").isNull().cast("int")).alias("mapped"))
    if boxes is not None:
        able = boxes.where("interactive").select("version_id", "element_id").distinct().withColumn("able", F.lit(1))
        blocks = blocks.join(able, ["version_id", "element_id"], "left")
    interactive = [F.count("able").alias("interactive")] if boxes is not None else []
    out = blocks.groupBy("version_id").agg(F.sum("mapped").alias("mapped"), *interactive, F.count("*").alias("total"))
    return out.withColumn("status", F.when(F.col("mapped") == 0, "failed").when(F.col("mapped") < F.col("total"), "partial").otherwise("completed"))


def paginate(blocks: DataFrame, key: list[str], order: str, units: str, capacity: int = 18) -> DataFrame:
    """Greedy pages: a block opens a new one if it doesn't fit any more; what a page holds first always fits.

    Every block gets a pointer to the block that would open the next page if it opened one itself, found among the prefix
    sums of units. Pages are the blocks that pointers reach from the first one, with distances doubling, so a document of p
    pages takes about log2(p) joins for all documents at once; steps are written. No document is gathered: its rows are
    sorted, which spills. Null keys are keys, orders are unique within them; units are 0 at least, null ones are 0.
    """
    by = W.partitionBy("k").orderBy("o")
    rows = blocks.select(F.struct(*key).alias("k"), F.col(order).cast("bigint").alias("o"), F.coalesce(F.col(units).cast("bigint"), F.lit(0)).alias("u"))
    rows = stored(rows.withColumn("upto", F.sum("u").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.lead("o").over(by)))
    # a page that opens here is full at the first block whose sum is above this; of equal numbers the question comes first
    asks = rows.select("k", "o", (F.col("upto") - F.col("u") + capacity).alias("at"), F.lit(0).alias("kind"))
    marks = asks.unionByName(rows.select("k", "o", F.col("upto").alias("at"), F.lit(1).alias("kind")))
    down = W.partitionBy("k").orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0)
    full = marks.withColumn("full", F.min(F.when(F.col("kind") == 1, F.col("o"))).over(down)).where("kind = 0 AND full IS NOT NULL").select("k", "o", "full")
    # and not before a block that takes room stands on it
    back = W.partitionBy("k").orderBy(F.desc("o")).rowsBetween(W.unboundedPreceding, 0)
    begun = rows.select("k", "o", F.last(F.when(F.col("u") > 0, F.struct("after")), ignorenulls=True).over(back)["after"].alias("begun")).where("begun IS NOT NULL")
    jump = stored(full.join(begun, ["k", "o"]).select("k", "o", F.greatest("full", "begun").alias("next")))
    reached = stored(rows.groupBy("k").agg(F.min("o").alias("o")))
    known = reached.count()
    while True:
        reached = stored(reached.unionByName(reached.join(jump, ["k", "o"]).select("k", F.col("next").alias("o"))).distinct())
        if (now := reached.count()) == known:
            break
        known = now
        far = jump.select("k", F.col("o").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(far, ["k", "next"]).select("k", "o", F.col("far").alias("next")))
    opened = rows.select("k", "o").join(reached.withColumn("opens", F.lit(1)), ["k", "o"], "left")
    page = F.sum(F.coalesce("opens", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return opened.select(*(F.col(f"k.{c}").alias(c) for c in key), F.col("o").alias(order), page.alias("page"))


def header_footer_usages(sections: DataFrame) -> DataFrame:
    """Which part each section shows: its own, or the last earlier one's of that kind and variant; one row for a part.

    sections: doc_id, section_index, kind, variant, relationship_id (null: as before).
    """
    w = W.partitionBy("doc_id", "kind", "variant").orderBy("section_index").rowsBetween(W.unboundedPreceding, 0)
    filled = sections.withColumn("part", F.last("relationship_id", ignorenulls=True).over(w)).where("part IS NOT NULL")
    return filled.groupBy("doc_id", "part").agg(F.min(F.struct("section_index", "kind", "variant")).alias("canonical"), F.sort_array(F.collect_set("section_index")).alias("section_indexes")).select("doc_id", "part", "canonical.*", "section_indexes")
