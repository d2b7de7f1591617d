"""URL filters: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from importlib import resources
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import LOWER, UPPER, ascii_lower, named, replaced



def read_terms() -> tuple[tuple[str, ...], dict[str, float]]:
    """The vocabulary file beside this module: strict terms, and soft ones with their weights."""
    strict, soft = [], {}
    with resources.files(__package__).joinpath("url_terms.csv").open(encoding="utf-8") as f:
        for row in csv.DictReader(f):
            if row["kind"] == "strict":
                strict.append(row["term"])
            else:
                soft[row["term"]] = float(row["weight"])
    return tuple(strict), soft


#: One strict hit rejects. A url also goes if several distinct soft ones reach the limit together.
STRICT_TERMS, SOFT_TERMS = read_terms()
SOFT_LIMIT = 2.0


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _counter(strict: tuple[str, ...], soft: dict[str, float]):
    """A pandas UDF: url -> distinct strict terms, distinct soft terms and the weight of the soft ones."""

    @F.pandas_udf("n_strict int, n_soft int, soft_weight double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in [*soft, *strict]:  # a term in both lists is strict
            automaton.add_word(term, term)
        automaton.make_automaton()
        lower, bounded = str.maketrans(UPPER, LOWER), frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        firm = frozenset(strict)
        for urls in batches:
            rows = []
            for url in urls:
                text, found = unquote(url or "").translate(lower), set()
                for end, term in automaton.iter(text):
                    start = end - len(term)
                    if (start < 0 or text[start] not in bounded) and (end + 1 == len(text) or text[end + 1] not in bounded):
                        found.add(term)
                gentle = found - firm
                rows.append((len(found & firm), len(gentle), float(sum(soft[x] for x in gentle))))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight"])

    return count


def url_filter(
    pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", strict: tuple[str, ...] = STRICT_TERMS, soft: dict[str, float] | None = None, soft_limit: float = SOFT_LIMIT, min_soft: int = 2
) -> DataFrame:
    """Append host, path, rule, verdict and the vocabulary's counts to every row.

    ``rules`` lists (allow or block, host/path); a rule fits its host and all subdomains if the path starts with the
    rule's, and the longest that fits decides. Where none fits, the vocabulary does: a url is blocked on one strict term,
    or on at least ``min_soft`` distinct soft terms whose weights reach ``soft_limit``. A term counts only between
    characters that are no ASCII letters or digits.

    Percent-encoded characters count as what they stand for in the vocabulary's part; malformed ones stay as they are.

    A null url has empty host and path, no term, and is allowed. Of rules with one text the last one counts. Repeated rows
    get equal results; columns with the names appended here are replaced where they stand, the url's own among them, and
    other names can't clash; a url of any length is taken whole; an empty table gives an empty table. No row leaves its
    partition.
    """
    soft = SOFT_TERMS if soft is None else soft
    out = pages.select(F.struct(*(named(c) for c in pages.columns)).alias("row"), F.col(url_col).alias("url"))
    out = out.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule, decided = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    out = out.withColumn("rule", rule).withColumn("decided", decided).withColumn("terms", _counter(strict, soft)(F.col("url")))
    bad = (F.col("terms.n_strict") > 0) | ((F.col("terms.n_soft") >= min_soft) & (F.col("terms.soft_weight") >= soft_limit))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("decided", F.when(bad, "block").otherwise("allow"))}
    new |= {k: F.col(f"terms.{k}") for k in ("n_strict", "n_soft", "soft_weight")}
    return out.select(*replaced(F.col("row"), pages.columns, new))
