"""URL filter: rules for hosts and paths, else a weighted vocabulary.

The vocabulary has strict terms, one of which is enough to block, and soft terms, of which
several different ones are needed. One pass of an Aho-Corasick automaton over the lower-cased
url finds all of them; a hit counts only if no ASCII letter or digit touches it.

Edge cases. A null url, or one without ``://``, has an empty host and path, fits no rule, and
is judged by its terms (null: allowed). Repeated rows are judged alike. Empty tables and
vocabularies are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.llm.text import ascii_lower

# Fixed values.
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "malware", "warez", "pills")
SOFT = ("cheap", "free", "bets", "bet", "win", "spam", "farm", "adult", "loan", "loans", "poker",
        "slots", "jackpot", "cracked", "torrent", "nude", "gambling", "payday")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")),
                  ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")),
                  F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule that fits, else null."""
    found: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def term_hits(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A function of url to the numbers of strict hits and of different soft terms."""
    @F.pandas_udf("strict_hits int, soft_terms int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        kinds = {term.lower(): "soft" for term in soft} | {term.lower(): "strict" for term in strict}
        for term, kind in kinds.items():
            automaton.add_word(term, (term, kind))
        if kinds:
            automaton.make_automaton()
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for urls in batches:
            rows = []
            for url in urls:
                hard, mild = 0, set()
                if url and kinds:
                    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url) if not url.isascii() else url.lower()
                    for end, (term, kind) in automaton.iter(text):
                        start = end - len(term) + 1
                        if (start and text[start - 1] in word) or (end + 1 < len(text) and text[end + 1] in word):
                            continue
                        if kind == "strict":
                            hard += 1
                        else:
                            mild.add(term)
                rows.append((hard, len(mild)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_terms"])
    return count


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT,
          soft: tuple[str, ...] = SOFT, soft_limit: int = 2, page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_hits, soft_terms`` of every page."""
    link = F.col(url).cast("string")
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"),
                         term_hits(strict, soft)(link).alias("_terms"))
    ruled = parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"))
    by_rule: Column = F.lit(None).cast("string")
    for rule in rules:
        by_rule = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(by_rule)
    by_terms = F.when((F.col("_terms.strict_hits") >= 1) | (F.col("_terms.soft_terms") >= soft_limit),
                      F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_terms).alias("verdict"),
                        F.col("_terms.strict_hits").alias("strict_hits"),
                        F.col("_terms.soft_terms").alias("soft_terms"))
