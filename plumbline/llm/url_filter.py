"""URL filters: host and path rules first, then a weighted vocabulary found by one Aho-Corasick automaton.

A term counts where it stands alone: neither a letter nor a digit before or after it. One strict term rejects a url,
as do two or more different soft terms whose weights reach the limit; repeats of a soft term count once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER

STRICT = ("adult", "casino", "escort", "hentai", "porn", "sex", "spam", "viagra", "warez", "xxx")
SOFT = {"ads": 1.0, "bet": 1.0, "bets": 1.0, "bonus": 0.5, "cheap": 1.0, "click": 0.5, "deal": 0.5, "farm": 0.5, "free": 1.0,
        "lottery": 1.0, "pills": 1.0, "poker": 1.0, "prize": 1.0, "slots": 1.0, "track": 1.0, "win": 1.0}
LIMIT = 2.0
#: (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    found = []
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def term_finder(strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT):
    """A vectorised function of lower-cased urls: struct(strict, soft), the different terms found, sorted."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict array<string>, soft array<string>")
    def find(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for t in {*strict, *soft}:
            machine.add_word(t, t)
        if len(machine):
            machine.make_automaton()
        hard = set(strict)
        for batch in urls:
            rows = []
            for u in batch:
                found = set()
                for end, t in machine.iter(u) if len(machine) else ():
                    around = u[end - len(t) : end - len(t) + 1] if end >= len(t) else "", u[end + 1 : end + 2]
                    if not any(c.isascii() and c.isalnum() for c in around):
                        found.add(t)
                rows.append((sorted(found & hard), sorted(found - hard)))
            yield pd.DataFrame(rows, columns=["strict", "soft"])
    return find


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict (allow or block), strict_terms, soft_terms.

    A fitting rule decides, else the vocabulary. A null url, or one without ``://``, has empty host and path; a null
    one holds no terms and is allowed. A term listed as strict and soft is strict. Rows are judged alone, so repeats get
    equal verdicts; an empty table gives an empty result; other columns are not read.
    """
    u = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    u = u.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn(
        "terms", term_finder(strict, soft)(F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)))
    weights = F.create_map(*[F.lit(x) for kv in soft.items() for x in kv]) if soft else F.create_map().cast("map<string,double>")
    weight = F.aggregate("terms.soft", F.lit(0.0), lambda s, t: s + F.element_at(weights, t))
    bad = (F.size("terms.strict") > 0) | ((F.size("terms.soft") > 1) & (weight >= limit))
    return u.select(F.col("id").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce("fit.verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    F.col("terms.strict").alias("strict_terms"), F.col("terms.soft").alias("soft_terms"))
