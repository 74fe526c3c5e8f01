"""URL rules found through their rarest literal token, in DataFrame operations only.

Each rule is a regular expression with the literal tokens that any matching URL must contain.
The rule is filed under the one of them that the fewest URLs hold; a URL fetches the rules filed
under its own tokens, and only those run their expression.

Distinct URLs are judged once and joined back, so a URL with a third of all rows costs one.  A
null or empty URL fits no rule.  Rows that repeat are judged alike, and a URL of any length is judged whole.  An
empty table gives no rows.  Other columns are kept out of the way.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.llm.common import LOWER, UPPER
from fieldform.scale import materialize

# A rule table up to this size is sent to every task; a larger one is joined by token.
BROADCAST_RULES = 10_000
TOKEN_BREAK = "[^A-Za-z0-9]+"
# Java spelling of the parts of a URL: host after the first ``://``, path up to ? or #.
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on the lower-cased host followed by the rest of the URL."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    # Site rules decide before patterns; among either, the longer wins, then the smaller name.
    site: bool = False


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains and a path prefix.  A prefix may end inside a token, which is then no token."""
    tokens = [t for t in re.split(TOKEN_BREAK, host) if t]
    tokens += [t for t in re.split(TOKEN_BREAK, path)[:-1] if t]
    quoted = "".join(c if c.isalnum() or c in "_/-" else "\\" + c for c in host + path)
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{quoted}", tuple(dict.fromkeys(tokens)), True)


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, verdict, pattern, tokens)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", *, id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, pattern``.

    ``rule`` is the longest fitting site rule.  Without one, the longest fitting pattern rule
    decides, named in ``pattern``; without either, ``default``.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    after = F.translate(F.regexp_extract("url", HOST, 1), UPPER, LOWER)
    rest = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)$", 1)
    seen = rows.where("url is not null").select("url").distinct().select("url", F.concat(after, rest).alias("target"))
    words = materialize(seen.select("url", "target", F.array_distinct(F.split("target", TOKEN_BREAK)).alias("tokens")), "urls")
    schema = "name string, verdict string, expression string, site boolean, tokens array<string>"
    listed = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.site, list(r.tokens)) for r in rules], schema)
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)

    # How many URLs hold each literal; counted over all of them, combined before the shuffle.
    literal = listed.select(F.explode("tokens").alias("token")).distinct()
    held = words.select(F.explode("tokens").alias("token")).join(hint(literal), "token").groupBy("token").agg(F.count("*").alias("held"))
    filed = (
        listed.select("name", "verdict", "expression", "site", F.explode_outer("tokens").alias("token"))
        .join(held, "token", "left")
        .groupBy("name", "verdict", "expression", "site")
        .agg(F.min(F.struct(F.coalesce("held", F.lit(0)), "token")).alias("rarest"))
        # A rule without literals is filed under the empty token, which every URL fetches.
        .select("name", "verdict", "expression", "site", F.coalesce("rarest.token", F.lit("")).alias("token"))
    )
    fetch = words.select("url", "target", F.explode(F.array_union("tokens", F.array(F.lit("")))).alias("token"))
    fits = fetch.join(hint(filed), "token").where(F.expr("target rlike expression"))
    order = F.struct(F.length("name").alias("size"), "name", "verdict")
    best = fits.groupBy("url").agg(F.max(F.when(F.col("site"), order)).alias("by_site"), F.max(F.when(~F.col("site"), order)).alias("by_pattern"))
    return rows.join(best, "url", "left").select(
        "page_id",
        F.coalesce(F.translate(F.regexp_extract("url", HOST, 1), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")).alias("path"),
        F.col("by_site.name").alias("rule"),
        F.coalesce("by_site.verdict", "by_pattern.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("by_site").isNull(), F.col("by_pattern.name")).alias("pattern"),
    )
