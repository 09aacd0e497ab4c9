"""URL rules found through their rarest literal token.

A rule is a pattern over the host (lower case) and what follows it.  Every rule is
filed under one literal token that each URL it fits must hold, the one that the
fewest URLs hold.  URL tokens fetch the rules filed under them, and only those
rules' regular expressions run.  A rule without such a token is filed under the
empty token, which every URL holds.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
fits no site rule; equal URLs are matched once; rows keep null and repeated ids;
an empty table, and an empty rule table, give no matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow import session
from labelflow.functions.columns import by_name

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULE_SCHEMA = "rule string, kind string, action string, regex string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """``kind`` is site (host and subdomains, path prefix) or pattern (text with ``*`` for any run)."""

    rule: str
    kind: str
    action: str

    def regex(self) -> str:
        literal = [re.escape(part) for part in self.rule.split("*")]
        return (r"^(?:[^/?#]*\.)?" if self.kind == "site" else "") + ".*".join(literal)

    def tokens(self) -> list[str]:
        """Runs of letters and digits that stand between other characters of the rule itself."""
        text = ("." if self.kind == "site" else "") + self.rule
        return sorted({t.lower() for t in re.findall(r"(?<=[^a-zA-Z0-9*])[a-zA-Z0-9]+(?=[^a-zA-Z0-9*])", text)})


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.rule, r.kind, r.action, r.regex(), r.tokens()) for r in rules], RULE_SCHEMA)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def target(url: Column) -> Column:
    """What rules run on: the host in lower case, then the rest as it stands."""
    return F.concat(host(url), F.regexp_extract(_after_scheme(url), r"^[^/?#]*([\s\S]*)$", 1))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, UPPER, UPPER.lower()), "[^a-z0-9]+"))


def index_rules(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Each rule under its rarest token, by the number of ``targets`` that hold the token."""
    held = rules.select("rule", "kind", F.explode("tokens").alias("token"))
    wanted = held.select("token").distinct()
    wanted, seen = session.measure(wanted, "rule-tokens", bytes=F.sum(F.octet_length("token")))
    tokens = targets.select(F.explode(_tokens(F.col("target"))).alias("token"))
    counts = tokens.join(session.broadcast_if_small(wanted, seen), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    ranked = held.join(counts, "token", "left").groupBy("rule", "kind").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest"))
    filed = rules.join(ranked, ["rule", "kind"], "left")
    return filed.select("rule", "kind", "action", "regex", F.coalesce("rarest.token", F.lit("")).alias("token"))


def match(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each of the distinct ``targets`` that some rule fits: the longest site rule and the deciding pattern."""
    index, seen = session.measure(index_rules(rules, targets), "rule-index", bytes=F.sum(F.octet_length("regex") + F.octet_length("rule")))
    tokens = F.array_union(_tokens(F.col("target")), F.array(F.lit("")))
    fetched = targets.select("target", F.explode(tokens).alias("token")).join(session.broadcast_if_small(index, seen), "token")
    fits = fetched.where(F.expr("rlike(target, regex)"))
    site = F.when(F.col("kind") == "site", F.struct(F.length("rule").alias("size"), "rule", "action"))
    pattern = F.when(F.col("kind") == "pattern", F.struct((F.col("action") == "allow").alias("first"), F.length("rule").alias("size"), "rule", "action"))
    return fits.groupBy("target").agg(F.max(site).alias("site"), F.max(pattern).alias("pattern"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the site rule that decides, and the verdict.

    The longest site rule decides.  Without one, a fitting pattern decides, allow
    before block and longer before shorter; without any, the page is allowed.
    """
    rows = pages.select(by_name(id_col).alias("page_id"), by_name(url_col).alias("url"))
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), target(F.col("url")).alias("target"))
    matches, seen = session.measure(match(rows.select("target").distinct(), rules), "matches", bytes=F.sum(F.octet_length("target")))
    joined = rows.join(session.broadcast_if_small(matches, seen), "target", "left")
    verdict = F.coalesce("site.action", "pattern.action", F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("site.rule").alias("rule"), verdict.alias("verdict"), F.col("pattern.rule").alias("pattern"))
