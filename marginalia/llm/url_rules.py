"""URL rules found by their rarest literal token (operator 10).

A pattern is matched against ``host + path``.  ``||`` at its start stands for the start of the host or of a subdomain
boundary in it, ``*`` for any characters, all else for itself.  A token is a run of ASCII letters and digits.  A token
of a pattern that is bounded on both sides must be a token of every url the pattern fits, so a rule is filed under
the one that fewest urls have; urls look up their tokens and only the rules found run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import ascii_lower

BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``name`` is reported, ``rank`` decides between fitting rules: the highest wins, ties by name."""

    name: str
    pattern: str
    verdict: str
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest such rule wins."""
    return Rule(host + path, f"||{host}{path}", verdict, 1_000_000 + len(host + path))


HOST_RULES = (
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
)
# Decide where no host rule fits.
PATTERN_RULES = (
    Rule("spam hosts", "spam-farm.", "block", 20),
    Rule("advert hosts", "||ads.", "block", 20),
    Rule("tracker hosts", "||tracker.", "block", 20),
    Rule("login pages", "/login/", "block", 10),
    Rule("cart pages", "/cart/", "block", 10),
    Rule("archives", "/downloads/*.zip", "block", 10),
)


def regex(pattern: str) -> str:
    """Java and RE2 alike."""
    start, body = ("^([^/]*[.])?", pattern[2:]) if pattern.startswith("||") else ("", pattern)
    return start + "(.|\n)*".join(re.sub(r"([^A-Za-z0-9/_ -])", r"[\1]", part) for part in body.split("*"))


def tokens_of_pattern(pattern: str) -> list[str]:
    """The bounded tokens of a pattern."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    found = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", body)]
    left = lambda i: (anchored if i == 0 else body[i - 1] != "*")
    right = lambda i: i < len(body) and body[i] != "*"
    return [body[i:j] for i, j in found if left(i) and right(j)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_index(spark: SparkSession, rules: tuple[Rule, ...], frequency: dict[str, int]) -> DataFrame:
    """(token, rule): each rule under its rarest bounded token, under a null token if it has none."""
    lines = []
    for rule in rules:
        own = tokens_of_pattern(rule.pattern)
        token = min(own, key=lambda t: (frequency.get(t, 0), -len(t), t)) if own else None
        lines.append((token, rule.name, regex(rule.pattern), rule.verdict, rule.rank))
    return spark.createDataFrame(lines, "token string, rule string, regex string, rule_verdict string, rank int")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (name or null) and verdict; input columns of these names are replaced.

    A null url or one without ``://`` has an empty host and path and gets the ``default`` unless a rule fits that.
    Repeated urls are judged once.  Pages, also those with a null page_id, are all kept.
    """
    spark = pages.sparkSession
    parsed = pages.select(F.struct("*").alias("row"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = parsed.select("row", host.alias("host"), path.alias("path"))
    urls = parsed.select("host", "path").distinct().withColumn("whole", F.concat("host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all("whole", F.lit("[A-Za-z0-9]+"), 0))
    split = urls.select("host", "path", "whole", F.explode(tokens).alias("token"))

    literal = sorted({t for r in rules for t in tokens_of_pattern(r.pattern)})
    asked = spark.createDataFrame([(t,) for t in literal], "token string")
    small = (lambda df: F.broadcast(df)) if len(rules) <= BROADCAST_RULES else (lambda df: df)
    counted = split.select("token").join(small(asked), "token").groupBy("token").count().collect()
    index = rule_index(spark, rules, {r["token"]: r["count"] for r in counted})

    found = split.join(small(index.filter("token is not null")), "token").drop("token")
    anywhere = [r for r in rules if not tokens_of_pattern(r.pattern)]
    for rule in anywhere:
        columns = [F.lit(rule.name).alias("rule"), F.lit(regex(rule.pattern)).alias("regex"), F.lit(rule.verdict).alias("rule_verdict")]
        found = found.unionByName(urls.select("host", "path", "whole", *columns, F.lit(rule.rank).alias("rank")))
    fitting = found.filter(F.regexp_like("whole", F.col("regex")))
    best = fitting.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "rule_verdict")).alias("best"))
    joined = parsed.join(best, ["host", "path"], "left")
    named = {"host", "path", "rule", "verdict"}
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c.lower() not in named]
    verdict = F.coalesce(F.col("best")["rule_verdict"], F.lit(default))
    return joined.select(*kept, "host", "path", F.col("best")["rule"].alias("rule"), verdict.alias("verdict"))
