"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern with an action, `allow` or `block`. Patterns are matched against the
URL without its scheme, host in lower case:

* `||` at the start anchors at a host label (`||example.com/a` fits the host and its
  subdomains), a single `|` at either end anchors there;
* `*` stands for any characters, `^` for a separator or the end;
* everything else is literal.

Whole alphanumeric tokens of a pattern must occur as whole tokens in every URL that it fits.
So each rule is filed under that token of its own which the fewest URLs have, a URL looks up
its tokens, and only the rules found so run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.util import ascii_lower, nested, unnested

#: Up to so many rules the index is broadcast (at most some 100 MB); beyond, joins shuffle.
MAX_BROADCAST_RULES = 200_000
_RULES = "rule_id long, rule string, action string, tier int, regex string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """tier: rules of a higher tier win over those of a lower; within a tier the longest pattern wins."""

    pattern: str
    action: str
    tier: int = 0
    name: str | None = None

    @classmethod
    def prefix(cls, host: str, path: str, action: str, tier: int = 1) -> Rule:
        """Fits a host with all its subdomains, where the path starts with `path`."""
        return cls(f"||{host}{path}", action, tier, f"{host}{path}")

    def parts(self) -> tuple[str, str, str]:
        body = self.pattern
        start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(start) :]
        end = "|" if body.endswith("|") else ""
        return start, body[: len(body) - len(end)], end

    def regex(self) -> str:
        start, body, end = self.parts()
        anchor = {"||": r"^(?:[^/?#]*\.)?", "|": "^", "": ""}[start]
        special = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|\z)"}
        return anchor + "".join(special.get(c) or (c if c.isalnum() else "\\" + c) for c in body) + (r"\z" if end else "")

    def tokens(self) -> list[str]:
        """Alphanumeric runs that neither a wildcard nor an open end of the pattern can lengthen."""
        start, body, end = self.parts()
        found = []
        for m in re.finditer("[a-z0-9]+", low := body.translate({i: i + 32 for i in range(65, 91)})):
            left = bool(start) if m.start() == 0 else low[m.start() - 1] != "*"
            right = bool(end) if m.end() == len(low) else low[m.end()] != "*"
            if left and right and m[0] not in found:
                found.append(m[0])
        return found


def read_rules(spark: SparkSession, path: str, tier: int = 0) -> list[Rule]:
    """Rules of text files, one a line: a pattern to block, or after `@@` one to allow; blank lines and those after `!` are skipped.

    The rules are held by the driver, as their expressions are made there: a filter list of 100,000 rules takes some 30 MB.
    """
    lines = [r.value.strip() for r in spark.read.text(path).collect()]
    return [Rule(x.removeprefix("@@"), "allow" if x.startswith("@@") else "block", tier) for x in lines if x and not x.startswith("!")]


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and the rest from `?` or `#` on. Null or without `://`: empty."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + F.lit(1), F.length(after))
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    return ascii_lower(host), path, F.substring(rest, F.length(path) + F.lit(1), F.length(rest))


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule, tier, verdict to every row of `pages`.

    rule and tier are those of the winning rule, null where none fits; verdict is its action, or
    `default`. Null and malformed URLs have an empty host and path, fit nothing and get `default`.
    Repeated URLs are judged once and keep all their rows. Columns of the input that are named
    like an output are replaced. An empty table gives an empty table.

    URLs are made distinct first (combined before the shuffle, so a URL that a third of all pages
    share arrives as one row), and the verdicts join back on two keys, which lets adaptive
    execution split the pages of a hot URL.
    """
    spark = pages.sparkSession
    listed = [(i, r.name or r.pattern, r.action, r.tier, r.regex(), r.tokens() or [""]) for i, r in enumerate(rules)]
    small = F.broadcast if len(rules) <= MAX_BROADCAST_RULES else (lambda df: df)
    rule_df = spark.createDataFrame(listed, _RULES)

    rest = pages.drop("host", "path", "rule", "tier", "verdict")
    keyed = nested(rest).withColumn("url", F.coalesce(F.col(f"row.`{url_col}`"), F.lit("")))
    host, path, rest_of_url = split_url(F.col("url"))
    urls = keyed.select("url").distinct().select("url", F.concat(host, path, rest_of_url).alias("subject"))
    # the empty token files rules that have no token of their own: every URL looks it up
    tokens = F.array_union(F.regexp_extract_all(ascii_lower(F.col("subject")), F.lit("[a-z0-9]+"), 0), F.array(F.lit("")))
    looked_up = urls.select("url", "subject", F.explode(tokens).alias("token"))

    rule_tokens = rule_df.select("rule_id", F.explode("tokens").alias("token"))
    counts = looked_up.join(small(rule_tokens.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n_urls"))
    rarest = rule_tokens.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n"), "token")).alias("r"))
    index = rule_df.drop("tokens").join(rarest, "rule_id").select(F.col("r.token").alias("token"), "rule", "action", "tier", "regex")

    verdicts = (
        looked_up.join(small(index), "token")
        .where(F.expr("rlike(subject, regex)"))
        .groupBy("url")
        .agg(F.max(F.struct("tier", F.length("rule").alias("n"), "rule", "action")).alias("win"))
        .withColumn("h", F.xxhash64("url"))
    )
    joined = keyed.withColumn("h", F.xxhash64("url")).join(verdicts, ["h", "url"], "left")
    return joined.select(*unnested(rest.columns), host.alias("host"), path.alias("path"), F.col("win.rule").alias("rule"), F.col("win.tier").alias("tier"), F.coalesce(F.col("win.action"), F.lit(default)).alias("verdict"))
