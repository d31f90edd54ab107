"""URL filters: rules indexed by their rarest literal token.

A rule names the whole tokens (runs of ASCII letters and digits) that every url it matches must hold. One aggregation over all
urls counts those tokens; each rule is filed under its rarest one. A url's tokens fetch the rules filed under them, and only
those run their regular expression. The rules are a list the user writes and travel with the task; urls are never shuffled.

Of the rules that match, those of the highest tier decide, and of these the longest. Without any, the verdict is allow.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule matches it; repeated rows are judged
each; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import UPPER, small_batches, table

TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class UrlRule:
    """A pattern for ``host + path`` (the host in lower case), and the tokens that must be there as a whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    tier: int = 0


def site_rule(verdict: str, name: str, tier: int = 1) -> UrlRule:
    """A host with all its subdomains and the start of a path, like ``example.com/en/``."""
    host, slash, path = name.partition("/")
    tokens = TOKEN.findall(host) + TOKEN.findall((slash + path)[: 1 + (slash + path).rfind("/")])
    return UrlRule(name, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(tokens), tier)


def host_word_rule(verdict: str, *words: str) -> UrlRule:
    """Neighbouring words in the host, like ``casino-win``."""
    inner = "[^A-Za-z0-9/]".join(map(re.escape, words))
    return UrlRule("-".join(words), verdict, rf"\A(?:[^/]*[^A-Za-z0-9/])?{inner}(?:[^A-Za-z0-9]|\Z)", words)


SITE_RULES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
)
#: What decides where no rule for a site does: words of hosts that sell or track.
WORD_RULES = tuple(
    host_word_rule("block", *words.split("-"))
    for words in ("ads", "adult", "bets", "casino", "gambling", "pills", "porn", "spam", "tracker", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
)


class RuleIndex:
    """Rules by their rarest token; without a token they run on every url."""

    def __init__(self, rules: tuple[UrlRule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[re.Pattern, UrlRule]]] = defaultdict(list)
        self.always: list[tuple[re.Pattern, UrlRule]] = []
        for rule in rules:
            entry = (re.compile(rule.pattern), rule)
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(entry)
            else:
                self.always.append(entry)

    def decide(self, target: str) -> UrlRule | None:
        found = list(self.always)
        for token in set(TOKEN.findall(target)):
            found += self.by_token.get(token, ())
        hits = [rule for pattern, rule in found if pattern.search(target)]
        return max(hits, key=lambda r: (r.tier, len(r.name), r.name), default=None)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return pages.withColumns({"host": F.translate(rest, UPPER, UPPER.lower()), "path": path})


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = SITE_RULES + WORD_RULES, url: str = "url") -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``tier`` (of the rule that decides; else null) and ``verdict``."""
    small_batches(pages.sparkSession)
    parts = with_host_and_path(pages, url)
    wanted = sorted({token for rule in rules for token in rule.tokens})
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit("([A-Za-z0-9]+)"), 1)))
    seen = parts.select(tokens.alias("token")).filter(F.col("token").isin(wanted)).groupBy("token").count()
    index_counts = {row["token"]: row["count"] for row in seen.collect()}  # a number for each token of the rules

    kept = [f for f in parts.schema.fields if f.name not in ("rule", "tier", "verdict")]
    names = [f.name for f in kept]
    added = [T.StructField("rule", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("verdict", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, index_counts)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [index.decide(host + path) for host, path in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array([r and r.name for r in found], pa.string()),
                    pa.array([r and r.tier for r in found], pa.int32()),
                    pa.array([r.verdict if r else "allow" for r in found], pa.string()),
                ],
                [*names, "rule", "tier", "verdict"],
            )

    return parts.select(*names).mapInArrow(run, T.StructType([*kept, *added]))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 1, F.col("rule")).alias("rule"), "verdict")


_WORDS = "|".join("[^A-Za-z0-9/]".join(rule.tokens) for rule in WORD_RULES)
OP6_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(name, verdict, rule_host, rule_path) AS (
  VALUES {", ".join(f"('{r.name}', '{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')" for r in SITE_RULES)}
), fits AS (
  SELECT page_id, max_by(struct_pack(name := name, verdict := verdict), length(name)) AS best
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, best.name AS rule,
       CASE WHEN best IS NOT NULL THEN best.verdict
            WHEN regexp_matches(host || path, '^([^/]*[^A-Za-z0-9/])?({_WORDS})([^A-Za-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""
