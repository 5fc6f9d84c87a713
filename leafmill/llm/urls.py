"""URL filter: pattern rules found by their rarest literal token.

Every rule is a regular expression over host and path and has literal tokens,
words that any URL it matches must hold as whole words. The rules are indexed by
that one of their tokens that the fewest URLs hold. A URL's tokens fetch its
candidate rules by an equality join, and only those run their expression. All of
it is DataFrame operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a host or path: what is between these signs.
BETWEEN = r"[^A-Za-z0-9\u0080-\x{10FFFF}]+"
#: An index of up to so many rules is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """weight: of the rules that match, the heaviest decides; name: what the result shows, None for a pattern."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    name: str | None = None


def words(prefix: str, text: str) -> list[str]:
    return [prefix + w for w in re.split(r"[^A-Za-z0-9\u0080-\U0010FFFF]+", text) if w]


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host, all its subdomains, and paths that start with path ("" or from its / on)."""
    # a URL may carry the path's last word on, so that only words before it must be there
    sure = re.match(r"(?s)(?:.*[^A-Za-z0-9\u0080-\U0010FFFF])?", path)[0]
    pattern = r"^(?:[^/]*\.)?" + quoted(host) + (quoted(path) if path else "(?:/|$)")
    return Rule(verdict, pattern, (*words("h:", host), *words("p:", sure)), len(host) + len(path), host + path)


def quoted(text: str) -> str:
    """text as a pattern for Java and RE2."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def host_word_rule(verdict: str, word: str) -> Rule:
    """Fits hosts that hold word as a whole word; any named rule weighs more."""
    return Rule(verdict, rf"^(?:[^/]*[^A-Za-z0-9/])?{quoted(word)}(?:[^A-Za-z0-9]|$)", (f"h:{word}",), 0)


#: The rules of the contract, then the method's own: hosts that sell, bet or track.
NAMED = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UNWANTED = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "track"]
RULES = [prefix_rule(*r) for r in NAMED] + [host_word_rule("block", w) for w in UNWANTED]


def host_of(url: str) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; null or none: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """From the host's end to the next ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    def marked(prefix: str, text: Column) -> Column:
        return F.transform(F.filter(F.split(text, BETWEEN), lambda w: w != ""), lambda w: F.concat(F.lit(prefix), w))

    return F.array_union(marked("h:", host), marked("p:", path))  # each once


def index(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each rule: its rarest token in places (ties: the first), or "" if it has none."""
    spark = places.sparkSession
    rows = [(k, r.verdict, r.pattern, r.weight, r.name, list(r.tokens) or [""]) for k, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_id int, verdict string, pattern string, weight int, name string, tokens array<string>")
    own = table.select(F.explode("tokens").alias("token")).distinct()
    seen = places.select(F.explode("tokens").alias("token"))
    seen = seen.join(F.broadcast(own) if len(rules) <= BROADCAST_RULES else own, "token").groupBy("token").count()
    ranked = table.select("*", F.posexplode("tokens").alias("at", "token")).join(seen, "token", "left")
    best = ranked.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "at")).alias("token"))
    return table.drop("tokens").join(best, "rule_id")


def judge(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict, which replace columns of such names.

    The heaviest rule that matches decides (ties: the first of rules); where none
    does, verdict is `otherwise` and rule is null. rule is null for patterns too.
    Every row of pages gives one row; URLs without :// and null URLs have an empty
    host and path, which are judged as well.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    # a frequent host and path counts as one place; map-side sums see to that before the shuffle
    places = store(split.select("host", "path").distinct().withColumn("tokens", F.array_union(tokens_of(F.col("host"), F.col("path")), F.array(F.lit("")))), "places")
    table = index(places, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    found = places.select("host", "path", F.explode("tokens").alias("token")).join(table, "token")
    found = found.where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("name", "verdict"), F.struct("weight", -F.col("rule_id"))).alias("_best"))
    out = split.join(best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.col("_best.name").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def _sql() -> str:
    cases = [f"WHEN regexp_matches(host || path, '{r.pattern}') THEN {k}" for k, r in sorted(enumerate(RULES), key=lambda x: (-x[1].weight, x[0]))]
    names = " ".join(f"WHEN {k} THEN '{r.name}'" for k, r in enumerate(RULES) if r.name)
    verdicts = " ".join(f"WHEN {k} THEN '{r.verdict}'" for k, r in enumerate(RULES))
    return f"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (SELECT *, CASE {' '.join(cases)} END AS k FROM split)
SELECT page_id, host, path, CASE k {names} END AS rule, coalesce(CASE k {verdicts} END, 'allow') AS verdict
FROM judged"""


ORACLE = _sql()
