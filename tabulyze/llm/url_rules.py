"""URL filters: host and path rules, then pattern rules indexed by their rarest literal token.

A pattern is literal text with `*` for anything; at both ends it must meet the border of a token
(a run of letters and digits). Each pattern is filed under the one of its whole tokens that is
rarest in the URLs at hand. The tokens of a URL fetch its candidate patterns, and only those run
their regular expressions. Patterns without a whole token are candidates for every URL.

A host and path rule fits its host and all subdomains if the URL's path starts with the rule's;
the longest fitting rule decides. Without one, an allowing pattern wins over a blocking one, and
with no pattern the URL is allowed.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no place
rule; an empty table gives no rows; repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class PlaceRule:
    action: str
    place: str  # host, then a path from its first slash

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


@dataclass(frozen=True)
class PatternRule:
    action: str
    pattern: str

    @property
    def expression(self) -> str:
        body = ".*".join(re.escape(x) for x in self.pattern.split("*"))
        ends = (self.pattern[0], self.pattern[-1])
        before = "(?<![a-z0-9])" if TOKEN.match(ends[0]) else ""
        after = "(?![a-z0-9])" if TOKEN.match(ends[1]) else ""
        return f"{before}{body}{after}"

    @property
    def tokens(self) -> list[str]:
        """Whole tokens: none that a wildcard could lengthen."""
        return [m.group() for m in TOKEN.finditer(self.pattern)
                if not (m.start() and self.pattern[m.start() - 1] == "*")
                and not (m.end() < len(self.pattern) and self.pattern[m.end()] == "*")]


PLACES = (
    PlaceRule("allow", "com/"), PlaceRule("block", "example.com/en/"),
    PlaceRule("allow", "www.example.com/en/"), PlaceRule("block", "net/es/"),
    PlaceRule("block", "net/fr/"),
)
PATTERNS = (
    PatternRule("block", "casino-win"), PatternRule("block", "free-bets"),
    PatternRule("block", "cheap-pills"), PatternRule("block", "/ads/*.html"),
    PatternRule("block", "sessionid="), PatternRule("block", "utm_source=spam"),
    PatternRule("allow", "responsible-gaming"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(
        F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(
        F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def place_rule(host: Column, path: Column, rules: tuple[PlaceRule, ...]) -> Column:
    """The longest fitting rule's place, else null."""
    fits = [
        F.when((F.concat(F.lit("."), host).endswith("." + r.host))
               & path.startswith(r.path), r.place)
        for r in sorted(rules, key=lambda r: (-len(r.place), r.place))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def token_counts(urls: Column, df: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URL tokens equal each of the given ones; only those are shuffled."""
    found = df.select(F.explode(F.regexp_extract_all(
        F.translate(F.coalesce(urls, F.lit("")), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)
    )).alias("t")).filter(F.col("t").isin(tokens))
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def indexed(rules: tuple[PatternRule, ...],
            counts: dict[str, int]) -> dict[str | None, list[PatternRule]]:
    """Rules under their rarest whole token; under None those that have none."""
    index: dict[str | None, list[PatternRule]] = {}
    for rule in rules:
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(key, []).append(rule)
    return index


def pattern_rule(url: Column, index: dict[str | None, list[PatternRule]]) -> Column:
    """Struct (action, pattern, tried): the deciding pattern and how many expressions ran."""
    order = sorted({r for rs in index.values() for r in rs}, key=lambda r: (r.action, r.pattern))
    rank = {r: i for i, r in enumerate(order)}
    filed = {k: sorted(rank[r] for r in rs) for k, rs in index.items()}
    always = filed.pop(None, [])

    @F.arrow_udf("action string, pattern string, tried int")
    def judge(urls: pa.Array) -> pa.Array:
        compiled = [re.compile(r.expression, re.S) for r in order]
        actions, patterns, tried = [], [], []
        for url in urls.to_pylist():
            url = "" if url is None else url.translate(_FOLD)
            fetched = set(always)
            for token in set(TOKEN.findall(url)) & filed.keys():
                fetched.update(filed[token])
            n, won = 0, None
            for i in sorted(fetched):  # allowing rules come first
                n += 1
                if compiled[i].search(url):
                    won = order[i]
                    break
            actions.append(won.action if won else None)
            patterns.append(won.pattern if won else None)
            tried.append(n)
        return pa.StructArray.from_arrays(
            [pa.array(actions, pa.string()), pa.array(patterns, pa.string()),
             pa.array(tried, pa.int32())], names=["action", "pattern", "tried"])

    return judge(url)


_FOLD = str.maketrans(UPPER, LOWER)


def judged(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
           places: tuple[PlaceRule, ...] = PLACES,
           patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """One row per URL: host, path, the place rule, the pattern that matched, and the verdict."""
    url = col(url_column)
    tokens = sorted({t for r in patterns for t in r.tokens})
    index = indexed(patterns, token_counts(url, pages, tokens) if tokens else {})
    rows = pages.select(
        col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
        pattern_rule(url, index).alias("p"))
    rule = place_rule(F.col("host"), F.col("path"), places)
    action = F.create_map(*(x for r in places for x in (F.lit(r.place), F.lit(r.action)))) \
        if places else F.create_map().cast("map<string,string>")
    ruled = rows.withColumn("rule", rule)
    return ruled.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.col("p.pattern").alias("pattern"),
        F.coalesce(F.try_element_at(action, F.col("rule")), F.col("p.action"), F.lit("allow"))
        .alias("verdict"))
