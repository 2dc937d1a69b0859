"""URL filter: domain rules first, then pattern rules found through their rarest literal token.

A pattern rule is a line of the usual filter syntax (wildcards, separators, anchors, exceptions, whole expressions) or a phrase
of words; it is made into a regular expression and the words that every match holds whole, derived from the rule itself. Each
rule is indexed under the one of its words that the fewest urls contain; a url's own words fetch rules from the index, and only
those rules' expressions run on it, and those of the few rules that hold no whole word. Domain rules are looked up by the
host's suffixes. Rule tables up to a size are sent to the workers, and a url is judged beside the scan; larger ones are joined
with the urls' words, each url under a number of its own, so urls that many pages share make no large group.

Defined results: a null url or one without ``://`` has an empty host and path and is allowed; of equally long domain rules the
one with the longer host decides, of a repeated one the last; an exception that matches outweighs every matching rule, and of several the first by name is told;
repeated rows are judged alike and all returned; an empty table gives an empty result; urls of any length are judged whole; only
the named columns are read, so others may clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: (host, path prefix, verdict). A rule holds for its host and every subdomain; the longest that fits decides.
DOMAIN_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@dataclass(frozen=True)
class PatternRule:
    """``tokens``: the alphanumeric runs that stand whole in every url that ``regex`` can match; ``verdict``: block or allow."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str = "block"


def pattern_rule(line: str) -> PatternRule | None:
    """A line of filter syntax, over host followed by path in lower case; None for comments and blank lines.

    ``*`` is anything, ``^`` a mark that parts words or the end, ``|`` at either end an anchor, ``||`` the start of the host or
    of one of its labels, ``@@`` before a rule an exception from all others, and a rule between slashes an expression.
    """
    text = line.strip()
    if not text or text.startswith("!"):
        return None
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    if len(body) > 2 and body.startswith("/") and body.endswith("/"):
        return PatternRule(text, body[1:-1], (), verdict)
    body = body.lower()
    begin = "host" if body.startswith("||") else "start" if body.startswith("|") else ""
    body = body[{"host": 2, "start": 1}.get(begin, 0) :]
    ends = body.endswith("|")
    body = body.removesuffix("|") if ends else body
    middle = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)
    regex = {"host": r"^(?:[^/]*\.)?", "start": "^"}.get(begin, "") + middle + ("$" if ends else "")
    tokens = []
    for m in re.finditer("[a-z0-9]+", body):
        left = bool(begin) if m.start() == 0 else body[m.start() - 1] != "*"
        right = ends if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            tokens.append(m[0])
    return PatternRule(text, regex, tuple(dict.fromkeys(tokens)), verdict)


def pattern_rules(lines: Iterable[str]) -> tuple[PatternRule, ...]:
    return tuple(r for line in lines if (r := pattern_rule(line)))


#: Phrases that block a url in whose host, or path, their words follow each other.
HOST_PHRASES = (
    "adult", "porn", "xxx", "sex cams", "live sex", "escort girls", "hot singles", "nude pics",
    "casino", "online casino", "poker", "roulette", "free slots", "slot machines", "free bets", "sports betting", "bet bonus", "jackpot",
    "cheap pills", "buy viagra", "buy cialis", "online pharmacy", "diet pills", "weight loss pills",
    "spam farm", "link farm", "buy links", "cheap backlinks", "seo spam", "doorway pages",
    "ads track", "ad server", "ad tracker", "click tracker", "pop ads", "banner ads", "tracking pixel",
    "free warez", "warez", "keygen", "serial keys", "cracked software", "free torrents", "movie torrents",
    "payday loans", "fast cash", "get rich quick", "crypto doubler", "free crypto", "essay mill", "buy essays", "fake id",
)
PATH_PHRASES = (
    "buy viagra", "buy cialis", "cheap pills", "casino bonus", "free slots", "online casino", "poker bonus", "free bets", "porn", "xxx", "live sex", "nude pics",
    "keygen", "serial key", "crack download", "warez", "payday loan", "get rich quick", "buy links", "buy followers", "fake id", "click tracker",
)


def phrase_rules(host_phrases=HOST_PHRASES, path_phrases=PATH_PHRASES) -> tuple[PatternRule, ...]:
    """A rule for each phrase, over host followed by path in lower case. The words stand whole, with marks between them."""
    out = []
    for phrase in host_phrases:
        words = phrase.split()
        out.append(PatternRule(f"host {phrase}", rf"^([^/]*[.-])?{'[.-]'.join(words)}[.-]", tuple(words)))
    for phrase in path_phrases:
        words = phrase.split()
        out.append(PatternRule(f"path {phrase}", rf"/(.*[^a-z0-9])?{'[^a-z0-9]+'.join(words)}([^a-z0-9]|$)", tuple(words)))
    return tuple(out)


PATTERN_RULES = phrase_rules()

#: Tables of up to so many domain and pattern rules are sent to the workers (a few MB at most); larger ones are joined by a shuffle.
BROADCAST_RULES = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def domain_index(rules=DOMAIN_RULES) -> dict[str, list[tuple[str, str]]]:
    """Host to (path prefix, verdict), the longest prefix first, the later rule first among equal ones."""
    out: dict[str, dict[str, str]] = {}
    for host, path, verdict in rules:
        out.setdefault(host, {})[path] = verdict
    return {host: sorted(paths.items(), key=lambda p: -len(p[0])) for host, paths in out.items()}


def domain_verdict(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest fitting rule (host and prefix together) and its verdict; the longer host among equally long rules."""
    best: tuple[int, int, str, str] | None = None
    part = host
    while part:
        for prefix, verdict in index.get(part, ()):
            if path.startswith(prefix):
                if best is None or len(part) + len(prefix) > best[0]:
                    best = len(part) + len(prefix), len(part), part + prefix, verdict
                break
        part = part.partition(".")[2]
    return (best[2], best[3]) if best else (None, None)


def url_tokens(c: Column) -> Column:
    return F.array_distinct(F.split(c, r"[^a-z0-9]+"))


def rule_index(urls: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """(pattern_rule, regex, verdict, token): each rule under the one of its tokens that the fewest urls contain (first by name on a
    tie), or under null where it has none. ``urls``: (target)."""
    spark = urls.sparkSession
    held = spark.createDataFrame([(r.name, r.regex, r.verdict, t) for r in rules for t in r.tokens or (None,)], "pattern_rule string, regex string, verdict string, token string")
    words = held.select("token").where("token is not null").distinct()
    few = F.broadcast(words) if len(rules) <= BROADCAST_RULES else words
    counts = urls.select(F.explode(url_tokens(F.col("target"))).alias("token")).join(few, "token").groupBy("token").count()
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"]
    return held.join(counts, "token", "left").groupBy("pattern_rule", "regex", "verdict").agg(rarest.alias("token"))


def _judged(domains, rows):
    """Batches with host, path and target to their rule, domain verdict and pattern rule; ``rows``: those of ``rule_index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, by_token = domains.value, {}
        for r in rows.value:
            by_token.setdefault(r[3], []).append((r[2] == "block", r[0], re.compile(r[1])))
        always = by_token.pop(None, [])
        for b in batches:
            out = []
            for host, path, target in zip(*(b.column(c).to_pylist() for c in ("host", "path", "target")), strict=True):
                name, verdict = domain_verdict(host, path, by_host)
                pattern, blocks = None, False
                if verdict is None and host:
                    found = [*always, *(r for t in set(re.split("[^a-z0-9]+", target)) if t in by_token for r in by_token[t])]
                    hits = [r[:2] for r in found if r[2].search(target)]
                    if hits:
                        blocks, pattern = min(hits)  # exceptions first, then by name
                out.append((name, verdict or ("block" if blocks else "allow"), pattern))
            made = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), *(pa.array(x, pa.string()) for x in made)], names=["page_id", "host", "path", "rule", "verdict", "pattern_rule"])

    return run


def pattern_matches(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(nr, pattern_rule, verdict) of the rows (nr, target) that a rule of ``index`` matches: an exception, else the first rule by name.

    A row's tokens are only in its own partition before they're grouped, so each row is one row of the shuffle. Rules without a token
    meet every row, in blocks: they're a stated set, and few.
    """
    hits = urls.select("nr", "target", F.explode(url_tokens(F.col("target"))).alias("token")).join(index.where("token is not null"), "token").where(F.expr("target rlike regex"))
    found = hits.select("nr", "verdict", "pattern_rule")
    for r in index.where("token is null").toLocalIterator():
        found = found.unionByName(urls.where(F.col("target").rlike(r["regex"])).select("nr", F.lit(r["verdict"]).alias("verdict"), F.lit(r["pattern_rule"]).alias("pattern_rule")))
    return found.groupBy("nr").agg(F.min(F.struct("verdict", "pattern_rule")).alias("_m")).select("nr", "_m.pattern_rule", F.col("_m.verdict").alias("pattern_verdict"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", domain_rules=DOMAIN_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, pattern_rule): a domain rule decides; else a matching exception allows; else a matching pattern
    rule blocks; else allow."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("target", ascii_lower(F.concat("host", "path")))
    domains = spark.sparkContext.broadcast(domain_index(domain_rules))
    index = rule_index(rows.where("host <> ''").select("target"), pattern_rules)
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, pattern_rule string"
    if len(pattern_rules) <= BROADCAST_RULES:
        held = spark.sparkContext.broadcast([tuple(r) for r in index.select("pattern_rule", "regex", "verdict", "token").collect()])
        return rows.mapInArrow(_judged(domains, held), schema)
    none = spark.sparkContext.broadcast([])
    # numbered once, in a written table, so a task that is run again can't number otherwise
    numbered = materialize(rows.withColumn("nr", F.monotonically_increasing_id()), "urls")
    named = numbered.select(F.struct("page_id", "nr").alias("page_id"), "host", "path", "target").mapInArrow(_judged(domains, none), schema.replace(schema.split(",")[0], f"page_id struct<page_id:{rows.schema['page_id'].dataType.simpleString()},nr:bigint>"))
    named = named.select("page_id.page_id", "page_id.nr", "host", "path", "rule", "verdict")
    met = pattern_matches(numbered.where("host <> ''").select("nr", "target"), materialize(index, "url-rules"))
    open_ = F.col("rule").isNull()
    return named.join(met, "nr", "left").select("page_id", "host", "path", "rule", F.when(open_, F.coalesce("pattern_verdict", "verdict")).otherwise(F.col("verdict")).alias("verdict"), F.when(open_, F.col("pattern_rule")).alias("pattern_rule"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("pattern_rule")


OP8_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM split
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host <> '' AND regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{patterns}') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
""".replace("{patterns}", "|".join(f"(?:{r.regex})" for r in PATTERN_RULES))
