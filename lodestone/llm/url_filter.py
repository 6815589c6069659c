"""URL filters, native: pattern rules indexed by their rarest literal token.

A pattern is written in the usual filter-list form: ``*`` any run, ``^`` a separator or
the end, a leading ``||`` the start of the host or of one of its labels, a leading or
trailing ``|`` the start or end of the URL.  Letters match in either case (A-Z only).
Rules are a table (pattern, action), read from a list of any length, a table or a text
file (``@@`` before a pattern allows, ``!`` begins a remark).

A literal token of a pattern is a run of ``[a-z0-9]`` that the pattern fixes on both
sides, so any URL that matches the pattern has it as a whole token.  The index files each
rule under the one of its tokens that the fewest distinct URLs have; a rule without such a
token stands under the empty token, which every URL has.  Each distinct URL is judged
once: its tokens meet the index in an equi-join, and only the rules met run their regular
expression.  Path rules meet the host and the domains above it in the same way.  All
joins are equi-joins of tables; Spark broadcasts an index under its size threshold.

Path rules (host suffix and path prefix, longest wins, then the first by name) are decided
first and override the pattern rules; of the matching pattern rules, an allow overrides
all blocks.

Rows: one out per row in, repeated rows too.  A null URL, or one without ``://``, has
empty host and path; patterns still see its text (null: empty).  Very long URLs are read
whole.  Rules without a pattern, or with another action than allow or block, are left out;
repeated rules count once.  An empty table gives an empty result, no rules give allow.  The
new columns take fresh names where the table has theirs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, join_texts, materialise, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[^a-z0-9_.%-]"


@dataclass(frozen=True)
class Pattern:
    text: str
    action: str = "block"


@dataclass(frozen=True)
class PathRule:
    host: str
    path: str
    action: str


PATH_RULES = (
    PathRule("org", "/", "allow"),
    PathRule("example.org", "/es/", "block"),
    PathRule("example.org", "/en/1", "block"),
    PathRule("com", "/fr/", "allow"),
    PathRule("com", "/de/", "block"),
)

PATTERNS = tuple(
    Pattern(p, a)
    for a, group in {
        "block": """
            ||ads.* ||adserver.* ||doubleclick.net^ ||tracker.* ||track.*^pixel^ ||casino.* ||*-casino.* ||porn.* ||xxx.* ||torrent.*
            /ads/* /adserver/* /banner/*/img^ /pixel.gif^ /tracking/*^ /affiliate/^ /popunder^ /sponsored/^ /login^ /wp-login.php^
            /cgi-bin/^ ^utm_source=spam^ ^ref=x^ ^sessionid= ^phpsessid= ^replytocom= /tag/*/feed^ .exe| .zip| .apk| .iso|
        """,
        "allow": "||docs.*^ads^ ||blog.*^sponsored^disclosure^ /about/ads^",
    }.items()
    for p in group.split()
)


def as_table(spark: SparkSession, rows: Sequence[tuple[str, ...]], columns: Sequence[str]) -> DataFrame:
    """A list as a table of string columns."""
    schema = f"array<struct<{','.join(f'{c}: string' for c in columns)}>>"
    said = F.lit(json.dumps([dict(zip(columns, r)) for r in rows]))
    return spark.range(1).select(F.inline(F.from_json(said, schema)))


def pattern_table(spark: SparkSession, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    return as_table(spark, [(p.text, p.action) for p in patterns], ("pattern", "action"))


def path_table(spark: SparkSession, rules: Sequence[PathRule] = PATH_RULES) -> DataFrame:
    return as_table(spark, [(r.host, r.path, r.action) for r in rules], ("host", "path", "action"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern, action of a filter list, a rule a line."""
    line = F.trim("value")
    rules = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("!"))
    allow = F.col("line").startswith("@@")
    return rules.select(F.when(allow, F.substr("line", F.lit(3))).otherwise(F.col("line")).alias("pattern"), F.when(allow, "allow").otherwise("block").alias("action"))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def regex_of(pattern: Column) -> Column:
    """The regular expression, in Java's and RE2's common syntax, of a filter-list pattern; for lower-cased URLs."""
    body = lowered(pattern)
    head = F.when(body.startswith("||"), r"^[^:/?#]*://(?:[^/?#]*[.@])?").when(body.startswith("|"), "^").otherwise("")
    tail = F.when(F.regexp_replace(body, r"^\|{1,2}", "").endswith("|"), "$").otherwise("")
    inner = F.regexp_replace(F.regexp_replace(body, r"^\|{1,2}", ""), r"\|$", "")
    # every ASCII mark but * and ^ stands for itself, then the two get their meaning
    inner = F.regexp_replace(inner, r"([!-)+-/:-@\[-\]`{-~])", r"\\$1")
    inner = F.replace(F.replace(inner, F.lit("^"), F.lit(f"(?:{SEPARATOR}|$)")), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("(?s)"), head, inner, tail)


def tokens_of(pattern: Column) -> Column:
    """Runs of [a-z0-9] that any matching URL has as whole tokens: what bounds them in the pattern is not a letter, digit or *."""
    body = lowered(pattern)
    bounded = F.concat(F.when(body.startswith("|"), "").otherwise("*"), body, F.when(body.endswith("|"), "").otherwise("*"))
    return F.array_distinct(F.regexp_extract_all(bounded, F.lit("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))


def url_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))


def host_path(url: Column) -> tuple[Column, Column]:
    u, rule = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, rule, 1), UPPER, LOWER), F.regexp_extract(u, rule, 2)


def build_index(patterns: DataFrame, urls: DataFrame) -> DataFrame:
    """token, pattern, action, regex: each rule under the token that the fewest of urls(text) have (a longer one first), or under the empty one."""
    rules = patterns.where(F.col("pattern").isNotNull() & F.col("action").isin("allow", "block")).select("pattern", "action").distinct()
    filed = rules.select("pattern", "action", F.explode_outer(tokens_of(F.col("pattern"))).alias("token"))
    wanted = filed.where("token is not null").select("token").distinct()
    counts = urls.select(F.explode(url_tokens(F.col("text"))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), F.col("token").alias("t"))
    best = filed.join(counts, "token", "left").groupBy("pattern", "action").agg(F.min(F.when(F.col("token").isNotNull(), rank)).alias("best"))
    return best.select(F.coalesce("best.t", F.lit("")).alias("token"), "pattern", "action", regex_of(F.col("pattern")).alias("regex"))


def pattern_hits(urls: DataFrame, index: DataFrame) -> DataFrame:
    """url, hit: struct<action, pattern> of the deciding pattern (allow sorts before block), for URLs that have one."""
    tokens = urls.select("url", "text", F.explode(F.concat(url_tokens(F.col("text")), F.array(F.lit("")))).alias("token"))
    met = tokens.join(index, "token").where(F.regexp(F.col("text"), F.col("regex")))
    return met.groupBy("url").agg(F.min(F.struct("action", "pattern")).alias("hit"))


def path_hits(urls: DataFrame, path_rules: DataFrame) -> DataFrame:
    """url, rule, ruled of the longest path rule that fits, for URLs that have one."""
    labels = F.split("url_host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = urls.select("url", "url_path", F.explode(above).alias("host")).join(path_rules, "host").where(F.startswith("url_path", "path"))
    name = F.concat("host", "path")
    best = met.groupBy("url").agg(F.min(F.struct((-F.length(name)).alias("l"), name.alias("name"), F.col("action").alias("action"))).alias("best"))
    return best.select("url", F.col("best.name").alias("rule"), F.col("best.action").alias("ruled"))


def filter_urls(pages: DataFrame, url_col: str = "url", patterns: Sequence[Pattern] | DataFrame = PATTERNS, path_rules: Sequence[PathRule] | DataFrame = PATH_RULES) -> DataFrame:
    """pages with url_host, url_path, url_rule, url_pattern and url_verdict (names made fresh where taken)."""
    spark, url = pages.sparkSession, F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    patterns = patterns if isinstance(patterns, DataFrame) else pattern_table(spark, patterns)
    path_rules = path_rules if isinstance(path_rules, DataFrame) else path_table(spark, path_rules)
    urls = materialise(pages.select(url.alias("url")).groupBy("url").agg(F.count("*").alias("n")), "urls")
    host, path = host_path(F.col("url"))
    seen = urls.select("url", "n", lowered(F.col("url")).alias("text"), host.alias("url_host"), path.alias("url_path"))
    ruled, hit = path_hits(seen, path_rules), pattern_hits(seen, build_index(patterns, seen))
    verdict = F.coalesce("ruled", F.col("hit")["action"], F.lit("allow"))
    judged = materialise(seen.join(ruled, "url", "left").join(hit, "url", "left").select("url", "n", "url_host", "url_path", F.col("rule").alias("url_rule"), verdict.alias("url_verdict"), F.col("hit")["pattern"].alias("url_pattern")), "judged")
    key, size = fresh(pages, "url_key"), fresh(pages, "url_count")
    names = {c: fresh(pages, c) for c in ("url_host", "url_path", "url_rule", "url_verdict", "url_pattern")}
    one = judged.select(F.col("url").alias(key), F.col("n").alias(size), *(F.col(c).alias(n) for c, n in names.items()))
    return join_texts(pages.withColumn(key, url), one, key, size).select(*(F.col(f"`{c}`") for c in pages.columns), *names.values())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_pattern").alias("pattern"))


def plain_regex(pattern: str) -> str:
    """A pattern's regular expression by Python's means, for the SQL twin and the tests."""
    import re

    body, head, tail = pattern.translate(str.maketrans(UPPER, LOWER)), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[^:/?#]*://(?:[^/?#]*[.@])?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    parts = {"*": ".*", "^": f"(?:{SEPARATOR}|$)"}
    return f"(?s){head}{''.join(parts.get(c) or re.escape(c) for c in body)}{tail}"


def oracle_sql() -> str:
    """The same by trying every rule on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    name = lambda r: f"{r.host}{r.path}"
    fits = lambda r: f"(host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)})"
    rules = sorted(PATH_RULES, key=lambda r: -len(name(r)))
    rule = " ".join(f"WHEN {fits(r)} THEN {quote(name(r))}" for r in rules)
    verdict = " ".join(f"WHEN {fits(r)} THEN {quote(r.action)}" for r in rules)
    tried = ", ".join(f"CASE WHEN regexp_matches(u, {quote(plain_regex(p.text))}) THEN {quote(('0' if p.action == 'allow' else '1') + p.text)} END" for p in PATTERNS)
    part = lambda n: f"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {n})"
    return f"""
        WITH a AS (SELECT page_id, translate({part(1)}, '{UPPER}', '{LOWER}') AS host, {part(2)} AS path, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u FROM pages),
        b AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled, least({tried}) AS hit FROM a)
        SELECT page_id, host, path, rule,
               coalesce(ruled, CASE substr(hit, 1, 1) WHEN '0' THEN 'allow' WHEN '1' THEN 'block' END, 'allow') AS verdict, substr(hit, 2) AS pattern FROM b"""


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE = {"op2_url_filter": oracle_sql()}
