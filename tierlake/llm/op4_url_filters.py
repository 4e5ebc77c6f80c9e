"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token.

Native: DataFrame functions alone. A rule list is small and given by the
caller; its size is checked before it is broadcast, and beyond the bound the
same equi-joins shuffle.

Host rules: (host, path, verdict). A rule fits its host and all subdomains, if
the URL's path starts with the rule's; the longest rule wins (host length, then
path length, then the rule's text). They are found by an equi-join: every host
suffix at a label border is looked up, never every rule against every URL.

Pattern rules: a regular expression and its spellings, each with the literal
tokens that every match in this spelling must hold (check_patterns compares them
with the regular expression). The index maps each spelling of a rule to the one
of its tokens that is rarest in the URLs at hand; a URL's tokens fetch the rules,
and only those run their regular expression. They decide where no host rule does:
block if one matches.

Defined cases: null URL, or one without "://": host and path are empty, no
rule, verdict "allow". Repeated rows stay, one result each; ties between
matching pattern rules don't matter, as all block. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict)
HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Host names of these two parts, with or without a hyphen between them, are blocked.
FIRST = ["spam", "cheap", "casino", "free", "adult", "ads", "fake", "click", "lucky", "easy", "fast", "bonus", "poker", "loan", "crypto", "prize", "viral", "pirate", "replica", "hot"]
SECOND = ["farm", "pills", "win", "bets", "x", "track", "clicks", "cash", "coins", "deals", "games", "links"]


def pair_rule(first: str, second: str) -> tuple[str, list[list[str]], str]:
    return f"{first}-{second}", [[first, second], [first + second]], rf"://([^/?#]*[.-])?{first}-?{second}[.-]"


#: (name, spellings: literal tokens that a match must hold, regular expression on the lower-cased URL)
PATTERN_RULES = [pair_rule(a, b) for a in FIRST for b in SECOND]

#: A rule list of more rows than this is not broadcast.
BROADCAST_RULES = 20_000


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _maybe_broadcast(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RULES else df


_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _ends(char: str) -> bool:
    return char.isascii() and not char.isalnum()


def _ways(parsed) -> list[list[str | None]]:
    """The sequences of pieces that match a parsed regular expression: a character, "" for one that ends a token, None for anything else."""
    out: list[list[str | None]] = [[]]
    for op, arg in parsed:
        if op is rc.LITERAL:
            some = [[chr(arg) if chr(arg) in _TOKEN else "" if _ends(chr(arg)) else None]]
        elif op is rc.IN and all(o is rc.LITERAL and _ends(chr(a)) for o, a in arg):
            some = [[""]]
        elif op is rc.SUBPATTERN and not arg[1] and not arg[2]:
            some = _ways(arg[3])
        elif op is rc.BRANCH:
            some = [w for b in arg[1] for w in _ways(b)]
        elif op is rc.MAX_REPEAT and arg[:2] == (0, 1):
            some = [[], *_ways(arg[2])]
        else:
            some = [[None]]
        out = [a + b for a in out for b in some]
    return out


def required_tokens(regex: str) -> list[set[str]]:
    """For each way to match, tokens of the URL that it must hold: its runs of letters and digits between two characters that end a token."""
    found = []
    for way in _ways(rp.parse(regex)):
        tokens, run = set(), None
        for piece in way:
            if piece:
                run = None if run is None else [*run, piece]
            else:
                if run and piece == "":
                    tokens.add("".join(run))
                run = [] if piece == "" else None
        found.append(tokens)
    return found


def check_patterns(patterns: Sequence) -> None:
    """Every way to match a rule's regular expression must hold all tokens of one of its spellings, or the index would miss it."""
    for name, spellings, regex in patterns:
        for tokens in required_tokens(regex):
            if not any(s and tokens.issuperset(s) for s in spellings):
                raise ValueError(f"rule {name}: a match of {regex} need hold no spelling of {spellings}, only {sorted(tokens)}")


def pattern_index(urls: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """(token, rule, regex): each spelling of a rule under the one of its tokens that fewest URLs hold."""
    tokens = patterns.select("rule", "regex", F.posexplode("spellings").alias("spelling", "tokens")).select("rule", "regex", "spelling", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).join(_maybe_broadcast(tokens.select("token").distinct(), n), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min_by(F.struct("token", "regex"), F.struct(F.coalesce("n", F.lit(0)), "token"))
    return tokens.join(seen, "token", "left").groupBy("rule", "spelling").agg(rarest.alias("r")).select("r.token", "rule", "r.regex")


def filter_urls(pages: DataFrame, key: str, url: str, host_rules: Sequence = HOST_RULES, patterns: Sequence = PATTERN_RULES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, and `pattern`, the first pattern rule that matched."""
    check_patterns(patterns)
    spark = pages.sparkSession
    rules = spark.createDataFrame(list(host_rules), "rule_host string, rule_path string, rule_verdict string")
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path"))
    regexes = spark.createDataFrame(list(patterns), "rule string, spellings array<array<string>>, regex string")

    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wins = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule_host"), F.length("rule_path"), F.col("rule")))
    fits = (
        urls.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
        .join(_maybe_broadcast(rules, len(host_rules)), "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path").agg(wins.alias("won"))
    )

    tokenised = urls.select("url").where(F.col("url").contains("://")).distinct().withColumn("tokens", F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+")))
    hits = (
        tokenised.select("url", F.explode("tokens").alias("token"))
        .join(_maybe_broadcast(pattern_index(tokenised, regexes, len(patterns)), len(patterns)), "token")
        .where(F.expr("lower(url) rlike regex"))
        .groupBy("url").agg(F.min("rule").alias("pattern"))
    )
    out = urls.join(fits, ["host", "path"], "left").join(hits, "url", "left")
    verdict = F.coalesce("won.rule_verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("won.rule").alias("rule"), verdict.alias("verdict"), "pattern")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), "page_id", "url")


_ANY = rf"://([^/?#]*[.-])?({'|'.join(FIRST)})-?({'|'.join(SECOND)})[.-]"
ORACLE = f"""
WITH u AS (
  SELECT page_id, url, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw_host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
h AS (SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
rules(rule_host, rule_path, v) AS (VALUES {", ".join(str(r) for r in HOST_RULES)}),
m AS (
  SELECT h.page_id, h.url, h.host, h.path, r.rule_host || r.rule_path AS rule, r.v,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)),
fetched AS (SELECT DISTINCT url FROM pages WHERE regexp_matches(lower(url), '{_ANY}')),
hits AS (SELECT url, min(name) AS pattern FROM fetched, (VALUES {", ".join(f"('{n}', '{r}')" for n, _, r in PATTERN_RULES)}) q(name, re) WHERE regexp_matches(lower(url), re) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern FROM m LEFT JOIN hits ON m.url = hits.url WHERE k = 1
"""
