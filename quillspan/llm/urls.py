"""URL filters by rules indexed under their rarest literal token, in DataFrame functions alone.

A rule is a regular expression over host and path with literal tokens that any URL it matches must
have (whole stretches between dots and slashes). Spark counts how many URLs have each token and files
each rule under the rarest of its own. A URL's tokens fetch the rules filed under them, and only those
rules run their expressions on it.

Site rules (host, path) fit the host and its subdomains where the path starts with the rule's; the
longest wins. Where none fits, pattern rules decide: block if any matches, else allow.

Cases: a null URL, or one without ``://``, has an empty host and path and is allowed; a rule without
tokens is filed under the empty token, which every URL has; rules of one length that fit alike: the
one that sorts last; repeated rows and ids keep a row each; very long URLs are judged whole; an empty table of URLs gives an
empty table, an empty one of rules allows all; other columns are ignored. Rules are a parameter: lists, or a table of any
size (``rules_table`` tells its columns). Up to ``SHARED_RULES`` of them, counted first, are shared with every task; more are joined by a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules up to which they are shared with every task.
SHARED_RULES = 50_000

#: Site rules (verdict, host and path).
SITES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

#: Pattern rules (expression over host and path, literal tokens of all it matches).
PATTERNS = [
    (r"^(?:[^/]*\.)?spam-farm\.", ["spam-farm"]),
    (r"^(?:[^/]*\.)?casino\.", ["casino"]),
    (r"^(?:[^/]*\.)?adserver\.", ["adserver"]),
    (r"^(?:[^/]*\.)?doubleclick\.net(?:/|$)", ["doubleclick", "net"]),
    (r"/wp-login\.php$", ["wp-login", "php"]),
    (r"/cgi-bin/", ["cgi-bin"]),
    (r"/(?:[^/]*/)*viagra(?:/|$)", ["viagra"]),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased. Empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end. Empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_expression(site: str) -> str:
    return r"^(?:[^/]*\.)?" + "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in site)


def site_tokens(site: str) -> list[str]:
    """Tokens that end in the rule itself: the last stretch of a path may go on in the URL."""
    host, slash, path = site.partition("/")
    whole = path.split("/")[:-1] if slash else []
    return [t for t in [*host.split("."), *whole] if t]


def tokens(where: Column) -> Column:
    return F.array_distinct(F.concat(F.split(where, r"[./]"), F.array(F.lit(""))))


def rules_table(pages: DataFrame, sites: list[tuple[str, str]], patterns: list[tuple[str, list[str]]]) -> DataFrame:
    """Rules as a table: ``rule`` (of a site rule, else null), ``verdict``, ``expression``, ``literal`` (its tokens) and ``size`` (the greatest wins)."""
    rows = [(site, verdict, site_expression(site), site_tokens(site), len(site)) for verdict, site in sites]
    rows += [(None, "block", expression, literal, 0) for expression, literal in patterns]
    for _, _, expression, _, _ in rows:
        re.compile(expression)
    strings = lambda t: F.array(*map(F.lit, t)) if t else F.array().cast("array<string>")
    listed = [F.struct(F.lit(r).cast("string").alias("rule"), F.lit(v).alias("verdict"), F.lit(e).alias("expression"), strings(t).alias("literal"), F.lit(size).alias("size")) for r, v, e, t, size in rows]
    one = pages.sparkSession.range(1 if rows else 0)
    empty = F.expr("array(named_struct('rule', '', 'verdict', '', 'expression', '', 'literal', array(''), 'size', 0))")
    return one.select(F.explode(F.array(*listed) if rows else empty).alias("r")).select("r.*")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", sites: list[tuple[str, str]] = SITES, patterns: list[tuple[str, list[str]]] = PATTERNS, rules: DataFrame | None = None) -> DataFrame:
    """A row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (the site rule that wins, else null), ``verdict``
    and ``candidates`` (how many rules were tried). ``rules``, if given, is used in place of ``sites`` and ``patterns``.
    """
    urls = pages.select(F.monotonically_increasing_id().alias("row"), pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    urls = urls.withColumn("where", F.concat("host", "path"))
    given = rules_table(pages, sites, patterns) if rules is None else rules
    n_rules = len(sites) + len(patterns) if rules is None else rules.count()
    shared = F.broadcast if n_rules <= SHARED_RULES else lambda df: df
    given = given.select("rule", "verdict", "expression", F.when(F.size("literal") > 0, F.col("literal")).otherwise(F.array(F.lit(""))).alias("literal"), "size")
    given = given.withColumn("n", F.xxhash64("rule", "verdict", "expression", "size"))
    literal = given.select("n", F.explode("literal").alias("token")).distinct()
    # how many URLs have each token that rules have
    seen = urls.select(F.explode(tokens(F.col("where"))).alias("token")).join(shared(literal.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = Window.partitionBy("n").orderBy(F.coalesce("urls", F.lit(0)), "token")
    filed = literal.join(seen, "token", "left").withColumn("place", F.row_number().over(rarest)).where("place = 1").select("n", "token")
    index = given.drop("literal").distinct().join(filed, "n")
    tried = urls.withColumn("token", F.explode(tokens(F.col("where")))).join(shared(index), "token", "left")
    fits = tried.withColumn("fits", F.coalesce(F.expr("where rlike expression"), F.lit(False)))
    site = F.when(F.col("fits") & F.col("rule").isNotNull(), F.struct("size", "rule", "verdict"))
    judged = fits.groupBy("row", "page_id", "host", "path").agg(F.max(site).alias("site"), F.bool_or(F.col("fits") & F.col("rule").isNull()).alias("matched"), F.count("n").alias("candidates"))
    verdict = F.coalesce(F.col("site.verdict"), F.when(F.col("matched"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("site.rule").alias("rule"), verdict.alias("verdict"), "candidates")
