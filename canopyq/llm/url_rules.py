"""URL filters by pattern rules that are indexed by their rarest literal token.

Every rule names the literal tokens that a URL must hold for its regular
expression to match.  The index keeps a rule under the one token that is rarest
in the URLs themselves.  A URL is cut into tokens, its tokens fetch candidate
rules from the index, and only those candidates run regular expressions.  All
of it is built-in functions.  An index of up to IN_PLAN tokens is part of one
projection, which needs no shuffle; a larger one is a table that the URLs' tokens
join (Spark broadcasts it if its size allows), and the verdicts of the few URLs
with a candidate join the pages.  Both give the same rows.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and gets the default verdict.  Very long URLs, and any
characters in them, line breaks too, are judged whole.  Repeated rows are judged
each for itself; extra columns are kept unless they clash with the result's names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import shared_checkpoint

#: Tokens of an index that is held in the plan.
IN_PLAN = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """regex is matched on host + # + path, neither of which can hold a #; tokens: ``h:`` and ``p:`` literals that it needs."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool
    length: int


def domain_rule(action: str, host: str, path: str) -> UrlRule:
    """Fits the host and its subdomains, where the path starts with path; the longest such rule wins."""
    cut = re.split(r"[^0-9A-Za-z]+", path)
    tokens = [f"h:{t}" for t in re.split(r"[^0-9a-z]+", host) if t] + [f"p:{t}" for t in cut[:-1] if t]
    return UrlRule(host + path, action, rf"^(?:[^#]*\.)?{re.escape(host)}#{re.escape(path)}", tuple(tokens), True, len(host + path))


def pattern_rule(action: str, name: str, regex: str, *tokens: str) -> UrlRule:
    """A rule of the method's own: decides only where no domain rule fits."""
    return UrlRule(name, action, regex, tokens, False, len(name))


def host_word(action: str, word: str) -> UrlRule:
    """Fits hosts with this word between dots, hyphens and the ends."""
    return pattern_rule(action, word, rf"^(?:[^#]*[.-])?{word}(?:[.-][^#]*)?#", f"h:{word}")


def path_end(action: str, ending: str) -> UrlRule:
    """Fits paths that end in a dot and this."""
    return pattern_rule(action, f".{ending}", rf"\.{ending}\z", f"p:{ending}")


#: Words in a host that tell of pages not worth reading: gambling, adult pages, drug shops, advertising and tracking, pirated and malicious files.
HOST_WORDS = (
    "casino", "casinos", "poker", "roulette", "bets", "betting", "jackpot", "lottery",
    "adult", "porn", "xxx", "escort", "webcams",
    "pills", "viagra", "cialis", "pharmacy",
    "ad", "ads", "adserver", "banner", "banners", "clicks", "popup", "spam", "telemetry", "track", "tracker", "tracking",
    "crack", "keygen", "malware", "phishing", "torrent", "torrents", "warez",
)
#: Endings of files that are no pages.
FILE_ENDINGS = ("apk", "bin", "dmg", "exe", "iso", "msi", "torrent")
#: Places on a host that hold no text: scripts, log-ins, carts, counting pixels; and hosts in punycode.
PLACES = (
    ("cgi-bin", r"#/cgi-bin/", "p:cgi", "p:bin"),
    ("wp-admin", r"#(?:/[^#]*)?/wp-admin(?:/|\z)", "p:wp", "p:admin"),
    ("wp-login", r"#(?:/[^#]*)?/wp-login\.php\z", "p:wp", "p:login"),
    ("signin", r"#(?:/[^#]*)?/signin(?:/|\z)", "p:signin"),
    ("cart", r"#(?:/[^#]*)?/cart(?:/|\z)", "p:cart"),
    ("pixel.gif", r"/pixel\.gif\z", "p:pixel", "p:gif"),
    ("punycode", r"^(?:[^#]*\.)?xn--[^#]*#", "h:xn"),
)


def own_rules() -> list[UrlRule]:
    """The method's own rules; each of them blocks."""
    return [host_word("block", w) for w in HOST_WORDS] + [path_end("block", e) for e in FILE_ENDINGS] + [pattern_rule("block", *p) for p in PLACES]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens of a URL, marked by where they stand."""
    cut = lambda c, mark, pattern: F.transform(F.filter(F.split(c, pattern), lambda t: t != ""), lambda t: F.concat(F.lit(mark), t))
    return F.array_distinct(F.concat(cut(host, "h:", r"[^0-9a-z]+"), cut(path, "p:", r"[^0-9A-Za-z]+")))


def token_counts(urls: DataFrame, rules: list[UrlRule]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules: at most one row per such token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    host, path = split_url(F.col("url"))
    tokens = url_tokens(host, path)
    if len(wanted) <= IN_PLAN:
        rows = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("t"))
    else:
        rows = urls.select(F.explode(tokens).alias("t")).join(urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string"), "t")
    return {t: 0 for t in wanted} | {r["t"]: r["count"] for r in rows.groupBy("t").count().collect()}


def build_index(rules: list[UrlRule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token -> rules kept under it, and the rules without any literal token."""
    index: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(i)
        else:
            always.append(i)
    return index, always


RULE = "listed int, length int, order int, name string, action string, regex string"


def _row(i: int, r: UrlRule) -> tuple:
    """Listed rules come before the method's own, then longer names, then earlier rules."""
    return int(r.listed), r.length, -i, r.name, r.action, r.regex


def _literal(row: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(c.split()[0]) for v, c in zip(row, RULE.split(", "))])


def _in_plan(pages: DataFrame, rows: list[tuple], index: dict[str, list[int]], always: list[int]) -> DataFrame:
    """pages with _best and n_candidates: everything in one projection."""
    table, keys = F.array(*map(_literal, rows)), F.array(*map(F.lit, index))
    held = F.array(*[F.array(*map(F.lit, v)) for v in index.values()])
    fetched = F.array().cast("array<int>")
    if index:
        fetched = F.flatten(F.transform(F.array_intersect(url_tokens(F.col("host"), F.col("path")), keys), lambda t: F.get(held, F.array_position(keys, t).cast("int") - 1)))
    if always:
        fetched = F.concat(fetched, F.array(*map(F.lit, always)))
    text = F.concat(F.col("host"), F.lit("#"), F.col("path"))
    pages = pages.withColumn("_rules", F.transform(fetched, lambda i: F.get(table, i)))
    best = F.array_max(F.filter(F.col("_rules"), lambda r: F.regexp_like(text, r["regex"])))
    return pages.withColumn("_best", best).withColumn("n_candidates", F.size("_rules")).drop("_rules")


def _by_join(pages: DataFrame, rows: list[tuple], index: dict[str, list[int]], always: list[int]) -> DataFrame:
    """The same by a table of rules that the URLs' tokens join."""
    names = [c.split()[0] for c in RULE.split(", ")]
    rules = pages.sparkSession.createDataFrame([(token, *rows[i]) for token, held in index.items() for i in held], f"_token string, {RULE}")
    text = F.concat(F.col("host"), F.lit("#"), F.col("path"))
    met = pages.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("_token")).join(rules, "_token")
    fits = F.when(F.regexp_like(text, F.col("regex")), F.struct(*names))
    # written, so that the join below stands on exchanges and a frequent URL can be split at run time
    found = shared_checkpoint(met.groupBy("host", "path").agg(F.max(fits).alias("_found"), F.count_distinct("order").cast("int").alias("_n")))
    found = found.withColumnsRenamed({"host": "_host", "path": "_path"})
    pages = pages.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    rest = [F.when(F.regexp_like(text, F.lit(rows[i][-1])), _literal(rows[i])) for i in always]
    best = F.array_max(F.array("_found", *rest))
    return pages.withColumn("_best", best).withColumn("n_candidates", F.coalesce("_n", F.lit(0)) + len(always)).drop("_found", "_n", "_host", "_path")


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the domain rule that decided, else null), verdict and n_candidates."""
    names = ("host", "path", "rule", "verdict", "n_candidates", "_host", "_path")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in names])
    host, path = split_url(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "n_candidates": F.lit(0)})
    index, always = build_index(rules, token_counts(pages.select("url"), rules))
    rows = [_row(i, r) for i, r in enumerate(rules)]
    pages = (_in_plan if len(index) <= IN_PLAN and len(rules) <= IN_PLAN else _by_join)(pages, rows, index, always)
    rule = F.when(F.col("_best.listed") == 1, F.col("_best.name"))
    return pages.withColumns({"rule": rule, "verdict": F.coalesce(F.col("_best.action"), F.lit(default))}).select(*[c for c in pages.columns if c not in ("_best", "n_candidates")], "rule", "verdict", "n_candidates")
