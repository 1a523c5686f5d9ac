"""URL filters: pattern rules looked up by their rarest literal token.

A rule is text: ``||host/path`` (the host and its subdomains, the path's
beginning) or a pattern with ``*`` for anything and ``^`` for a separator or the
end, which may stand anywhere in the URL. Every rule is filed under one literal
token that any matching URL must hold, the one that fewest URLs hold. A URL's
tokens fetch candidate rules, and only those run their regular expression.

All work is DataFrame expressions. URLs are judged once per distinct text, so a
page repeated a million times is one lookup.

Defined results: null URLs, and those without ``://``, have empty host and path
and can only match plain patterns; a null URL matches nothing. Rules without a
usable token are filed under the empty token, which every URL holds. Equal rules
may be repeated. An empty rule table allows everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii

TOKEN = "[a-z0-9]+"


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def literal_regex(text: Column) -> Column:
    """A regular expression for a rule's text: ``*`` anything, ``^`` a separator or the end."""
    quoted = F.regexp_replace(text, r"([\\.+?()\[\]{}|$\-])", r"\\$1")
    return F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^A-Za-z0-9_.%-]|$)"))


def compiled(rules: DataFrame) -> DataFrame:
    """rule, verdict, anchored, regex, tokens of rules (rule, verdict).

    A token is sure to stand alone in a matching URL if a literal other than a
    letter or digit stands on both sides of it; the start of a host counts.
    """
    anchored = F.col("rule").startswith("||")
    # Hosts are compared in lower case, so a rule's is lowered too; its path stays.
    host = lower_ascii(F.regexp_extract("rule", r"^\|\|([^/]*)", 1))
    body = F.when(anchored, F.concat(host, F.regexp_extract("rule", r"(?s)^\|\|[^/]*(.*)\z", 1))).otherwise(F.col("rule"))
    head = F.when(anchored, F.lit(".")).otherwise(F.lit(""))
    framed = F.concat(head, lower_ascii(body))
    # The look-around leaves out tokens beside a wildcard or at an open end.
    tokens = F.regexp_extract_all(framed, F.lit(rf"(?<=[^a-z0-9*])({TOKEN})(?=[^a-z0-9*])"), F.lit(1))
    prefix = F.when(anchored, F.lit(r"(?s)^(?:[^/]*\.)?")).otherwise(F.lit("(?s)"))
    return rules.where(F.col("rule").isNotNull()).dropDuplicates(["rule", "verdict"]).select(
        "rule", "verdict", anchored.alias("anchored"), F.concat(prefix, literal_regex(body)).alias("regex"),
        tokens.alias("tokens"),
    )


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, and the empty one."""
    found = F.regexp_extract_all(lower_ascii(url), F.lit(f"({TOKEN})"), F.lit(1))
    return F.array_distinct(F.array_append(found, F.lit("")))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """token, rule, verdict, anchored, regex: each rule once, under its rarest token in ``urls``."""
    parsed = compiled(rules)
    listed = parsed.select("rule", "verdict", F.explode_outer("tokens").alias("token"))
    wanted = listed.where(F.col("token").isNotNull()).select("token").distinct()
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(wanted, "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("urls"))
    ranked = listed.join(counts, "token", "left").groupBy("rule", "verdict").agg(
        F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best")
    )
    chosen = ranked.select("rule", "verdict", F.coalesce(F.col("best.token"), F.lit("")).alias("token"))
    return chosen.join(parsed.drop("tokens"), ["rule", "verdict"])


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of every rule that fits, for distinct non-null ``urls`` (url)."""
    known = urls.where(F.col("url").isNotNull())
    held = known.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    subject = F.when(F.col("anchored"), F.concat(url_host(F.col("url")), url_path(F.col("url")))).otherwise(F.col("url"))
    candidates = held.join(rule_index(known, rules), "token").withColumn("subject", subject)
    return candidates.where(F.expr("rlike(subject, regex)")).select("url", "rule", "verdict")


def judged_urls(
    pages: DataFrame, host_rules: DataFrame, patterns: DataFrame, default: str = "allow", url_col: str = "url"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Of ``host_rules`` (rule like ``example.com/en/``, verdict) the longest that
    fits decides. Without one, ``patterns`` (rule, verdict) decide: an allowing
    pattern outweighs a blocking one, and without either ``default`` holds.
    """
    names = pages.columns
    host, path, rule, verdict, key = (free_name(n, names) for n in ("host", "path", "rule", "verdict", "__url"))
    urls = pages.select(F.col(url_col).alias("url")).distinct()
    hosts = host_rules.select(F.concat(F.lit("||"), "rule").alias("rule"), F.concat(F.lit("host:"), "verdict").alias("verdict"))
    fits = matching_rules(urls, hosts.unionByName(patterns.select("rule", "verdict")))
    # One comparable text a rule: host rules by length, then patterns, allowing ones first.
    by_host = F.col("verdict").startswith("host:")
    rank = F.when(by_host, F.lit(1_000_000) + F.length("rule")).when(F.col("verdict") == "allow", 2).otherwise(1)
    best = fits.groupBy("url").agg(F.max(F.struct(
        rank.cast("long").alias("rank"), F.when(by_host, F.expr("substring(rule, 3)")).alias("rule"),
        F.regexp_replace("verdict", "^host:", "").alias("verdict"),
    )).alias("best"))
    right = best.select(F.col("url").alias(key), F.col("best.rule").alias(rule), F.col("best.verdict").alias(verdict))
    return pages.join(right, pages[url_col] == right[key], "left").select(
        *[pages[n] for n in names], url_host(pages[url_col]).alias(host), url_path(pages[url_col]).alias(path),
        right[rule], F.coalesce(right[verdict], F.lit(default)).alias(verdict),
    )
