"""URL filters as a sort-merge range join, in DataFrame and window functions alone.

A host's canonical key is its labels from the last to the first, each followed by a dot, so a
rule's host is a prefix of the keys of the host and its subdomains, which makes the rule the
interval [key, key + highest character). The rules' interval ends and the hosts' keys are sorted
together and swept once: a rule's start pushes it on the stack of active nested rules, its end
pops it, and a host finds on the stack all rules that enclose it. Of these, the longest one whose
path the url's path starts with decides.

Prefix intervals nest or are disjoint, so the stack after each event is known from the rule
alone: the rule and the rules on its shorter prefixes. Each event therefore carries its stack,
and the sweep is `last(stack)` over the sorted order. The sorted keys are dealt to tasks by ranges
of about equal size, wherever they begin, so a domain with most of the hosts is dealt to many
tasks; the stack of the last event before a range is carried into it. Each distinct host is swept once,
however many urls name it, and urls are joined with the hosts that have rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .common import col, unused

# The base rules as (verdict, host and path).
RULES: list[tuple[str, str]] = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
# The method's own rules, which decide where no base rule fits; anything else is allowed.
METHOD_RULES: list[tuple[str, str]] = [
    ("block", "adult/"),
    ("block", "bet/"),
    ("block", "casino/"),
    ("block", "poker/"),
    ("block", "porn/"),
    ("block", "sex/"),
    ("block", "xxx/"),
    ("block", "doubleclick.net/"),
    ("block", "googlesyndication.com/"),
    ("block", "googletagmanager.com/"),
    ("block", "google-analytics.com/"),
    ("block", "bit.ly/"),
    ("block", "t.co/"),
    ("block", "wordpress.com/wp-login"),
    ("block", "wordpress.com/wp-admin/"),
]
#: Sorts after every character of a key.
HIGH = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _labels(key: Column) -> Column:
    return F.split(F.substring(key, F.lit(1), F.char_length(key) - 1), r"\.", -1)


def _prefix(key: Column, n: Column) -> Column:
    """The first n labels of a key."""
    return F.concat(F.array_join(F.slice(_labels(key), F.lit(1), n), "."), F.lit("."))


def _events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack) for each start (kind 0) and end (kind 1) of a distinct rule host."""
    parts = rules.select(F.regexp_extract("rule", r"(?s)^[^/]*", 0).alias("host"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)", 1).alias("path"), "rule", "verdict", "base")
    at = parts.select(host_key(F.col("host")).alias("key"), F.struct("base", F.char_length("rule").alias("n"), "rule", "path", "verdict").alias("r"))
    hosts = at.groupBy("key").agg(F.collect_set("r").alias("own"))
    above = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(_labels(F.col("key")))), lambda n: _prefix(F.col("key"), n))).alias("up"))
    stacks = above.join(hosts.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own")))).alias("outside"),
    )
    starts = stacks.select("key", F.lit(0).alias("kind"), F.col("inside").alias("stack"))
    return starts.unionByName(stacks.select(F.concat("key", F.lit(HIGH)).alias("key"), F.lit(1).alias("kind"), F.col("outside").alias("stack")))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, active): for each distinct host that has any, the rules whose host encloses it."""
    # kind 2 sorts a host after a start at its own key; the highest character puts ends behind all subdomains
    keys = hosts.select("host").distinct().select("host", host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"))
    both = keys.unionByName(_events(rules), allowMissingColumns=True).repartitionByRange("key", "kind")
    dealt = keep(both.withColumn("part", F.spark_partition_id()), "host-keys")  # ranges stay as they are written
    last = dealt.where(F.col("stack").isNotNull()).groupBy("part").agg(F.max_by("stack", F.struct("key", "kind")).alias("stack"))
    parts = dealt.select("part").distinct().join(last, "part", "left")  # a row for each range
    carried = parts.select("part", F.last("stack", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("active", F.last("stack", ignorenulls=True).over(order)).where("kind = 2").join(carried, "part")
    return swept.select("host", F.coalesce("active", "carried").alias("active")).where(F.size("active") > 0)


def rule_table(like: DataFrame) -> DataFrame:
    """The base rules and the method's own as (rule, verdict, base)."""
    rows = [(r, v, True) for v, r in RULES] + [(r, v, False) for v, r in METHOD_RULES]
    return like.sparkSession.createDataFrame(rows, "rule string, verdict string, base boolean")


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, url: str = "url") -> DataFrame:
    """All columns of pages with host, path, rule, verdict, method_verdict.

    rules: (rule, verdict, base), a rule being host, then a path from its first slash on, of any
    number. rule is the longest base rule that fits (null: none) and verdict is its verdict;
    method_verdict is that of the longest other rule, or allow, and counts where no base rule fits.
    Rules of equal text count once, block before allow. A null url or one without :// has an empty
    host and path. Rows are judged one by one, so repeats and null ids stay; an empty table gives
    no rows. Columns of pages that bear the names of the results are replaced; other names don't matter.
    """
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "method_verdict")]
    host, path, active, base, other, key = unused(pages.select(*[col(c) for c in rest]), "own_host", "own_path", "active", "base", "other", "join_host")
    urls = pages.select(*[col(c) for c in rest], host_of(col(url)).alias(host), path_of(col(url)).alias(path))
    found = active_rules(urls.select(F.col(host).alias("host")), rule_table(pages) if rules is None else rules)
    judged = urls.join(found.select(F.col("host").alias(key), F.col("active").alias(active)), F.col(host) == F.col(key), "left")

    def best(wanted: Column) -> Column:
        fits = F.filter(active, lambda r: F.startswith(F.col(path), r["path"]) & (r["base"] == wanted))
        return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), (r["verdict"] == "block").alias("block"), r["verdict"].alias("verdict"))))

    judged = judged.select(*[col(c) for c in rest], host, path, best(F.lit(True)).alias(base), best(F.lit(False)).alias(other))
    method = F.coalesce(F.col(other)["verdict"], F.lit("allow"))
    return judged.select(
        *[col(c) for c in rest], F.col(host).alias("host"), F.col(path).alias("path"), F.col(base)["rule"].alias("rule"),
        F.coalesce(F.col(base)["verdict"], method).alias("verdict"), method.alias("method_verdict"),
    )
