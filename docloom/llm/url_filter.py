"""URL filters: listed rules first, then a tree of path templates.

A rule names a host and the beginning of a path; it fits the host, all of its
subdomains, and every path with that beginning; the longest rule that fits
decides. Other urls are judged by their template. Per host, path segments with a
digit become wildcards. From the first segment down, sibling branches (nodes
below one node) become one wildcard if there are more than FAN_OUT of them, and
are merged if they are statistically similar, with all below them, so the
children of merged branches become siblings in turn. A branch is similar to its
siblings if the share of its pages in each child lies within Hoeffding's bound
of the share among all of them (two proportions at level LEVEL, as when states
of a prefix tree are merged), and if its share of blocked pages, where it has
labels, lies within two standard errors of all of theirs. Pages that a rule
decides are the labels: a template's purity is the smoothed share of blocked
pages among its labelled ones. So a folder without labels takes on those of the
folders that are built like it. A template pools the labels of those merged with
it, but where its own labels differ from theirs by more than two standard errors
its own count alone. Templates of purity REJECT or more are blocked.

All is DataFrame code: templates are counted before anything is exploded, so a
host with most pages is no hot spot. Null urls, and urls without ://, have an
empty host and path. Repeated rows are judged alike; empty tables give no rows;
urls of any length are judged whole. Only page_id and url are read. The rules are
a parameter, compiled to one expression (MAX_RULES at most).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import scratch

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
FAN_OUT, LEVEL, PRIOR, STRENGTH, REJECT = 50, 0.05, 0.25, 4, 0.8
MAX_RULES = 500
MERGED, END = "/", "//"  # no segment holds a slash


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))


def fits(rule: str) -> Column:
    """Whether the rule, a host and the beginning of a path, fits columns host and path."""
    name, _, path = rule.partition("/")
    on_host = (F.col("host") == name) | F.col("host").endswith("." + name)
    return on_host & F.col("path").startswith("/" + path)


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """With rule (the longest that fits, or null) and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule, verdict = F.when(fits(text), F.lit(text)).otherwise(rule), F.when(fits(text), F.lit(what)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def segments() -> Column:
    """Segments of column path, those with a digit as *."""
    raw = F.filter(F.split("path", "/"), lambda s: s != "")
    return F.transform(raw, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))


def alike() -> Column:
    """Whether bad of labelled lies within two standard errors of all_bad of all_labelled."""
    bad, n, all_bad, all_n = (F.col(c).cast("double") for c in ("bad", "labelled", "all_bad", "all_labelled"))
    gap = bad * all_n - all_bad * n
    return gap * gap <= 4 * all_bad * (all_n - all_bad) * n


def apart(share: Column, n: Column, of: Column, all_n: Column) -> Column:
    """Whether two shares, of n and of all_n pages, differ by more than Hoeffding's bound."""
    return F.abs(share - of) > math.sqrt(0.5 * math.log(2 / LEVEL)) * (1 / F.sqrt(n) + 1 / F.sqrt(all_n))


def unlike(here: DataFrame) -> DataFrame:
    """(host, parent, segment) of the branches whose pages fall into children otherwise than those of all their siblings."""
    key = ["host", "parent", "segment"]
    kids = here.groupBy(*key, "child").agg(F.sum("pages").alias("c"))
    each = here.groupBy(*key).agg(F.sum("pages").alias("n"))
    total = each.groupBy("host", "parent").agg(F.sum("n").alias("all_n"))
    pool = kids.groupBy("host", "parent", "child").agg(F.sum("c").alias("all_c")).join(total, ["host", "parent"]).withColumn("of", F.col("all_c") / F.col("all_n"))
    present = kids.join(each, key).join(pool, ["host", "parent", "child"]).where(apart(F.col("c") / F.col("n"), F.col("n"), F.col("of"), F.col("all_n"))).select(*key)
    # a child that a branch lacks counts if its share is large; few are large enough for any branch, as shares sum to one
    large = pool.where(apart(F.lit(0.0), F.col("all_n"), F.col("of"), F.col("all_n")))
    absent = each.join(large, ["host", "parent"]).where(apart(F.lit(0.0), F.col("n"), F.col("of"), F.col("all_n"))).join(kids.select(*key, "child"), [*key, "child"], "left_anti").select(*key)
    return present.unionByName(absent).distinct()


def merged(leaves: DataFrame) -> DataFrame:
    """Leaves (host, form, bad, labelled, pages) with branch: their segments, MERGED for those of merged siblings, * for those of many."""
    now, place = leaves.withColumn("branch", F.split("form", "/")), 0
    key = ["host", "parent", "segment"]
    while True:
        nodes = now.select("host", "branch", F.explode(F.sequence(F.lit(1), F.size("branch"))).alias("place")).where(F.col("place") > place)
        nodes = nodes.select("host", "place", F.expr("slice(branch, 1, place - 1)").alias("parent"), F.expr("branch[place - 1]").alias("segment")).distinct()
        siblings = scratch(nodes.groupBy("host", "place", "parent").agg(F.count("*").alias("k")).where("k >= 2"), "siblings")
        place = siblings.agg(F.min("place")).first()[0]
        if place is None:  # no siblings below the last place
            return now
        star = siblings.where((F.col("place") == place) & (F.col("k") > FAN_OUT)).select("host", "parent", F.lit("*").alias("star"))
        here = now.withColumn("parent", F.slice("branch", 1, place - 1)).withColumn("segment", F.get("branch", F.lit(place - 1))).withColumn("child", F.coalesce(F.get("branch", F.lit(place)), F.lit(END)))
        here = scratch(here.join(star, ["host", "parent"], "left").withColumn("segment", F.when(F.col("segment").isNotNull(), F.coalesce("star", "segment"))).drop("star"), f"place{place}")
        inner = here.where("segment is not null")
        each = inner.groupBy(*key).agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
        pools = each.groupBy("host", "parent").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"), F.count("*").alias("k")).where("k >= 2")
        same = each.join(pools, ["host", "parent"]).where(alike()).join(unlike(inner), key, "left_anti").select(*key, F.lit(MERGED).alias("same"))
        branch = F.transform("branch", lambda s, i: F.when(i == place - 1, F.coalesce("same", "segment")).otherwise(s))
        now = scratch(here.join(same, key, "left").select(*leaves.columns, branch.alias("branch")), f"branches{place}")


def templates(pages: DataFrame) -> DataFrame:
    """host, form (segments joined by /), template (** for merged segments), and the template's verdict, from pages with rules."""
    counted = pages.groupBy("host", "form").agg(F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"), F.count("ruled").alias("labelled"), F.count("*").alias("pages"))
    leaves = merged(scratch(counted, "templates"))
    pools = leaves.groupBy("host", "branch").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    judged = leaves.join(pools, ["host", "branch"]).withColumn("similar", alike())
    pooled = judged.join(judged.where("similar").groupBy("host", "branch").agg(F.sum("bad").alias("m_bad"), F.sum("labelled").alias("m_n")), ["host", "branch"], "left")
    b = F.when(F.col("similar"), F.col("m_bad")).otherwise(F.col("bad"))
    m = F.when(F.col("similar"), F.col("m_n")).otherwise(F.col("labelled"))
    purity = (b + PRIOR * STRENGTH) / (m + STRENGTH)
    template = F.array_join(F.transform("branch", lambda s: F.when(s == MERGED, F.lit("**")).otherwise(s)), "/")
    return pooled.select("host", "form", template.alias("template"), F.when(purity >= REJECT, "block").otherwise("allow").alias("by_template"))


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row."""
    all_pages = ruled(parsed(pages), rules).withColumn("form", F.array_join(segments(), "/"))
    known = templates(all_pages)
    return all_pages.join(known, ["host", "form"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_template", F.lit("allow")).alias("verdict"), "template")
