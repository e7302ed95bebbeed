"""URL filters: rules of hosts and paths, and a path-template tree for what no rule judges.

`grow` learns a tree per host, a level of path segments a round, over the host's
different paths. Under a node a segment that a share SHARE of its paths (and LEAST of
them) have is a branch of its own; the others are variable and become wildcards of their
kind (`{n}`, `{date}`, `{hex}`, `{word}`, `{mixed}`, with their extension). Branches with
the same kind of next segment whose shares of bad labels don't differ by a two-proportion
test are merged to one, `{de|en|fr}`. A node's share of bad labels is smoothed by its
parent's, a host's by that of all labels; a template with a smoothed share of good labels
(its purity) under PURITY is rejected. A node is split no further if it has fewer than
LEAST paths or if all its paths go on alike, so deep paths that few share end early.

Everything is joins and grouped sums on (host, node). Sums are combined before the
shuffle; a host or node that a third of the rows have is a skewed key of a join only,
and its smaller side is read from a table, so that Spark can split it. Branches are
gathered per node, at most 1 / SHARE of them.

A null url and one without `://` have an empty host and path: they are a host like any
other. Paths of any length and depth are read whole. Repeated urls, with one page_id or
several, are one path to the tree and a row each in the result; their labels all count.
Without labels nothing is rejected. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, start of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Paths that a branch and a split need; share of a node's paths that a branch needs; normal quantile of the merge test;
#: labels that a parent's share counts for; least smoothed share of good labels.
LEAST, SHARE, QUANTILE, PRIOR, PURITY = 20, 0.02, 1.96, 20.0, 0.5

END = "end"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    c = F.col(url) if isinstance(url, str) else url
    at = F.instr(c, "://")
    rest = F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null fields if none does. Rules are a short list: each is a test in one expression."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def kind(segment: Column) -> Column:
    """The kind of a path segment, without its extension; null is the path's end."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return (
        F.when(segment.isNull(), END)
        .when(stem == "", "")
        .when(stem.rlike(r"^[12][0-9]{3}[-_.]?[01][0-9]([-_.]?[0-3][0-9])?$"), "{date}")
        .when(stem.rlike("^[0-9]+$"), "{n}")
        .when(stem.rlike("^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "{hex}")
        .when(stem.rlike("^[^0-9]+$"), "{word}")
        .otherwise("{mixed}")
    )


def wildcard(segment: Column) -> Column:
    return F.concat(kind(segment), F.translate(F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0), UPPER, LOWER))


def first_and_rest(rest: Column) -> tuple[Column, Column]:
    """First segment of what is left of a path, and what is left after it (null at the end)."""
    at = F.instr(rest, "/")
    return F.substring_index(rest, "/", 1), F.when(at > 0, F.substring(rest, at + 1, F.length(rest)))


def bad_share(good: Column, bad: Column, prior: Column) -> Column:
    return (bad + F.lit(PRIOR) * prior) / (good + bad + F.lit(PRIOR))


def merged(branches: Column) -> Column:
    """Arrays of segments, one per group, from sorted struct(share, seg, good, bad): a branch joins the group before it unless their shares differ by the test."""

    def alike(a: Column, x: Column) -> Column:
        n, m = a["good"] + a["bad"], x["good"] + x["bad"]
        pooled = (a["bad"] + x["bad"]) / (n + m)
        gap = a["bad"] / n - x["bad"] / m
        known = (n > 0) & (m > 0) & (pooled > 0) & (pooled < 1)
        return ~known | F.coalesce(gap * gap <= F.lit(QUANTILE * QUANTILE) * pooled * (1 - pooled) * (1 / n + 1 / m), F.lit(True))

    def group(done: Column, segs: Column, good: Column, bad: Column) -> Column:
        return F.struct(done.alias("done"), segs.alias("segs"), good.cast("long").alias("good"), bad.cast("long").alias("bad"))

    def step(a: Column, x: Column) -> Column:
        joined = group(a["done"], F.concat(a["segs"], F.array(x["seg"])), a["good"] + x["good"], a["bad"] + x["bad"])
        begun = group(F.concat(a["done"], F.array(a["segs"])), F.array(x["seg"]), x["good"], x["bad"])
        return F.when((F.size(a["segs"]) == 0) | alike(a, x), joined).otherwise(begun)

    none = F.array().cast("array<string>")
    start = group(F.array().cast("array<array<string>>"), none, F.lit(0), F.lit(0))
    return F.aggregate(branches, start, step, lambda a: F.concat(a["done"], F.array(a["segs"])))


def branch_labels(cut: DataFrame) -> DataFrame:
    """(host, node, seg, label) of the segments that are branches, by the groups they are merged to."""
    kinds = cut.groupBy("host", "node", "seg", "ahead").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("good", "bad")), *(F.max(c).alias(c) for c in ("urls", "share")))
    segs = kinds.groupBy("host", "node", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")), *(F.max(c).alias(c) for c in ("urls", "share")), F.max(F.struct("n", "ahead"))["ahead"].alias("ahead"))
    own = segs.where((F.col("n") >= LEAST) & (F.col("n") >= F.lit(SHARE) * F.col("urls"))).withColumn("own", bad_share(F.col("good"), F.col("bad"), F.col("share")))
    per_node = own.groupBy("host", "node", "ahead").agg(F.sort_array(F.collect_list(F.struct(F.col("own").alias("share"), "seg", "good", "bad"))).alias("b"))
    groups = per_node.select("host", "node", F.explode(merged(F.col("b"))).alias("segs"))
    plain = lambda s: F.replace(F.replace(F.replace(s, F.lit("{"), F.lit("%7B")), F.lit("|"), F.lit("%7C")), F.lit("}"), F.lit("%7D"))
    named = F.concat_ws("|", F.transform(F.array_sort("segs"), plain))
    return groups.select("host", "node", F.when(F.size("segs") > 1, F.concat(F.lit("{"), named, F.lit("}"))).otherwise(named).alias("label"), F.explode("segs").alias("seg"))


def settled(rows: DataFrame, parent: str) -> DataFrame:
    """rows (host, path, node, rest, good, bad, parent's share) with their node's urls and share, and whether it is split further."""
    stats = rows.groupBy("host", "node").agg(
        F.count("*").alias("urls"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max(parent).alias("p"),
        F.min("rest").alias("least"), F.max("rest").alias("most"), F.count("rest").alias("going"),
    )
    varied = (F.col("least") < F.col("most")) | ((F.col("going") > 0) & (F.col("going") < F.col("urls")))
    stats = stats.select("host", "node", "urls", bad_share(F.col("g"), F.col("b"), F.col("p")).alias("share"), ((F.col("urls") >= LEAST) & F.coalesce(varied, F.lit(False))).alias("split"))
    # from a table, so that the join shuffles rows for itself and a skewed node can be split
    return stored(rows.drop("share", "urls", "split").join(stored(stats, "url-nodes"), ["host", "node"]), "url-level")


def grow(paths: DataFrame) -> DataFrame:
    """(host, path, template, share) of the different paths (host, path, good, bad): each one's leaf and its smoothed share of bad labels."""
    total = paths.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).collect()[0]
    overall = ((total.b or 0) + 1) / ((total.g or 0) + (total.b or 0) + 2)
    first = paths.withColumns({"node": F.lit(""), "rest": F.when(F.col("path") != "", F.substring("path", 2, 1 << 30)), "parent": F.lit(overall)})
    level, leaves = settled(first, "parent"), []
    while True:
        going = F.col("split") & F.col("rest").isNotNull()
        leaves.append(level.where(~going).select("host", "path", F.when(F.col("rest").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/**"))).alias("template"), "share"))
        live = level.where(going)
        if live.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        seg, after = first_and_rest(F.col("rest"))
        cut = live.withColumns({"seg": seg, "after": after}).withColumn("ahead", kind(first_and_rest(F.col("after"))[0]))
        labels = stored(branch_labels(cut), "url-branches")
        down = cut.join(labels, ["host", "node", "seg"], "left")
        label = F.coalesce("label", wildcard(F.col("seg")))
        level = settled(down.select("host", "path", "good", "bad", F.concat("node", F.lit("/"), label).alias("node"), F.col("after").alias("rest"), F.col("share").alias("parent")), "parent")


def judged(pages: DataFrame, label: str, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict of every page; `label` is true for good pages, false for bad ones, null where nothing is known."""
    host, path = host_and_path("url")
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), F.col(label).cast("boolean").alias("label"))
    paths = stored(seen.groupBy("host", "path").agg(F.count_if(F.col("label")).alias("good"), F.count_if(~F.col("label")).alias("bad")), "url-paths")
    leaves = stored(grow(paths), "url-leaves")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = seen.select("page_id", "host", "path").join(leaves, ["host", "path"]).withColumn("by_rule", rule)
    purity = 1 - F.col("share")
    return out.select("page_id", "host", "path", "by_rule.rule", "template", purity.alias("purity"), F.coalesce("by_rule.verdict", F.when(purity < PURITY, "block").otherwise("allow")).alias("verdict"))
