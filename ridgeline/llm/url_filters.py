"""URL filters by rules and a path-template tree.

Method: a URL's path is cut into segments; numbers and long hexadecimal strings in
a segment become wildcards. From level to level, below each host and template prefix,
rare segments of a node with many children become one wildcard branch, and labelled
branches whose share of good labels doesn't differ significantly from that of
their siblings (two-proportion z test) are merged into it. Each leaf is a
template; its purity is the smoothed share of good labels, and a template with
enough labels and a low purity is rejected. Templates without labels are allowed.

Rules come first: one fits its host and all subdomains if the path starts with the
rule's; the longest rule wins, at equal length the first in text order.

All steps are DataFrame operations. What is grouped level by level is the distinct
generalised paths with their counts, never the pages; each grouping is
pre-aggregated, so a hot host is spread over its paths. The tree is as deep as paths
branch: a path that is alone below its prefix ends there, with its last segments as they
are, and segments that all paths below a prefix share are passed at once, as many as
each prefix of the host has; so the number of steps is that of the levels on which some
host branches. What a step joins is written first, and the tree is broadcast if it's small, so that
Spark can split a frequent host or path over tasks.

Defined results: a null URL or one without `://` has an empty host and path, and
the verdict allow. Repeated rows count and are judged each. Ties of the test count as
similar. Very long URLs are cut into all their segments. Input columns are kept; the
operator's own columns replace columns of the same name. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.lineage import cut, drop, few

#: The query's rules: host and path prefix, verdict. Fixed values.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
MANY_CHILDREN, RARE_SHARE = 16, 0.02
SIMILAR_Z, MIN_LABELS, SMOOTHING, LEAST_PURITY = 1.96, 5, 2.0, 0.3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    part = lambda i: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_column(rules: tuple[tuple[str, str], ...], what: int) -> Column:
    """The winning rule's text (what=0) or verdict (what=1); null without a rule."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule[0].partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        out = F.when(fits, rule[what]) if out is None else out.when(fits, rule[what])
    return F.lit(None).cast("string") if out is None else out


def generalised(path: Column) -> Column:
    """The path's segments with variable parts as wildcards."""
    shape = F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{x}")
    return F.split(F.regexp_replace(F.regexp_replace(shape, r"[0-9]+", "{n}"), "^/", ""), "/")


def template_tree(urls: DataFrame, good: Column) -> DataFrame:
    """host, shape (generalised path), template, n_labels, purity, rejected. urls: with host and path; good: 1, 0 or null."""
    shapes = urls.select("host", generalised(F.col("path")).alias("segments"), good.cast("double").alias("good"))
    shapes = shapes.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("good").alias("labels"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("goods")).withColumn("prefix", F.lit(""))
    shapes, done = cut(shapes.withColumn("level", F.lit(0))), []
    sums = [F.sum(c).alias(c) for c in ("n", "labels", "goods")]
    level, size = F.col("level"), F.size("segments")
    rest = F.slice("segments", level + 1, F.greatest(size - level, F.lit(0)))
    joined = lambda parts: F.array_join(F.filter(parts, lambda x: x != ""), "/")
    longer = lambda more: F.when(more == "", F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), more))
    while True:
        # segments shared by all paths below a prefix are those shared by the least and the greatest; an empty one ends them, because prefixes leave it out and may meet there
        same = F.zip_with("least", "most", lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
        nodes = shapes.groupBy("host", "prefix").agg(F.count("*").alias("paths"), F.min(rest).alias("least"), F.max(rest).alias("most"))
        nodes = cut(nodes.select("host", "prefix", (F.col("paths") == 1).alias("alone"), F.when(F.col("paths") > 1, F.array_position(F.array_append(same, F.lit(False)), F.lit(False)) - 1).cast("int").alias("common")))
        if nodes.where("NOT alone").isEmpty():
            done.append(shapes.withColumn("prefix", longer(joined(rest))))
            drop(nodes)
            break
        hosts = cut(nodes.groupBy("host").agg(F.min("common").alias("passed")))  # null: each of the host's paths is alone
        # a path that is alone below its prefix has no siblings any more: its last segments follow as they are
        moved = shapes.join(nodes.select("host", "prefix", "alone"), ["host", "prefix"]).join(hosts, "host")
        moved = moved.withColumn("prefix", F.when(F.col("alone"), longer(joined(rest))).otherwise(longer(joined(F.slice("segments", level + 1, F.coalesce("passed", F.lit(0)))))))
        moved = moved.withColumn("level", level + F.coalesce("passed", F.lit(0)) + 1)
        moved = cut(moved.withColumn("seg", F.coalesce(F.try_element_at("segments", level), F.lit(""))).drop("passed"))
        drop(nodes, hosts)
        done.append(moved.where("alone"))
        moved = moved.where("NOT alone").drop("alone")
        branches = moved.groupBy("host", "prefix", "seg").agg(*sums)
        nodes = branches.groupBy("host", "prefix").agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labels", "goods")))
        b = branches.join(nodes, ["host", "prefix"])
        others, other_good = F.col("all_labels") - F.col("labels"), F.col("all_goods") - F.col("goods")
        pooled = F.try_divide("all_goods", "all_labels")
        spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labels")) + F.try_divide(F.lit(1.0), others))
        distance = F.abs(F.try_divide("goods", "labels") - F.try_divide(other_good, others))
        similar = (F.col("labels") > 0) & (others > 0) & (distance * distance <= SIMILAR_Z**2 * spread)
        rare = (F.col("children") > MANY_CHILDREN) & (F.col("n") < RARE_SHARE * F.col("all_n")) & ~F.col("seg").startswith("{")
        branch = F.when(F.col("seg") == "", "").when(F.coalesce(similar, F.lit(False)) | rare, "*").otherwise(F.col("seg"))
        b = cut(b.select("host", "prefix", "seg", branch.alias("branch")))
        shapes = cut(moved.join(b, ["host", "prefix", "seg"]).withColumn("prefix", longer(F.col("branch"))).drop("branch", "seg"))
        drop(b)
        done.append(shapes.where(size < level))
        shapes = shapes.where(size >= level)
    leaf = ["host", "prefix", "segments", "labels", "goods"]
    shapes = reduce(DataFrame.unionByName, [d.select(*leaf) for d in done])
    leaves = shapes.groupBy("host", "prefix").agg(F.sum("labels").alias("n_labels"), F.sum("goods").alias("goods"))
    purity = (F.col("goods") + SMOOTHING / 2) / (F.col("n_labels") + SMOOTHING)
    leaves = leaves.select("host", "prefix", "n_labels", purity.alias("purity"), ((F.col("n_labels") >= MIN_LABELS) & (purity < LEAST_PURITY)).alias("rejected"))
    return shapes.select("host", "prefix", "segments").join(leaves, ["host", "prefix"]).select("host", F.array_join("segments", "/").alias("shape"), F.concat("host", "prefix").alias("template"), "n_labels", "purity", "rejected")


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, good: Column | None = None) -> DataFrame:
    """Add host, path, rule, verdict, template and purity.

    good: 1 for a page known as good, 0 for a bad one, null where unknown; by
    default the rules' own verdicts are the labels.
    """
    own = ("host", "path", "rule", "verdict", "template", "purity")
    kept = [c for c in pages.columns if c not in own]
    host, path = host_and_path(pages[url_col])
    label = F.lit(None).cast("double") if good is None else good.cast("double")
    rows = pages.select(*(pages[c].alias(f"__c{i}") for i, c in enumerate(kept)), host.alias("host"), path.alias("path"), label.alias("__good"))
    rows = rows.withColumns({"rule": rule_column(rules, 0), "__verdict": rule_column(rules, 1)})
    label = F.when(F.col("__verdict").isNotNull(), (F.col("__verdict") == "allow").cast("double")) if good is None else F.col("__good")
    tree = cut(template_tree(rows.where("host <> ''"), label))
    rows = rows.withColumn("shape", F.array_join(generalised(F.col("path")), "/"))
    out = rows.join(few(tree), ["host", "shape"], "left")
    method = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("__verdict", method)).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)), *own)
