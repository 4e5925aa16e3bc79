"""URL filters: rules, and a tree of path templates for the urls without one."""

from __future__ import annotations

from collections import defaultdict
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.llm.staging import staged, unstage

#: Fixed by the contract: verdict, rule (host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A node whose children are at least so many, and so large a share of its urls, has variable children.
FANOUT, SPREAD = 8, 0.3
#: Weight of the smoothing prior in labelled urls, standard errors that set a branch apart, share that rejects a template.
PRIOR, APART, REJECT = 4.0, 2.0, 0.6
#: A node with at most so many distinct paths is finished in one task, to its last segment.
SMALL = 4096


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def coarse(path: Column) -> Column:
    """The path with the segments that vary by their look as wildcards: numbers, dates, long hexadecimal names; an extension stays."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9a-f]{8,}(?=\.|$)|^[0-9a-f]{4,}-[0-9a-f-]+(?=\.|$)", "*"), r"[0-9]+", "*"))


def deeper(tree: DataFrame) -> DataFrame:
    """tree with one segment more in each template; a node all of whose rows have one path left takes it whole."""
    tree = tree.withColumn("seg", F.get("rest", F.lit(0)))
    counts = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    child = tree.groupBy("host", "template", "seg").agg(*counts, F.min("rest").alias("low"), F.max("rest").alias("high"))
    node = child.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("kids"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")), (F.min("low") == F.max("high")).alias("only")
    )
    told, rest = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")
    share, others = F.col("bad") / F.greatest(told, F.lit(1)), (F.col("all_bad") - F.col("bad")) / F.greatest(rest, F.lit(1))
    pooled = F.col("all_bad") / F.greatest(told + rest, F.lit(1))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(told, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))) + 1e-9)
    alike = (told > 0) & (rest > 0) & (F.abs(share - others) <= APART * error)
    variable = (F.col("kids") >= FANOUT) & (F.col("kids") >= SPREAD * F.col("all_n"))
    named = child.join(node, ["host", "template"]).select("host", "template", "seg", "only", F.when(variable | alike, "*").otherwise(F.col("seg")).alias("name"))
    tree = tree.join(named, ["host", "template", "seg"])
    return tree.select(
        "host", "shape", "n", "bad", "good",
        F.concat("template", F.lit("/"), F.when(F.col("only"), F.array_join("rest", "/")).otherwise(F.col("name"))).alias("template"),
        F.when(F.col("only"), F.slice("rest", 1, 0)).otherwise(F.expr("slice(rest, 2, size(rest))")).alias("rest"),
    )


def finished(rests: list[tuple[str, ...]], counts: list[tuple[int, int, int]]) -> list[str]:
    """The names, joined, that each path under one node gets; counts are (n, bad, good) of each. What deeper() does, level by level, in memory."""
    said = ["" for _ in rests]
    nodes = [(0, list(range(len(rests))))]
    while nodes:
        level, rows = nodes.pop()
        rows = [r for r in rows if len(rests[r]) > level]
        kids = defaultdict(list)
        for r in rows:
            kids[rests[r][level]].append(r)
        if len(kids) == 1 and all(rests[r] == rests[rows[0]] for r in rows[1:]):
            for r in rows:
                said[r] += "/" + "/".join(rests[r][level:])
            continue
        sums = {seg: [sum(counts[r][i] for r in of) for i in range(3)] for seg, of in kids.items()}
        n, bad, good = (sum(s[i] for s in sums.values()) for i in range(3))
        variable = len(kids) >= FANOUT and len(kids) >= SPREAD * n
        named = defaultdict(list)
        for seg, of in kids.items():
            told, rest, alike = sum(sums[seg][1:]), bad + good - sum(sums[seg][1:]), False
            if told and rest:
                pooled = bad / (bad + good)
                error = sqrt(pooled * (1 - pooled) * (1 / told + 1 / rest) + 1e-9)
                alike = abs(sums[seg][1] / told - (bad - sums[seg][1]) / rest) <= APART * error
            named["*" if variable or alike else seg] += of
        for name, of in named.items():
            for r in of:
                said[r] += "/" + name
            nodes.append((level + 1, of))
    return said


def _finish(node: pd.DataFrame) -> pd.DataFrame:
    below = finished([tuple(r) for r in node["rest"]], list(zip(node["n"], node["bad"], node["good"], strict=True)))
    return node.assign(template=node["template"] + below)[["host", "shape", "bad", "good", "template"]]


def templates(paths: DataFrame, small: int = SMALL) -> DataFrame:
    """(host, shape) -> template and rejected.

    paths: host, shape (array of segments), n urls, bad and good (urls that a rule
    blocks or allows). Level by level, down to the last segment of the longest path,
    a node's children become one wildcard where they are variable; of the others,
    one whose share of blocked urls is within APART standard errors of its siblings'
    together is merged with its like. That takes labels on both sides: a branch
    without any is like nothing. A leaf is rejected if it has labels and its share of
    blocked urls, smoothed towards the share over all hosts, reaches REJECT. Shares
    are of the urls with a rule; a url without one takes the label of its leaf.

    Nodes of up to `small` distinct paths, so most hosts, are finished in one task each, so a
    path of any depth costs no further job; each level of larger ones is a job and a
    step in the folder of spark.checkpoint.dir, which the next replaces. The result is the same.
    """
    tree = staged(paths.select("host", "shape", "n", "bad", "good", F.lit("").alias("template"), F.col("shape").alias("rest")))
    done = []
    while True:
        ended = tree.where(F.size("rest") == 0).select("host", "shape", "bad", "good", "template")
        sizes = tree.where(F.size("rest") > 0).groupBy("host", "template").agg((F.count(F.lit(1)) <= small).alias("fits"))
        open_ = staged(tree.where(F.size("rest") > 0).join(sizes, ["host", "template"]))
        fit = open_.where("fits").groupBy("host", "template").applyInPandas(_finish, "host string, shape array<string>, bad long, good long, template string")
        done.append(staged(ended.unionByName(fit)))
        unstage(tree)
        large = open_.where("NOT fits").drop("fits")
        if large.isEmpty():
            unstage(open_)
            break
        tree = staged(deeper(large))
        unstage(open_)
    tree = done[0]
    for more in done[1:]:
        tree = tree.unionByName(more)
    told = F.sum("bad") + F.sum("good")
    prior = tree.agg(F.coalesce(F.sum("bad") / F.greatest(told, F.lit(1)), F.lit(0.0)).alias("prior"))
    leaf = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), told.alias("told"))
    # The prior is one row.
    smoothed = (F.col("bad") + PRIOR * F.col("prior")) / (F.col("told") + PRIOR)
    leaf = leaf.join(F.broadcast(prior)).select("host", "template", ((F.col("told") > 0) & (smoothed >= REJECT)).alias("rejected"))
    out = staged(tree.select("host", "shape", "template").join(leaf, ["host", "template"]))
    unstage(*done)
    return out


def judge_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template.

    A url that a rule fits has the rule's verdict; every other, that of its path
    template, learnt from the urls with rules. A url that is null or has no "://"
    has empty host and path, no rule, and an empty template. Repeated and null
    page_ids keep their rows. Other columns are ignored.
    """
    url = F.col("url")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", coarse(F.col("path")))
    bad, good = (F.coalesce((F.col("r.verdict") == v).cast("long"), F.lit(0)) for v in ("block", "allow"))
    shapes = p.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"), F.sum(good).alias("good"))
    said = F.when(F.col("rejected"), "block").otherwise("allow")
    return p.join(templates(shapes), ["host", "shape"]).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", said).alias("verdict"), "template"
    )


def op3_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
