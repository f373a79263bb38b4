"""URL filter: host rules, and a path-template tree for urls that no rule fits. DataFrame functions only.

Host and path are cut out of each url. A rule fits its host and every subdomain of it if the path starts
with the rule's; the longest rule wins. Rules also label the urls that the tree learns from, next
to any labels that are given.

Tree. A path is its segments; digits and long hex runs in a segment are generalised at once, and what comes after `depth` segments
counts as one more. Level by level from the root of each host, branches that are statistically similar are merged: a branch's share
of blocked labels is drawn towards its parent's by `pull` labels, put on the scale on which shares have one standard error (the arcsine of
the root), and branches that fall into the same of `bins` classes become one wildcard. Branches without labels are a class
of their own, so no label of a neighbour counts against them. What is left of a path is its template.

The same tree is grown over all hosts together. A template's purity on its host is its share of blocked labels there,
smoothed by `strength` labels at the rate of the path's template in the common tree, which is itself smoothed by `strength` labels at `prior`. So a
host without labels is judged by what paths like its own are elsewhere, and one with many by itself. A template is
rejected if its purity reaches `purity` and it has a label on its host or `support` labels over all hosts.

The tree is built on counts of different (host, segments), so a host with very many urls is aggregated before it
is shuffled; no step collects the children of a branch in one place.

Defined results: a null url and one without `://` have an empty host and path, which no rule fits and no
template rejects. Repeated rows are judged alike. Ties cannot occur: of the rules that fit, no two are equally long. Very long urls keep
all their segments. Other columns are ignored. An empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames


@dataclass(frozen=True)
class Options:
    depth: int = 6
    bins: int = 5
    pull: float = 5.0
    prior: float = 0.2
    strength: float = 5.0
    purity: float = 0.8
    support: int = 50


#: Fixed values of the query's contract: host and path, and what the rule says.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block")
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct (length, rule, verdict), or null. The rules are literals of the plan."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    one = [
        F.struct(
            F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"),
            F.lit(p).alias("p")
        ) for h,
        p, v in rules
    ]
    fits = F.filter(F.array(*one), lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    return F.array_max(
        F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    )


def segments(path: Column, depth: int) -> Column:
    """The generalised segments of a path; after depth of them the rest is the last one."""
    every = F.split(F.regexp_replace(path, r"^/", ""), "/", depth + 1)
    return F.transform(
        every, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F]{16,}(?:-[0-9a-fA-F]+)*", "<h>"), r"[0-9]+", "<n>")
    )


EVERY = "*"  # the host of the common tree; no url has it


def grown(nodes: DataFrame, opt: Options) -> DataFrame:
    """(host, segs, template) for counts (host, segs, n, l, b) of urls, labels and blocked labels."""
    nodes = nodes.withColumn("template", F.lit(""))
    levels = nodes.agg(F.max(F.size("segs")).alias("n")).first()["n"] or 0
    with frames.Scratch() as keep:
        return _grown(nodes, levels, opt, keep)


def _grown(nodes: DataFrame, levels: int, opt: Options, keep: frames.Scratch) -> DataFrame:
    for level in range(levels):
        saved = keep(nodes)
        seg = F.get("segs", F.lit(level))
        child = saved.where(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
        parent = child.groupBy("host", "template").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        own = (F.col("pb") + opt.prior * opt.pull) / (F.col("pl") + opt.pull)
        share = (F.col("b") + opt.pull * own) / (F.col("l") + opt.pull)
        bin_ = F.least(F.floor(F.asin(F.sqrt(share)) * (2 * opt.bins / math.pi) + 1e-9), F.lit(opt.bins - 1))
        step = F.concat(F.lit("/*"), F.when(F.col("l") == 0, F.lit("?")).otherwise(bin_.cast("string")))
        classes = frames.join(child, parent, ["host", "template"]).select("host", "template", "seg", step.alias("step"))
        joined = frames.join(saved.withColumn("seg", seg), classes, ["host", "template", "seg"], "left")
        nodes = joined.select("host", "segs", "n", "l", "b", F.concat("template", F.coalesce("step", F.lit(""))).alias("template"))
    return frames.Saved(nodes).df


def templates(urls: DataFrame, opt: Options = Options()) -> DataFrame:
    """(host, segs, template, n_labels, n_blocked, purity, rejected) for each different (host, segs); urls has host, segs and bad (1, 0 or null)."""
    per = frames.Saved(
        urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    ).df
    common = per.where("host <> ''").groupBy("segs").agg(
        F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b")
    ).select(F.lit(EVERY).alias("host"), "segs", "n", "l", "b")
    nodes = grown(per.unionByName(common), opt)
    totals = nodes.groupBy("host", "template").agg(F.sum("l").alias("n_labels"), F.sum("b").alias("n_blocked"))
    every = frames.join(
        nodes.where(F.col("host") == EVERY).select("segs", "template"), totals.where(F.col("host") == EVERY).drop("host"), ["template"]
    )
    rate = (F.col("n_blocked") + opt.prior * opt.strength) / (F.col("n_labels") + opt.strength)
    every = every.select("segs", rate.alias("rate"), F.col("n_labels").alias("all_labels"))
    own = frames.join(nodes.where(F.col("host") != EVERY).select("host", "segs", "template"), totals, ["host", "template"])
    purity = (F.col("n_blocked") + F.coalesce("rate", F.lit(opt.prior)) * opt.strength) / (F.col("n_labels") + opt.strength)
    known = (F.col("n_labels") > 0) | (F.coalesce("all_labels", F.lit(0)) >= opt.support)
    return frames.join(own, every, ["segs"], "left").withColumn("purity", purity).withColumn(
        "rejected", known & (F.col("purity") >= opt.purity) & (F.col("host") != "")
    ).drop("rate", "all_labels")


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, opt: Options = Options()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each url; labels: (page_id, bad 0 or 1)."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    cut = cut.withColumn("r", best_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path"), opt.depth))
    if labels is not None:
        one = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("given"))
        cut = frames.join(cut, one, ["page_id"], "left")
    else:
        cut = cut.withColumn("given", F.lit(None).cast("int"))
    said = F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0)
    urls = frames.Saved(cut.withColumn("bad", F.coalesce(said, "given"))).df
    tree = templates(urls, opt).select("host", "segs", "template", "purity", "rejected")
    out = frames.join(urls, tree, ["host", "segs"])
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(frames.pick(frames.table(spark, sf_dir, "pages"), page_id="long", url="string"))
