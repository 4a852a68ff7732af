"""URL filter: rules first, else a path-template tree per host. DataFrame functions only.

Urls with a rule verdict are the labels. Paths become templates: digits turn into
wildcards, then, from one branching to the next, a position whose values keep being
new becomes one, and sibling branches with the same subtree shapes and the same share
of blocked urls merge. Segments that all paths below a node share are passed over at
once, so the rounds are as many as the branchings along a path, however deep it is.
A branch without labels keeps its own name and takes the labels of all siblings with
its subtree shapes. A template is rejected when its share of blocked urls, smoothed
towards its parent's, and so on up to the host, is high. Towards the host, urls without
a label count at a fixed prior, so that rules which can only block (or only allow) do
not speak for what they don't cover.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored


@dataclass(frozen=True)
class Tree:
    """Settings of the template tree."""

    # A position becomes a wildcard where so large a share of its rows have a value of their own: the chance that
    # the next row brings a new one. It keeps to that share however many rows come, and falls to none for a fixed
    # set of values. A few rows prove nothing, so some count as if they had no value of their own.
    open_share: float = 0.2
    doubt_rows: float = 20.0
    purity_steps: int = 5  # branches merge if their blocked shares fall into the same of so many steps
    node_weight: float = 4.0  # rows at which a node's own labels weigh as much as its parent's share
    prior: float = 0.25  # blocked share of what no label speaks for
    reject_at: float = 0.5


def host_and_path(url: Column) -> list[Column]:
    """Host after the first ``://``, A-Z lower-cased, and path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return [ascii_lower(host).alias("host"), path.alias("path")]


def rule_for(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as ``struct<rule,verdict>``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def smoothed(blocked, labelled, prior, weight) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return (blocked + prior * weight) / (labelled + weight)


def templates(paths: DataFrame, tree: Tree) -> DataFrame:
    """``host, shape`` of distinct (host, shape, n, labelled, blocked, share) rows, with ``template``: the generalised path.

    ``share`` comes in as the host's share of blocked urls and goes out as that of the last node of the template.
    """
    columns = ["host", "shape", "n", "labelled", "blocked", "share"]
    joined = lambda segments: F.expr(f"array_join(transform({segments}, s -> concat('/', s)), '')")
    open_nodes = paths.select(*columns, F.split(F.regexp_replace("shape", "^/", ""), "/").alias("rest"), F.lit("").alias("prefix"))
    settled = []
    while True:
        # The least and the greatest path below a node tell how far all of them agree.
        groups = open_nodes.groupBy("host", "prefix").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        nodes = open_nodes.join(groups, ["host", "prefix"]).withColumn("alone", F.col("lo") == F.col("hi"))
        agree = F.expr("cast(array_position(zip_with(lo, hi, (a, b) -> a <=> b), false) as int) - 1").alias("agree")
        nodes = stored(nodes.select(*columns, "rest", "prefix", "alone", agree), f"url-nodes{len(settled)}")
        settled.append(nodes.where("alone").select(*columns, F.concat("prefix", joined("rest")).alias("template")))
        nodes = nodes.where("not alone")
        if nodes.isEmpty():
            break
        # Branch '' holds the path that ends here; it neither merges nor becomes a wildcard.
        nodes = nodes.select(
            *columns,
            F.concat("prefix", joined("slice(rest, 1, agree)")).alias("prefix"),
            F.expr("case when agree < size(rest) then concat('/', rest[agree]) else '' end").alias("branch"),
            F.expr("slice(rest, agree + 2, size(rest))").alias("rest"),
        )
        below = F.xxhash64("rest")
        branches = nodes.groupBy("host", "prefix", "branch").agg(
            F.sum("n").alias("bn"),
            F.sum("labelled").alias("bl"),
            F.sum("blocked").alias("bb"),
            F.count_distinct(below).alias("shapes"),
            F.min(below).alias("least"),
            F.max(below).alias("most"),
            F.max("share").alias("above"),  # one value a prefix
        )
        # A branch's likeness: how its subtree looks, and in which step its blocked share falls.
        step = F.when(F.col("bl") > 0, F.floor(F.least(F.col("bb") / F.col("bl"), F.lit(0.999)) * tree.purity_steps)).otherwise(-1)
        looks = F.concat_ws("|", F.col("branch") == "", "shapes", "least", "most")
        like = F.concat_ws("|", looks, step.cast("int"))
        branches = branches.select("host", "prefix", "branch", "bn", "bl", "bb", "above", looks.alias("looks"), like.alias("like"))
        labels = lambda of: (F.sum("bl").alias(f"{of}_l"), F.sum("bb").alias(f"{of}_b"))
        own_value = F.sum(F.when((F.col("bn") == 1) & (F.col("branch") != ""), 1).otherwise(0)).alias("own_value")
        sizes = branches.groupBy("host", "prefix").agg(own_value, F.sum("bn").alias("rows"), *labels("all"))
        merged = branches.groupBy("host", "prefix", "like").agg(
            F.min("branch").alias("name"), F.count(F.lit(1)).alias("alike"), *labels("own")
        )
        kin = branches.groupBy("host", "prefix", "looks").agg(*labels("kin"))
        named = branches.drop("bl", "bb").join(merged, ["host", "prefix", "like"]).join(kin, ["host", "prefix", "looks"])
        named = named.join(sizes, ["host", "prefix"])
        wild = (F.col("own_value") >= tree.open_share * (F.col("rows") + tree.doubt_rows)) & (F.col("branch") != "")
        name = F.when(wild, F.lit("/*")).when(F.col("alike") > 1, F.concat("name", F.lit("+"))).otherwise(F.col("branch"))
        # The labels of the node: its own, or else those of all siblings that look like it.
        spoken = lambda x: F.when(wild, F.col(f"all_{x}")).when(F.col("own_l") > 0, F.col(f"own_{x}")).otherwise(F.col(f"kin_{x}"))
        share = smoothed(spoken("b"), spoken("l"), F.col("above"), tree.node_weight)
        named = named.select("host", "prefix", "branch", name.alias("to"), share.alias("share"))
        moved = nodes.drop("share").join(named, ["host", "prefix", "branch"])
        open_nodes = stored(moved.select(*columns, "rest", F.concat("prefix", "to").alias("prefix")), f"url-moved{len(settled)}")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", tree: Tree = Tree()
) -> DataFrame:
    """``id, host, path, rule, verdict, template, purity`` per row; ``rules`` are (allow or block, host, path).

    A null url and one without ``://`` have empty host and path. Null and repeated
    ids stay as they are. On a host without any labelled url the purity is 0 and all
    pages pass. Only the two named columns are read. An empty table gives an empty result.

    All counting is on distinct (host, shape) pairs, summed before the shuffle, so a
    host with a third of all pages is one row per shape and task; the join back has
    one row a pair on its other side, so Spark can split it.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    parts = urls.select("id", *host_and_path(F.col("url")))
    shape = F.regexp_replace("path", r"[0-9]+", "*")
    judged = parts.select("id", "host", "path", rule_for(rules).alias("r"), shape.alias("shape"))
    sums = judged.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("r.verdict").alias("labelled"),
        F.count_if(F.col("r.verdict") == "block").alias("blocked"),
    )
    sums = stored(sums, "url-shapes")
    by_host = sums.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("blocked").alias("hb"), F.sum("labelled").alias("hl"))
    host_share = F.when(F.col("hl") > 0, smoothed(F.col("hb"), F.col("hl"), F.lit(tree.prior), F.col("hn") - F.col("hl") + tree.node_weight))
    by_host = by_host.select("host", F.coalesce(host_share, F.lit(0.0)).alias("share"))
    tree_rows = templates(sums.join(by_host, "host"), tree)
    by_template = tree_rows.groupBy("host", "template").agg(
        F.sum("blocked").alias("tb"), F.sum("labelled").alias("tl"), F.max("share").alias("above")
    )
    by_template = by_template.select(
        "host", "template", smoothed(F.col("tb"), F.col("tl"), F.col("above"), tree.node_weight).alias("purity")
    )
    verdicts = tree_rows.select("host", "shape", "template").join(by_template, ["host", "template"])
    verdicts = stored(verdicts.select("host", "shape", "template", "purity"), "url-verdicts")
    learned = F.when(F.col("purity") >= tree.reject_at, "block").otherwise("allow")
    return judged.join(verdicts, ["host", "shape"]).select(
        "id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", learned).alias("verdict"), "template", "purity"
    )
