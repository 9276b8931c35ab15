"""URL filters: given rules first, then a path-template tree for each host.

A tree is grown level by level over counts of (host, prefix, segment), so a host that holds a third of all pages is a
few counted rows. Segments that look variable, and segments of a node with many rare children, become wildcards;
sibling templates whose labelled shares don't differ significantly are judged together, at every level; a template
without labels takes the share of its siblings or of the nearest branch above it; a template is rejected when its
smoothed share of labelled bad pages is above a threshold. Pages that a rule judges are the labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host, its subdomains and the paths that begin with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(*lines: str) -> list[Rule]:
    """Rules from lines such as ``block example.com/en/``."""
    out = []
    for line in lines:
        verdict, _, place = line.partition(" ")
        host, slash, path = place.partition("/")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_replace(url, r"^(?s:.*?)://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, UPPER, UPPER.lower())).otherwise(""), F.when(has, path).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct (verdict, name) of the longest rule that fits, else null: more of the host first, then more of the path."""
    out = F.lit(None).cast("struct<verdict: string, name: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments, with those that look like numbers, hashes or long mixed names as wildcards of their shape."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = lambda s: (
        F.when(s.rlike(r"^[0-9]+$"), F.lit("{number}"))
        .when(s.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{number}."), F.lower(F.regexp_extract(s, r"\.([A-Za-z]{1,5})$", 1))))
        .when(s.rlike(r"^[0-9A-Fa-f-]{16,}$"), F.lit("{hash}"))
        .when(s.rlike(r"[0-9]") & (F.char_length(s) >= 24), F.lit("{mixed}"))
        .otherwise(F.concat(F.lit("="), s))
    )
    return F.transform(parts, shape)


def grow(pages: DataFrame, children: int, support: int) -> DataFrame:
    """Adds ``_template`` to rows of distinct (_k, _segments) with counts: node by node, rare segments of a wide node become ``{any}``.

    A node is wide if it has more than ``children`` different children; of those, the ones with fewer than ``support``
    pages are variable. Below a node with no more than ``children`` rows no node can be wide, so rows leave as soon as
    theirs has no more, with their other segments as they are: the levels grown are those that have something to merge.
    """
    done = None
    pages, level = pages.withColumn("_template", F.lit("")), 0
    while True:
        longer = F.size("_segments") > level
        crowded = pages.filter(longer).groupBy("_k", "_template").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > children).select("_k", "_template", F.lit(True).alias("_crowded"))
        flagged = pages.join(crowded, ["_k", "_template"], "left").withColumn("_open", longer & F.coalesce("_crowded", F.lit(False))).drop("_crowded")
        open_ = flagged.filter("_open").drop("_open").withColumn("_seg", F.get("_segments", F.lit(level)))
        nodes = open_.groupBy("_k", "_template", "_seg").agg(F.sum("_n").alias("_m"))
        wide = nodes.groupBy("_k", "_template").agg(F.count("*").alias("_children")).filter(F.col("_children") > children)
        rare = nodes.filter(F.col("_m") < support).join(wide, ["_k", "_template"], "left_semi").select("_k", "_template", "_seg", F.lit(True).alias("_rare"))
        named = open_.join(rare, ["_k", "_template", "_seg"], "left")
        segment = F.when(F.col("_rare"), F.lit("{any}")).otherwise(F.col("_seg"))
        grown = cut(named.withColumn("_template", F.concat("_template", F.lit("/"), segment)).drop("_seg", "_rare"))
        left = F.slice("_segments", level + 1, F.greatest(F.size("_segments") - level, F.lit(0)))
        ended = cut(flagged.filter(~F.col("_open")).drop("_open").withColumn("_template", F.concat("_template", F.array_join(F.transform(left, lambda s: F.concat(F.lit("/"), s)), ""))))
        done = ended if done is None else done.unionByName(ended)
        if grown.isEmpty():
            return done
        pages, level = grown, level + 1


def judged_templates(counts: DataFrame, prior: float, strength: float, threshold: float, z: float) -> DataFrame:
    """Adds ``_bad_share`` and ``_rejected`` to templates with counts of labelled pages (_good, _bad).

    Siblings are templates of a host that differ in one segment alone, at any level; the deepest level comes first. A
    template whose share is within ``z`` standard errors of its siblings' joint share is judged by that, one that has no
    such siblings by its own. One without labels is judged by the joint share of its siblings, else by that of the nearest
    branch above it with labels, the whole host at last; by the prior if its host has none.
    """
    total, all_total = F.col("_good") + F.col("_bad"), F.col("_all_good") + F.col("_all_bad")
    parts = F.filter(F.split("_template", "/"), lambda s: s != "")
    n = F.size("_parts")
    path = lambda xs: F.concat(F.lit("/"), F.array_join(xs, "/"))
    sibling = lambda k: path(F.transform("_parts", lambda s, i: F.when(i == n - 1 - k, F.lit("{sibling}")).otherwise(s)))
    above = lambda k: F.concat(path(F.slice("_parts", 1, n - 1 - k)), F.lit("/{below}"))
    levels = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    branch = lambda kind, at: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), at(k).alias("at"))
    # a branch holds the pages at its own node too
    branches = F.concat(F.transform(levels, branch(0, sibling)), F.transform(F.sequence(F.lit(-1), n - 1), branch(1, above)))
    spread = counts.withColumn("_parts", parts).select("_k", "_template", "_good", "_bad", F.explode(branches).alias("_b")).withColumns({"_at": F.regexp_replace("_b.at", "^/+", "/")})
    joint = spread.filter(total > 0).groupBy("_k", "_at").agg(F.sum("_good").alias("_all_good"), F.sum("_bad").alias("_all_bad"))
    share, pooled = F.col("_bad") / F.greatest(total, F.lit(1)), F.col("_all_bad") / F.greatest(all_total, F.lit(1))
    alike = (F.col("_b.kind") == 0) & (all_total > total) & (F.abs(share - pooled) <= z * F.sqrt(pooled * (1 - pooled) / F.greatest(total, F.lit(1))))
    met = spread.join(joint, ["_k", "_at"]).filter((total == 0) | alike)
    judges = met.groupBy("_k", "_template").agg(F.min(F.struct("_b.kind", "_b.k", "_all_good", "_all_bad")).alias("_judge"))
    both = counts.join(judges, ["_k", "_template"], "left")
    good, bad = F.coalesce("_judge._all_good", "_good"), F.coalesce("_judge._all_bad", "_bad")
    smoothed = (bad + strength * prior) / (good + bad + strength)
    return both.withColumn("_bad_share", smoothed).withColumn("_rejected", smoothed > threshold)


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", children: int = 32, support: int = 8,
    prior: float = 0.25, strength: float = 4.0, threshold: float = 0.5, z: float = 1.96,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, bad_share) for every row of ``pages``.

    ``rule`` is the longest rule that fits, else null; ``verdict`` is the rule's, else block if the template's smoothed
    share of blocked pages is above ``threshold``, else allow. A null url and one without ``://`` have an empty host
    and path, which form a tree like any other; paths may have any number of segments. Repeated rows count as often as
    they come, null ids are ids like others. Other columns aren't read, whatever their names. An empty table gives an
    empty table.
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path")).withColumn("_r", rule_for(F.col("_host"), F.col("_path"), rules)).withColumn("_segments", segments(F.col("_path")))
    shapes = cut(
        parsed.groupBy(F.col("_host").alias("_k"), "_segments").agg(F.count("*").alias("_n"), F.count_if(F.col("_r.verdict") == "allow").alias("_good"), F.count_if(F.col("_r.verdict") == "block").alias("_bad"))
    )
    grown = grow(shapes, children, support)
    templates = grown.groupBy("_k", "_template").agg(F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad"))
    judged = judged_templates(templates, prior, strength, threshold, z).select("_k", "_template", "_bad_share", "_rejected")
    shaped = grown.join(judged, ["_k", "_template"]).select(F.col("_k").alias("_host"), "_segments", "_template", "_bad_share", "_rejected")
    return parsed.join(shaped, ["_host", "_segments"]).select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_r.name").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(F.col("_rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_template").alias("template"),
        F.col("_bad_share").alias("bad_share"),
    )
