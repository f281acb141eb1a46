"""URL filters: host and path rules, and a path-template tree judged by smoothed labelled purity.

For every host the path segments make a tree. Variable segments (those with a digit, and those seen fewer
than MIN_SUPPORT times in their place) become wildcards. Sibling branches below one parent whose labelled
shares do not differ more than chance explains are merged into the parent's wildcard branch. A template is
rejected if its share of blocked among labelled urls, smoothed by the share over all urls, reaches PURITY;
templates without a labelled url are allowed. Labels are given, or are the verdicts of the rules.

All of it is DataFrame functions. Rows are counted by (host, template) before anything else moves, so a host
with a third of all rows is a few counted rows per task; the tree is worked out on that table.

Defined cases: a null url or one without `://` has an empty host and path and is judged by the method
like any other; host letters A-Z are lower-cased, nothing else changes; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.rows import others, quoted

MIN_SUPPORT = 5
SMOOTHING = 2.0
PURITY = 0.5
#: Standard errors by which the share of a branch may differ from its siblings' and still be merged.
ALIKE = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. Rules are a short given list."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    none = F.lit(None).cast("string")
    ranked = sorted(rules, key=lambda r: (len(r[1]), r[1]))  # the longest is asked first, so it is wrapped last
    name = reduce(lambda rest, r: F.when(fits(r[1]), F.lit(r[1])).otherwise(rest), ranked, none)
    verdict = reduce(lambda rest, r: F.when(fits(r[1]), F.lit(r[0])).otherwise(rest), ranked, none)
    return name, verdict


def first_template(path: Column) -> Column:
    """The path with every segment that holds a digit generalised to a wildcard."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))


def templates(counted: DataFrame, min_support: int = MIN_SUPPORT, smoothing: float = SMOOTHING, purity: float = PURITY) -> DataFrame:
    """host, first (its raw template), template, labelled, purity and blocked from counts by host and first.

    counted: host, first array<string>, n, labelled, blocked.
    """
    each = counted.select("host", "first", "n", F.posexplode_outer("first").alias("pos", "segment"))
    seen = each.groupBy("host", "pos", "segment").agg(F.sum("n").alias("support"))
    seen = seen.select(F.col("host").alias("h"), F.col("pos").alias("p"), F.col("segment").alias("s"), "support")
    same = (F.col("host") == F.col("h")) & F.col("pos").eqNullSafe(F.col("p")) & F.col("segment").eqNullSafe(F.col("s"))
    general = F.when(F.col("support") < min_support, F.lit("*")).otherwise(F.col("segment"))
    part = F.when(F.col("pos").isNotNull(), F.struct("pos", general.alias("segment")))
    grown = each.join(seen, same).groupBy("host", "first").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    grown = grown.withColumn("grown", F.transform("parts", lambda p: p["segment"])).drop("parts")
    tree = counted.join(grown, ["host", "first"]).withColumn("last", F.array_position(F.reverse(F.transform("grown", lambda s: s != "*")), True))
    size = F.size("grown")
    parent = F.when(F.col("last") > 0, F.transform("grown", lambda s, i: F.when(i == size - F.col("last"), F.lit("*")).otherwise(s))).otherwise(F.col("grown"))
    branch = tree.withColumn("parent", parent).groupBy("host", "parent", "grown").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    siblings = Window.partitionBy("host", "parent")
    rate = (F.sum("b").over(siblings) + 1) / (F.sum("l").over(siblings) + 2)
    away = F.abs(F.col("b") / F.col("l") - rate)
    alike = (F.col("l") > 0) & (away <= ALIKE * F.sqrt(rate * (1 - rate) / F.col("l")))
    merged = branch.select("host", "grown", F.when(F.coalesce(alike, F.lit(False)), F.col("parent")).otherwise(F.col("grown")).alias("template"), "l", "b")
    whole = merged.agg(F.sum("b").alias("all_b"), F.sum("l").alias("all_l"))
    prior = (F.col("all_b") + 1) / (F.col("all_l") + 2)
    judged = merged.groupBy("host", "template").agg(F.sum("l").alias("labelled"), F.sum("b").alias("b")).join(F.broadcast(whole))
    share = (F.col("b") + smoothing * prior) / (F.col("labelled") + smoothing)
    judged = judged.select("host", "template", "labelled", share.alias("purity"), ((F.col("labelled") > 0) & (share >= purity)).alias("rejected"))
    return tree.select("host", "first", "grown").join(merged.select("host", "grown", "template"), ["host", "grown"]).join(judged, ["host", "template"]).drop("grown")


def judge(
    pages: DataFrame,
    rules: list[Rule],
    url: str = "url",
    label: str | None = None,
    carry: list[str] | None = None,
    min_support: int = MIN_SUPPORT,
    smoothing: float = SMOOTHING,
    purity: float = PURITY,
) -> DataFrame:
    """Columns of pages with host, path, rule, template, purity and verdict (allow or block).

    rules: pairs of verdict and `host/path`. label names a boolean column, true for urls known to be bad and
    null for unknown ones; without it the verdicts of the rules are the labels.
    """
    new = ["host", "path", "rule", "template", "purity", "verdict"]
    kept = [c for c in others(pages, new) if carry is None or c in carry]
    names = [f"c{i}" for i in range(len(kept))]
    rows = pages.select(
        *(pages[quoted(c)].alias(n) for c, n in zip(kept, names, strict=True)),
        host_of(pages[quoted(url)]).alias("host"), path_of(pages[quoted(url)]).alias("path"),
        (pages[quoted(label)] if label else F.lit(None).cast("boolean")).alias("bad"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "first": first_template(F.col("path"))})
    known = F.col("bad") if label else F.col("by_rule") == "block"
    counted = rows.groupBy("host", "first").agg(
        F.count("*").alias("n"), F.count(known).alias("labelled"), F.coalesce(F.sum(known.cast("int")), F.lit(0)).alias("blocked")
    )
    tree = templates(counted, min_support, smoothing, purity)
    out = rows.join(tree, ["host", "first"], "left")
    verdict = F.coalesce("by_rule", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    template = F.concat(F.lit("/"), F.array_join("template", "/"))
    return out.select(*names, "host", "path", "rule", template, "purity", verdict).toDF(*kept, *new)
