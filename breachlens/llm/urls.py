"""Operator 1: URL filters by path-template trees, in DataFrame functions only.

Explicit rules come first. All other URLs are judged by the template their path falls under:

1. Every host has a tree of path segments. Digits and long hexadecimal runs within a segment are
   variable by their form; a node with many children of few pages each has a variable segment
   by its counts. Both become wildcards.
2. Sibling branches whose labelled shares do not differ from that of their siblings taken
   together (two-proportion z-test) are merged into one, `~`, those that are significantly
   lower into another, `~-`, and those that are higher into a third, `~+`.
3. A template's purity is its share of bad labels, smoothed towards its host's share, which is
   smoothed towards the share of all. Templates of a purity of at least `threshold` are blocked.

The tree is built on counts of distinct forms, level by level, so that a host with very many
pages is as small as its number of forms.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up
to `?`, `#` or the end.

Defined cases: a null URL, or one without `://`, has empty host and path and is judged like any
other page of the empty host; an empty path fits no rule; of rules that fit the longest wins;
repeated rows are judged each; labels that are null count for nothing; an empty table gives no
rows; columns besides the id, the URL and the label are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.common import ascii_lower

#: Levels of a tree; what lies deeper counts as one segment.
DEPTH = 6
#: A node of at least so many children, with fewer pages each than this, has a variable segment.
CHILDREN, PAGES = 8, 4
#: Branches differ from their siblings if the z value is at least this.
DIFFERENT = 1.96
#: Labels that the host's share is worth in a template's purity, and all labels' in a host's.
PRIOR = 5.0


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    mark = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    text = verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        text = text.when(rule.fits(host, path), F.lit(rule.text))
        verdict = verdict.when(rule.fits(host, path), F.lit(rule.verdict))
    return text.otherwise(F.lit(None)), verdict.otherwise(F.lit(None))


def form(path: Column) -> Column:
    """A path with what is variable by its form replaced."""
    hexadecimal = F.regexp_replace(path, r"(?<=[/_-])[0-9a-fA-F-]{16,}(?=$|[/._-])", "*")
    return F.regexp_replace(hexadecimal, r"[0-9]+", "*")


def grown(forms: DataFrame) -> DataFrame:
    """(host, form, template) from (host, form, n, labelled, bad), a level at a time."""
    parts = F.filter(F.split("form", "/"), lambda x: x != "")
    cut = F.when(F.size(parts) > DEPTH, F.concat(
        F.slice(parts, 1, DEPTH - 1), F.array(F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts), F.lit(1))), "/"))
    )).otherwise(parts)
    tree = forms.select("host", "form", "n", "labelled", "bad", cut.alias("parts"), F.lit("").alias("template"))
    for level in range(DEPTH):
        part = F.get("parts", F.lit(level))
        node = Window.partitionBy("host", "template")
        branch = Window.partitionBy("host", "template", "part")
        counted = tree.withColumn("part", part).select(
            "*", F.dense_rank().over(node.orderBy("part")).alias("number"),
            *[F.sum(c).over(branch).alias(f"own_{c}") for c in ("labelled", "bad")],
            *[F.sum(F.when(F.col("part").isNotNull(), F.col(c))).over(node).alias(f"all_{c}")
              for c in ("n", "labelled", "bad")],
        ).withColumn("children", F.max(F.when(F.col("part").isNotNull(), F.col("number"))).over(node))
        own, rest = F.col("own_labelled"), F.col("all_labelled") - F.col("own_labelled")
        share = F.col("all_bad") / F.nullif(F.col("all_labelled"), F.lit(0))
        gap = F.col("own_bad") / F.nullif(own, F.lit(0)) - (F.col("all_bad") - F.col("own_bad")) / F.nullif(rest, F.lit(0))
        error = F.sqrt(share * (1 - share) * (1 / F.nullif(own, F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
        # Branches without labels, or without labelled siblings, have nothing to differ by.
        differs = F.coalesce(F.abs(gap) >= DIFFERENT * error, F.lit(False)) & (gap != 0)
        side = F.when(F.col("part").isNull(), "").when(differs & (gap < 0), "~-").when(differs & (gap > 0), "~+").otherwise("~")
        same = Window.partitionBy("host", "template", "side")
        sided = counted.withColumn("side", side).withColumn(
            "place", F.dense_rank().over(same.orderBy("part"))
        ).withColumn("together", F.max("place").over(same))
        variable = (F.col("children") >= CHILDREN) & (F.col("all_n") < PAGES * F.col("children"))
        kept = F.when(variable, F.lit("*")).when(F.col("together") > 1, F.col("side")).otherwise(F.col("part"))
        tree = sided.withColumn(
            "template", F.when(F.col("part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), kept))
        ).select("host", "form", "n", "labelled", "bad", "parts", "template")
    return tree.select("host", "form", "labelled", "bad", "template")


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for every page.

    `labels` has (url, bad) with bad 0 or 1, for some URLs.
    """
    def located(rows: DataFrame, first: str, url: str) -> DataFrame:
        host, path = parsed(F.col("url"))
        plain = rows.select(F.col(first).alias("first"), F.col(url).cast("string").alias("url"))
        return plain.select("first", host.alias("host"), path.alias("path")).withColumn("form", form(F.col("path")))

    judged = located(pages, id_col, url_col)
    marked = located(labels, "bad", "url").where(F.col("first").isNotNull()).groupBy("host", "form").agg(
        F.count("*").alias("labelled"), F.sum(F.col("first").cast("long")).alias("bad"),
    )
    forms = judged.groupBy("host", "form").agg(F.count("*").alias("n")).join(marked, ["host", "form"], "left").fillna(
        0, ["labelled", "bad"]
    )
    whole = marked.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    overall = (whole["bad"] or 0) / (whole["labelled"] or 1)
    template, host = Window.partitionBy("host", "template"), Window.partitionBy("host")

    def total(column: str, over) -> Column:
        return F.sum(column).over(over)

    host_share = (total("bad", host) + PRIOR * overall) / (total("labelled", host) + PRIOR)
    purity = (total("bad", template) + PRIOR * host_share) / (total("labelled", template) + PRIOR)
    known = grown(forms).select("host", "form", "template", purity.alias("purity"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return judged.join(known, ["host", "form"], "left").select(
        F.col("first").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "template", "purity",
    )
