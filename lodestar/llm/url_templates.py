"""URL filters: listed rules first, then templates of paths learned per host.

The paths of a host form a tree. Runs of digits and long hexadecimal segments count as one
number, which the character ``#`` stands for, as no path can hold it. From the top level down
the children of a node become branches of its template:

* more than ``most_branches`` different children are a variable: all are the wildcard ``?``;
* of fewer, a child whose pages are distributed like those of its siblings together joins the
  wildcard, the others stay as they are. Pages are counted by the kind of the next segment and
  by label; the distance is Hellinger's, less what chance adds at these counts.

A template is rejected when its purity, (bad + 1) / (bad + good + 2) over its labelled pages,
reaches ``least_purity``. So a template without labels is never rejected.

A template names ``levels`` segments, and one mark stands for all beyond them. Each level is
one pass over the distinct paths, stored in between, so neither a host nor a template with a
third of all pages is ever gathered: nodes are sums, and only nodes with few children meet
them again. A null url, or one without ``://``, has an empty host and path.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.staging import stage

# Kinds of a segment: none, a number, one with numbers, one with a dot, another word.
KINDS = 5
# Label classes: good, bad, without.
CLASSES = 3
CELLS = KINDS * CLASSES
NUMBER, ANY, REST = "#", "?", "/??"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TemplateSettings:
    levels: int = 8
    most_branches: int = 16
    most_distance: float = 0.1
    least_purity: float = 0.8


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (text, allow), null without one.

    Of equally long ones that with the longer host counts, then the one listed first.
    """
    found = F.lit(None).cast("struct<text: string, allow: boolean>")
    for rule in sorted(reversed(rules), key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The non-empty segments of a path, numbers as one mark."""
    return F.transform(
        F.filter(F.split(path, "/", -1), lambda s: s != ""),
        lambda s: F.when(s.rlike("^[0-9A-Fa-f-]{16,}$"), NUMBER).otherwise(F.regexp_replace(s, "[0-9]+", NUMBER)),
    )


def _kind(segment: Column) -> Column:
    """0 to 4, as KINDS lists them."""
    return (
        F.when(segment.isNull(), 0).when(segment == NUMBER, 1).when(segment.contains(NUMBER), 2)
        .when(segment.contains("."), 3).otherwise(4)
    )


def _distance(n: Column, whole: Column) -> Column:
    """Hellinger distance of a branch's cells c0.. to those of its siblings, less chance."""
    rest = whole - n
    parts = [F.sqrt((F.col(f"c{j}") / n) * ((F.col(f"w{j}") - F.col(f"c{j}")) / rest)) for j in range(CELLS)]
    used = sum((F.when(F.col(f"w{j}") > 0, 1).otherwise(0) for j in range(CELLS)), F.lit(0))
    overlap = parts[0]
    for part in parts[1:]:
        overlap = overlap + part
    return 1.0 - overlap - (used - 1) / (8.0 * n) - (used - 1) / (8.0 * rest)


def _own_branches(here: DataFrame, settings: TemplateSettings) -> DataFrame:
    """The children (host, node, segment) that stay as they are."""
    label = {0: F.col("good"), 1: F.col("bad"), 2: F.col("n") - F.col("good") - F.col("bad")}
    cells = [
        F.sum(F.when(F.col("next") == j // CLASSES, label[j % CLASSES]).otherwise(0)).alias(f"c{j}") for j in range(CELLS)
    ]
    # stored, so that the join with a node of many children can be split
    children = stage(here.groupBy("host", "node", "segment").agg(F.sum("n").alias("n"), *cells))
    nodes = (
        children.groupBy("host", "node")
        .agg(F.count(F.lit(1)).alias("width"), F.sum("n").alias("whole"), *[F.sum(f"c{j}").alias(f"w{j}") for j in range(CELLS)])
        .filter(F.col("width") <= settings.most_branches)
    )
    apart = _distance(F.col("n"), F.col("whole")) > settings.most_distance
    return (
        children.join(nodes, ["host", "node"]).filter((F.col("width") == 1) | apart)
        .select("host", "node", "segment", F.lit(True).alias("own"))
    )


def learn_templates(paths: DataFrame, settings: TemplateSettings = TemplateSettings()) -> DataFrame:
    """The template of every distinct path, and whether it is rejected.

    ``paths`` has host, path (segments joined by ``/``), n, good and bad, a row per path.
    """
    segment = F.split("path", "/", -1)
    rows = stage(paths.select("*", F.when(F.col("path") == "", 0).otherwise(F.size(segment)).alias("depth"), F.lit("").alias("node")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    for level in range(min(deepest, settings.levels)):
        deep = F.col("depth") > level
        here = rows.withColumn("segment", F.when(deep, F.get(segment, F.lit(level)))).withColumn(
            "next", _kind(F.when(F.col("depth") > level + 1, F.get(segment, F.lit(level + 1))))
        )
        own = _own_branches(here.filter(deep), settings)
        step = F.concat("node", F.lit("/"), F.when(F.col("own"), F.col("segment")).otherwise(ANY))
        rows = stage(
            here.join(own, ["host", "node", "segment"], "left")
            .select("host", "path", "n", "good", "bad", "depth", F.when(deep, step).otherwise(F.col("node")).alias("node"))
        )
    longer = F.concat("node", F.when(F.col("depth") > settings.levels, REST).otherwise(""))
    rows = rows.select("host", "path", "good", "bad", longer.alias("template"))
    purity = (F.sum("bad") + 1) / (F.sum("bad") + F.sum("good") + 2)
    judged = rows.groupBy("host", "template").agg((purity >= settings.least_purity).alias("rejected"))
    return rows.join(judged, ["host", "template"]).select("host", "path", "template", "rejected")


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], label: Column | None = None,
    settings: TemplateSettings = TemplateSettings(), page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and template.

    ``label`` is true for pages known to be bad, false for good ones and null for others;
    without it the rules' verdicts are the labels.
    """
    link = F.col(url)
    read = pages.select(
        F.col(page_id).alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"),
        *([label.alias("label")] if label is not None else []),
    ).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    if label is None:
        read = read.withColumn("label", ~F.col("found.allow"))
    read = read.withColumn("shape", F.array_join(segments(F.col("path")), "/"))
    paths = read.groupBy("host", F.col("shape").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label")).alias("good"), F.count_if("label").alias("bad")
    )
    learned = stage(learn_templates(paths, settings)).withColumnRenamed("path", "shape")
    verdict = F.when(F.coalesce(F.col("found.allow"), ~F.col("rejected")), "allow").otherwise("block")
    return read.join(learned, ["host", "shape"], "left").select(
        "page_id", "host", "path", F.col("found.text").alias("rule"), verdict.alias("verdict"), "template"
    )
