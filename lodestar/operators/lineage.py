"""Jobs over model and report metadata."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import bracket_references, first_capture
from lodestar.sources.staging import stage


def source_tables(parts: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The source table of every model table, sorted.

    ``parts`` has workspace, model_name, table_name, entity_name and expression. The
    entity name wins; else the capture of the first pattern that matches the
    expression; else the whole expression.
    """

    def filled(c):
        return F.when(c != "", c)

    source = F.coalesce(
        filled(F.col("entity_name")),
        filled(first_capture("expression", patterns)),
        filled(F.col("expression")),
    )
    return parts.select(
        "workspace", "model_name", "table_name", source.alias("source_table_name")
    ).orderBy("workspace", "model_name", "table_name")


def expression_references(df: DataFrame, expression: str, name: str = "reference") -> DataFrame:
    """One row per ``[name]`` in the expression; other columns are kept."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != expression]
    return df.select(*kept, F.explode(bracket_references(expression)).alias(name))


# The files of a report definition that hold references, and its measures.
PART_FILES = r"/definition/(report\.json|pages/[^/]+/page\.json|pages/[^/]+/visuals/[^/]+/visual\.json|bookmarks/[^/]+\.bookmark\.json)$"
MEASURE_FILES = r"/definition/reportExtensions\.json$"


def definition_files(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON files below a folder: path and value, their whole text."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True, recursiveFileLookup=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("path"), "value")


def _report_files(files: DataFrame, wanted: str) -> DataFrame:
    """Files of report definitions: report, path and json, without a byte order mark.

    The report is the folder that holds the definition. ``error`` tells of text that is
    not JSON.
    """
    text = F.regexp_replace("value", "^\ufeff", "")
    return files.select("path", text.alias("json")).filter(F.col("path").rlike(wanted)).select(
        F.regexp_extract("path", "([^/]+)/definition/", 1).alias("report"), "path", "json",
        F.when(F.try_parse_json("json").isNull(), "not JSON").alias("error"),
    )


def report_parts(files: DataFrame) -> DataFrame:
    """The parts of all reports among definition files: report, path, json and error.

    ``files`` has path and value, one row a file: those of a folder, or of a table into which
    many small files were packed.
    """
    return _report_files(files, PART_FILES)


def read_report_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of all reports below a folder: report, path, json and error."""
    return report_parts(definition_files(spark, folder))


def report_measures(files: DataFrame) -> DataFrame:
    """The measures that reports among definition files (path, value) define themselves.

    A file that is not JSON comes as one row with its error and no measure.
    """
    measure = "name string, expression string, dataType string, formatString string, dataCategory string"
    schema = f"entities array<struct<name: string, measures: array<struct<{measure}>>>>"
    found = _report_files(files, MEASURE_FILES)
    entities = found.select("report", "error", F.explode_outer(F.from_json("json", schema)["entities"]).alias("e"))
    rows = entities.select("report", "error", F.col("e.name").alias("table"), F.explode_outer("e.measures").alias("m"))
    return rows.filter("m.name is not null or error is not null").select(
        "report", "table", F.col("m.name").alias("name"), F.col("m.expression").alias("expression"),
        F.col("m.dataType").alias("data_type"), F.col("m.formatString").alias("format_string"),
        F.col("m.dataCategory").alias("data_category"), "error",
    )


def read_report_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The measures that reports below a folder define themselves, as ``report_measures``."""
    return report_measures(definition_files(spark, folder))


def _part_walker(skip_unapplied: bool) -> Callable[[pd.Series], pd.Series]:
    """The function that walks a batch of report parts.

    Its helpers are local, so they travel to the executors with it and the package need
    not be installed there.
    """

    def measure_of(field: object) -> tuple[str, str] | None:
        """(entity, measure) of a field object that names a measure."""
        measure = field.get("Measure") if isinstance(field, dict) else None
        if not isinstance(measure, dict) or not isinstance(measure.get("Property"), str):
            return None
        at = measure.get("Expression")
        for step in ("SourceRef", "Entity"):
            at = at.get(step) if isinstance(at, dict) else None
        return (at, measure["Property"]) if isinstance(at, str) else None

    def references(root: object) -> Iterator[tuple[str | None, str]]:
        # a stack of its own, so that trees may be of any depth
        stack: list[tuple[object, bool, frozenset]] = [(root, False, frozenset())]
        while stack:
            node, in_filters, hidden = stack.pop()
            if isinstance(node, list):
                stack += [(item, in_filters, hidden) for item in reversed(node)]
                continue
            if not isinstance(node, dict):
                continue
            filtered = measure_of(node.get("field"))
            if skip_unapplied and in_filters and filtered and "filter" not in node:
                hidden = hidden | {filtered}
            own = measure_of(node)
            if own and own not in hidden:
                yield own
            text = node.get("Expression")
            if isinstance(text, str):
                quiet = {name for _, name in hidden}
                for part in text.split("[")[1:]:
                    name = part.partition("]")[0]
                    if "]" in part and name and name not in quiet:
                        yield None, name
            stack += [
                (value, in_filters or "filterConfig" in key, hidden)
                for key, value in reversed(list(node.items()))
            ]

    def walk(texts: pd.Series) -> pd.Series:
        def found(t: str | None) -> list[dict]:
            if t is None:
                return []
            try:
                refs = references(json.loads(t.lstrip("\ufeff")))
            except json.JSONDecodeError:
                return []
            return [{"entity": e, "name": n} for e, n in dict.fromkeys(refs)]

        return texts.map(found)

    return walk


def report_measure_refs(
    parts: DataFrame, text: str = "json", ignore_unapplied_filters: bool = False
) -> DataFrame:
    """The measures each report part refers to: columns ``entity`` and ``name``.

    A part refers to a measure by a ``Measure`` object, or by ``[name]`` in an
    ``Expression`` text, where the entity is null. With ``ignore_unapplied_filters``
    a filter pane entry without a condition does not count. Parts are JSON trees of
    any depth, so each batch of parts is walked in Python. Text that is not JSON has no
    references; ``read_report_parts`` tells which parts those are.
    """
    kind = "array<struct<entity:string,name:string>>"
    refs = F.pandas_udf(_part_walker(ignore_unapplied_filters), kind)
    kept = [F.col(f"`{c}`") for c in parts.columns if c != text]
    return parts.select(*kept, F.inline(refs(text)))


def unused_measures(
    measures: DataFrame, refs: DataFrame, max_rounds: int | None = None
) -> tuple[DataFrame, int]:
    """Measures nothing refers to, found in rounds, and the number of rounds run.

    ``measures`` has report, table, name and expression, ``refs`` report, entity and name;
    repeated rows count once. Each round drops the measures that neither a report part nor the
    expression of a remaining measure refers to, until none is left to drop; the last,
    empty round is counted. Self-references and cycles keep a measure. All reports are
    treated at once. With ``max_rounds`` more rounds than that are an error.

    The round of a name is one more than the latest round of its callers. Where all callers
    but one are settled, it is a function max(m, x + w) of that caller's round x, and such
    functions are closed under composition. So each pass settles what it can and lets every
    name with a single open caller point past it, which halves the way of a long chain: the
    passes grow with the logarithm of the depth.
    """
    names = stage(_names(measures, refs))
    state = stage(_first_state(names))
    while True:
        state = stage(_next_state(state))
        left = state.agg(
            F.bool_or("moved").alias("moved"), F.bool_or(F.col("caller").isNotNull()).alias("open"),
            F.max(F.when(~F.col("kept"), F.col("m"))).alias("last"),
        ).first()
        if not (left["moved"] and left["open"]):
            break
    dropped = _nodes(state).filter("callers = 0 and not kept").select("node", F.col("m").alias("round"))
    # with every call settled a name has one row
    last = (dropped.agg(F.max("round")).first()[0] if left["open"] else left["last"]) or 0
    if max_rounds is not None and last >= max_rounds:
        raise ValueError(f"more than {max_rounds} rounds are needed")
    found = names.join(dropped, "node").select("report", "name", F.inline("tables"), "round")
    return found.select("report", "name", "table", "round"), last + 1


def _names(measures: DataFrame, refs: DataFrame) -> DataFrame:
    """Each report and name with a number, its tables and calls, and if a part shows it."""
    shown = refs.select(
        F.col("report").alias("_report"), F.col("name").alias("_name"), F.col("entity").alias("_entity")
    ).distinct()
    same = (F.col("report") == F.col("_report")) & (F.col("name") == F.col("_name"))
    hit = same & (F.col("_entity").isNull() | (F.col("_entity") == F.col("table")))
    return (
        measures.select("report", "name", "table", "expression").join(shown, hit, "left")
        .groupBy("report", "name").agg(
            F.bool_or(F.col("_name").isNotNull()).alias("kept"), F.collect_set(F.struct("table")).alias("tables"),
            F.array_distinct(F.flatten(F.collect_set(bracket_references("expression")))).alias("calls"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )


def _first_state(names: DataFrame) -> DataFrame:
    """A row per name, and one per call of it, in numbers.

    Columns node, ``caller`` (open, or null), m and w as in ``unused_measures``, and
    ``kept`` (the name stays).
    """
    calls = names.select("report", F.col("node").alias("caller"), F.explode("calls").alias("name")).join(
        names.select("report", "name", "node"), ["report", "name"]
    )
    none, zero = F.lit(None).cast("long"), F.lit(0)
    return names.select("node", none.alias("caller"), F.lit(1).alias("m"), zero.alias("w"), "kept").unionByName(
        calls.select("node", "caller", zero.alias("m"), F.lit(1).alias("w"), F.lit(False).alias("kept"))
    )


def _nodes(state: DataFrame) -> DataFrame:
    """Each name with its number of open callers, one of them, its function and if it stays."""
    return state.groupBy("node").agg(
        F.count("caller").alias("callers"), F.max("caller").alias("up"), F.max("m").alias("m"), F.max("w").alias("w"),
        F.bool_or(F.col("kept") | F.coalesce(F.col("caller") == F.col("node"), F.lit(False))).alias("kept"),
    )


def _next_state(state: DataFrame) -> DataFrame:
    """Callers that are settled become numbers, those with one open caller give way to it.

    ``moved`` tells the calls whose caller was settled.
    """
    known = _nodes(state).filter("callers <= 1 or kept").select(
        F.col("node").alias("_node"), "up", F.col("m").alias("_m"), F.col("w").alias("_w"), F.col("kept").alias("_kept")
    )
    rows = state.select("node", "caller", "m", "w", "kept")
    met = rows.filter(F.col("caller").isNotNull()).join(known, F.col("caller") == F.col("_node"), "left")
    found = F.col("_node").isNotNull()
    stays = F.coalesce("_kept", F.lit(False))
    moved = met.select(
        "node",
        F.when(stays, None).when(found, F.col("up")).otherwise(F.col("caller")).alias("caller"),
        F.when(found & ~stays, F.greatest("m", F.col("_m") + F.col("w"))).otherwise(F.col("m")).alias("m"),
        F.when(~found, F.col("w")).when(~stays & F.col("up").isNotNull(), F.col("w") + F.col("_w")).otherwise(0).alias("w"),
        (F.col("kept") | stays).alias("kept"),
        (found & (stays | F.col("up").isNull())).alias("moved"),
    )
    done = rows.filter(F.col("caller").isNull()).withColumn("moved", F.lit(False))
    return done.unionByName(moved).groupBy("node", "caller").agg(
        F.max("m").alias("m"), F.max("w").alias("w"), F.bool_or("kept").alias("kept"), F.bool_or("moved").alias("moved")
    )


def dependency_closure(edges: DataFrame, seeds: DataFrame, key: str = "object") -> DataFrame:
    """Everything the seeds depend on, directly or not, with the least distance.

    ``edges`` has the columns ``object`` and ``depends_on``; rows with a null in either, and
    null seeds, name nothing and are left out. An object is kept once, so cycles end.

    Each round follows the edges of the objects whose distance has changed. An object with a
    single dependency also gets shortcuts that skip 2, 4, 8, ... steps and know how many:
    round r makes those of 2^r steps from the ones before and follows them from all that is
    known, so a chain takes the logarithm of its length. There is at most one shortcut an
    object and round; an object with several dependencies gets none.
    """
    edges = stage(
        edges.select("object", "depends_on", F.lit(1).alias("steps")).filter("object is not null and depends_on is not null")
    )
    jumps = stage(
        edges.groupBy("object").agg(F.min("depends_on").alias("depends_on"), F.max("depends_on").alias("_last"))
        .filter("depends_on = _last").select("object", "depends_on", F.lit(1).alias("steps"))
    )
    known = stage(seeds.select(F.col(key).alias("object")).filter("object is not null").distinct().withColumn("depth", F.lit(0)))
    changed, followed, longer = known, edges, True
    while True:
        reached = _reached(changed, followed)
        if longer:
            jumps = stage(_twice(jumps))
            longer = not jumps.isEmpty()
        if longer:
            reached = reached.unionByName(_reached(known, jumps))
            followed = followed.unionByName(jumps)
        changed = stage(_nearer(reached, known))
        if changed.isEmpty():
            return known
        known = stage(known.unionByName(changed).groupBy("object").agg(F.min("depth").alias("depth")))


def _reached(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The objects that edges lead to from known ones, with their distance."""
    return known.join(edges, "object").select(F.col("depends_on").alias("object"), (F.col("depth") + F.col("steps")).alias("depth"))


def _twice(jumps: DataFrame) -> DataFrame:
    """Each jump and then the one from where it leads."""
    on = jumps.select(F.col("object").alias("depends_on"), F.col("depends_on").alias("_end"), F.col("steps").alias("_steps"))
    return jumps.join(on, "depends_on").select(
        "object", F.col("_end").alias("depends_on"), (F.col("steps") + F.col("_steps")).alias("steps")
    )


def _nearer(reached: DataFrame, known: DataFrame) -> DataFrame:
    """The least distance of each reached object, where it is new or less than the known one."""
    least = reached.groupBy("object").agg(F.min("depth").alias("depth"))
    before = known.select("object", F.col("depth").alias("_before"))
    return least.join(before, "object", "left").filter("_before is null or depth < _before").drop("_before")
