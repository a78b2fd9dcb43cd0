"""Queries over logs, lineage and report metadata."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.dates import local_moment
from lodestar.operators.lineage import (
    dependency_closure,
    expression_references,
    report_measure_refs,
    report_measures,
    report_parts,
    source_tables,
)
from lodestar.operators.lineage import unused_measures as find_unused
from lodestar.operators.logs import (
    LogStar,
    build_log_star,
    compare_runs,
    models_by_status,
)
from lodestar.operators.logs import spike_query_log as find_spike
from lodestar.queries.columns import request_properties
from lodestar.queries.registry import Tables, query
from lodestar.plans.sketches import merged_quantiles, run_sketches
from lodestar.sources.staging import stage, staging_path
from lodestar.sources.tables import append_log, read_runs, write_run


def _k() -> Column:
    return F.get_json_object("props", "$.k")


@query("""
WITH b AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h,
                  'r' || json_extract_string(props, '$.k') AS report_id, event_type AS visual_id
           FROM events WHERE event_type = 'view')
SELECT strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS ts, coalesce(report_id, 'none') AS report_id,
       coalesce(visual_id, 'none') AS visual_id, e.user_id, value
FROM events e LEFT JOIN b ON e.user_id = b.user_id AND date_trunc('hour', e.ts) = b.h
WHERE event_type = 'error'
  AND ts BETWEEN TIMESTAMP '2024-01-03 05:00:00' AND TIMESTAMP '2024-01-28 17:00:00'
""")
def spike_query_log(t: Tables) -> DataFrame:
    """Errors of a time range with the views of the same user and hour, dearest first."""
    operation = F.date_trunc("hour", F.col("ts")).alias("operation")
    ends = t.events.filter("event_type = 'error'").select("*", operation)
    begins = t.events.filter("event_type = 'view'").select(
        "user_id", operation, request_properties().alias("properties")
    )
    rows = find_spike(
        ends, begins, ["user_id", "operation"], "ts", "value",
        dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 28, 12), 5, "properties",
        {"report_id": "$.Sources[0].ReportId", "visual_id": "$.Sources[0].VisualId"}, ["user_id"],
    )
    none = F.lit("none")
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.coalesce("report_id", none).alias("report_id"),
        F.coalesce("visual_id", none).alias("visual_id"), "user_id", "value",
    )


@query("""
SELECT r_name AS workspace, n_name AS model_name, c_name AS table_name,
  coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_name || ' entity'
    WHEN 'BUILDING' THEN 'table_' || c_custkey WHEN 'FURNITURE' THEN 'item ' || c_custkey
    WHEN 'HOUSEHOLD' THEN '#date(2013, 1, 1)' END, 'none') AS source_table_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def source_table_lineage(t: Tables) -> DataFrame:
    """Source names from an entity, from two patterns, from the expression, or none."""
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    expression = (
        F.when(segment == "BUILDING", F.concat(F.lit('let S = SourceTable("table_'), key, F.lit('") in S')))
        .when(segment == "FURNITURE", F.concat(F.lit('Source{[Item="item '), key, F.lit('"]}[Data]')))
        .when(segment == "HOUSEHOLD", "#date(2013, 1, 1)")
        .otherwise("")
    )
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("workspace"), F.col("n_name").alias("model_name"),
        F.col("c_name").alias("table_name"),
        F.when(segment == "AUTOMOBILE", F.concat("c_name", F.lit(" entity"))).alias("entity_name"),
        expression.alias("expression"),
    )
    sources = source_tables(parts, [r'SourceTable\("([^"]+)"\)', r'\[Item="([^"]+)"\]'])
    return sources.withColumn("source_table_name", F.coalesce("source_table_name", F.lit("none")))


@query("""
SELECT p_partkey, unnest([p_name, p_type, p_brand]) AS reference FROM part
""")
def measure_dependencies(t: Tables) -> DataFrame:
    """Every measure an expression refers to."""
    expression = F.concat(
        F.lit("DIVIDE(SUM(Sales["), F.col("p_name"), F.lit("]) + ["), F.col("p_type"),
        F.lit("], ["), F.col("p_brand"), F.lit("])"),
    )
    return expression_references(t.part.select("p_partkey", expression.alias("e")), "e")


@query("""
SELECT user_id AS model, CASE WHEN event_type <> 'error' THEN 'ok'
  WHEN json_extract_string(props, '$.k')::INT < 50 THEN 'security_error' ELSE 'other_error' END AS status,
  count(*) AS probes
FROM events GROUP BY ALL
""")
def error_classification(t: Tables) -> DataFrame:
    """Probe results per model by kind of error."""
    text = F.when(
        F.col("event_type") == "error",
        F.when(
            _k().cast("int") < 50,
            F.concat(F.lit("Failed: universal SECURITY version mismatch error on artifact "), _k()),
        ).otherwise(F.concat(F.lit("timeout "), _k())),
    )
    logs = t.events.select(F.col("user_id").alias("model"), text.alias("error"))
    return models_by_status(logs, "model", "error")


_RUNS_SQL = """
SELECT event_type AS query, CASE WHEN json_extract_string(props, '$.k')::INT < 30 THEN 'cold'
         WHEN json_extract_string(props, '$.k')::INT < 60 THEN 'warm' ELSE 'hot' END AS state,
       CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'v1' ELSE 'v2' END AS version,
       value AS duration, value / 2 AS cpu, value < 100 AS success FROM events
"""


@query(f"""
WITH g AS (SELECT query, state, version, count(*) AS runs, avg(duration) AS d, min(duration) AS lo,
                  max(duration) AS hi, avg(cpu) AS cpu, avg(success::INT) AS success_rate
           FROM ({_RUNS_SQL}) GROUP BY ALL)
SELECT g.query, g.state, g.version, g.runs, round(g.d, 6) AS avg_duration, g.lo AS min_duration,
       g.hi AS max_duration, round(g.cpu, 6) AS avg_cpu, round(g.success_rate, 6) AS success_rate,
       round(g.d / b.d, 6) AS ratio
FROM g JOIN g b ON g.query = b.query AND g.state = b.state AND b.version = 'v1'
""")
def perf_log_compare(t: Tables) -> DataFrame:
    """Runs appended to a log by date, then compared between two versions."""
    k = _k().cast("int")
    runs = t.events.select(
        F.col("event_type").alias("query"),
        F.when(k < 30, "cold").when(k < 60, "warm").otherwise("hot").alias("state"),
        F.when(F.col("ts") < local_moment(dt.datetime(2024, 1, 16)), "v1")
        .otherwise("v2").alias("version"),
        F.col("value").alias("duration"), (F.col("value") / 2).alias("cpu"),
        (F.col("value") < 100).alias("success"), F.to_date("ts").alias("run_date"),
    )
    path = staging_path(t.spark)
    for version in ("v1", "v2"):
        append_log(runs.filter(F.col("version") == version), path)
    log = t.spark.read.schema(runs.schema).parquet(path)
    rows = compare_runs(log, ["query", "state"], "version", "v1", "duration", "cpu", "success")
    rounded = {
        c: F.round(c, 6) for c in ("avg_duration", "avg_cpu", "success_rate", "ratio")
    }
    return rows.withColumns(rounded).drop("median_duration")


@query("""
SELECT 'run-' || event_type AS run, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE event_type <> 'error' GROUP BY 1
""")
def runs_written_again(t: Tables) -> DataFrame:
    """A run per kind of event, of which one is repeated with other rows and one cut short."""
    path = staging_path(t.spark)
    events = t.events.select("event_id", "event_type", "value")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a few kinds
    for kind in kinds:
        rows = events.filter(F.col("event_type") == kind)
        if kind == "error":
            # no manifest follows
            rows.write.parquet(f"{path}/rows/run=run-{kind}/attempt=cut")
            continue
        write_run(rows.filter("event_id % 2 = 0"), path, f"run-{kind}")
        write_run(rows, path, f"run-{kind}")
    log = read_runs(t.spark, path, events.schema.toDDL())
    return log.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
WITH v AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)
SELECT event_type, n, round(mean, 4) AS mean, true AS median_near, true AS tail_near FROM v
""")
def run_quantiles_from_sketches(t: Tables) -> DataFrame:
    """Quantiles over all days from a sketch a day, tested by the rank they have in the rows."""
    daily = stage(run_sketches(t.events.withColumn("run", F.to_date("ts")), ["event_type", "run"], "value"))
    found = merged_quantiles(daily, ["event_type"], {"median": 0.5, "tail": 0.9})
    below = t.events.select("event_type", "value").join(F.broadcast(found), "event_type").groupBy("event_type", "n", "mean").agg(
        *[
            ((F.count_if(F.col("value") < F.col(c)) <= (r + 0.03) * F.count(F.lit(1)))
             & (F.count_if(F.col("value") <= F.col(c)) >= (r - 0.03) * F.count(F.lit(1)))).alias(f"{c}_near")
            for c, r in (("median", 0.5), ("tail", 0.9))
        ]
    )
    return below.withColumn("mean", F.round("mean", 4))


def _log_star(t: Tables) -> LogStar:
    logs = t.events.select(
        F.when(F.col("value") < 10, "small").otherwise("large").alias("model"),
        F.col("event_type").alias("object"), F.concat(F.lit("r"), _k()).alias("report"),
        F.col("user_id").alias("user"), F.col("ts").alias("moment"), "event_id", "value",
    )
    statistics = logs.groupBy("model", "object").agg(
        F.count(F.lit(1)).alias("rows"), F.max("value").alias("largest")
    )
    return build_log_star(logs, statistics)


_STAR_SQL = """
WITH l AS (SELECT *, CASE WHEN value < 10 THEN 'small' ELSE 'large' END AS model,
                  'r' || json_extract_string(props, '$.k') AS report FROM events),
k AS (SELECT *, dense_rank() OVER (ORDER BY model, event_type) - 1 AS object_key,
             dense_rank() OVER (ORDER BY model) - 1 AS model_key,
             dense_rank() OVER (ORDER BY report) - 1 AS report_key,
             dense_rank() OVER (ORDER BY user_id) - 1 AS user_key FROM l)
"""

_STAR_KEYS = {
    "_SKey Model Object": "object_key", "_SKey Model": "model_key",
    "_SKey Report": "report_key", "_SKey User": "user_key",
}


@query(f"""{_STAR_SQL}
SELECT object_key, model_key, report_key, user_key, count(*) AS queries FROM k GROUP BY ALL
""")
def log_star_schema(t: Tables) -> DataFrame:
    """Query counts per model object, report and user, by surrogate keys."""
    return _log_star(t).fact_object_query_count.withColumnsRenamed(_STAR_KEYS)


@query(f"""{_STAR_SQL}
SELECT event_id, object_key, model_key, report_key, user_key, value FROM k
""")
def log_star_logs(t: Tables) -> DataFrame:
    """Every log row with its surrogate keys."""
    return _log_star(t).fact_logs.withColumnsRenamed(_STAR_KEYS).drop("moment")


@query(f"""{_STAR_SQL}
SELECT object_key, model_key, count(*) AS rows, max(value) AS largest FROM k GROUP BY ALL
""")
def log_star_statistics(t: Tables) -> DataFrame:
    """Figures per model object, by surrogate keys."""
    return _log_star(t).fact_object_statistics.withColumnsRenamed(_STAR_KEYS)


@query("""
WITH e AS (SELECT CASE WHEN value < 10 THEN 'small' ELSE 'large' END AS model, event_type AS object,
                  value FROM events),
     o AS (SELECT model, object FROM e WHERE object <> 'error' UNION SELECT model, object FROM e
           UNION SELECT 'small', r_name FROM region),
     k AS (SELECT *, dense_rank() OVER (ORDER BY model, object) - 1 AS object_key,
                  dense_rank() OVER (ORDER BY model) - 1 AS model_key FROM o),
     s AS (SELECT model, object, count(*) AS rows FROM e GROUP BY ALL)
SELECT object_key, model_key, rows FROM s JOIN k USING (model, object)
""")
def log_star_unqueried_objects(t: Tables) -> DataFrame:
    """Statistics of objects that no log row names keep their keys."""
    every = t.events.select(
        F.when(F.col("value") < 10, "small").otherwise("large").alias("model"),
        F.col("event_type").alias("object"), F.concat(F.lit("r"), _k()).alias("report"),
        F.col("user_id").alias("user"), F.col("ts").alias("moment"),
    )
    logs = every.filter("object <> 'error'")
    statistics = every.groupBy("model", "object").agg(F.count(F.lit(1)).alias("rows"))
    objects = t.region.select(F.lit("small").alias("model"), F.col("r_name").alias("object"))
    star = build_log_star(logs, statistics, objects)
    return star.fact_object_statistics.withColumnsRenamed(_STAR_KEYS)


def _source_ref(entity, name) -> Column:
    source = F.struct(F.struct(entity.alias("Entity")).alias("SourceRef"))
    return F.struct(
        F.struct(source.getField("SourceRef").alias("SourceRef")).alias("Expression"),
        name.alias("Property"),
    ).alias("Measure")


@query("""
SELECT o_orderkey, o_orderstatus AS entity, o_orderpriority AS name FROM orders
UNION ALL SELECT o_orderkey, 'none', 'Total of ' || o_custkey FROM orders
UNION ALL SELECT o_orderkey, 'customer', 'Filter ' || o_custkey FROM orders WHERE o_orderstatus = 'P'
""", name="report_measure_refs")
def report_measure_refs_of_orders(t: Tables) -> DataFrame:
    """References in report parts; filters without a condition do not count."""
    customer = F.col("o_custkey").cast("string")
    visual = F.struct(
        F.struct(
            F.array(
                F.struct(F.struct(_source_ref(F.col("o_orderstatus"), F.col("o_orderpriority"))).alias("field"))
            ).alias("projections")
        ).alias("query")
    )
    flt = F.struct(
        F.struct(
            _source_ref(F.lit("customer"), F.concat(F.lit("Filter "), customer))
        ).alias("field"),
        F.when(F.col("o_orderstatus") == "P", F.struct(F.lit(2).alias("Version"))).alias("filter"),
    )
    text = F.struct(F.concat(F.lit("1 + [Total of "), customer, F.lit("]")).alias("Expression"))
    parts = t.orders.select(
        "o_orderkey",
        F.to_json(
            F.struct(
                visual.alias("visual"), F.struct(F.array(flt).alias("filters")).alias("filterConfig"),
                F.array(text).alias("objects"),
            )
        ).alias("json"),
    )
    refs = report_measure_refs(parts, ignore_unapplied_filters=True)
    return refs.withColumn("entity", F.coalesce("entity", F.lit("none")))


@query("""
WITH o AS (SELECT c_mktsegment AS report, o_orderkey, c_name, o_orderpriority = '1-URGENT' AS shown
           FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT c_mktsegment AS report, c.c_name, n_name,
             CASE WHEN bool_or(shown) THEN 0 WHEN count(o_orderkey) = 0 THEN 1 ELSE 2 END AS round
      FROM customer c JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c.c_name = o.c_name
      GROUP BY ALL),
n AS (SELECT report, n_name, CASE WHEN min(round) = 0 THEN 0 ELSE max(round) + 1 END AS round
      FROM c GROUP BY ALL)
SELECT report, 'Order ' || o_orderkey AS name, 1 AS round FROM o WHERE NOT shown
UNION ALL SELECT report, c_name, round FROM c WHERE round > 0
UNION ALL SELECT report, n_name, round FROM n WHERE round > 0
""")
def unused_measures(t: Tables) -> DataFrame:
    """Measures no part shows: orders call their customer, customers their nation."""
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    report = F.col("c_mktsegment").alias("report")

    def called(c: str) -> Column:
        return F.concat(F.lit("1 + ["), F.col(c), F.lit("]")).alias("expression")

    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    order_name = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    measures = (
        orders.select(report, F.lit("orders").alias("table"), order_name.alias("name"), called("c_name"))
        .unionByName(
            places.select(report, F.lit("customer").alias("table"), F.col("c_name").alias("name"), called("n_name"))
        )
        .unionByName(
            places.select(
                report, F.lit("nation").alias("table"), F.col("n_name").alias("name"),
                F.lit("SUM(sales)").alias("expression"),
            ).distinct()
        )
    )
    parts = orders.filter("o_orderpriority = '1-URGENT'").select(
        report, F.to_json(F.struct(_source_ref(F.lit("orders"), order_name))).alias("json")
    )
    unused, _ = find_unused(measures, report_measure_refs(parts))
    return unused.drop("table")


@query("""
WITH l AS (SELECT c_custkey // 50 AS chain, c_custkey % 50 AS place FROM customer),
     n AS (SELECT chain, min(place) AS first FROM l GROUP BY chain)
SELECT 'chain ' || chain AS report, 'Measure ' || place AS name, place - first + 1 AS round
FROM l JOIN n USING (chain) WHERE chain % 2 = 0
""")
def unused_measure_chains(t: Tables) -> DataFrame:
    """Chains of up to fifty measures; in every other report a part shows the first."""
    chain, place = F.floor(F.col("c_custkey") / 50), F.col("c_custkey") % 50
    report = F.concat(F.lit("chain "), chain.cast("string")).alias("report")
    measures = t.customer.select(
        report, F.lit("customer").alias("table"), F.concat(F.lit("Measure "), place.cast("string")).alias("name"),
        F.concat(F.lit("1 + [Measure "), (place + 1).cast("string"), F.lit("]")).alias("expression"),
    )
    lowest = t.customer.groupBy(chain.alias("chain")).agg(F.min(place).alias("place")).filter("chain % 2 = 1")
    refs = lowest.select(
        F.concat(F.lit("chain "), F.col("chain").cast("string")).alias("report"), F.lit("customer").alias("entity"),
        F.concat(F.lit("Measure "), F.col("place").cast("string")).alias("name"),
    )
    unused, _ = find_unused(measures, refs)
    return unused.select("report", "name", F.col("round").cast("long").alias("round"))


@query("""
SELECT 'Group ' || c_custkey // 50 || '.Report' AS report, c_name AS name FROM customer WHERE c_custkey % 3 <> 0
""")
def unused_measures_from_files(t: Tables) -> DataFrame:
    """Definition files of a report per fifty customers, packed into a table, and their unused measures."""
    group = F.floor(F.col("c_custkey") / 50).cast("string")
    measure = F.struct(F.col("c_name").alias("name"), F.lit("SUM(sales)").alias("expression"), F.lit("Double").alias("dataType"))
    visual = F.when(F.col("c_custkey") % 3 == 0, F.struct(F.struct(_source_ref(F.lit("Sales"), F.col("c_name"))).alias("field")))
    reports = t.customer.groupBy(group.alias("group")).agg(
        F.to_json(F.struct(F.array(F.struct(F.lit("Sales").alias("name"), F.collect_list(measure).alias("measures"))).alias("entities"))).alias("extensions"),
        F.to_json(F.struct(F.collect_list(visual).alias("visuals"))).alias("page"),
    )

    def file(name: str, value: Column) -> Column:
        return F.struct(F.concat(F.lit("/Group "), "group", F.lit(f".Report/definition/{name}")).alias("path"), value.alias("value"))

    # a part that is not JSON, and a file that belongs to no report definition
    packed = reports.select(F.inline(F.array(
        file("reportExtensions.json", F.concat(F.lit("\ufeff"), "extensions")), file("pages/one/page.json", F.col("page")),
        file("report.json", F.lit("{broken")), file("other.json", F.col("extensions")),
    )))
    files = stage(packed)
    refs = report_measure_refs(report_parts(files).filter("error is null"))
    unused, _ = find_unused(report_measures(files).filter("error is null"), refs.select("report", "entity", "name"))
    return unused.select("report", "name")


@query("""
WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'F')
SELECT 'order ' || o_orderkey AS object, 0 AS depth FROM o
UNION ALL SELECT DISTINCT 'customer ' || o_custkey, 1 FROM o
UNION ALL SELECT DISTINCT 'nation ' || c_nationkey, 2 FROM o JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT 'region ' || n_regionkey, 3 FROM o JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey
""")
def object_dependency_closure(t: Tables) -> DataFrame:
    """Everything the finished orders depend on along the foreign keys."""

    def edge(rows: DataFrame, kind: str, key: str, other: str, to: str) -> DataFrame:
        return rows.select(
            F.concat_ws(" ", F.lit(kind), F.col(key).cast("string")).alias("object"),
            F.concat_ws(" ", F.lit(other), F.col(to).cast("string")).alias("depends_on"),
        )

    edges = (
        edge(t.orders, "order", "o_orderkey", "customer", "o_custkey")
        .unionByName(edge(t.customer, "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge(t.nation, "nation", "n_nationkey", "region", "n_regionkey"))
    )
    seeds = t.orders.filter("o_orderstatus = 'F'").select(
        F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string")).alias("object")
    )
    return dependency_closure(edges, seeds)
