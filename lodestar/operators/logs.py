"""Jobs over query logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.dates import local_moment, shift_hours
from lodestar.functions.text import contains_any, quoted, xml_json_field
from lodestar.operators.joins import join_and_expand
from lodestar.operators.keys import SKEY_PREFIX, add_surrogate_key

# Where the application context sits in the request properties.
CONTEXT_PATH = "/PropertyList/ApplicationContext"

# Texts that mark an error as a security error.
SECURITY_ERROR_TEXTS = (
    "OneLake security configuration has changed",
    "transient issue when trying to determine user permissions defined in OneLake",
    "Universal security version mismatch error on artifact",
)


def spike_query_log(
    ends: DataFrame,
    begins: DataFrame,
    on: Sequence[str],
    moment: str,
    cpu: str,
    start: dt.datetime,
    end: dt.datetime,
    hour_offset: int,
    properties: str,
    fields: Mapping[str, str],
    keep: Sequence[str],
) -> DataFrame:
    """Queries that ended in a time range, with what their begin events tell.

    ``start`` and ``end`` are local times, both included; the log is ``hour_offset``
    hours ahead and the result is shifted back. ``fields`` maps output names to
    JSON paths in the application context of the begin event. Dearest first.
    """
    shift = dt.timedelta(hours=hour_offset)
    kind = ends.schema[moment].dataType
    spike = ends.filter(
        F.col(moment).between(local_moment(start + shift, kind), local_moment(end + shift, kind))
    ).select(*on, moment, *keep, cpu)
    # only the begins of these queries are parsed
    asked = begins.join(spike.select(*on).distinct(), list(on), "left_semi")
    context = asked.select(
        *on,
        *[
            xml_json_field(properties, CONTEXT_PATH, path).alias(name)
            for name, path in fields.items()
        ],
    ).distinct()
    joined = spike.join(context, list(on), "left")
    return joined.select(
        shift_hours(moment, -hour_offset).alias(moment), *fields, *keep, cpu
    ).orderBy(F.desc(cpu))


def object_query_count(logs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of queries per model object, user, report or any of them together."""
    return logs.groupBy(*quoted(by)).agg(F.count(F.lit(1)).alias("queries"))


def error_status(
    error: Column | str, security_texts: Sequence[str] = SECURITY_ERROR_TEXTS
) -> Column:
    """``ok`` without an error text, else ``security_error`` or ``other_error``."""
    text = F.col(error) if isinstance(error, str) else error
    return (
        F.when(text.isNull(), "ok")
        .when(contains_any(text, security_texts), "security_error")
        .otherwise("other_error")
    )


def models_by_status(
    logs: DataFrame,
    model: str,
    error: str,
    security_texts: Sequence[str] = SECURITY_ERROR_TEXTS,
) -> DataFrame:
    """Probe results per model and status."""
    status = error_status(error, security_texts).alias("status")
    return logs.groupBy(model, status).agg(F.count(F.lit(1)).alias("probes"))


def affected_models(
    logs: DataFrame,
    model: str,
    error: str,
    security_texts: Sequence[str] = SECURITY_ERROR_TEXTS,
) -> DataFrame:
    """The models with a security error."""
    found = error_status(error, security_texts) == "security_error"
    return logs.filter(found).select(model).distinct()


def compare_runs(
    log: DataFrame,
    by: Sequence[str],
    version: str,
    baseline: object,
    duration: str,
    cpu: str,
    success: str,
) -> DataFrame:
    """Durations of repeated query runs per version, set against a baseline version.

    ``by`` names the query and what else must be equal, such as cache state and
    model. ``ratio`` is the mean duration over the baseline's.
    """
    runs = log.groupBy(*quoted(by), version).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(duration).alias("avg_duration"),
        F.min(duration).alias("min_duration"),
        F.max(duration).alias("max_duration"),
        F.percentile_approx(duration, 0.5).alias("median_duration"),
        F.avg(cpu).alias("avg_cpu"),
        F.avg(F.col(success).cast("int")).alias("success_rate"),
    )
    # one row per query, state and version is left
    base = F.max(F.when(F.col(version) == baseline, F.col("avg_duration"))).over(
        Window.partitionBy(*quoted(by))
    )
    return runs.withColumn("ratio", F.try_divide("avg_duration", base))


class LogStar:
    """The star schema of a query log; each part is built when it is first asked for."""

    KEYS: Mapping[str, Sequence[str]] = {
        "Model Object": ("model", "object"),
        "Model": ("model",),
        "Report": ("report",),
        "User": ("user",),
    }

    def __init__(self, logs: DataFrame, statistics: DataFrame, objects: DataFrame | None = None) -> None:
        self._logs = logs
        self._statistics = statistics
        self._objects = objects
        self._dimensions: dict[str, DataFrame] = {}

    def dimension(self, name: str) -> DataFrame:
        """A dimension with its surrogate key.

        Models and their objects come from the metadata and the statistics too, so an
        object that nobody has queried yet is among them.
        """
        if name not in self._dimensions:
            on = list(self.KEYS[name])
            members = self._logs.select(*on)
            if set(on) <= {"model", "object"}:
                for more in (self._statistics, self._objects):
                    if more is not None:
                        members = members.unionByName(more.select(*on))
            self._dimensions[name] = add_surrogate_key(members.distinct(), name, order=on)
        return self._dimensions[name]

    def _keyed(self, rows: DataFrame, names: Sequence[str]) -> DataFrame:
        for name in names:
            key = list(self.KEYS[name])
            rows = join_and_expand(rows, self.dimension(name), key, [SKEY_PREFIX + name])
        return rows.drop(*{c for name in names for c in self.KEYS[name]})

    @cached_property
    def fact_object_query_count(self) -> DataFrame:
        counts = object_query_count(self._logs, ["model", "object", "report", "user"])
        return self._keyed(counts, list(self.KEYS))

    @cached_property
    def fact_logs(self) -> DataFrame:
        return self._keyed(self._logs, list(self.KEYS))

    @cached_property
    def fact_object_statistics(self) -> DataFrame:
        return self._keyed(self._statistics, ["Model Object", "Model"])


def build_log_star(
    logs: DataFrame, statistics: DataFrame, objects: DataFrame | None = None
) -> LogStar:
    """Dimensions with surrogate keys and facts that refer to them.

    ``logs`` has the columns model, object, report, user, moment and any measures;
    ``statistics`` has model, object and figures per object; ``objects`` has the model
    and object of everything the models hold, from their metadata.
    """
    return LogStar(logs, statistics, objects)
