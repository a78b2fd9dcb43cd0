import datetime as dt
import json
import os
import random
import re
import subprocess
import sys

import pytest
from compare import rows
from pyspark import cloudpickle

from lodestar.operators.lineage import (
    _part_walker,
    dependency_closure,
    read_report_measures,
    read_report_parts,
    report_measure_refs,
    source_tables,
    unused_measures,
)
from lodestar.operators.logs import (
    affected_models,
    build_log_star,
    compare_runs,
    models_by_status,
    object_query_count,
    spike_query_log,
)
from lodestar.sources.staging import _staged


def test_spike_log(spark):
    t = dt.datetime
    ends = spark.createDataFrame(
        [("o1", "s", t(2025, 6, 11, 17, 30), 5, "u"), ("o2", "s", t(2025, 6, 11, 18, 30), 9, "v"),
         ("o3", "s", t(2025, 6, 11, 18, 31), 7, "w")],
        "op string, session string, ts timestamp_ntz, cpu int, user string",
    )
    xml = '<PropertyList><ApplicationContext>{"Sources":[{"ReportId":"%s"}]}</ApplicationContext></PropertyList>'
    begins = spark.createDataFrame(
        [("o1", "s", xml % "r1"), ("o1", "s", xml % "r1"), ("o3", "s", xml % "r3")],
        "op string, session string, props string",
    )
    got = spike_query_log(
        ends, begins, ["op", "session"], "ts", "cpu", t(2025, 6, 11, 12, 30), t(2025, 6, 11, 13, 30),
        5, "props", {"ReportId": "$.Sources[0].ReportId"}, ["user"],
    )
    assert [tuple(r) for r in got.collect()] == [
        (t(2025, 6, 11, 13, 30), None, "v", 9), (t(2025, 6, 11, 12, 30), "r1", "u", 5),
    ]


def test_errors(spark):
    logs = spark.createDataFrame(
        [("a", None), ("b", "x OneLake SECURITY configuration has changed y"), ("c", "timeout"), ("a", None)],
        "model string, error string",
    )
    assert rows(models_by_status(logs, "model", "error")) == [
        ("a", "ok", 2), ("b", "security_error", 1), ("c", "other_error", 1),
    ]
    assert rows(affected_models(logs, "model", "error")) == [("b",)]


def test_compare_runs(spark):
    log = spark.createDataFrame(
        [("q", "cold", "1", 10.0, 1.0, True), ("q", "cold", "1", 20.0, 3.0, False), ("q", "cold", "2", 30.0, 1.0, True),
         ("q", "warm", "2", 1.0, 1.0, True)],
        "query string, state string, version string, ms double, cpu double, ok boolean",
    )
    got = {(r["state"], r["version"]): r for r in compare_runs(log, ["query", "state"], "version", "1", "ms", "cpu", "ok").collect()}
    assert got["cold", "2"]["ratio"] == 2.0 and got["cold", "1"]["success_rate"] == 0.5
    assert got["cold", "1"]["median_duration"] == 10.0 and got["warm", "2"]["ratio"] is None


def test_log_star(spark):
    logs = spark.createDataFrame(
        [("m", "t[a]", None, "u1", 1), ("m", "t[a]", None, "u1", 2), ("n", "t[a]", "r", "u2", 3)],
        "model string, object string, report string, user string, moment int",
    )
    stats = spark.createDataFrame([("n", "t[a]", 77)], "model string, object string, bytes int")
    star = build_log_star(logs, stats)
    assert star.dimension("Model Object").count() == 2 and star.dimension("Report").count() == 2
    counts = star.fact_object_query_count
    assert counts.columns == ["queries", "_SKey Model Object", "_SKey Model", "_SKey Report", "_SKey User"]
    assert rows(counts) == [(1, 1, 1, 1, 1), (2, 0, 0, 0, 0)]
    assert star.fact_logs.count() == 3
    assert rows(star.fact_object_statistics) == [(77, 1, 1)]
    assert rows(object_query_count(logs, ["user"])) == [("u1", 2), ("u2", 1)]


def test_source_tables(spark):
    parts = spark.createDataFrame(
        [("w", "m", "a", "Entity", 'SourceTable("x")'), ("w", "m", "b", "", 'f(SourceTable("T b"))'),
         ("w", "m", "c", None, "#date(1,1,1)"), ("w", "m", "d", None, ""), ("v", "m", "z", None, 'SourceTable("q")')],
        "workspace string, model_name string, table_name string, entity_name string, expression string",
    )
    got = [tuple(r) for r in source_tables(parts, [r'SourceTable\("([^"]+)"\)']).collect()]
    assert got == [
        ("v", "m", "z", "q"), ("w", "m", "a", "Entity"), ("w", "m", "b", "T b"),
        ("w", "m", "c", "#date(1,1,1)"), ("w", "m", "d", None),
    ]


def measure(entity, name):
    return {"Measure": {"Expression": {"SourceRef": {"Entity": entity}}, "Property": name}}


PART = {
    "visual": {"query": [{"field": measure("T", "Shown")}, {"deep": [[{"x": measure("T", "Nested")}]]}]},
    "filterConfig": {
        "filters": [
            {"field": measure("T", "Idle"), "objects": {"Expression": "[Idle] + [Other]"}},
            {"field": measure("T", "Applied"), "filter": {"Version": 2}},
        ]
    },
    "objects": {"Expression": "SUM([In Text]) + Sales[Amount"},
}


def test_report_references(spark, tmp_path):
    page = tmp_path / "My Report.Report" / "definition" / "pages" / "p1"
    (page / "visuals" / "v1").mkdir(parents=True)
    (page / "visuals" / "v1" / "visual.json").write_text("\ufeff" + json.dumps(PART, indent=2), encoding="utf-8")
    (page / "page.json").write_text("{oops")
    (page / "notes.json").write_text(json.dumps(PART))
    own = {"entities": [{"name": "T", "measures": [{"name": "Shown", "expression": "1", "dataType": "Double"}]}, {"name": "E"}]}
    (page.parent.parent / "reportExtensions.json").write_text(json.dumps(own))
    measures = read_report_measures(spark, str(tmp_path))
    assert rows(measures) == [("My Report.Report", "T", "Shown", "1", "Double", None, None, None)]
    every_part = read_report_parts(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["report"], r["error"]) for r in every_part.collect()) == [
        ("page.json", "My Report.Report", "not JSON"), ("visual.json", "My Report.Report", None),
    ]
    parts = every_part
    every = {("T", "Shown"), ("T", "Nested"), ("T", "Applied"), (None, "In Text"), (None, "Other")}
    applied = report_measure_refs(parts, ignore_unapplied_filters=True)
    assert {(r["entity"], r["name"]) for r in applied.collect()} == every
    refs = report_measure_refs(parts)
    assert {(r["entity"], r["name"]) for r in refs.collect()} == every | {("T", "Idle"), (None, "Idle")}


def test_a_reference_without_its_table_is_none(spark):
    text = json.dumps([{"Measure": {"Property": "P"}}, {"Measure": {"Property": "P", "Expression": {"SourceRef": {"Entity": {}}}}}])
    assert report_measure_refs(spark.createDataFrame([(text,)], "json string")).count() == 0


def test_the_walker_runs_without_the_package(tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(_part_walker(False)))
    code = (
        "import pickle, pandas as pd; f = pickle.load(open('f', 'rb'));"
        "print(f(pd.Series(['{\"Expression\": \"[A]\"}']))[0])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "[{'entity': None, 'name': 'A'}]"


def test_unused_measures(spark):
    chain = [("r", "T", f"M{i}", f"[M{i + 1}]") for i in range(4)]
    measures = spark.createDataFrame(
        chain + [
            ("r", "T", "M4", "1"), ("r", "T", "Shown", "[Used]"), ("r", "T", "Used", None),
            ("r", "T", "Self", "[Self]"), ("r", "T", "C1", "[C2]"), ("r", "T", "C2", "[C1]"),
            ("r", "T", "Wrong Table", "1"), ("s", "T", "Shown", "1"),
        ],
        "report string, table string, name string, expression string",
    )
    refs = spark.createDataFrame(
        [("r", "T", "Shown"), ("r", "U", "Wrong Table")], "report string, entity string, name string"
    )
    unused, rounds = unused_measures(measures, refs)
    assert rows(unused.select("report", "name", "round")) == [
        ("r", "M0", 1), ("r", "M1", 2), ("r", "M2", 3), ("r", "M3", 4), ("r", "M4", 5),
        ("r", "Wrong Table", 1), ("s", "Shown", 1),
    ]
    assert rounds == 6
    with pytest.raises(ValueError, match="more than 2 rounds"):
        unused_measures(measures, refs, max_rounds=2)


def test_long_chains_of_unused_measures(spark):
    chain = [("r", "T", f"M{i:02}", f"[M{i + 1:02}]") for i in range(14)]
    measures = spark.createDataFrame(chain, "report string, table string, name string, expression string")
    refs = spark.createDataFrame([], "report string, entity string, name string")
    unused, rounds = unused_measures(measures, refs)
    assert rows(unused.select("name", "round")) == [(f"M{i:02}", i + 1) for i in range(14)] and rounds == 15


def brute_unused(measures, refs):
    """Round by round, as the definition says."""
    shown = {(r, t, n) for r, t, n in refs}
    left, out, k = set(measures), set(), 1
    while True:
        used = {(r, n) for r, t, n, _ in left if (r, t, n) in shown or (r, None, n) in shown}
        used |= {(r, n) for r, _, _, e in left for n in re.findall(r"\[([^\]]+)\]", e or "")}
        gone = {m for m in left if (m[0], m[2]) not in used}
        if not gone:
            return out, k
        out |= {(r, n, t, k) for r, t, n, _ in gone}
        left -= gone
        k += 1


@pytest.mark.parametrize("seed", range(4))
def test_unused_measures_of_any_graph(spark, seed):
    rng = random.Random(seed)
    measures = set()
    for report in ("r", "s"):
        for i in range(40):
            # mostly chains and trees, some joins and some calls back, of cycles of any length
            calls = [j for j in range(40) if j == i + 1 and rng.random() < 0.8 or j > i and rng.random() < 0.04 or rng.random() < 0.004]
            text = " + ".join(f"[M{j}]" for j in calls) + " + [Column]"
            measures.add((report, rng.choice("TU"), f"M{i}", text))
    refs = [("r", "T", "M7"), ("r", None, "M30"), ("s", "U", "M11")]
    unused, rounds = unused_measures(
        spark.createDataFrame(sorted(measures), "report string, table string, name string, expression string"),
        spark.createDataFrame(refs, "report string, entity string, name string"),
    )
    expected, last = brute_unused(measures, refs)
    assert {tuple(r) for r in unused.select("report", "name", "table", "round").collect()} == expected
    assert rounds == last


def test_passes_grow_with_the_logarithm_of_the_depth(spark):
    chain = [("r", "T", f"M{i}", f"[M{i + 1}]") for i in range(300)] + [("r", "T", f"C{i}", f"[C{(i + 1) % 7}]") for i in range(7)]
    measures = spark.createDataFrame(chain, "report string, table string, name string, expression string")
    before = len(_staged)
    unused, rounds = unused_measures(measures, spark.createDataFrame([], "report string, entity string, name string"))
    assert rounds == 301 and unused.count() == 300
    assert len(_staged) - before <= 13


def test_star_of_objects_without_logs(spark):
    logs = spark.createDataFrame([("m", "a", "r", "u", 1)], "model string, object string, report string, user string, moment int")
    stats = spark.createDataFrame([("m", "b", 7), ("n", "c", 8)], "model string, object string, bytes int")
    star = build_log_star(logs, stats, spark.createDataFrame([("o", "d")], "model string, object string"))
    assert rows(star.fact_object_statistics) == [(7, 1, 0), (8, 2, 1)]
    assert star.dimension("Model Object").count() == 4 and star.dimension("Model").count() == 3


def test_dependency_closure(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "object string, depends_on string"
    )
    seeds = spark.createDataFrame([("a",), ("a",)], "object string")
    assert rows(dependency_closure(edges, seeds)) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]


def brute_closure(edges, seeds):
    depth = {s: 0 for s in seeds if s is not None}
    newest = list(depth)
    while newest:
        found = {b for a, b in edges if a in newest and b is not None} - set(depth)
        depth |= {b: depth[newest[0]] + 1 for b in found}
        newest = list(found)
    return depth


def closure_of(spark, edges, seeds):
    found = dependency_closure(
        spark.createDataFrame(edges, "object string, depends_on string, kind string"),
        spark.createDataFrame([(s,) for s in seeds], "object string"),
    ).collect()
    assert len({r["object"] for r in found}) == len(found)
    return {r["object"]: r["depth"] for r in found}


def test_closure_of_a_long_path(spark):
    edges = [(f"o{i}", f"o{i + 1}", "k") for i in range(999)]
    before = len(_staged)
    found = closure_of(spark, edges, ["o0"])
    assert found == {f"o{i}": i for i in range(1000)}
    # three tables at the start; jumps, changes and what is known in each of at most 12 rounds
    assert len(_staged) - before <= 3 + 3 * 12


@pytest.mark.parametrize("seed", range(4))
def test_closure_of_any_graph(spark, seed):
    rng = random.Random(seed)
    # chains with some forks, ways of different lengths to one object, and calls back
    edges = [(f"o{i}", f"o{i + 1}") for i in range(60) if rng.random() < 0.9]
    edges += [(f"o{rng.randrange(60)}", f"o{rng.randrange(60)}") for _ in range(12)]
    edges += [edges[0], ("o3", None), (None, "o4"), ("o5", "o5")]
    seeds = ["o0", "o20", "o20", "nowhere", None]
    assert closure_of(spark, [(*e, "k") for e in edges], seeds) == brute_closure(edges, seeds)


def test_closure_of_nothing(spark):
    assert closure_of(spark, [], ["a"]) == {"a": 0}
    assert closure_of(spark, [("a", "b", "k")], []) == {}


def test_deep_report_json(spark):
    node = measure("T", "Bottom")
    for _ in range(200):
        node = {"inner": [node]}
    parts = spark.createDataFrame([(json.dumps(node),), (None,)], "json string")
    assert rows(report_measure_refs(parts)) == [("T", "Bottom")]
    assert report_measure_refs(spark.createDataFrame([("{",)], "json string")).count() == 0
