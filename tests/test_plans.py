"""What the plans must and must not contain."""

import dataclasses
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from breachlens.operators import findings
from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import latest_runs, scope
from breachlens.operators.upsert import versioned_upsert
from breachlens.plans import details, partials, summaries, tops
from breachlens.schemas import HOST_KEY, NATURAL_FINDING_KEY, TABLES
from breachlens.sources import sample
from breachlens.sources.store import Store
from breachlens.sources.tables import from_parquet
from tests.small import settings

DIRECTORY = "/root/testdata/sf0.001"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The tables as files of their own, as on a cluster."""
    root = tmp_path_factory.mktemp("tables")
    for name, df in _sample(spark).items():
        df.write.parquet(str(root / name))
    return from_parquet(spark, str(root))


def _sample(spark):
    tables = sample.load(spark, DIRECTORY)
    return {name: getattr(tables, name) for name in (
        "folder", "scan", "scan_run", "host", "host_vuln", "plugin", "vuln_output",
    )}


def test_reports_on_stored_tables_agree(spark, stored):
    tables = sample.load(spark, DIRECTORY)
    for build in (summaries.scan_summary, summaries.scan_summary_rows, tops.top_ports, summaries.host_report):
        assert build(stored).collect() == build(tables).collect()


def test_no_outputs_are_read_unless_ports_matter(stored):
    for build in (summaries.severity_distribution, summaries.scan_summary, tops.top_vulnerabilities):
        assert "output_no" not in plan(build(stored)) and "port" not in plan(build(stored), "executedPlan")
    assert "port" in plan(summaries.severity_distribution(stored, FilterSpec(port="80")))


def test_distinct_counts_do_not_copy_rows(stored):
    for build in (summaries.scan_summary, summaries.scan_summary_rows, summaries.host_report, tops.top_ports):
        assert "Expand" not in plan(build(stored), "executedPlan")


def test_long_texts_are_only_read_for_the_shown_rows(stored):
    text = plan(details.vulnerability_detail_extended(stored), "executedPlan")
    reads = [r for r in re.findall(r"FileScan parquet \[([^\]]*)\]", text) if "description" in r]
    assert len(reads) == 1
    for build in (summaries.scan_summary, details.vulnerability_list, tops.top_vulnerabilities):
        assert "description" not in plan(build(stored), "executedPlan")


def test_filters_reach_the_scans(stored):
    text = plan(summaries.severity_distribution(stored, FilterSpec(severity=[3, 4])), "executedPlan")
    assert re.search(r"PushedFilters: \[[^\]]*In\(severity, \[3,4\]\)", text)
    text = plan(tops.ip_ports(stored, "10.0.1.1"), "executedPlan")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(host_ip,10.0.1.1\)", text)


def test_filters_on_plugins_leave_no_outer_join(stored):
    text = plan(summaries.severity_distribution(stored, FilterSpec(severity=[4])))
    assert "LeftOuter" not in text


def test_older_runs_are_dropped_before_the_first_shuffle(stored):
    text = plan(summaries.scan_summary(stored), "executedPlan")
    for table_column in ("plugin_id", "host_ip"):
        below = text[:text.rindex(table_column)].splitlines()
        assert any("LeftSemi" in line for line in below)
    assert "LeftSemi" in text


def test_nothing_but_bitmaps_is_broadcast_beyond_the_limit(spark, stored):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert not scope(stored, FilterSpec()).few_runs
        for build in (
            summaries.scan_summary, summaries.scan_summary_rows, summaries.severity_distribution,
            summaries.host_report, tops.top_vulnerabilities, tops.top_ports, details.vulnerability_list,
        ):
            text = plan(build(stored), "executedPlan")
            joins = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
            assert all("BroadcastHashJoin [run_bucket" in line for line in joins)
    assert scope(stored, FilterSpec()).few_runs


def test_results_do_not_depend_on_broadcasts(spark, stored):
    builds = (
        summaries.scan_summary, summaries.scan_summary_rows, summaries.severity_distribution,
        tops.top_vulnerabilities, tops.top_ports, details.vulnerability_list,
    )
    spec = FilterSpec([2, 3, 4], "-1", "a", "10.0", "1-500")
    before = [b(stored, s).collect() for b in builds for s in (FilterSpec(), spec)]
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        after = [b(stored, s).collect() for b in builds for s in (FilterSpec(), spec)]
    assert list(map(sorted, map(lambda rows: map(str, rows), before))) == list(
        map(sorted, map(lambda rows: map(str, rows), after))
    )


def test_no_query_leaves_the_jvm_or_crosses_tables(spark):
    queries = entry.queries()
    for name in ("scan_summary", "saved_filter_counts", "saved_links", "plugin_upsert", "ingest_ports", "fk_orphans"):
        text = plan(queries[name](spark, DIRECTORY), "executedPlan")
        assert not re.search(r"Python|CartesianProduct|NestedLoop|Pandas", text), name


def test_a_hot_host_is_split(spark, tmp_path):
    """A third of all findings on one host: the skewed join side is cut up."""
    spark.range(0, 1, 1, 1).selectExpr("1L AS scan_id", "1 AS folder_id", "'t' AS type", "'s' AS name").write.parquet(f"{tmp_path}/scan")
    spark.range(0, 1, 1, 1).selectExpr("1 AS folder_id", "'t' AS type", "'f' AS name").write.parquet(f"{tmp_path}/folder")
    spark.range(0, 1, 1, 1).selectExpr("1L AS scan_run_id", "1L AS scan_id", "5L AS scan_start", "6L AS scan_end").write.parquet(f"{tmp_path}/scan_run")
    spark.range(0, 2000, 1, 4).selectExpr("id AS scanner_host_id", "1L AS scan_run_id", "1L AS scan_id", "'10.0.0.' || id AS host_ip", "'h' AS host_fqdn").write.parquet(f"{tmp_path}/host")
    spark.range(0, 300000, 1, 8).selectExpr("if(id % 3 = 0, 0L, id % 2000) AS scanner_host_id", "1L AS scan_run_id", "id AS plugin_id").write.parquet(f"{tmp_path}/host_vuln")
    spark.range(0, 300000, 1, 4).selectExpr("id AS plugin_id", "CAST(id % 5 AS INT) AS severity", "'n' AS name").write.parquet(f"{tmp_path}/plugin")
    spark.range(0, 10, 1, 1).selectExpr("0L AS scanner_host_id", "1L AS scan_run_id", "id AS plugin_id", "0 AS output_no", "'80' AS port").write.parquet(f"{tmp_path}/vuln_output")
    tables = from_parquet(spark, str(tmp_path))
    with settings(spark, {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "20",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }):
        df = summaries.scan_summary(tables)
        rows = df.collect()
        assert "isSkewJoin=true" in plan(df, "executedPlan") or "skew=true" in plan(df, "executedPlan")
    assert [(r.total_hosts, r.total_critical + r.total_high + r.total_medium + r.total_low + r.total_info) for r in rows] == [(2000, 300000)]


def test_plugin_texts_are_read_late(spark):
    """Only the rows that take effect are shuffled with their texts."""
    feed = spark.range(1000).selectExpr(
        "id % 7 AS plugin_id", "id AS seq", "CAST(id DIV 300 AS STRING) AS mod_date", "repeat('text ', 50) || id AS description"
    )
    stored = spark.createDataFrame([(1, "0", "old")], "plugin_id BIGINT, mod_date STRING, description STRING")
    merged = versioned_upsert(stored, feed, "plugin_id", "mod_date", "seq", ["description"])
    text = merged._jdf.queryExecution().executedPlan().toString()
    shuffled = re.findall(r"Exchange hashpartitioning\(([^)]*)\)[^\n]*\n[^\n]*Aggregate", text)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text and len(shuffled) == 1
    assert merged.count() == 7
    assert {r.description[:4] for r in merged.collect()} == {"text"}


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """The same two loads, without buckets and with."""
    stores = [Store(spark, str(tmp_path_factory.mktemp("plain"))), Store(spark, str(tmp_path_factory.mktemp("dealt")), 4)]
    frames = _sample(spark).items()
    for store in stores:
        for number in (0, 1):
            load = store.begin(number)
            load.write_all({
                name: df.filter(df.scan_run_id % 2 == number) if "scan_run_id" in df.columns else df
                for name, df in _of_store(dict(frames)).items()
            })
            load.commit()
    return stores


def _of_store(frames):
    """With the columns that the sample leaves out as NULL."""
    out = {}
    for name, df in frames.items():
        schema = T.StructType.fromDDL(TABLES[name])
        out[name] = df.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
        ])
    return out


def test_hosts_findings_and_outputs_lie_together(spark, bucketed):
    """Joins of stored tables on hosts and findings need no shuffle, over several loads."""
    plain, dealt = (store.tables() for store in bucketed)
    outer = lambda t: t.host.join(t.host_vuln, [*HOST_KEY], "left").join(
        t.vuln_output.drop("host_vuln_id"), [*NATURAL_FINDING_KEY], "left"
    ).select(*HOST_KEY, "plugin_id", "port")
    inner = lambda t: t.vuln_output.join(t.host_vuln, [*NATURAL_FINDING_KEY]).select(*HOST_KEY, "port")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
        for join in (outer, inner):
            assert "Exchange" in plan(join(plain), "executedPlan")
            text = plan(join(dealt), "executedPlan")
            assert "Exchange" not in text and text.count("Bucketed: true") == text.count("FileScan")
            assert sorted(map(str, join(plain).collect())) == sorted(map(str, join(dealt).collect()))
    for report in (summaries.scan_summary, summaries.scan_summary_rows, details.vulnerability_detail):
        assert report(plain).collect() == report(dealt).collect()
    with pytest.raises(ValueError, match="4 buckets"):
        Store(spark, bucketed[1].root, 8).begin(2)


def test_an_address_is_looked_up(spark, bucketed, monkeypatch):
    """Of findings and outputs only loads and runs with the address are read, and shuffled."""
    for store in bucketed:
        tables = store.tables()
        # An address that only the second load has.
        ip = tables.host.groupBy("host_ip").agg(F.min("load_id").alias("lo"), F.max("load_id").alias("hi")).filter(
            "lo = hi"
        ).first()
        ip = ip or tables.host.first()
        everywhere = tables.host.filter(F.col("host_ip") == ip.host_ip).select(*HOST_KEY)
        found = tables.vuln_output.join(everywhere, [*HOST_KEY], "left_semi").join(
            tables.host_vuln, [*NATURAL_FINDING_KEY], "left_semi"
        )
        want = sorted({r.port for r in found.collect()}, key=lambda p: (p is not None, p or ""))
        text = plan(tops.ip_ports(tables, ip.host_ip), "executedPlan")
        for columns in ("plugin_id", "port"):
            scans = [line for line in text.splitlines() if "FileScan" in line and columns in line]
            assert scans and all(
                re.search(r"PartitionFilters: \[[^\]]*load_id#\d+L (IN|=)", line) for line in scans
            ), text
        with monkeypatch.context() as patch:  # in few runs, as in a store of a size that matters
            patch.setattr(tops, "RUNS", 100_000)
            assert plan(tops.ip_ports(tables, ip.host_ip), "executedPlan").count("PushedFilters: [In(scan_run_id") >= 2
        monkeypatch.setattr(tops, "KEYS", 0)
        text = plan(tops.ip_ports(tables, ip.host_ip), "executedPlan")
        assert text.count("dynamicpruning") >= 2 and "BroadcastHashJoin" in text
        for keys, rows in ((1000, 100_000), (0, 100_000), (0, 0)):
            monkeypatch.setattr(tops, "KEYS", keys)
            monkeypatch.setattr(tops, "FEW_ROWS", rows)
            assert [r.port for r in tops.ip_ports(tables, ip.host_ip).collect()] == want
        monkeypatch.undo()
        assert tops.ip_ports(tables, "no address").collect() == []


def test_refreshed_totals_read_no_finding(spark, bucketed):
    """The partial sums that loads keep give the reports' rows, without findings and outputs."""
    for store in bucketed:
        tables, parts = store.tables(), store.partials()
        for spec in (FilterSpec(), FilterSpec(scan_name="-1")):
            for refreshed, whole in (
                (partials.scan_summary(tables, parts, spec), summaries.scan_summary(tables, spec)),
                (partials.scan_summary(tables, parts, spec, by_rows=True), summaries.scan_summary_rows(tables, spec)),
                (partials.severity_totals(tables, parts, spec), summaries.severity_totals(tables, spec)),
            ):
                assert refreshed.collect() == whole.collect() and refreshed.dtypes == whole.dtypes
                text = plan(refreshed, "executedPlan")
                assert "dynamicpruning" in text and not re.search(r"Location: [^\n]*/(host|host_vuln|vuln_output)\b", text)
        both = FilterSpec(severity=[3, 4], vulnerability_name="widget")
        got, want = (sorted(map(str, df.collect())) for df in (
            partials.severity_distribution(tables, parts, both), summaries.severity_distribution(tables, both)
        ))
        assert got == want
        for spec in (FilterSpec(port="22"), FilterSpec(ip_address="10.")):
            with pytest.raises(ValueError, match="partial sums"):
                partials.severity_distribution(tables, parts, spec)
        with pytest.raises(ValueError, match="partial sums"):
            partials.scan_summary(tables, parts, FilterSpec(severity=[1]))


def test_runs_that_cannot_be_broadcast_prune_as_bitmaps(spark, bucketed, monkeypatch):
    """Without any broadcast of runs, only rows of latest runs are shuffled."""
    tables = bucketed[0].tables()
    latest = latest_runs(tables.scan_run)
    reports = (summaries.scan_summary, summaries.scan_summary_rows, details.vulnerability_detail, tops.top_ports)
    want = [report(tables).collect() for report in reports]
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        sc = scope(tables, FilterSpec())
        assert not sc.few_runs and sc.bitmaps is not None
        for df in (tables.host, tables.host_vuln, tables.vuln_output):
            kept = sc.prune(df)
            text = plan(kept, "executedPlan")
            assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("BroadcastExchange")[0]
            assert sorted(map(str, kept.collect())) == sorted(map(str, df.join(latest, "scan_run_id", "left_semi").select(*df.columns).collect()))
            assert kept.count() < df.count() / 3
        assert [report(tables).collect() for report in reports] == want
        monkeypatch.setattr(findings, "BITMAPS", 0)
        assert scope(tables, FilterSpec()).bitmaps is None
        assert [report(tables).collect() for report in reports] == want


def test_bitmaps_tell_runs_of_any_number_apart(spark, bucketed):
    tables = bucketed[0].tables()
    numbers = [1, 2, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 300_000]
    runs = spark.createDataFrame([(n, n % 3) for n in numbers], "scan_run_id BIGINT, scan_id BIGINT")
    odd = findings.Scope(
        dataclasses.replace(tables, scan_run=runs), FilterSpec(), runs.filter("scan_run_id % 2 = 1"), few_runs=False
    )
    every = spark.createDataFrame([(n + d,) for n in numbers for d in (-1, 0, 1)], "scan_run_id BIGINT")
    assert {r[0] for r in odd.prune(every).collect()} == {n for n in numbers if n % 2}
