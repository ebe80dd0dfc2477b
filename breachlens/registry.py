"""Every report and operator as a named query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breachlens.functions.scalars import run_time_text, turkish_date, turkish_datetime
from breachlens.operators import checks, ingest, trigrams
from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import latest_runs
from breachlens.operators.partials import partials
from breachlens.operators.upsert import upsert, upsert_metrics, versioned_upsert
from breachlens.plans import details, filter_table, hierarchies, saved, summaries, tops
from breachlens.plans import partials as from_partials
from breachlens.plans.load import FOLDER_COLUMNS, SCAN_COLUMNS, choose_runs, load_pass
from breachlens.plans.pages import store_pages
from breachlens.schemas import HOST_KEY, NATURAL_FINDING_KEY, PAYLOADS
from breachlens.session import configure, shared_dir
from breachlens.sources import sample, sample_landing
from breachlens.sources.landing import read_landing
from breachlens.sources.store import MERGED, Store
from breachlens.sources.tables import Tables
from breachlens.streaming import arrivals, jobs

Query = Callable[[SparkSession, str], DataFrame]

FILTERS = {
    "filter_severity": FilterSpec(severity=[3, 4]),
    "filter_severity_zero": FilterSpec(severity=[0]),
    "filter_scan_name": FilterSpec(scan_name="build"),
    "filter_vuln_name": FilterSpec(vulnerability_name="WIDGET #_"),
    "filter_ip": FilterSpec(ip_address="10.0.1."),
    "filter_port": FilterSpec(port="22,400-500"),
    "filter_all": FilterSpec([3, 4], "-1", "a", "10.0", "1-500"),
}

SAVED_LINKS = {
    "critical_or_high": "/detailed-analysis?severity=4%2C3",
    "informational": "/detailed-analysis?severity=0",
    "office_scans": "/detailed-analysis?scan_name=furn",
    "widgets_on_web": "/detailed-analysis?vulnerability_name=widget&port=80%2C443",
    "subnet_two": "/detailed-analysis?ip_address=10.0.2.",
    "all_conditions": FILTERS["filter_all"].to_link(),
    "everything": "/detailed-analysis?",
}

SOME_IP = "10.0.1.1"


def _configured(spark: SparkSession, sf_dir: str) -> SparkSession:
    return configure(spark, [sample.path(sf_dir, name) for name in sample.SCHEMAS])


def _report(build: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf_dir: build(sample.load(_configured(spark, sf_dir), sf_dir), *args, **kwargs)


def _from_partials(build: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A report from the partial sums of all runs."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = sample.load(_configured(spark, sf_dir), sf_dir)
        return build(tables, partials(tables.host, tables.host_vuln, tables.vuln_output), *args, **kwargs)
    return query


def _merge_case(build: Callable[..., DataFrame], *args) -> Query:
    """A report that ignores case, over tables in which every third scan's name, and the ports
    of every other run, are in the other case."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = sample.load(_configured(spark, sf_dir), sf_dir).as_dict()
        name, port = F.col("name"), F.col("port")
        frames["scan"] = frames["scan"].withColumn("name", F.when(F.col("scan_id") % 3 == 0, F.lower(name)).otherwise(name))
        frames["vuln_output"] = frames["vuln_output"].withColumn(
            "port", F.when(F.col("scan_run_id") % 2 == 0, F.upper(port)).otherwise(port)
        )
        return build(Tables(**frames), *args, merge_case=True)
    return query


def _frames(build: Query) -> Query:
    return lambda spark, sf_dir: build(_configured(spark, sf_dir), sf_dir)


def _latest_runs_sql(tables: Tables) -> DataFrame:
    """The latest runs as SQL with a correlated subquery, which Catalyst turns into a join."""
    return tables.spark.sql(
        """
        SELECT s.scan_id, r.scan_run_id
        FROM {scan} s JOIN {scan_run} r ON s.scan_id = r.scan_id
        WHERE r.scan_run_id = (SELECT max(x.scan_run_id) FROM {scan_run} x WHERE x.scan_id = s.scan_id)
        """,
        scan=tables.scan, scan_run=tables.scan_run,
    )


def _turkish_dates(tables: Tables) -> DataFrame:
    start = F.timestamp_seconds("scan_start")
    return tables.scan_run.select(
        "scan_run_id",
        turkish_date(start).alias("date_text"),
        turkish_datetime(start).alias("datetime_text"),
    )


def _run_times(tables: Tables) -> DataFrame:
    end = F.when(F.col("scan_run_id") % 10 != 0, F.col("scan_end"))
    return tables.scan_run.select(
        "scan_run_id",
        run_time_text("scan_start").alias("start_text"),
        run_time_text(end).alias("end_text"),
    )


def _detail_filtered(tables: Tables) -> DataFrame:
    return details.filter_columns(
        details.vulnerability_detail(tables, limit=None),
        [("cvss3_base_score", ">=", 5.0), ("port", "contains", "TCP"), ("plugin_family", "!=", "SMALL")],
    )


PAGE_SORT = [("severity", False), ("host_ip", True)]


def _detail_page(tables: Tables) -> DataFrame:
    return details.page(details.vulnerability_detail(tables, limit=None), 2, sort=PAGE_SORT)


def _detail_page_stored(tables: Tables) -> DataFrame:
    """The same page, of a result that is stored once."""
    rows = details.vulnerability_detail(tables, limit=None)
    return store_pages(rows, _new_path(tables.spark, "pages"), PAGE_SORT).page(2).drop("row")


def _detail_page_after(tables: Tables) -> DataFrame:
    """The page that follows a place deep in the list."""
    columns = ["scan_name", "host_ip", "host_fqdn", "vulnerability_name", "severity", "severity_text", "port"]
    last = dict.fromkeys(columns) | {"severity": 2, "host_ip": "10.0.2.1", "copy": 1}
    return details.page_after(details.vulnerability_detail(tables, limit=None).select(*columns), last, sort=PAGE_SORT)


def _detail_search_indexed(tables: Tables) -> DataFrame:
    index = details.write_search_index(tables, _new_path(tables.spark, "grams"))
    return details.detail_search(tables, "Widget", index=index)


PATTERNS = ["widget #1", "W_dget%#2", "ii", "%", "small%7", "no such name", "100\\%"]


def _name_search(tables: Tables) -> DataFrame:
    """The plugins whose name matches each pattern, found by an index of names."""
    index = trigrams.write_index(tables.plugin, _new_path(tables.spark, "names"), "plugin_id", "name")
    return reduce(DataFrame.union, [
        index.matching(tables.plugin, "name", p).select(F.lit(p).alias("pattern"), "plugin_id") for p in PATTERNS
    ])


def _saved_filter_counts(tables: Tables) -> DataFrame:
    filters = {name: FilterSpec.from_link(link) for name, link in SAVED_LINKS.items()}
    return saved.saved_filter_counts(tables, filters)


def _saved_filter_table(tables: Tables) -> DataFrame:
    """The same filters as rows: their links are parsed and answered by the job."""
    links = tables.spark.createDataFrame(list(SAVED_LINKS.items()), "filter_name STRING, link STRING")
    return filter_table.filter_counts(tables, saved.parsed_links(links).drop("severity_labels"))


def _scan_filter_counts(tables: Tables) -> DataFrame:
    """A filter for every scan: its name, two levels and, of every other scan, a range of ports."""
    key = F.col("scan_id")
    filters = tables.scan.select(
        F.col("scan_id").cast("string").alias("filter_name"),
        F.array((key % 5).cast("int"), ((key + 2) % 5).cast("int")).alias("severity"),
        F.col("name").alias("scan_name"), F.lit(None).cast("string").alias("vulnerability_name"),
        F.when(key % 3 == 0, F.concat(F.lit("10.0."), (key % 4).cast("string"), F.lit("."))).alias("ip_address"),
        F.when(key % 2 == 0, F.concat(F.lit("22,"), (80 + key % 400).cast("string"), F.lit("-445"))).alias("port"),
    )
    return filter_table.filter_counts(tables, filters).drop("severity_labels")


def _saved_links(tables: Tables) -> DataFrame:
    """A link for every scan, made and read back."""
    key = F.col("scan_id")
    level = (key % 5).cast("int")
    no_levels = F.array().cast("array<int>")
    filters = tables.scan.select(
        "scan_id",
        F.when(key % 4 == 0, no_levels)
        .when(key % 4 == 1, F.array(level))
        .otherwise(F.array(level, F.lit(7))).alias("severity"),
        F.col("name").alias("scan_name"),
        F.concat(F.lit("a & b=% "), "type", F.lit("*~ü")).alias("vulnerability_name"),
        F.when(key % 3 != 0, F.concat(F.lit("10.0."), (key % 4).cast("string"), F.lit("."))).alias("ip_address"),
        F.lit("22,400-500").alias("port"),
    )
    parsed = saved.parsed_links(saved.link_table(filters).select("scan_id", "link"))
    return parsed.withColumn("severity", F.array_join(F.col("severity").cast("array<string>"), ","))


def _payloads(rows: DataFrame, kind: str, ids: list[str], body) -> DataFrame:
    """Rows as JSON texts and back, as payloads of a kind would arrive."""
    text = rows.select(*ids, F.to_json(body).alias("payload"))
    return text.select(*ids, F.from_json("payload", PAYLOADS[kind]).alias("p")).select(*ids, "p.*")


def _vulnerability_payloads(spark: SparkSession, sf_dir: str, kind: str, ids: list[str]) -> DataFrame:
    """Each finding as one payload with two entries, the second a single hit one level up."""
    severity = F.col("severity")
    entries = F.array(
        F.struct(severity, F.col("n").alias("count"), "plugin_id"),
        F.struct(((severity + 1) % 5).alias("severity"), F.lit(1).alias("count"), "plugin_id"),
    )
    counts = sample.vulnerability_counts(spark, sf_dir)
    return _payloads(counts, kind, ids, F.struct(entries.alias("vulnerabilities")))


def _ingest_run_counts(spark, sf_dir):
    payloads = _vulnerability_payloads(spark, sf_dir, "run", ["scan_run_id"])
    return ingest.count_severities(payloads, "scan_run_id")


def _ingest_host_counts(spark, sf_dir):
    payloads = _vulnerability_payloads(spark, sf_dir, "host", ["scan_run_id", "scanner_host_id"])
    return ingest.count_severities(payloads, "scan_run_id", "scanner_host_id")


def _ingest_ports(spark, sf_dir):
    """Outputs of every finding, from payloads in which ports are the keys of a map."""
    outputs = []
    for number, condition, port in sample.OUTPUTS:
        ports = f"if({port} IS NULL, map(), map({port}, array(named_struct('hostname', 'h'))))"
        outputs.append(
            f"if({condition}, named_struct('plugin_output', 'output {number}', 'ports', {ports}), NULL)"
        )
    rows = sample.host_vuln(spark, sf_dir).selectExpr(
        "scan_run_id AS history_id", "scanner_host_id AS host_id", "plugin_id"
    )
    body = F.expr(f"named_struct('outputs', array_compact(array({', '.join(outputs)})))")
    payloads = _payloads(rows, "finding", ["history_id", "host_id", "plugin_id"], body)
    return ingest.output_rows(payloads).drop("vuln_output_id", "host_vuln_id")


def _loaded(spark, sf_dir):
    """Runs that count as loaded before the pass."""
    return sample.scan_run(spark, sf_dir).filter("scan_run_id % 2 = 0").select("scan_run_id")


def _new_runs(spark, sf_dir):
    return choose_runs(sample.history(spark, sf_dir), _loaded(spark, sf_dir)).select("scan_id", "history_id")


SKIPPED = ["NATION_3", "NATION_12", "NATION_99"]


def _skip_folders(spark, sf_dir):
    return ingest.skip_scans(sample.scan(spark, sf_dir), sample.folder(spark, sf_dir), SKIPPED)


def _ingest_metrics(spark, sf_dir):
    return ingest.ingest_metrics(
        folders=sample.folder(spark, sf_dir),
        scans=sample.scan(spark, sf_dir),
        chosen_runs=choose_runs(sample.history(spark, sf_dir), _loaded(spark, sf_dir)),
    )


def _plugin_upsert(spark, sf_dir):
    return versioned_upsert(
        sample.plugin_stored(spark, sf_dir), sample.plugin_feed(spark, sf_dir),
        "plugin_id", "mod_date", "seq", ["payload"],
    )


def _upsert_folder(build, spark, sf_dir):
    stored, feed = sample.folder_stored(spark, sf_dir), sample.folder_feed(spark, sf_dir)
    return build(stored, feed, "folder_id", FOLDER_COLUMNS)


def _upsert_scan(build, spark, sf_dir):
    stored, feed = sample.scan_stored(spark, sf_dir), sample.scan_feed(spark, sf_dir)
    return build(stored, feed, "scan_id", SCAN_COLUMNS)


_STORES: dict[tuple[str, str], tuple[Store, DataFrame]] = {}


def _pass(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """The test tables landed as JSON and loaded, once in an application: the store and what
    was rejected."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES:
        root = _new_path(spark, "loaded")
        landing = read_landing(spark, sample_landing.land(spark, sf_dir, f"{root}/landing"), lines=True)
        store = Store(spark, f"{root}/store")
        _STORES[key] = store, load_pass(landing, store, 1, SKIPPED)["rejects"]
    return _STORES[key]


def _stored(table: str, *without: str) -> Query:
    """A stored table without ids that are hashes."""
    return _frames(lambda s, d: getattr(_pass(s, d)[0].tables(), table).drop("load_id", *without))


def _after_a_broken_load(spark, sf_dir):
    """What readers see after a second load that has written other rows to all seven tables but
    was not committed: names of the merged tables, rows per run of the others."""
    store = _pass(spark, sf_dir)[0]
    frames = store.tables().as_dict()
    broken = {name: df.withColumn("name", F.concat(F.lit("broken "), "name")) if "name" in df.columns else df
              for name, df in frames.items()}
    store.begin(2).write_all(broken)
    seen = store.tables().as_dict()
    merged = [
        df.select(F.lit(name).alias("table_name"), F.col(f"{name}_id").cast("bigint").alias("key"), F.col("name").alias("seen"))
        for name, df in seen.items() if name in MERGED
    ]
    growing = [
        df.groupBy("scan_run_id").agg(F.count("*").cast("string").alias("seen"))
        .select(F.lit(name).alias("table_name"), F.col("scan_run_id").alias("key"), "seen")
        for name, df in seen.items() if name not in MERGED
    ]
    return reduce(DataFrame.union, [*merged, *growing])


def _surrogate_keys(spark, sf_dir):
    """Rows, different hashed ids, and ids that stand for several natural keys."""
    tables = _pass(spark, sf_dir)[0].tables()
    keys = {
        "host_id": (tables.host, HOST_KEY), "host_vuln_id": (tables.host_vuln, NATURAL_FINDING_KEY),
        "vuln_output_id": (tables.vuln_output, (*NATURAL_FINDING_KEY, "output_no", "port")),
    }

    def counted(name, df, key):
        ids = df.groupBy(name).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"))
        clashes = checks.key_collisions(df, name, list(key)).agg(F.count("*").alias("n_collisions"))
        return ids.crossJoin(clashes).select(F.lit(name).alias("id"), "n_rows", "n_ids", "n_collisions")  # one row each

    return reduce(DataFrame.union, [counted(name, *of) for name, of in keys.items()])


def _rejected_runs(spark, sf_dir):
    return _pass(spark, sf_dir)[1].select(F.col("history_id").alias("scan_run_id")).distinct()


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return jobs.file_stream(spark, sf_dir, sample.SCHEMAS[table], f"{table}.parquet")


def _stream_latest_run(spark, sf_dir):
    path = _new_path(spark, "latest-run")
    runs = _stream(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("scan_id"), F.col("o_orderkey").alias("scan_run_id")
    )
    jobs.keep_changes(jobs.latest_run_stream(runs), path, "scan_id", "scan_run_id").awaitTermination()
    schema = "scan_id BIGINT, scan_run_id BIGINT"
    return jobs.current_values(spark, path, schema, "scan_id", "scan_run_id")


def _stream_severity_counts(spark, sf_dir):
    path = _new_path(spark, "severity-counts")
    known = sample.plugin(spark, sf_dir).select("plugin_id", "severity")
    hits = _stream(spark, sf_dir, "lineitem").filter("l_quantity > 5").select(
        F.col("l_partkey").alias("plugin_id"), (1 + F.col("l_partkey") % 3).alias("n")
    )
    counts = jobs.severity_count_stream(hits.join(known, "plugin_id"))
    jobs.keep_changes(counts, path, "severity", "n").awaitTermination()
    return jobs.current_values(spark, path, "severity INT, n BIGINT", "severity", "n")


def _stream_new_runs(spark, sf_dir):
    path = _new_path(spark, "new-runs")
    history = _stream(spark, sf_dir, "orders").selectExpr(*sample.HISTORY)
    schema = "scan_id BIGINT, creation_date BIGINT, history_id BIGINT, status STRING"
    jobs.new_runs(history, path, _loaded(spark, sf_dir), schema).awaitTermination()
    return jobs.picked_runs(spark, path, schema).select("scan_id", "history_id")


def _stream_loaded_runs(spark, sf_dir):
    """Loaded as answers land, in two rounds: the findings of every third run come after all else."""
    path, late = _new_path(spark, "arrivals"), F.col("history_id") % 3 == 0
    landing, store = f"{path}/landing", Store(spark, f"{path}/store")

    def arrived():
        arrivals.load_arrivals(spark, landing, store, f"{path}/state", True, SKIPPED).awaitTermination()

    sample_landing.land(spark, sf_dir, landing, late)
    arrived()
    sample_landing.land_late(spark, sf_dir, landing, late)
    arrived()
    return store.tables().scan_run.drop("load_id")


def queries() -> dict[str, Query]:
    def filtered(build, name):
        return _report(build, FILTERS[name])

    return {
        "latest_runs": _report(lambda t: latest_runs(t.scan_run)),
        "latest_runs_sql": _report(_latest_runs_sql),
        **{name: _report(summaries.severity_distribution, spec) for name, spec in FILTERS.items()},
        "scan_summary": _report(summaries.scan_summary),
        "scan_summary_by_severity": _report(summaries.scan_summary, FilterSpec(severity=[2, 3])),
        "scan_summary_filtered": filtered(summaries.scan_summary, "filter_all"),
        "scan_summary_port": filtered(summaries.scan_summary, "filter_port"),
        "scan_summary_rows": _report(summaries.scan_summary_rows),
        "scan_summary_rows_port": filtered(summaries.scan_summary_rows, "filter_port"),
        "severity_distribution": _report(summaries.severity_distribution),
        "severity_totals": _report(summaries.severity_totals),
        "vulnerability_detail": _report(details.vulnerability_detail),
        "vulnerability_detail_port": filtered(details.vulnerability_detail, "filter_port"),
        "vulnerability_detail_extended": _report(details.vulnerability_detail_extended),
        "vulnerability_list": _report(details.vulnerability_list),
        "vulnerability_list_filtered": filtered(details.vulnerability_list, "filter_all"),
        "top_vulnerabilities": _report(tops.top_vulnerabilities),
        "top_vulnerabilities_filtered": filtered(tops.top_vulnerabilities, "filter_severity"),
        "scan_names": _report(tops.scan_names),
        "top_ports": _report(tops.top_ports),
        "top_ports_filtered": filtered(tops.top_ports, "filter_all"),
        "ip_ports": _report(tops.ip_ports, SOME_IP),
        "ip_ports_valid": _report(tops.usable_ip_ports, SOME_IP),
        "severity_hierarchy": _report(hierarchies.severity_hierarchy),
        "top_vulnerability_hierarchy": _report(hierarchies.top_vulnerability_hierarchy),
        "top_port_hierarchy": _report(hierarchies.top_port_hierarchy),
        "host_report": _report(summaries.host_report),
        "scan_summary_partials": _from_partials(from_partials.scan_summary),
        "scan_summary_rows_partials": _from_partials(from_partials.scan_summary, by_rows=True),
        "severity_distribution_partials": _from_partials(from_partials.severity_distribution),
        "severity_totals_partials": _from_partials(from_partials.severity_totals),
        "filter_severity_partials": _from_partials(from_partials.severity_distribution, FILTERS["filter_severity"]),
        "scan_summary_merge_case": _merge_case(summaries.scan_summary),
        "top_vulnerabilities_merge_case": _merge_case(tops.top_vulnerabilities),
        "scan_names_merge_case": _merge_case(tops.scan_names),
        "top_ports_merge_case": _merge_case(tops.top_ports),
        "ip_ports_merge_case": _merge_case(tops.ip_ports, SOME_IP),
        "host_report_merge_case": _merge_case(summaries.host_report),
        "plugin_detail": _report(details.plugin_detail),
        "cvss_band": _report(details.cvss_bands),
        "reference_links": _report(details.reference_links),
        "detail_search": _report(details.detail_search, "Widget"),
        "detail_search_indexed": _report(_detail_search_indexed),
        "name_search": _report(_name_search),
        "detail_search_all": _report(details.detail_search, "h7.example", limit=1000),
        "detail_column_filter": _report(_detail_filtered),
        "detail_page": _report(_detail_page),
        "detail_page_stored": _report(_detail_page_stored),
        "detail_page_after": _report(_detail_page_after),
        "turkish_dates": _report(_turkish_dates),
        "run_times": _report(_run_times),
        "saved_filter_counts": _report(_saved_filter_counts),
        "saved_filter_table": _report(_saved_filter_table),
        "scan_filter_counts": _report(_scan_filter_counts),
        "saved_links": _report(_saved_links),
        "fk_orphans": _report(checks.fk_orphans),
        "pk_duplicates": _report(checks.pk_duplicates),
        "ingest_run_counts": _frames(_ingest_run_counts),
        "ingest_host_counts": _frames(_ingest_host_counts),
        "ingest_ports": _frames(_ingest_ports),
        "ingest_metrics": _frames(_ingest_metrics),
        "newest_run": _frames(lambda s, d: ingest.newest_runs(sample.history(s, d))),
        "newest_completed_run": _frames(
            lambda s, d: ingest.completed_runs(ingest.newest_runs(sample.history(s, d)))
        ),
        "new_runs_only": _frames(_new_runs),
        "skip_folders": _frames(_skip_folders),
        "upsert_folder": _frames(lambda s, d: _upsert_folder(upsert, s, d)),
        "upsert_folder_metrics": _frames(lambda s, d: _upsert_folder(upsert_metrics, s, d)),
        "upsert_scan": _frames(lambda s, d: _upsert_scan(upsert, s, d)),
        "upsert_scan_metrics": _frames(lambda s, d: _upsert_scan(upsert_metrics, s, d)),
        "plugin_upsert": _frames(_plugin_upsert),
        "loaded_folders": _stored("folder"),
        "loaded_scans": _stored("scan"),
        "loaded_runs": _stored("scan_run"),
        "loaded_hosts": _stored("host", "host_id", "host_start", "host_end", "os"),
        "loaded_findings": _stored("host_vuln", "host_vuln_id"),
        "loaded_plugins": _stored("plugin", "cvss_base_score", "cvss_vector", "cvss3_vector", "pub_date"),
        "loaded_outputs": _stored("vuln_output", "vuln_output_id", "host_vuln_id"),
        "rejected_runs": _frames(_rejected_runs),
        "after_a_broken_load": _frames(_after_a_broken_load),
        "surrogate_keys": _frames(_surrogate_keys),
        "stream_latest_run": _frames(_stream_latest_run),
        "stream_severity_counts": _frames(_stream_severity_counts),
        "stream_new_runs": _frames(_stream_new_runs),
        "stream_loaded_runs": _frames(_stream_loaded_runs),
    }
