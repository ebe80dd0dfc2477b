"""Reports on small random tables against plain loops over the outer-joined rows."""

from collections import defaultdict

import pytest

from breachlens.operators.filters import FilterSpec
from breachlens.plans import details, filter_table, hierarchies, saved, summaries, tops
from tests.small import joined, make, random_rows

SPECS = [
    FilterSpec(),
    FilterSpec(severity=[0]),
    FilterSpec(severity=[3, 4]),
    FilterSpec(severity=[7]),
    FilterSpec(scan_name="WEB"),
    FilterSpec(vulnerability_name="a%e"),
    FilterSpec(ip_address="10.0.1."),
    FilterSpec(port="0-100,400-500"),
    FilterSpec(port="9-1"),
    FilterSpec([1, 2, 3, 4], "_", "a", "10.0", "0-9999"),
]
# With known sizes and natural keys, and without either, when all joins shuffle.
CASES = [(1, True, SPECS[i]) for i in (0, 2, 5, 7, 9)] + [(2, False, SPECS[i]) for i in (0, 9)]
LEVELS = {4: "critical", 3: "high", 2: "medium", 1: "low", 0: "info"}


@pytest.fixture(scope="module", params=CASES, ids=str)
def case(request, spark):
    seed, known, spec = request.param
    rows = random_rows(seed)
    return make(spark, rows, natural=known, sized=known), spec, list(joined(rows, spec))


def epoch(ts):
    return None if ts is None else int(ts.timestamp())


def grouped(rows, *keys):
    groups = defaultdict(list)
    for row in rows:
        groups[tuple(row[k] for k in keys)].append(row)
    return groups


def distinct(rows, value="finding"):
    return len({r[value] for r in rows} - {None})


def test_summaries(case):
    tables, spec, rows = case
    for build, weighted in ((summaries.scan_summary, False), (summaries.scan_summary_rows, True)):
        got = {(r.scan_name, r.folder_name): r.asDict() for r in build(tables, spec).collect()}
        want = grouped(rows, "scan_name", "folder_name")
        assert got.keys() == want.keys()
        for key, group in want.items():
            starts = [r["start"] for r in group if r["start"] is not None]
            assert epoch(got[key]["last_scan_date"]) == (max(starts) if starts else None)
            assert got[key]["total_hosts"] == distinct(group, "ip")
            for level, name in LEVELS.items():
                part = [r for r in group if r["severity"] == level]
                assert got[key][f"total_{name}"] == (len(part) if weighted else distinct(part))


def test_distribution_totals_and_hierarchy(case):
    tables, spec, rows = case
    got = {r.severity: r.finding_count for r in summaries.severity_distribution(tables, spec).collect()}
    want = {k[0]: distinct(g) for k, g in grouped(rows, "severity").items()}
    assert got == want
    totals = [(r.severity, r.finding_count) for r in summaries.severity_totals(tables, spec).collect()]
    assert totals == [(level, want.get(level, 0)) for level in LEVELS]
    tree = [(r.label, r.parent, r.value) for r in hierarchies.severity_hierarchy(tables, spec).collect()]
    assert tree == [("Total", "", sum(want.get(s, 0) for s in range(1, 5)))] + [
        (LEVELS[s].capitalize(), "Total", want.get(s, 0)) for s in (4, 3, 2, 1)
    ]


def test_hosts(case):
    tables, spec, rows = case
    got = {
        (r.host_ip, r.host_fqdn, r.scan_name, r.folder_name, epoch(r.last_scan_date)): r.asDict()
        for r in summaries.host_report(tables, spec).collect()
    }
    filed = [r for r in rows if r["folder_id"] is not None]
    want = grouped(filed, "ip", "fqdn", "scan_name", "folder_name", "start")
    assert got.keys() == want.keys()
    for key, group in want.items():
        assert got[key]["total_vulnerabilities"] == distinct(group)
        for level, name in LEVELS.items():
            assert got[key][f"{name}_count"] == distinct([r for r in group if r["severity"] == level])


def nulls_first(*values):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in values)


def test_tops(case):
    tables, spec, rows = case
    keys = ("folder_name", "scan_name", "plugin", "name", "severity")
    filed = grouped([r for r in rows if r["folder_id"] is not None], *keys)
    ranked = sorted((-distinct(g), nulls_first(*k), k) for k, g in filed.items())[:10]
    want = [(k[0], k[1], k[3] or "Bilinmeyen Zafiyet", k[4], -n) for n, _, k in ranked]
    found = tops.top_vulnerabilities(tables, spec).collect()
    assert [(r.folder_name, r.scan_name, r.vulnerability_name, r.severity, r.finding_count) for r in found] == want
    tree = hierarchies.top_vulnerability_hierarchy(tables, spec).collect()
    assert len(tree) == (len(want) + 1 if want else 0)
    assert all(tree[0].value == sum(r.value for r in tree[1:]) for _ in tree[:1])

    ports = grouped([r for r in rows if r["port"] is not None], "port")
    ranked = sorted((-distinct(g), k[0]) for k, g in ports.items())[:10]
    got = [(-r.finding_count, r.port) for r in tops.top_ports(tables, spec).collect()]
    assert got == ranked
    tree = hierarchies.top_port_hierarchy(tables, spec).collect()
    assert [r.id for r in tree][0] == "Most Used 10 Ports" and len(tree) == len(ranked) + 1
    assert tree[0].value == -sum(n for n, _ in ranked)


def test_lists(case):
    tables, spec, rows = case
    known = [r for r in rows if r["plugin"] is not None]

    def shown(r):
        return (r["scan_name"], r["ip"], r["fqdn"], r["name"], r["severity"], r["port"], r["cvss"], r["start"])

    def key(values):
        return nulls_first(*values)

    every = sorted(map(shown, known), key=key)
    got = [
        (r.scan_name, r.host_ip, r.host_fqdn, r.vulnerability_name, r.severity, r.port,
         r.cvss3_base_score, epoch(r.scan_date))
        for r in details.vulnerability_list(tables, spec).collect()
    ]
    assert sorted(got, key=key) == every

    def order(r):
        worst = nulls_first(r["severity"], r["start"])
        last = r["key"] if "scan_run_id" in tables.vuln_output.columns else (r["finding"],)
        if len(last) == 3:
            last = (last[1], last[0], last[2])
        return tuple((-p, -v) for p, v in worst), last, nulls_first(r["port"])

    want = [(r["severity"], r["start"], r["port"]) for r in sorted(known, key=order)]
    for limit in (5, 1000):
        few = details.vulnerability_detail(tables, spec, limit=limit).collect()
        assert [(r.severity, epoch(r.scan_date), r.port) for r in few] == want[:limit]


def test_search_and_pages(case):
    tables, spec, rows = case
    full = details.vulnerability_detail_extended(tables, spec).collect()
    for term in ("ALPHA", "7.0", "none"):
        want = [
            r for r in full
            if any(
                term.lower() in str(v).lower()
                for c, v in r.asDict().items() if v is not None and c != "scan_date"
            )
        ]
        assert details.detail_search(tables, term, spec).collect() == want
        assert details.detail_search(tables, term, spec, limit=2).collect() == want[:2]
    base = details.vulnerability_detail(tables, spec, limit=None)
    size = len(full) // 3 + 1
    pages = [
        details.page(base, i, size, [("severity", False)]).collect() for i in range(len(full) // size + 2)
    ]
    together = [r for p in pages for r in p]
    assert sorted(map(str, together)) == sorted(map(str, base.collect()))
    levels = [r.severity for r in together if r.severity is not None]
    assert levels == sorted(levels, reverse=True)


def test_pages_after_a_row(spark):
    """However deep, with NULLs, and with equal rows over the border of a page."""
    rows = [(i % 3 or None, "ab"[i % 2], i // 8) for i in range(24)] + [(1, "b", 0)] * 5
    df = spark.createDataFrame(rows, "a INT, b STRING, c INT")
    for size in (1, 4, 7):
        last, seen = None, []
        while page := details.page_after(df, last, size, [("a", False), ("b", True)]).collect():
            seen += page
            last = page[-1].asDict()
        assert sorted(map(str, [(r.a, r.b, r.c) for r in seen])) == sorted(map(str, rows))
        assert [(r.a is None, -(r.a or 0), r.b, r.c, r.copy) for r in seen] == sorted(
            (r.a is None, -(r.a or 0), r.b, r.c, r.copy) for r in seen
        )
        if size == 1:
            break
    with pytest.raises(ValueError, match="lacks"):
        details.page_after(df, {"a": 1}, 2)


def test_search_looks_beyond_the_report_limit(spark):
    """A hit behind the first thousand rows is found, and so is a page there."""
    n = 1100
    rows = {
        "scan": [(1, None, "t", "s")], "scan_run": [(10, 1, 900, 0)],
        "host": [(h, 10, 1, f"10.0.0.{h}", "needle" if h == n - 1 else "h") for h in range(n)],
        "host_vuln": [(h, h, 10, 5) for h in range(n)], "plugin": [(5, 4) + ("p",) + (None,) * 8],
        "vuln_output": [(h, "80") for h in range(n)],
    }
    tables = make(spark, rows)
    assert details.vulnerability_detail(tables).count() == 1000
    assert [r.host_fqdn for r in details.detail_search(tables, "NEEDLE").collect()] == ["needle"]
    every = details.vulnerability_detail(tables, limit=None)
    assert details.filter_columns(every, [("host_fqdn", "=", "needle")]).count() == 1
    assert details.page(every, 10, 100).count() == 100


def test_orders(spark):
    """Of the summary, the names and the host report, which row checks do not see."""
    rows = random_rows(5)
    tables = make(spark, rows, natural=True)
    high = summaries.scan_summary(tables, FilterSpec(severity=[1, 3])).collect()
    assert [r.total_high for r in high] == sorted((r.total_high for r in high), reverse=True)
    hosts = [(r.last_scan_date is None, -(epoch(r.last_scan_date) or 0), -r.total_vulnerabilities)
             for r in summaries.host_report(tables).collect()]
    assert hosts == sorted(hosts)
    newest = [epoch(r.last_scan_date) for r in summaries.scan_summary(tables).collect()]
    assert newest == sorted(newest, key=lambda t: (t is None, -(t or 0)))
    names = [r.scan_name for r in tops.scan_names(tables).collect()]
    assert names == sorted(names, key=lambda x: (x is not None, x))


def test_saved_filters(spark):
    rows = random_rows(3)
    tables = make(spark, rows, natural=True)
    filters = {f"f{i}": spec for i, spec in enumerate(SPECS)}
    got = {r.filter_name: r.finding_count for r in saved.saved_filter_counts(tables, filters).collect()}
    assert got == {name: distinct(joined(rows, spec)) for name, spec in filters.items()}


def test_saved_filters_as_a_table(spark):
    """Any number of filters, more than a word of a bitmap has bits, with equal and odd ones."""
    rows = random_rows(3)
    tables = make(spark, rows, natural=True)
    specs = [*SPECS, *SPECS, *[FilterSpec(severity=[i % 6], port=f"{i},{20 + i}-{30 + 3 * i}") for i in range(90)]]
    specs += [FilterSpec(port="30-20"), FilterSpec(scan_name="no such"), FilterSpec(vulnerability_name="100%"), FilterSpec(ip_address="\\")]
    table = [(f"f{i}", list(s.severity), s.scan_name or "", s.vulnerability_name, s.ip_address, s.port) for i, s in enumerate(specs)]
    schema = "filter_name STRING, severity ARRAY<INT>, scan_name STRING, vulnerability_name STRING, ip_address STRING, port STRING"
    got = filter_table.filter_counts(tables, spark.createDataFrame(table, schema))
    assert {r.filter_name: r.finding_count for r in got.collect()} == {
        f"f{i}": distinct(joined(rows, spec)) for i, spec in enumerate(specs)
    }
    assert filter_table.filter_counts(tables, spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(Exception, match="not a port"):
        filter_table.filter_counts(tables, spark.createDataFrame([("x", [], "", "", "", "80-")], schema)).collect()


def test_filtered_rows_are_among_all(spark):
    tables = make(spark, random_rows(4), natural=True)
    every = {r.severity: r.finding_count for r in summaries.severity_distribution(tables).collect()}
    for spec in SPECS[1:]:
        for r in summaries.severity_distribution(tables, spec).collect():
            assert r.finding_count <= every[r.severity]


def test_case_merging(spark):
    rows = {
        "folder": [(1, "t", "F")], "scan": [(1, 1, "t", "web"), (2, 1, "t", "WEB")],
        "scan_run": [(10, 1, 100, 0), (20, 2, 200, 0)],
        "host": [(1, 10, 1, "10.0.0.1", None), (1, 20, 2, "10.0.0.1", None)],
        "host_vuln": [(1, 1, 10, 5), (2, 1, 20, 5)], "plugin": [(5, 4) + ("p",) + (None,) * 8],
        "vuln_output": [],
    }
    tables = make(spark, rows)
    assert summaries.scan_summary(tables).count() == 2
    merged = summaries.scan_summary(tables, merge_case=True).collect()
    assert [(r.scan_name, r.total_hosts, r.total_critical) for r in merged] == [("WEB", 1, 2)]
    assert epoch(merged[0].last_scan_date) == 200


def test_highest_id_wins_over_later_start(spark):
    rows = {
        "scan": [(1, None, "t", "s")], "scan_run": [(10, 1, 900, 0), (20, 1, 100, 0)],
        "host": [(1, 10, 1, "a", None), (2, 20, 1, "b", None)],
    }
    found = summaries.scan_summary(make(spark, rows)).collect()
    assert [(r.folder_name, r.total_hosts, epoch(r.last_scan_date)) for r in found] == [(None, 1, 100)]


def test_ip_ports_reads_every_run_and_matches_exactly(spark):
    rows = {
        "scan_run": [(10, 1, 0, 0), (20, 1, 0, 0)],
        "host": [(1, 10, 1, "10.0.0.1", None), (1, 20, 1, "10.0.0.1", None), (2, 20, 1, "10.0.0.12", None)],
        "host_vuln": [(1, 1, 10, 5), (2, 1, 20, 5), (3, 2, 20, 5)],
        "vuln_output": [(1, "80"), (1, "9"), (2, "80"), (2, None), (2, "0 / tcp"), (2, "null"), (2, ""), (3, "1")],
    }
    tables = make(spark, rows)
    assert [r.port for r in tops.ip_ports(tables, "10.0.0.1").collect()] == [None, "", "0 / tcp", "80", "9", "null"]
    assert [r.port for r in tops.usable_ip_ports(tables, "10.0.0.1").collect()] == ["80", "9"]


def test_column_filter_refuses_unknown_names(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "a INT, b STRING")
    assert details.filter_columns(df, [("b", "contains", "B"), ("a", "<=", 1)]).count() == 1
    with pytest.raises(ValueError, match="column"):
        details.filter_columns(df, [("c", "=", 1)])
    with pytest.raises(ValueError, match="comparison"):
        details.filter_columns(df, [("a", "like", 1)])
    with pytest.raises(ValueError, match="column"):
        details.page(df, 0, sort=[("c", True)])
