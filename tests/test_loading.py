"""From JSON files to stored tables, with hand-made edge cases."""

import json
import os
import re
from datetime import UTC, datetime

import pytest

from breachlens.operators import ingest
from breachlens.operators.filters import FilterSpec
from breachlens.plans.load import load_pass
from breachlens.plans.summaries import scan_summary
from breachlens.plans.tops import ip_ports
from breachlens.session import shared_dir
from breachlens.sources.landing import read_landing
from breachlens.schemas import TABLES
from breachlens.sources.store import Load, Store
from tests.small import settings


def plugin(number, modified, name="p", **extra):
    risk = {"cvss3_base_score": "7.5"} if number % 2 else {}
    attributes = {
        "synopsis": "s", "description": "d", "solution": "fix", "risk_information": risk,
        "plugin_information": {"plugin_modification_date": modified} if modified else {"x": 1},
        **extra,
    }
    return {"plugindescription": {
        "pluginid": number, "severity": number % 5, "pluginname": f"{name}{number}",
        "pluginfamily": "fam", "pluginattributes": attributes,
    }}


RUN = {"scanner_start": 100, "scanner_end": 200, "targets": "t", "hostcount": 1}

# (scan, run) -> hosts -> plugin ids; a host may lack its address, a run its end.
DOCUMENTS = [
    ("folders", (), {"folders": [
        {"id": 1, "type": "main", "name": "keep"}, {"id": 2, "type": "main", "name": "test1"},
        {"id": 3, "type": "main", "name": None},
    ]}),
    ("scans", (), {"scans": [
        {"id": 1, "folder_id": 1, "type": "x", "name": "one"},
        {"id": 2, "folder_id": 2, "type": "x", "name": "skipped"},
        {"id": 3, "folder_id": 99, "type": "x", "name": "unknown folder"},
        {"id": 4, "folder_id": 3, "type": "x", "name": "no history"},
        {"id": 5, "folder_id": 1, "type": "x", "name": "running"},
        {"id": 6, "folder_id": 1, "type": "x", "name": "broken"},
    ]}),
    ("history", (1,), {"history": [
        {"history_id": 12, "creation_date": 5, "status": "completed"},
        {"history_id": 11, "creation_date": 9, "status": "completed"},
    ]}),
    ("history", (2,), {"history": [{"history_id": 21, "creation_date": 1, "status": "completed"}]}),
    ("history", (3,), {"history": [
        {"history_id": 31, "creation_date": 1, "status": "completed"},
        {"history_id": 32, "creation_date": 1, "status": "completed"},
    ]}),
    ("history", (4,), {"history": None}),
    ("history", (5,), {"history": [
        {"history_id": 51, "creation_date": 1, "status": "completed"},
        {"history_id": 52, "creation_date": 2, "status": "running"},
    ]}),
    ("history", (6,), {"history": [{"history_id": 61, "creation_date": 1, "status": "completed"}]}),
    ("run", (1, 11), {"info": RUN, "vulnerabilities": [
        {"severity": 4, "count": 3}, {"severity": 4, "count": 2}, {"severity": 0, "count": 1},
    ], "hosts": [{"host_id": 8}, {"host_id": 7}]}),
    ("run", (3, 32), {"info": RUN, "vulnerabilities": [], "hosts": [{"host_id": 7}]}),
    ("run", (6, 61), {"info": RUN, "vulnerabilities": [], "hosts": [{"host_id": 7}]}),
    ("host", (1, 11, 8), {"info": {"host-ip": "10.0.0.8", "host-fqdn": "a.b"}, "vulnerabilities": [
        {"severity": 1, "count": 4, "plugin_id": 101},
    ]}),
    ("host", (1, 11, 7), {"info": {"host-ip": "10.0.0.7"}, "vulnerabilities": [
        {"severity": 1, "count": 2, "plugin_id": 101}, {"severity": 4, "count": 1, "plugin_id": 104},
    ]}),
    ("host", (3, 32, 7), {"info": {"host-ip": "10.0.0.7"}, "vulnerabilities": [
        {"severity": 1, "count": 1, "plugin_id": 101},
    ]}),
    ("host", (6, 61, 7), {"info": {"host-fqdn": "no address"}, "vulnerabilities": []}),
    # The same plugin, by arrival: A, B, A. The last A replaces the B.
    ("finding", (1, 11, 8, 101), {"info": plugin(101, "A", "first"), "outputs": [
        {"plugin_output": "two ports", "ports": {"443 / tcp / www": [{"hostname": "h"}], "80 / tcp": []}},
        {"plugin_output": "no port", "ports": {}},
    ]}),
    ("finding", (1, 11, 7, 101), {"info": plugin(101, "B", "second"), "outputs": []}),
    ("finding", (1, 11, 7, 104), {"info": plugin(104, None, see_also=["http://x", "http://y"]), "outputs": [
        {"plugin_output": "o", "ports": {"0 / tcp": []}},
    ]}),
    ("finding", (3, 32, 7, 101), {"info": plugin(101, "A", "third"), "outputs": [
        {"plugin_output": "o", "ports": {"22": []}},
    ]}),
]
IDS = ("scan_id", "history_id", "host_id", "plugin_id")


def land(root, documents, lines, landed=None):
    """`landed`, a Unix time, is when the documents are landed at; by default now."""
    for number, (kind, ids, payload) in enumerate(documents):
        if lines:
            folder = root / kind
            folder.mkdir(parents=True, exist_ok=True)
            with open(folder / "all.json", "a") as out:
                at = {} if landed is None else {"landed_at": f"{datetime.fromtimestamp(landed, UTC):%FT%TZ}"}
                out.write(json.dumps({**dict(zip(IDS, ids)), **at, "payload": payload}) + "\n")
        else:
            folder = root.joinpath(kind, *[f"{n}={v}" for n, v in zip(IDS, ids)])
            folder.mkdir(parents=True, exist_ok=True)
            name = folder / f"{number}-{landed}.json"
            name.write_text(json.dumps(payload, indent=1))
            if landed is not None:
                os.utime(name, (landed, landed))
    return str(root)


def stored(store):
    tables = store.tables()
    return {name: sorted(map(str, df.drop("load_id").collect())) for name, df in tables.as_dict().items()}


@pytest.mark.parametrize("lines", [False, True])
def test_a_pass_and_its_repetition(spark, tmp_path, lines):
    landing = read_landing(spark, land(tmp_path / "in", DOCUMENTS, lines), lines)
    store = Store(spark, str(tmp_path / "store"))
    out = load_pass(landing, store, 1, ["test1", "test2"])
    tables = store.tables()

    assert {r.folder_id for r in tables.folder.collect()} == {1, 3}
    assert {r.scan_id for r in tables.scan.collect()} == {1, 3, 4, 5, 6}
    runs = {r.scan_run_id: r for r in tables.scan_run.collect()}
    assert runs.keys() == {11, 32}
    assert (runs[11].critical_count, runs[11].info_count, runs[11].high_count) == (5, 1, 0)
    hosts = {(r.scan_run_id, r.scanner_host_id): r for r in tables.host.collect()}
    assert hosts.keys() == {(11, 8), (11, 7), (32, 7)}
    assert hosts[11, 7].host_fqdn is None and hosts[11, 7].low_count == 2 and hosts[11, 7].critical_count == 1
    assert tables.host_vuln.count() == 4
    plugins = {r.plugin_id: r for r in tables.plugin.collect()}
    assert plugins[101].name == "third101" and plugins[101].cvss3_base_score == 7.5
    assert plugins[101].ref is None and plugins[101].mod_date == "A"
    assert plugins[104].ref == "http://x\nhttp://y" and plugins[104].mod_date is None
    ports = {(r.scan_run_id, r.plugin_id, r.port, r.port_number, r.output) for r in tables.vuln_output.collect()}
    assert ports == {
        (11, 101, "443 / tcp / www", 443.0, "two ports"), (11, 101, "80 / tcp", 80.0, "two ports"),
        (11, 104, "0 / tcp", 0.0, "o"), (32, 101, "22", 22.0, "o"),
    }
    rejects = [(r.payload, r.history_id, r.host_id, r.reason) for r in out["rejects"].collect()]
    assert ("host", 61, 7, "info.host-ip") in rejects and {r[1] for r in rejects} == {61}
    assert {r.status: r.n for r in out["folder_metrics"].collect()} == {"inserted": 2}
    stages = {r.stage: r.n for r in out["ingest_metrics"].collect()}
    assert stages == {"folders": 3, "scans": 6, "chosen_runs": 3, "loaded_runs": 2}

    summary = {r.scan_name: (r.total_hosts, r.total_low, r.total_critical) for r in scan_summary(tables).collect()}
    assert summary == {"one": (2, 2, 1), "unknown folder": (1, 1, 0)}
    assert [r.port for r in ip_ports(tables, "10.0.0.7").collect()] == ["0 / tcp", "22"]

    before = stored(store)
    load_pass(landing, store, 1, ["test1", "test2"])  # the same pass again, as after a failure
    assert stored(store) == before
    out = load_pass(landing, store, 2, ["test1", "test2"])  # a later pass finds nothing new
    assert stored(store) == before
    assert {r.status: r.n for r in out["folder_metrics"].collect()} == {"same": 2}
    store.expire(keep=1)
    assert stored(store) == before and not (tmp_path / "store/plugin/version=1").exists()


def test_a_missing_answer_holds_a_run_back_until_it_arrives(spark, tmp_path):
    late = ("finding", (1, 11, 7, 104))
    first = [d for d in DOCUMENTS if d[:2] != late]
    store = Store(spark, str(tmp_path / "store"))
    out = load_pass(read_landing(spark, land(tmp_path / "a", first, True), True), store, 1)
    assert ("finding", 11, 104, "no answer") in {
        (r.payload, r.history_id, r.plugin_id, r.reason) for r in out["rejects"].collect()
    }
    assert {r.scan_run_id for r in store.tables().scan_run.collect()} == {32}
    load_pass(read_landing(spark, land(tmp_path / "b", DOCUMENTS, True), True), store, 2)
    tables = store.tables()
    assert {r.scan_run_id for r in tables.scan_run.collect()} == {11, 32}
    assert {r.plugin_id for r in tables.plugin.collect()} == {101, 104}


LISTINGS = [d for d in DOCUMENTS if d[0] in ("folders", "scans", "history")]


@pytest.mark.parametrize("lines", [False, True])
def test_a_landing_that_is_listed_again(spark, tmp_path, lines):
    """Repeated answers double nothing, and the newest state of a run counts, whatever its text."""
    root = tmp_path / "in"
    store = Store(spark, str(tmp_path / "store"))
    land(root, DOCUMENTS, lines, 1_000)
    load_pass(read_landing(spark, str(root), lines), store, 1, ["test1"])
    before = stored(store)
    land(root, DOCUMENTS, lines, 2_000)
    load_pass(read_landing(spark, str(root), lines), store, 2, ["test1"])
    assert stored(store) == before
    # Run 52 was listed as running, which is the larger text, and is now completed; a folder
    # and a scan have new names.
    later = [
        ("folders", (), {"folders": [{"id": 1, "type": "main", "name": "renamed"}]}),
        ("scans", (), {"scans": [{"id": 5, "folder_id": 1, "type": "x", "name": "done"}]}),
        ("history", (5,), {"history": [{"history_id": 52, "creation_date": 2, "status": "completed"}]}),
        ("run", (5, 52), {"info": RUN, "vulnerabilities": [], "hosts": [{"host_id": 7}]}),
        ("host", (5, 52, 7), {"info": {"host-ip": "10.0.0.5"}, "vulnerabilities": []}),
        ("host", (5, 52, 7), {"info": {"host-ip": "10.0.0.55"}, "vulnerabilities": []}),
    ]
    land(root, later[:-1], lines, 3_000)
    land(root, later[-1:], lines, 4_000)
    out = load_pass(read_landing(spark, str(root), lines), store, 3, ["test1"])
    tables = store.tables()
    assert {r.folder_id: r.name for r in tables.folder.collect()} == {1: "renamed", 3: None}
    assert {r.scan_id: r.name for r in tables.scan.collect()}[5] == "done"
    assert sorted(r.scan_run_id for r in tables.scan_run.collect()) == [11, 32, 52]
    assert [r.host_ip for r in tables.host.filter("scan_run_id = 52").collect()] == ["10.0.0.55"]
    assert out["duplicates"].collect() == [] and out["key_collisions"].collect() == []


LATER = [
    ("folders", (), {"folders": [{"id": 1, "type": "main", "name": "renamed"}]}),
    ("scans", (), {"scans": [{"id": 5, "folder_id": 1, "type": "x", "name": "done"}]}),
    ("history", (5,), {"history": [{"history_id": 53, "creation_date": 9, "status": "completed"}]}),
    ("run", (5, 53), {"info": RUN, "vulnerabilities": [], "hosts": [{"host_id": 7}]}),
    ("host", (5, 53, 7), {"info": {"host-ip": "10.0.0.7"}, "vulnerabilities": [{"severity": 1, "count": 1, "plugin_id": 101}]}),
    ("finding", (5, 53, 7, 101), {"info": plugin(101, "C", "fourth"), "outputs": [
        {"plugin_output": "late", "ports": {"99": []}},
    ]}),
]


def broken(monkeypatch, at):
    """Let a load fail before it has written the table `at`, or before its manifest is in place."""
    write, commit = Load.write, Store._commit

    def failing(self, name, rows):
        if name == at:
            raise RuntimeError("power cut")
        write(self, name, rows)

    def uncommitted(self, manifest):
        if at == "manifest":
            raise RuntimeError("power cut")
        commit(self, manifest)

    monkeypatch.setattr(Load, "write", failing)
    monkeypatch.setattr(Store, "_commit", uncommitted)


@pytest.mark.parametrize("at", [*TABLES, "manifest"])
def test_a_load_is_seen_in_all_tables_or_in_none(spark, tmp_path, monkeypatch, at):
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    land(root, DOCUMENTS, True, 1_000)
    load_pass(read_landing(spark, str(root), True), store, 1)
    before = stored(store)
    land(root, LATER, True, 2_000)
    with monkeypatch.context() as patch:
        broken(patch, at)
        with pytest.raises(RuntimeError, match="power cut"):
            load_pass(read_landing(spark, str(root), True), store, 2)
    assert stored(store) == before and store.complete_loads() == [1]
    assert store.read_version("plugin", before=3).filter("name = 'fourth101'").isEmpty()
    # Neither does the next load build upon it, nor does its repetition find anything left.
    load_pass(read_landing(spark, str(root), True), store, 2)
    after = stored(store)
    assert {r.scan_run_id for r in store.tables().scan_run.collect()} == {11, 32, 53}
    assert {r.folder_id: r.name for r in store.tables().folder.collect()}[1] == "renamed"
    store.expire(keep=1)
    assert stored(store) == after


def test_a_first_load_that_breaks_leaves_empty_tables(spark, tmp_path, monkeypatch):
    landing = read_landing(spark, land(tmp_path / "in", DOCUMENTS, True), True)
    store = Store(spark, str(tmp_path / "store"))
    with monkeypatch.context() as patch:
        broken(patch, "manifest")
        with pytest.raises(RuntimeError, match="power cut"):
            load_pass(landing, store, 1)
    assert all(rows == [] for rows in stored(store).values())
    assert ip_ports(store.tables(), "10.0.0.7").count() == 0
    load_pass(landing, store, 2)
    assert store.tables().host_vuln.count() == 4
    with pytest.raises(ValueError, match="load 1"):
        load_pass(landing, store, 1)
    assert set(store._parts("host")) != {store.manifest().part}
    store.expire()
    assert store._parts("host") == store._parts("plugin") == [store.manifest().part]


def test_readers_of_a_load_are_not_disturbed_by_its_repetition(spark, tmp_path):
    landing = read_landing(spark, land(tmp_path / "in", DOCUMENTS, True), True)
    store = Store(spark, str(tmp_path / "store"))
    load_pass(landing, store, 1)
    reader = store.tables()
    load_pass(landing, store, 1)
    assert store.complete_loads() == [1] and store.manifest().part == 2
    assert reader.host.count() == store.tables().host.count() == 3
    assert reader.plugin.count() == store.tables().plugin.count() == 2


def test_a_load_must_have_all_tables(spark, tmp_path):
    load = Store(spark, str(tmp_path)).begin(1)
    load.write("folder", spark.createDataFrame([(1, "t", "n")], TABLES["folder"]))
    with pytest.raises(RuntimeError, match="scan_run"):
        load.commit()


def test_repeating_a_load_with_nothing_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    load_pass(read_landing(spark, land(tmp_path / "a", DOCUMENTS, True), True), store, 1)
    assert store.tables().host.count() == 3
    nothing = [d if d[0] != "history" else ("history", d[1], {"history": None}) for d in DOCUMENTS]
    load_pass(read_landing(spark, land(tmp_path / "b", nothing, True), True), store, 1)
    assert {name: df.count() for name, df in store.tables().as_dict().items() if name not in ("folder", "scan", "plugin")} == {
        "scan_run": 0, "host": 0, "host_vuln": 0, "vuln_output": 0,
    }


def test_reports_skip_loads_without_a_latest_run(spark, tmp_path):
    """Of the three large tables only the loads that hold latest runs are read."""
    store = Store(spark, str(tmp_path / "store"))
    load_pass(read_landing(spark, land(tmp_path / "in", DOCUMENTS, True), True), store, 1)
    text = scan_summary(store.tables(), FilterSpec(port="1-500"))._jdf.queryExecution().executedPlan().toString()
    for columns in ("host_ip", "plugin_id", "port_number"):
        scans = re.findall(rf"FileScan parquet \[[^\]]*{columns}[^\]]*\][^\n]*PartitionFilters: \[([^\]]*)", text)
        assert any("dynamicpruning" in f for f in scans), (columns, text)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        shuffled = scan_summary(store.tables()).collect()
    assert shuffled == scan_summary(store.tables()).collect()


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir().removeprefix("file:").startswith(shared_dir(spark))


def test_required_fields(spark):
    schema = "scan_id BIGINT, history_id BIGINT, host_id BIGINT, " \
        "info STRUCT<`host-ip`: STRING>, vulnerabilities ARRAY<STRUCT<severity: INT, count: BIGINT, plugin_id: BIGINT>>"
    rows = [
        (1, 1, 1, ("ip",), [(4, 1, 1)]), (1, 1, 2, (None,), []), (1, 1, 3, ("ip",), None),
        (1, 1, 4, ("ip",), [(None, 1, 1)]), (1, 1, 5, ("ip",), [(5, 1, 1)]), (1, 1, 6, None, []),
        (1, 1, 7, ("ip",), [(4, 1, None)]),
    ]
    good, bad = ingest.split_required(spark.createDataFrame(rows, schema), "host")
    assert [r.host_id for r in good.collect()] == [1]
    assert {r.host_id: r.reason for r in bad.collect()} == {
        2: "info.host-ip", 3: "vulnerabilities", 4: "vulnerabilities[]", 5: "vulnerabilities[]",
        6: "info.host-ip", 7: "vulnerabilities[]",
    }
