"""Hand-made and random tables, and the reports over them by plain loops."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from breachlens.sources.tables import Tables

@contextmanager
def settings(spark, values: dict[str, str]):
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


SCHEMAS = {
    "folder": "folder_id INT, type STRING, name STRING",
    "scan": "scan_id BIGINT, folder_id INT, type STRING, name STRING",
    "scan_run": "scan_run_id BIGINT, scan_id BIGINT, scan_start BIGINT, scan_end BIGINT",
    "host": "scanner_host_id BIGINT, scan_run_id BIGINT, scan_id BIGINT, host_ip STRING, host_fqdn STRING",
    "host_vuln": "host_vuln_id BIGINT, scanner_host_id BIGINT, scan_run_id BIGINT, plugin_id BIGINT",
    "plugin": "plugin_id BIGINT, severity INT, name STRING, family STRING, description STRING, "
    "solution STRING, cvss3_base_score DOUBLE, cvss3_vector STRING, ref STRING, pub_date STRING, "
    "mod_date STRING",
    "vuln_output": "host_vuln_id BIGINT, port STRING",
}
NATURAL_OUTPUT = (
    "scanner_host_id BIGINT, scan_run_id BIGINT, plugin_id BIGINT, output_no INT, port STRING"
)


def frame(spark, rows: list[tuple], schema: str):
    """A frame whose size Spark knows, so that it may be broadcast."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(
        pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)
    )


def make(spark, rows: dict[str, list[tuple]], natural: bool = False, sized: bool = True) -> Tables:
    """Tables from tuples. With `natural`, outputs refer to findings by the natural key.

    Unless `sized`, Spark knows no sizes, and nothing may be broadcast.
    """
    schemas, rows = dict(SCHEMAS), dict(rows)
    if natural:
        finding = {v[0]: v[1:] for v in rows["host_vuln"]}
        numbered = enumerate(rows["vuln_output"])
        rows["vuln_output"] = [(*finding[v], i, port) for i, (v, port) in numbered]
        schemas["vuln_output"] = NATURAL_OUTPUT
    return Tables(**{
        name: (frame(spark, rows.get(name, []), schema) if sized
               else spark.createDataFrame(rows.get(name, []), schema))
        for name, schema in schemas.items()
    })


PORTS = [
    None, "", "0", "null", "0 / tcp", "general", "443 / tcp / www", "22", " 80 / tcp", "8080", "1e2",
    "-5", "22.5",
]
NAMES = ["Alpha one", "alpha TWO", "Beta 100%", "beta_x", "Çay", None]


def random_rows(seed: int) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    folders = [(i, "t", r.choice(["f1", "f2", None])) for i in range(3)]
    scans = [(i, r.choice([0, 1, 2, 9, None]), "t", r.choice(["web-1", "Web-2", "db_1", None])) for i in range(6)]
    runs = [(i, r.randrange(7), r.choice([None, 0, r.randrange(10**9)]), 5) for i in range(12)]
    hosts = [
        (h, run, 0, f"10.0.{r.randrange(2)}.{r.randrange(3)}", r.choice([None, "a.b"]))
        for run in range(13) for h in range(4) if r.random() < 0.6
    ]
    plugins = [
        (i, r.choice([0, 1, 2, 3, 4, 7, None]), r.choice(NAMES), "fam", None, "fix",
         r.choice([None, 3.9, 4.0, 7.0, 9.0]), None, None, None, "m")
        for i in range(8)
    ]
    keys = {
        (r.randrange(4), r.randrange(13), r.randrange(10)) for _ in range(90)
    }
    findings = [(i, *key) for i, key in enumerate(sorted(keys))]
    outputs = [(r.randrange(len(findings)), r.choice(PORTS)) for _ in range(120)]
    return {
        "folder": folders, "scan": scans, "scan_run": runs, "host": hosts, "plugin": plugins,
        "host_vuln": findings, "vuln_output": outputs,
    }


def number(port):
    if port is None:
        return None
    found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", port)
    return float(found[1]) if found else 0.0


def like(value, text):
    if value is None:
        return False
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in text.lower())
    return re.search(pattern, value.lower(), re.S) is not None


def joined(rows, spec):
    """The outer-joined rows of the latest runs that pass the filters, as dicts."""
    folders = {f[0]: f for f in rows["folder"]}
    plugins = {p[0]: p for p in rows["plugin"]}
    outputs = defaultdict(list)
    for v, port in rows["vuln_output"]:
        outputs[v].append(port)
    latest = {}
    for run, scan, start, _ in rows["scan_run"]:
        if scan not in latest or run > latest[scan][0]:
            latest[scan] = (run, start)
    allowed = set()
    for part in (spec.port or "").split(","):
        if part:
            low, _, high = part.partition("-")
            allowed |= set(range(int(low), int(high or low) + 1))
    for scan_id, folder_id, _, scan_name in rows["scan"]:
        if scan_id not in latest:
            continue
        run, start = latest[scan_id]
        folder = folders.get(folder_id)
        for host_id, host_run, _, ip, fqdn in rows["host"]:
            if host_run != run:
                continue
            found = [v for v in rows["host_vuln"] if v[1] == host_id and v[2] == run] or [(None,) * 4]
            for v in found:
                p = plugins.get(v[3], (None,) * 11)
                for port in outputs.get(v[0], [None]) if v[0] is not None else [None]:
                    if spec.severity and p[1] not in spec.severity:
                        continue
                    if spec.scan_name and not like(scan_name, spec.scan_name):
                        continue
                    if spec.vulnerability_name and not like(p[2], spec.vulnerability_name):
                        continue
                    if spec.ip_address and not like(ip, spec.ip_address):
                        continue
                    if spec.port and number(port) not in allowed:
                        continue
                    yield {
                        "scan_name": scan_name, "folder_id": folder and folder_id,
                        "folder_name": folder[2] if folder else None, "start": start, "ip": ip,
                        "fqdn": fqdn, "finding": v[0], "key": v[1:], "plugin": p[0], "severity": p[1],
                        "name": p[2], "port": port, "cvss": p[6],
                    }
