"""A loading pass: from landed payloads to the stored tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.operators import ingest
from breachlens.operators.sizing import checkpointed
from breachlens.operators.checks import key_collisions, pk_duplicates
from breachlens.operators.upsert import upsert, upsert_metrics, versioned_upsert
from breachlens.schemas import HOST_KEY, NATURAL_FINDING_KEY, REQUEST_IDS
from breachlens.session import shuffles_dropped
from breachlens.sources.landing import Payloads
from breachlens.sources.store import Store

FOLDER_COLUMNS = ["type", "name"]
SCAN_COLUMNS = ["folder_id", "type", "name"]


def choose_runs(
    history_rows: DataFrame, loaded: DataFrame, scans: DataFrame | None = None
) -> DataFrame:
    """The runs a pass loads: each scan's newest, if it is completed and not yet loaded."""
    if scans is not None:
        history_rows = history_rows.join(scans.select("scan_id"), "scan_id", "left_semi")
    return ingest.unloaded_runs(ingest.completed_runs(ingest.newest_runs(history_rows)), loaded)


def arrival_order(scans: DataFrame, run: DataFrame, host: DataFrame) -> DataFrame:
    """The place of each finding in a pass: by scan, then host, then finding."""
    scans = scans.select("scan_id", F.col("position").alias("scan_position"))
    hosts = run.select(
        "scan_id", F.col("history_id").alias("scan_run_id"),
        F.posexplode("hosts").alias("host_position", "h"),
    ).select("scan_id", "scan_run_id", "host_position", F.col("h.host_id").alias("scanner_host_id"))
    found = ingest.finding_rows(host)
    return (
        found.join(hosts, ["scan_run_id", "scanner_host_id"])
        .join(scans, "scan_id")
        .select(
            "scan_run_id", "scanner_host_id", F.col("plugin_id").alias("requested_plugin_id"),
            F.struct("scan_position", "host_position", "position").alias("arrival"),
        )
    )


def load_pass(
    payloads: Payloads, store: Store, load_id: int, skip_folder_names: list[str] | None = None
) -> dict[str, DataFrame]:
    """Load every scan's newest completed run that is not stored yet.

    The landing may hold several answers to one request; the newest counts. A run with a
    payload that is missing or incomplete is left out whole, and its rejected requests are
    returned. The pass can be repeated under its `load_id`. Passes are numbered upwards, one
    at a time.
    """
    names = skip_folder_names or []
    folders = ingest.newest_listed(ingest.folders(payloads.folders), "folder_id")
    scans = ingest.newest_listed(ingest.scans(payloads.scans), "scan_id")
    loaded = store.read_loads("scan_run", without=load_id)
    # Needed many times below, and it must not change while the pass writes.
    chosen = checkpointed(
        choose_runs(ingest.history(payloads.history), loaded, ingest.skip_scans(scans, folders, names))
        .select("scan_id", "history_id")
    )
    answers = {kind: payloads.of_runs(kind, chosen) for kind in ("run", "host", "finding")}
    return load_runs(store, load_id, folders, scans, chosen, answers, names)


def load_runs(
    store: Store, load_id: int, all_folders: DataFrame, all_scans: DataFrame, chosen: DataFrame,
    answers: dict[str, DataFrame], skip_folder_names: list[str],
) -> dict[str, DataFrame]:
    """Load the chosen runs (scan_id, history_id) whose answers are complete, with what is now
    listed, as one load. `chosen` must be a written table."""
    with shuffles_dropped(store.spark):
        return _load_runs(store, load_id, all_folders, all_scans, chosen, answers, skip_folder_names)


def _load_runs(
    store: Store, load_id: int, all_folders: DataFrame, all_scans: DataFrame, chosen: DataFrame,
    answers: dict[str, DataFrame], skip_folder_names: list[str],
) -> dict[str, DataFrame]:
    load = store.begin(load_id)
    folders = ingest.skip_folders(all_folders, skip_folder_names)
    scans = ingest.skip_scans(all_scans, all_folders, skip_folder_names)

    def of_chosen(payload: DataFrame, runs: DataFrame) -> DataFrame:
        return payload.join(runs, ["scan_id", "history_id"], "left_semi")

    def stage(kind: str) -> DataFrame:
        """The answers for the chosen runs, parsed once; of several to a request the newest."""
        parsed = store.stage(kind, of_chosen(answers[kind], chosen))
        if "landed_at" not in parsed.columns or not ingest.asked_again(parsed, *REQUEST_IDS[kind]):
            return parsed.drop("landed_at")
        return store.stage(f"{kind}-newest", ingest.newest_payloads(parsed, *REQUEST_IDS[kind]))

    with ThreadPoolExecutor(len(answers)) as pool:
        staged = dict(zip(answers, pool.map(stage, answers)))
    answered = staged["run"].select("scan_id", "history_id")
    order = arrival_order(all_scans, staged["run"], staged["host"])
    run, bad_run = ingest.split_required(staged["run"], "run")
    host, bad_host = ingest.split_required(staged["host"], "host")
    finding, bad_finding = ingest.split_required(staged["finding"], "finding")
    no_run = chosen.join(answered, ["scan_id", "history_id"], "left_anti").withColumns({
        "payload": F.lit("run"), "reason": F.lit("no answer"),
    })
    rejects = bad_run
    for more in (bad_host, bad_finding, ingest.unanswered(run, host, finding), no_run):
        rejects = rejects.unionByName(more, allowMissingColumns=True)
    rejects = checkpointed(rejects)
    accepted = checkpointed(
        chosen.join(rejects.select("history_id").distinct(), "history_id", "left_anti")
    )
    run, host, finding = (of_chosen(p, accepted) for p in (run, host, finding))

    old_folders, old_scans, old_plugins = (store.read_version(name, before=load_id) for name in ("folder", "scan", "plugin"))
    fed = ingest.plugin_rows(finding).join(
        order, ["scan_run_id", "scanner_host_id", "requested_plugin_id"]
    )
    columns = [c for c in old_plugins.columns if c != "plugin_id"]
    load.write_all({
        "folder": upsert(old_folders, folders, "folder_id", FOLDER_COLUMNS),
        "scan": upsert(old_scans, scans, "scan_id", SCAN_COLUMNS),
        "plugin": versioned_upsert(old_plugins, fed, "plugin_id", "mod_date", "arrival", columns),
        "vuln_output": ingest.output_rows(finding),
        "host_vuln": ingest.finding_rows(host),
        "host": ingest.host_rows(host),
        "scan_run": ingest.run_rows(run),
    })
    load.commit()
    tables = store.tables()
    collisions = [
        key_collisions(frame, column, list(key)).select(F.lit(column).alias("id"), F.col(column).alias("value"), "n_keys")
        for frame, column, key in (
            (tables.host, "host_id", HOST_KEY), (tables.host_vuln, "host_vuln_id", NATURAL_FINDING_KEY),
        )
    ]
    return {
        "rejects": rejects,
        "accepted": accepted,
        # Checks of what is now stored, run when they are asked for.
        "key_collisions": collisions[0].union(collisions[1]),
        "duplicates": pk_duplicates(tables).filter("n_duplicate_keys > 0"),
        "folder_metrics": upsert_metrics(old_folders, folders, "folder_id", FOLDER_COLUMNS),
        "ingest_metrics": ingest.ingest_metrics(
            folders=all_folders, scans=all_scans, chosen_runs=chosen,
            loaded_runs=accepted,
        ),
    }
