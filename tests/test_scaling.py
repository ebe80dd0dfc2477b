"""What keeps large inputs within disk, time and memory."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from breachlens import session
from breachlens.operators import trigrams
from breachlens.plans import filter_table
from breachlens.plans.load import load_pass
from breachlens.session import shared_dir, shuffles_dropped
from breachlens.sources import sample_landing
from breachlens.sources.landing import read_landing, read_payloads, read_payloads_of
from breachlens.sources.store import Store


@pytest.fixture
def small_tables(spark, tmp_path):
    """Eight runs of two scans, each with 40 findings on five hosts."""
    made = {
        "region": spark.sql("SELECT 0 r_regionkey, 'R' r_name"),
        "nation": spark.sql("SELECT 0 n_nationkey, 'N' n_name, 0 n_regionkey"),
        "customer": spark.range(1, 3).selectExpr("id c_custkey", "0 c_nationkey", "'seg' c_mktsegment"),
        "part": spark.range(1, 41).selectExpr(
            "id p_partkey", "repeat('part ', 20) || id p_name", "'b' p_brand", "'t' p_type", "CAST(id AS INT) p_size"
        ),
        "orders": spark.range(1, 9).selectExpr(
            "id o_orderkey", "1 + id % 2 o_custkey", "'F' o_orderstatus",
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) o_orderdate", "'1' o_orderpriority",
        ),
        "lineitem": spark.range(320).selectExpr(
            "1 + id DIV 40 l_orderkey", "1 + id % 40 l_partkey", "id % 5 l_suppkey", "CAST(6 AS DOUBLE) l_quantity"
        ),
    }
    for name, rows in made.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_landing_is_compressed_and_whole(spark, small_tables, monkeypatch):
    monkeypatch.setattr(sample_landing, "LINES", 100)
    root = sample_landing.land(spark, small_tables, f"{shared_dir(spark)}/landing-compressed")
    files = [f for f in Path(root.removeprefix("file://")).rglob("part-*")]
    assert files and all(f.name.endswith(".gz") for f in files)
    landing = read_landing(spark, root, lines=True)
    assert landing.finding.select("history_id", "host_id", "plugin_id").distinct().count() == 320
    store = Store(spark, f"{root}/store")
    assert load_pass(landing, store, 1)["rejects"].isEmpty()
    assert store.tables().host_vuln.count() == 80


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.name for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*.data")}


def test_shuffles_of_finished_jobs_are_dropped(spark, tmp_path):
    before = shuffle_files(spark)
    with shuffles_dropped(spark):
        spark.range(1000).groupBy(F.col("id") % 7).count().write.parquet(f"{tmp_path}/rows")
    assert shuffle_files(spark) <= before
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_filters_with_one_condition_share_words(spark):
    """1,280 filters on ten names in turn: a name's bits lie in few of all words."""
    filters = spark.range(1280).selectExpr(
        "CAST(id AS STRING) filter_name", "array(CAST(id % 5 AS INT)) severity", "'n' || (id % 10) scan_name",
        "'' vulnerability_name", "'' ip_address", "'' port",
    )
    words = filter_table._words(filter_table._numbered(filters), F.col("scan_name"))
    assert words.groupBy("condition").count().agg(F.max("count")).first()[0] <= 4


@pytest.fixture
def own_settings(spark):
    keys = [*session.MOST_BYTES, session._INITIAL, "spark.sql.shuffle.partitions"]
    before = {key: spark.conf.get(key, None) for key in keys}
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffles_start_from_as_many_partitions_as_the_input_asks_for(spark, tmp_path, own_settings, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 1000)
    monkeypatch.setattr(session, "INPUT_OF_PARTITION", 10)
    paths = [str(tmp_path / "a"), str(tmp_path / "none")]
    session.configure(spark, paths)
    assert spark.conf.get(session._INITIAL) == "100"
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    session.configure(spark, paths)
    assert spark.conf.get(session._INITIAL, None) is None


def test_tasks_are_given_no_more_than_the_session_allows(spark, own_settings):
    key, other = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "1m")
    spark.conf.set(other, "64MB")
    session.configure(spark)
    assert (spark.conf.get(key), spark.conf.get(other)) == ("1m", "16m")


def test_texts_are_dealt_out_by_their_lengths(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "CHARACTERS", 100)
    texts = spark.range(100).selectExpr("id % 90 key", "'text number ' || id t")
    found = trigrams.postings(texts, "key", "t")
    assert found.rdd.getNumPartitions() >= 13
    assert found.count() == found.distinct().count()


def test_lines_of_other_runs_are_not_parsed(spark, tmp_path):
    """Whatever a line looks like, it is kept if it may be of a wanted run."""
    lines = [
        '{"scan_id":1,"history_id":7,"payload":{"info":{"targets":"a"}}}',
        '{"scan_id":1,"history_id":8,"payload":{"info":{"targets":"other"}}}',
        '{ "payload":{"info":{"targets":"b"}}, "history_id" : 7 , "scan_id":1}',
        '{"scan_id":1,"payload":{"info":{"targets":"c","history_id":8}},"history_id":7}',
        '{"scan_id":1,"history\\u005fid":7,"payload":{"info":{"targets":"d"}}}',
        '{"scan_id":1,"history_id":"7","payload":{"info":{"targets":"no number"}}}',
        '{"scan_id":1,"history_id":70,"payload":{"info":{"targets":"other"}}}',
        '{"scan_id":1,"payload":{"info":{"targets":"no run"}}}', "", "broken",
    ]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "x.json").write_text("\n".join(lines))
    runs = spark.sql("SELECT 1L scan_id, 7L history_id")
    every, some = read_payloads(spark, str(tmp_path), "run", lines=True), read_payloads_of(spark, str(tmp_path), "run", runs)
    of = lambda rows: sorted(r[0] for r in rows.join(runs, ["scan_id", "history_id"], "left_semi").select("info.targets").collect())
    assert of(some) == of(every) == ["a", "b", "c", "d"]
    assert "other" not in [r[0] for r in some.select("info.targets").collect()]
    assert some.schema.simpleString() == every.schema.simpleString()
    # The tests for null that Spark adds to joins must not parse each line once more.
    plan = some.join(runs, ["scan_id", "history_id"], "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(from_json" not in plan


def test_runs_too_far_apart_for_bitmaps_are_read_all_the_same(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "x.json").write_text('{"scan_id":1,"history_id":9000000000,"payload":{}}\n{"scan_id":1,"history_id":5}')
    runs = spark.sql("SELECT 1L scan_id, explode(array(1L, 9000000000L)) history_id")
    some = read_payloads_of(spark, str(tmp_path), "run", runs)
    assert some.join(runs, ["scan_id", "history_id"], "left_semi").count() == 1


@pytest.fixture
def odd_tables(spark, small_tables, tmp_path):
    """With nulls, lines and plugins that come twice, and a run that is listed for two scans."""
    add = {
        "part": "SELECT 1L p_partkey, repeat('part ', 20) || 1 p_name, 'b' p_brand, 't' p_type, 1 p_size",
        "orders": "SELECT 3L o_orderkey, 9L o_custkey, 'F' o_orderstatus, TIMESTAMP_NTZ '2024-01-01 00:00:00' o_orderdate, '1' o_orderpriority",
        "lineitem": "SELECT * FROM VALUES (3L, 1L, 1L, 6D), (3L, 1L, 1L, 9D), (3L, null, 1L, 6D), (3L, 99L, null, 6D), "
                    "(3L, 2L, 77L, 1D), (3L, 2L, 78L, null), (null, 2L, 1L, 6D), (555L, 2L, 1L, 6D) AS t(l_orderkey, l_partkey, l_suppkey, l_quantity)",
    }
    for name, rows in add.items():
        spark.sql(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}.parquet")
    return small_tables


def test_answers_are_made_from_lines_that_are_shuffled_once(spark, odd_tables):
    from breachlens.sources import sample

    root = sample_landing.land(spark, odd_tables, f"{shared_dir(spark)}/landing-odd")
    landing = read_landing(spark, root, lines=True)
    runs = sample.scan_run(spark, odd_tables).select("scan_run_id", "scan_id")
    counted = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert counted(landing.host.select("history_id", "host_id", "scan_id", "info.host-ip")) == counted(
        sample.host(spark, odd_tables).select("scan_run_id", "scanner_host_id", "scan_id", "host_ip")
    )
    assert counted(landing.finding.select("history_id", "host_id", "scan_id", "plugin_id")) == counted(
        sample.host_vuln(spark, odd_tables).join(runs, "scan_run_id").join(
            sample.plugin(spark, odd_tables).select("plugin_id"), "plugin_id", "left"
        ).select("scan_run_id", "scanner_host_id", "scan_id", "plugin_id")
    )
    third = landing.run.filter("history_id = 3").select(F.size("hosts"), "info.hostcount", F.expr(
        "aggregate(vulnerabilities, 0L, (n, v) -> n + v.count)"
    )).distinct().collect()
    plain = sample.host_vuln(spark, odd_tables).filter("scan_run_id = 3").join(
        sample.plugin(spark, odd_tables).select("plugin_id"), "plugin_id", "left"
    ).agg(F.expr("sum(1 + plugin_id % 3)")).first()[0]
    hosts = sample.host(spark, odd_tables).filter("scan_run_id = 3").count()
    assert [tuple(r) for r in third] == [(hosts, hosts, plain)]
    no_host = landing.host.filter("host_id IS NULL").select(F.size("vulnerabilities")).collect()
    assert [r[0] for r in no_host] == [0, 0]
    with sample_landing._hosts_found(spark, odd_tables) as found:
        for kind, rows in sample_landing._answers(spark, odd_tables, found).items():
            assert not [f for f in rows.inputFiles() if "lineitem" in f], kind


def test_a_batch_of_texts_is_read_once_and_dealt_out_by_kind(spark, tmp_path):
    from breachlens.streaming import arrivals

    rows = [("run", "p1", "a"), ("host", "p2", "b"), ("run", "p3", None), ("", "p4", "c")]
    batch = spark.createDataFrame(rows, "kind STRING, path STRING, value STRING").selectExpr(
        "kind", "path", "TIMESTAMP '2024-01-01 00:00:00' landed_at", "value"
    )
    with arrivals._texts(batch, f"{tmp_path}/landed") as texts:
        assert sorted(r.path for r in texts.filter("kind = 'run'").collect()) == ["p1", "p3"]
        assert texts.filter("kind = 'finding'").isEmpty()
        assert all("kind=" in f for f in texts.inputFiles())
    with arrivals._texts(batch.filter("false"), f"{tmp_path}/landed") as texts:
        assert texts.filter("kind = 'run'").isEmpty()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
