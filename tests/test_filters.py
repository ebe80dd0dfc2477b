import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breachlens.operators.filters import FilterSpec, contains_text, port_ranges
from breachlens.plans.saved import link_table, parsed_links


def test_ranges_are_sorted_and_merged():
    assert port_ranges("400-500, 22,23 ,450-600") == [(22, 23), (400, 600)]
    assert port_ranges("22-20") == []
    assert port_ranges("22-20,80") == [(80, 80)]


@pytest.mark.parametrize("text", ["80-", "abc", "1-2-3", "-5", "80,,443", "80;443"])
def test_bad_port_text_is_named(text):
    with pytest.raises(ValueError, match="port"):
        FilterSpec(port=text)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=6))
def test_ranges_hold_the_same_ports(pairs):
    merged = port_ranges(",".join(f"{low}-{high}" for low, high in pairs))
    assert {p for low, high in merged for p in range(low, high + 1)} == {
        p for low, high in pairs for p in range(low, high + 1)
    }
    assert all(a[1] + 1 < b[0] for a, b in zip(merged, merged[1:]))


def test_empty_values_do_not_filter():
    for spec in (FilterSpec(), FilterSpec([], "", "", "", ""), FilterSpec(severity=None)):
        assert not spec.on_finding
        assert spec.scan_condition("x") is None and spec.host_condition("x") is None
        assert spec.plugin_condition("s", "n") is None and spec.port_condition("p") is None
    assert FilterSpec(severity=[0]).on_plugin


TEXTS = ["abc", "a%c", "a_c", "ABC", "a\\c", "İZMİR", "çay", "cay", None]


def hits(spark, text, **kwargs):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x STRING")
    return {r.x for r in df.filter(contains_text("x", text, **kwargs)).collect()}


def test_text_matching(spark):
    assert hits(spark, "b") == {"abc", "ABC"}
    assert hits(spark, "a_c") == {"abc", "ABC", "a%c", "a_c", "a\\c"}
    assert hits(spark, "a\\_c") == {"a_c"}
    assert hits(spark, "a\\%c") == {"a%c"}
    assert hits(spark, "a\\c") == {"a\\c"}
    assert hits(spark, "'; DROP") == set()
    assert hits(spark, "İ") == {"İZMİR"}
    assert hits(spark, "ÇAY") == {"çay"}
    assert hits(spark, "CAY", fold_accents=True) == {"çay", "cay"}


@given(
    st.lists(st.integers(0, 9), max_size=4),
    *[st.one_of(st.none(), st.text(max_size=8)) for _ in range(3)],
    st.one_of(st.none(), st.just("22,80-90")),
)
def test_links_come_back(severity, scan, name, ip, port):
    spec = FilterSpec(severity, scan, name, ip, port)
    back = FilterSpec.from_link(spec.to_link())
    assert back == FilterSpec(severity, scan or None, name or None, ip or None, port)


def test_link_columns_agree_with_specs(spark):
    specs = [
        FilterSpec([4, 3], "a b", "x&y=z%", "10.0.", "22,80-90"),
        FilterSpec([0]), FilterSpec(), FilterSpec(scan_name="ığü*~'\"+"),
    ]
    rows = [
        (i, list(s.severity), s.scan_name, s.vulnerability_name, s.ip_address, s.port)
        for i, s in enumerate(specs)
    ]
    schema = "i INT, severity ARRAY<INT>, scan_name STRING, vulnerability_name STRING, ip_address STRING, port STRING"
    links = link_table(spark.createDataFrame(rows, schema)).select("i", "link")
    for row in parsed_links(links).orderBy("i").collect():
        spec = specs[row.i]
        assert row.link == spec.to_link()
        assert (tuple(row.severity), row.scan_name, row.vulnerability_name) == (
            spec.severity, spec.scan_name, spec.vulnerability_name
        )
        assert (row.ip_address, row.port) == (spec.ip_address, spec.port)


def test_odd_links(spark):
    links = ["?severity=3,x,-1,٣,2&scan_name=%zz&scan_name=b&port=", "severity=&other=1", ""]
    df = spark.createDataFrame([(x,) for x in links], "link STRING")
    found = {r.link: r for r in parsed_links(df).collect()}
    first = found[links[0]]
    assert first.severity == [3, 2] and first.scan_name == "%zz" and first.port is None
    assert first.severity_labels == "Yüksek, Orta"
    assert found[""].severity == [] and found["severity=&other=1"].severity == []


def test_port_condition_on_text_and_number(spark):
    rows = [("443 / tcp", 443.0), ("", 0.0), (None, None), ("22", 22.0), ("80", 80.0), ("450", 450.0)]
    df = spark.createDataFrame(rows, "port STRING, n DOUBLE")
    spec = FilterSpec(port="22,400-449,0")
    for condition in (spec.port_condition("port"), spec.port_condition("port", F.col("n"))):
        assert {r.port for r in df.filter(condition).collect()} == {"443 / tcp", "", "22"}
    assert df.filter(FilterSpec(port="9-1").port_condition("port")).count() == 0
