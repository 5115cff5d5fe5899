"""Connectors, export, decoders of files and periodic jobs on local fixtures; ids of mapped records."""

import time
import uuid
from datetime import datetime

import pytest

from tidewright.operators import mapping as M
from tidewright.sources import decoding as X
from tidewright.sources import ingest as I

RECORDS = "source_name string, source_id string, ts timestamp_ntz, payload string"


def test_sql_dicts_export_and_snapshot(spark, tmp_path):
    rows = I.sql(spark, "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y) WHERE x >= ?", [2])
    assert I.dicts(rows.collect()) == [{"x": 2, "y": "b"}]
    assert I.export(rows, f"{tmp_path}/deep/er/x") == f"{tmp_path}/deep/er/x" and spark.read.parquet(f"{tmp_path}/deep/er/x").count() == 1
    for n in (5, 3):
        assert I.snapshot({"a": spark.range(n), "b": rows}, str(tmp_path)) == {"a": n, "b": 1}


def test_connectors_keep_to_box_time_pace_and_tries():
    calls, slept, now = [], [], [0.0]

    def fetch(box, start, end, **options):
        calls.append(options)
        if len(calls) == 1:
            raise OSError("down")
        day = lambda d: datetime(2024, 1, d)
        return [{"source_id": "1", "timestamp": day(2), "lon": 1.0, "lat": 1.0}, {"source_id": "2", "timestamp": day(9)}, {"source_id": "3", "lon": 50.0, "lat": 1.0}, {"source_id": "4"}]

    c = I.Connector("tide gauges", "http://x", "daily", fetch, options={"limit": 5})
    pace = I.Pace(2.0, clock=lambda: now[0], sleep=slept.append)
    got = c.records((0, 0, 10, 10), datetime(2024, 1, 1), datetime(2024, 1, 5), pace, station="a")
    assert [r["source_id"] for r in got] == ["1", "4"] and got[0]["source_name"] == "tide gauges"
    assert calls == [{"limit": 5, "station": "a"}] * 2
    c.records((0, 0, 10, 10), datetime(2024, 1, 1), datetime(2024, 1, 5), pace)
    assert slept == [0.5]
    registry = I.Registry()
    registry.add("tides", c)
    assert registry["tides"] is c
    with pytest.raises(KeyError, match="there are tides"):
        registry["waves"]
    with pytest.raises(ValueError, match="is registered"):
        registry.add("tides", c)


def test_tabledap():
    url = I.tabledap_url("https://h/erddap/", "buoys", ["time", "sst"], (1, 2, 3, 4), datetime(2024, 1, 1), datetime(2024, 2, 1), 100)
    assert url == "https://h/erddap/tabledap/buoys.csv?time,sst&time>=2024-01-01T00%3A00%3A00Z&time<=2024-02-01T00%3A00%3A00Z&latitude>=2&latitude<=4&longitude>=1&longitude<=3&orderByLimit(%22100%22)"
    assert I.table_lines(iter(["time,sst", "UTC,C", "2024-01-01,4.5", "2024-01-02,NaN"])) == [{"time": "2024-01-01", "sst": "4.5"}, {"time": "2024-01-02", "sst": None}]
    assert I.table_lines(iter(["time"])) == []


def test_jobs_fail_alone_and_slow_down():
    def bad():
        raise RuntimeError("no")

    out = I.run_all({"a": lambda: 3, "b": bad, "c": lambda: time.sleep(1.5) or 1}, at_once=3, timeout=0.3)
    assert out == {"a": 3, "b": "failed: no", "c": "timeout"}
    assert [I.pause(60, n) for n in (0, 2, 3)] == [60, 60, 300] and I.pause(1000, 4) == 3600
    slept = []
    assert I.periodic(bad, 10, 4, slept.append) == 4 and slept == [10, 10, 50, 50]


def test_ingest_deals_records(spark):
    rows = [("FRED", "1", None, '{"series_id": "X", "value": 1.5}'), ("BOEM", "2", None, '{"lease_number": "L1", "company": "Deep Co"}'), ("nobody", "3", None, "{}"), ("FRED", "4", None, None), ("FRED", "5", None, "[1]"), (None, "6", None, "{}")]
    out = I.ingested(spark.createDataFrame(rows, RECORDS))
    assert [(r.code, r.value) for r in out["time_series"].collect()] == [("X", 1.5)]
    company = uuid.uuid5(uuid.NAMESPACE_URL, "entity:BOEM:operator-Deep Co")
    asset = uuid.uuid5(uuid.NAMESPACE_URL, "entity:BOEM:unknown-L1")
    assert {r.id for r in out["entities"].collect()} == {str(company), str(asset)}
    assert [(r.source_entity_id, r.dest_entity_id, r.relationship_type) for r in out["relationships"].collect()] == [(str(company), str(asset), "operates")]
    assert sorted((r.source_id for r in out["observations"].collect())) == ["3", "6"]
    assert out["lineage"].count() == 6
    empty = I.ingested(spark.createDataFrame([], RECORDS))
    assert all(df.collect() == [] for df in empty.values())


def test_the_golden_record(spark):
    row = ("Shanghai Shipping Exchange", "bdi-2024", datetime(2024, 1, 15), '{"index_code": "BDI", "index_name": "Baltic Dry Index", "value": 1850.0, "unit": "index"}')
    got = M.dispatch(spark.createDataFrame([row], RECORDS), "time_series").collect()
    assert [(r.code, r.name, r.value, r.unit, r.country, r.ts) for r in got] == [("BDI", "Baltic Dry Index", 1850.0, "index", "CN", datetime(2024, 1, 15))]


def test_defaults_are_for_missing_keys_alone(spark):
    rows = [("IMF PCPS", str(i), None, p) for i, p in enumerate(['{"commodity_code": "A", "value": 1}', '{"commodity_code": "A", "value": 1, "unit": null}', '{"commodity_code": "A", "value": "x"}', '{"commodity_code": "A"}'])]
    assert [(r.record_id, r.unit) for r in M.dispatch(spark.createDataFrame(rows, RECORDS), "time_series").orderBy("record_id").collect()] == [("0", "index"), ("1", None)]


def test_sdmx(spark, tmp_path):
    obs = lambda k, v: f'<generic:Obs><generic:ObsKey><generic:Value id="REF_AREA" value="{k}"/><generic:Value id="TIME" value="2020"/></generic:ObsKey><generic:ObsValue value="{v}"/></generic:Obs>'
    (tmp_path / "x.xml").write_text(f'<message:Data xmlns:message="m" xmlns:generic="g"><message:DataSet>{obs("FRA", 1.5)}{obs("ESP", "NaN?")}{obs("PRT", 2)}</message:DataSet></message:Data>')
    got = X.sdmx_observations(spark, str(tmp_path / "x.xml")).collect()
    assert sorted((r["at"]["REF_AREA"], r["at"]["TIME"], r["value"]) for r in got) == [("FRA", "2020", 1.5), ("PRT", "2020", 2.0)]


def test_json_stat_of_dense_values(spark):
    text = '{"id": ["geo", "year"], "size": [2, 3], "value": [1, 2, null, 4, 5, 6], "dimension": {"geo": {"category": {"index": {"FR": 1, "ES": 0}}}, "year": {"category": {"index": {"a": 0, "b": 1, "c": 2}}}}}'
    got = X.json_stat(spark.createDataFrame([("k", text), ("n", None)], "k string, t string"), "t").collect()
    assert sorted((r.k, r["at"]["geo"], r["at"]["year"], r.value) for r in got) == [("k", "ES", "a", 1.0), ("k", "ES", "b", 2.0), ("k", "FR", "a", 4.0), ("k", "FR", "b", 5.0), ("k", "FR", "c", 6.0)]
