"""Cleaning of a one-route fixture of nested files, and the rules around missing values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from routelore.operators import cleaning as C
from routelore.sources import files, nested
from routelore import schemas

ROUTES = """{"r1": {"station_code": "S1", "date_YYYY_MM_DD": "2020-01-01", "departure_time_utc": "08:00:00",
 "executor_capacity_cm3": 100.0, "route_score": "High", "stops": {
  "AA": {"lat": 1.0, "lng": 2.0, "type": "Station", "zone_id": NaN},
  "BB": {"lat": 3.0, "lng": 4.0, "type": "Dropoff", "zone_id": "Z1"},
  "CC": {"lat": 5.0, "lng": Infinity, "type": "Dropoff", "zone_id": null}}}}"""
SEQUENCES = {"r1": {"actual": {"AA": 0, "BB": 1, "CC": 2}}}
PACKAGES = """{"r1": {"BB": {
 "p1": {"planned_service_time_seconds": 30.0, "time_window": {"start_time_utc": "09:00", "end_time_utc": "10:00"},
        "dimensions": {"length_cm": 2.0, "width_cm": 3.0, "height_cm": 4.0}, "scan_status": "DELIVERED"},
 "p2": {"planned_service_time_seconds": null, "time_window": {"start_time_utc": NaN, "end_time_utc": NaN}, "scan_status": null}}}}"""
TIMES = {"r1": {"AA": {"BB": 12.0}}}


@pytest.fixture
def raw(spark, tmp_path):
    for name, text in (("r", ROUTES), ("s", json.dumps(SEQUENCES)), ("p", PACKAGES), ("t", json.dumps(TIMES))):
        (tmp_path / f"{name}.json").write_text(text)
    part = nested.Part("one", *(str(tmp_path / f"{n}.json") for n in "rsp"))
    absent = nested.Part("two", str(tmp_path / "absent.json"))
    with pytest.warns(UserWarning, match="skipping"):
        routes = nested.read_parts(spark, [part, absent], "routes")
    return {
        "routes": routes,
        **{k: nested.read_parts(spark, [part], k) for k in ("stops", "sequence", "packages")},
        "edges": nested.read_edges(spark, {"training_build": str(tmp_path / "t.json")}),
    }


def test_fixture_numbers(raw):
    summary = C.route_summary(raw["routes"], raw["stops"])
    row = summary.first()
    assert (row["number_of_stops"], row["station_stop_id"], row["number_of_station_stops"]) == (3, "AA", 1)
    assert (row["number_of_dropoff_stops"], row["missing_zone_count"]) == (2, 2)
    stops = C.stop_base_features(raw["stops"])
    assert stops.count() == 3
    assert stops.where("stop_id = 'CC'").first()["lng"] is None
    moves = [tuple(r) for r in C.actual_transitions(raw["sequence"]).orderBy("position").collect()]
    assert moves == [("r1", "AA", "BB", 0, 1), ("r1", "BB", "CC", 1, 1)]
    p = C.stop_package_features(raw["packages"]).first()
    assert p.asDict() == {
        "route_id": "r1", "stop_id": "BB", "package_count": 2, "total_planned_service_time": 30.0, "has_time_window": 1,
        "time_window_package_count": 1, "total_package_volume_cm3": 24.0, "delivered_count": 1, "attempted_count": 0,
        "rejected_count": 0, "unknown_status_count": 1,
    }
    missing = {r["field"]: (r["missing_count"], r["total_count"]) for r in C.missing_value_summary(summary, raw["packages"]).collect()}
    assert missing == {
        "zone_id": (2, 3), "package_time_window": (1, 2), "planned_service_time": (1, 2), "package_dimensions": (1, 2), "scan_status": (1, 2)
    }
    q = C.data_quality_report(summary, raw["stops"], raw["sequence"], raw["packages"]).first()
    assert q["route_exists_in_actual_sequences"] and q["sequence_matches_route_stops"] and q["can_use_for_training"]
    assert (q["sequence_stop_count"], q["package_stop_count"], q["package_stops_not_in_route_count"]) == (3, 1, 0)
    assert [tuple(r) for r in raw["edges"].collect()] == [("r1", "AA", "BB", 12.0, "training_build")]


def test_positions_with_ties_and_nulls(spark):
    rows = spark.createDataFrame(
        [("r", "b", 1.0), ("r", "a", 1.0), ("r", "z", None), ("r", "c", 0.0)], "route_id string, stop_id string, seq_position double"
    )
    out = C.actual_transitions(rows).orderBy("position").collect()
    assert [(r["from_stop"], r["to_stop"]) for r in out] == [("c", "a"), ("a", "b"), ("b", "z")]


def test_depth_replaces_length_only_when_key_is_absent(spark, tmp_path):
    body = {"r": {"s": {
        "a": {"dimensions": {"depth_cm": 2.0, "width_cm": 3.0, "height_cm": 1.0}},
        "b": {"dimensions": {"length_cm": None, "depth_cm": 2.0, "width_cm": 3.0, "height_cm": 1.0}}}, "empty": {}}}
    (tmp_path / "p.json").write_text(json.dumps(body))
    rows = nested.package_rows(nested.read_keyed(spark, str(tmp_path / "p.json"), schemas.RAW_PACKAGES))
    out = {r["stop_id"]: r for r in C.stop_package_features(rows).collect()}
    assert (out["s"]["package_count"], out["s"]["total_package_volume_cm3"]) == (2, 6.0)
    assert out["empty"]["package_count"] == 0


def test_malformed_object_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"r1": {"actual": {"a": 1}')
    with pytest.raises(Exception):
        nested.read_keyed(spark, str(tmp_path / "r.json"), schemas.RAW_SEQUENCE).collect()


def test_status_order(spark):
    from routelore.functions.scalars import scan_status_class

    rows = spark.createDataFrame([("UNDELIVERED",), ("Attempt_rejected",), ("rejected",), (None,)], "s string")
    assert [r[0] for r in rows.select(scan_status_class(F.col("s"))).collect()] == ["delivered", "attempted", "rejected", "unknown"]


def test_overwrite_guard_and_counted_csv(spark, tmp_path):
    df = spark.range(3).select(F.lit("r").alias("route_id"), F.lit(1).alias("extra"))
    path = str(tmp_path / "out")
    assert files.write_csv(df, path, schemas.ACTUAL_TRANSITIONS) == 3
    with pytest.raises(FileExistsError):
        files.write_csv(df, path, schemas.ACTUAL_TRANSITIONS)
    assert files.write_csv(df, path, schemas.ACTUAL_TRANSITIONS, overwrite=True) == 3
    with pytest.raises(ValueError):
        files.read_csv(spark, path, schemas.ACTUAL_TRANSITIONS, ["nope"])
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none"), schemas.ACTUAL_TRANSITIONS)
