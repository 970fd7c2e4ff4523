from __future__ import annotations

from pyspark.sql import DataFrame

from routelore.operators import routing as G


def counted(df: DataFrame):
    """The rows, and how often any of them has been worked out."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(passed, df.schema), read


def test_generated_steps_are_matched_once(spark):
    keys = ["route_id", "method", "weight_id"]
    rows = [(r, "m", "", i, f"s{(i * 3) % 7}") for r in ("a", "b") for i in range(7)]
    made, read = counted(spark.createDataFrame(rows, "route_id string, method string, weight_id string, position long, stop_id string"))
    actual = spark.createDataFrame([(r, i, f"s{i}") for r in ("a", "b") for i in range(7)], "route_id string, position long, stop_id string")
    found = G.order_agreement(made, actual, keys).collect()
    assert [(r.stop_count, r.route_valid) for r in found] == [(7, True)] * 2
    assert read.value == len(rows)
