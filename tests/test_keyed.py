"""The splittable reader of keyed JSON objects."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import types as T

from routelore.sources import keyed

NESTED = T.StructType([T.StructField("name", T.StringType()), T.StructField("list", T.ArrayType(T.LongType())), T.StructField("more", T.MapType(T.StringType(), T.StringType()))])


def objects(n: int, seed: int = 1) -> dict:
    rng = random.Random(seed)
    odd = ['a"b', "c\\", "{x}", "},{", "[", "ä\n", '\\"', "", "}" * 30, '"' * 3, "\\" * 7]
    return {f"k{i},{rng.choice(odd)}{i}": {"name": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))), "list": [i] * rng.randint(0, 5), "more": {c: c + "," for c in rng.sample(odd, 2)}} for i in range(n)}


def test_transition_tables_compose(tmp_path):
    text = json.dumps(objects(40), ensure_ascii=False)
    rng = random.Random(5)
    for _ in range(200):
        cuts = sorted(rng.sample(range(len(text)), rng.randint(1, 60)))
        state, depth = keyed.OUTSIDE, 0
        for lo, hi in zip([0, *cuts], [*cuts, len(text)]):
            state, change = keyed.transition(text[lo:hi], state)
            depth += change
        assert (state, depth) == (keyed.OUTSIDE, 0)


@pytest.mark.parametrize("indent,end,chunk", [(None, "", 1), (None, "\n", 50), (2, " \n ", 300), (1, "", 1 << 20)])
def test_entries_come_back_whatever_the_cuts(spark, tmp_path, indent, end, chunk):
    want = objects(120)
    (tmp_path / "a.json").write_text(json.dumps(want, indent=indent, ensure_ascii=False) + end)
    got = {r.route_id: r.body.asDict() for r in keyed.keyed_rows(spark, str(tmp_path / "a.json"), NESTED, chunk).collect()}
    assert got == want
    held = keyed.chunks(spark, str(tmp_path / "a.json"), chunk)
    assert held.count() >= (4 if chunk <= 300 else 1)


def test_splits_of_the_text_source(spark, tmp_path):
    """Byte ranges that Spark cuts, not this reader."""
    want = objects(400, 2)
    (tmp_path / "a.json").write_text(json.dumps(want))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        assert keyed.chunks(spark, str(tmp_path / "a.json"), 1 << 20).select("start").distinct().count() > 4
        got = {r.route_id: r.body.asDict() for r in keyed.keyed_rows(spark, str(tmp_path / "a.json"), NESTED).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_several_files_empty_and_compressed_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text(' {"x": {"name": "1"}, "x": {"name": "2"}}\n')
    (tmp_path / "c.json").write_text("")
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write('{"y": {"name": "}"}}\n')
    rows = keyed.keyed_rows(spark, str(tmp_path / "*.json*"), NESTED, 5).collect()
    assert sorted((r.route_id, r.body.name) for r in rows) == [("x", "1"), ("x", "2"), ("y", "}")]


@pytest.mark.parametrize("text", ['{"a": {"name": "x"}', '{"a": {"name": "x"}\n', '{"a": {"name": "x', '{"a": {}}}', "[1, 2]", '{"a": {}} x', '{"a": {"name": }}'])
def test_malformed_files_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="JSON|bracket|object|MALFORMED|malformed"):
        keyed.keyed_rows(spark, str(tmp_path / "a.json"), NESTED, 4).collect()
