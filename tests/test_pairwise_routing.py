"""Samples, metrics, scorers and route generation on small fixtures."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from routelore.operators import metrics as M
from routelore.operators import models as ML
from routelore.operators import pairwise as P
from routelore.operators import routing as G
from routelore.operators import stats as T
from routelore.operators import weights as WT
from routelore.operators.scoring import LogitScorer, from_pipeline
from routelore.operators.travel import StopTravel, route_sources, with_times
from routelore.schemas import WEIGHTS


@pytest.fixture(scope="module")
def moves(spark):
    rows = [(f"r{r}", f"s{i:02d}", f"s{i + 1:02d}", i) for r, n in ((1, 14), (2, 3), (3, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "route_id string, from_stop string, to_stop string, position long")


def test_draws_are_distinct_later_stops(moves):
    seq = P.stop_sequence(moves)
    assert seq.where("route_id = 'r1'").count() == 15
    draws = P.sample_draws(seq.select("route_id", "position", "sequence_length"), 5, 42).toPandas()
    assert (draws[draws.label == 1].candidate_position == draws[draws.label == 1].position + 1).all()
    neg = draws[draws.label == 0]
    assert (neg.candidate_position > neg.position + 1).all() and (neg.candidate_position < neg.sequence_length).all()
    assert not neg.duplicated(["route_id", "position", "candidate_position"]).any()
    expected = draws[draws.label == 1].apply(lambda r: min(5, r.sequence_length - r.position - 2), axis=1).sum()
    assert len(neg) == expected


def test_every_subset_is_drawn_about_equally(spark):
    seq = spark.range(4000).select(F.col("id").cast("string").alias("route_id"), F.lit(0).cast("long").alias("position"), F.lit(7).cast("long").alias("sequence_length"))
    neg = P.sample_draws(seq, 2, 1).where("label = 0").toPandas()
    pairs = neg.groupby("route_id")["candidate_position"].apply(lambda s: tuple(sorted(s))).value_counts()
    assert len(pairs) == 10 and pairs.min() > 300 and pairs.max() < 500


def test_sequence_blocks_are_bounded(moves):
    blocks = P.sequence_blocks(P.stop_sequence(moves), 4).toPandas()
    assert blocks["stop_ids"].map(len).max() == 4


def brute_rank(part: pd.DataFrame) -> int:
    ordered = part.sort_values(["predicted_probability", "negative_sample_rank", "candidate_stop"], ascending=[False, True, True])
    return int(np.argmax(ordered["label"].to_numpy()) + 1)


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [("all", f"r{i // 40}", i // 4, f"c{i % 4}", i % 4, int(i % 4 == 0 and i % 28 != 0), float(np.round(rng.random(), 1))) for i in range(400)]
    cols = ["g", "route_id", "position", "candidate_stop", "negative_sample_rank", "label", "predicted_probability"]
    pdf = pd.DataFrame(rows, columns=cols)
    df = spark.createDataFrame(pdf)
    got = M.all_metrics(df, ["g"]).first()
    pos, neg = pdf[pdf.label == 1].predicted_probability.to_numpy(), pdf[pdf.label == 0].predicted_probability.to_numpy()
    auc = np.mean([(p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)])
    assert got["roc_auc"] == pytest.approx(auc)
    ap, seen, last = 0.0, 0, 0.0
    for t in sorted(set(pdf.predicted_probability), reverse=True):
        above = pdf[pdf.predicted_probability >= t]
        recall = above.label.sum() / len(pos)
        ap += (recall - last) * above.label.mean()
        last = recall
    assert got["average_precision"] == pytest.approx(ap)
    with_positive = [p for _k, p in pdf.groupby(["route_id", "position"]) if p.label.sum()]
    ranks = np.array([brute_rank(p) for p in with_positive])
    assert got["evaluated_contexts"] == len(ranks)
    assert got["skipped_contexts_no_positive"] == 100 - len(ranks)
    assert got["sampled_top1_accuracy"] == pytest.approx((ranks <= 1).mean())
    assert got["mrr"] == pytest.approx((1 / ranks).mean())
    assert got["median_actual_positive_rank"] == np.median(ranks)
    blocks = M.curve_metrics(df, ["g"], rows_per_block=2).first()
    assert blocks["roc_auc"] == pytest.approx(auc) and blocks["average_precision"] == pytest.approx(ap)
    single = M.curve_metrics(df.where("label = 0"), ["g"]).first()
    assert single["roc_auc"] is None and single["average_precision"] == 0.0


def members_frame(spark, sizes=(9, 5, 2), seed=0):
    rng = np.random.default_rng(seed)
    rows, edges = [], []
    for r, n in enumerate(sizes):
        for i in range(n):
            rows.append(
                (f"r{r}", i, f"s{i}", n, n, ["A", "B", "UNKNOWN_ZONE"][rng.integers(3)], int(i == 0), int(i > 0), *map(float, rng.integers(0, 4, 9)))
            )
            for j in range(n):
                if i != j and rng.random() < 0.7:
                    edges.append((f"r{r}", f"s{i}", f"s{j}", float(rng.integers(1, 30))))
    cols = "route_id string, position long, stop_id string, sequence_length long, number_of_stops long, zone string, is_station long, is_dropoff long, "
    cols += ", ".join(f"{c} double" for c in G.STOP_FEATURES)
    return (
        spark.createDataFrame(rows, cols),
        spark.createDataFrame(edges, "route_id string, from_stop string, to_stop string, travel_time double"),
    )


SCORER = LogitScorer(0.2, {"travel_time_ij": -0.05, "same_zone": 0.7, "route_progress": 0.3, "candidate_package_count": 0.2}, 9)
PLANS = [(G.NEAREST, "", (0,) * 5), (G.PREFERENCE, "", (0,) * 5), (G.HYBRID, "w1", (0.35, 0.4, 0.15, 0.05, 0.05)), (G.HYBRID, "w2", (0.7, 0.15, 0.15, 0, 0))]


def test_plan_batches_walk_the_same_way(spark):
    members, edges = members_frame(spark)
    keys = ["route_id", "method", "weight_id", "position"]
    short = G.generate_routes(members, edges, PLANS, SCORER).toPandas().sort_values(keys).reset_index(drop=True)
    long = G.generate_routes(members, edges, PLANS, SCORER, plans_at_once=1).toPandas().sort_values(keys).reset_index(drop=True)
    assert (short[[*keys, "stop_id", "candidate_count"]] == long[[*keys, "stop_id", "candidate_count"]]).all().all()
    assert np.allclose(short["cost"].fillna(-1), long["cost"].fillna(-1))
    for _key, part in short.groupby(keys[:3]):
        assert sorted(part["actual_position"]) == list(range(len(part)))
        assert part["stop_id"].iloc[0] == "s0"


def test_unreachable_stops_follow_driven_order(spark):
    members, edges = members_frame(spark, (6,))
    out = G.generate_routes(members, edges.limit(0), PLANS[:1], SCORER).orderBy("position").toPandas()
    assert list(out["actual_position"]) == list(range(6))


def brute_lis(a):
    return max(len(c) for k in range(len(a) + 1) for c in itertools.combinations(a, k) if list(c) == sorted(set(c)))


def test_lcs_lengths(spark):
    rng = np.random.default_rng(1)
    perms = {f"k{i}": rng.permutation(9) for i in range(6)}
    rows = [(k, i, int(v)) for k, p in perms.items() for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "key string, position long, actual_position long")
    want = {k: brute_lis(list(map(int, p))) for k, p in perms.items()}
    assert {r[0]: r[1] for r in G.lcs_lengths(df, ["key"]).collect()} == want
    long = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").alias("position"), F.col("id").alias("actual_position"))
    assert G.lcs_lengths(long, ["key"]).first()["lcs_length"] == 5000


def test_lcs_in_tiles_equals_one_pass(spark):
    """Blocks of positions by blocks of values pass tails and moves on, also through tiles without positions of their own."""
    rng = np.random.default_rng(2)
    orders = {"shuffled": rng.permutation(97), "rising": np.arange(60), "falling": np.arange(60)[::-1], "short": rng.permutation(5),
              "waves": np.concatenate([np.arange(40, 80), np.arange(0, 40), np.arange(80, 100)]), "sparse": rng.choice(400, 70, replace=False)}

    def one_pass(a):
        return len(G.patience_tile([], list(enumerate(map(int, a))))[0])

    rows = [(k, i, int(v)) for k, p in orders.items() for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "key string, position long, actual_position long")
    got = {r["key"]: r["lcs_length"] for r in G.lcs_lengths(df, ["key"], block=20).collect()}
    assert got == {k: one_pass(p) for k, p in orders.items()}
    assert all(one_pass(p) == brute_lis(list(map(int, p))) for p in (rng.permutation(9) for _ in range(20)))


def test_lcs_of_a_hundred_thousand_positions(spark):
    values = np.random.default_rng(3).permutation(100_000)
    rows = spark.createDataFrame(pd.DataFrame({"key": "k", "position": np.arange(len(values)), "actual_position": values}))
    want = len(G.patience_tile([], list(enumerate(values.tolist())))[0])
    assert G.lcs_lengths(rows, ["key"], block=25_000).first()["lcs_length"] == want


def test_plans_share_their_common_choices(spark):
    members, edges = members_frame(spark, (30,))
    plans = [(G.HYBRID, f"w{i}", (0.5 + i / 1000, 0.5 - i / 1000, 0.0, 0.0, 0.0)) for i in range(40)]
    out = G.generate_routes(members, edges, plans, SCORER).where("position > 0").toPandas()
    worked_out = (1 / out["plans_sharing"]).sum()
    assert worked_out == pytest.approx(round(worked_out)) and worked_out < 0.5 * len(out)
    alone = G.generate_routes(members, edges, plans, SCORER, plans_at_once=1).where("position > 0").toPandas()
    keys = ["weight_id", "position"]
    assert (out.sort_values(keys)["stop_id"].to_numpy() == alone.sort_values(keys)["stop_id"].to_numpy()).all()


def stop_travel(spark, n):
    """Times that follow from a number of each stop, none between odd stops."""
    stops = spark.range(n).selectExpr("'r' AS route_id", "concat('s', id) AS stop_id", "CAST(id AS DOUBLE) AS x")
    odd = lambda s: s["x"] % 2 == 1
    return StopTravel(
        stops, spark.createDataFrame([("r", "a")], "route_id string, source string"), ("x",),
        lambda a, b, source: F.when(~(odd(a) & odd(b)), F.abs(a["x"] - b["x"]) + 1),
        lambda a, b, source: np.where(odd(a) & odd(b), np.nan, np.abs(a["x"] - b["x"]) + 1),
    )


def test_computed_travel_times_equal_listed_ones(spark):
    travel = stop_travel(spark, 12)
    left = travel.stops.select("route_id", F.col("stop_id").alias("from_stop"))
    pairs = left.join(travel.stops.select("route_id", F.col("stop_id").alias("to_stop")), "route_id")
    listed = with_times(pairs, travel, "travel_time").where("travel_time IS NOT NULL").withColumn("source", F.lit("a"))
    assert listed.count() == 12 * 11 - 6 * 5
    members = members_frame(spark, (12,))[0].withColumn("route_id", F.lit("r"))
    keys = ["method", "weight_id", "position"]
    one, two = (G.generate_routes(members, t, PLANS, SCORER).drop("plans_sharing").orderBy(*keys).toPandas() for t in (travel, listed))
    pd.testing.assert_frame_equal(one, two)
    asked = pairs.withColumn("s", F.when(F.col("from_stop") == "s3", "b").otherwise("a"))
    one, two = (with_times(asked, t, "t", source="s").orderBy("from_stop", "to_stop").toPandas() for t in (travel, listed))
    pd.testing.assert_frame_equal(one, two[one.columns])
    assert route_sources(travel).collect() == route_sources(listed).collect()


def test_far_negatives_of_a_long_route_have_travel_times(spark):
    n = 500
    travel = stop_travel(spark, n)
    even = travel.only(travel.sources)
    moves = spark.range(n - 1).selectExpr("'r' AS route_id", "concat('s', 2 * id) AS from_stop", "concat('s', 2 * id + 2) AS to_stop", "id AS position", "1L AS label")
    even = StopTravel(spark.range(n).selectExpr("'r' AS route_id", "concat('s', 2 * id) AS stop_id", "CAST(id AS DOUBLE) AS x"), travel.sources, ("x",), lambda a, b, s: F.abs(a["x"] - b["x"]), travel.row)
    stops = even.stops.select("route_id", "stop_id", F.lit("A").alias("zone_id"), F.lit("Dropoff").alias("type"), F.lit(0).cast("long").alias("is_station"), F.lit(1).cast("long").alias("is_dropoff"))
    packages = stops.limit(0).select("route_id", "stop_id", *[F.lit(0).cast("long").alias(c) for c in P.PACKAGE_COLUMNS])
    wanted = spark.createDataFrame([("r", "train", "High", n, "a")], "route_id string, split string, route_score string, number_of_stops long, source string")
    found = P.pairwise_samples(moves, even, stops, packages, wanted, negatives=5)
    counts = {r["position"]: r["count"] for r in found.where("label = 0").groupBy("position").count().collect()}
    assert all(counts.get(p, 0) == min(5, n - p - 2) for p in range(n - 1))
    far = found.where("label = 0").agg(F.max(F.abs(F.substring("candidate_stop", 2, 9).cast("int") / 2 - F.col("position")))).first()[0]
    assert far > 400


def test_route_metrics_of_the_driven_order(spark):
    members, edges = members_frame(spark)
    actual = members.select("route_id", "position", "stop_id")
    same = actual.withColumns({"method": F.lit("m"), "weight_id": F.lit("")})
    out = G.route_metrics(same, actual, edges, members.select("route_id", "stop_id", "zone")).toPandas()
    assert (out["lcs_similarity"] == 1).all() and (out["position_match_ratio"] == 1).all() and out["route_valid"].all()
    known = out.dropna(subset=["actual_total_travel_time"])
    assert (known["generated_total_travel_time"] == known["actual_total_travel_time"]).all()


def test_admission_reasons(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "route_id string")
    seq = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "route_id string, stop_id string")
    got = {r["route_id"]: r["sequence_status"] for r in G.sequence_admission(ids, seq).collect()}
    assert got == {"a": "ok", "b": "duplicate_stop_in_sequence", "c": "missing_or_short_sequence"}


def test_weight_grids(spark):
    assert WT.full_grid(spark, 0.1).count() == 1001
    assert WT.full_grid(spark, 0.05).count() == 10626
    with pytest.raises(ValueError):
        WT.full_grid(spark, 0.3)
    few = WT.weight_grid(spark, 0.05, 20).orderBy("weight_id").toPandas()
    assert len(few) == 20 and few["weight_id"].iloc[0] == "w000001"
    assert np.allclose(few.iloc[0][list(WEIGHTS)].astype(float), [0.35, 0.40, 0.15, 0.05, 0.05])
    assert np.allclose(few[list(WEIGHTS)].sum(axis=1), 1.0) and not few.duplicated(list(WEIGHTS)).any()
    assert WT.weight_grid(spark, 0.25).count() == 70


def test_model_scorers_agree_with_the_models(spark):
    rng = np.random.default_rng(2)
    names = ["travel_time_ij", "same_zone", "route_progress"]
    x = np.round(rng.random((400, 3)), 3)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.random(400) > 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({**{n: x[:, i] for i, n in enumerate(names)}, "label": y}))
    for model_name in ML.MODEL_NAMES:
        model = ML.train(model_name, df, names, trees=5, depth=3)
        want = ML.score(model, df, names).toPandas()
        scorer = from_pipeline(model, names)
        got = scorer.probability({n: want[n].to_numpy() for n in names})
        assert np.allclose(got, want["predicted_probability"], atol=1e-6), model_name
    models, status = ML.train_all(["logistic_regression", "no_such_model"], df, names)
    assert list(models) == ["logistic_regression"]
    assert {r["status"] for r in status.collect()} == {"trained", "skipped"}


def test_feature_rules(spark):
    df = spark.createDataFrame([(1.0, "x")], "travel_time_ij double, route_score string")
    assert ML.feature_columns([df]) == ["travel_time_ij"]
    assert ML.serving_columns(["a", " ", "route_score", "a"]) == ["a"]
    served = ML.serving_frame(df, ["travel_time_ij", "absent"]).first()
    assert served["absent"] == 0.0
    weighted = ML.with_class_weights(spark.createDataFrame([(1,), (0,), (0,), (0,)], "label long")).collect()
    assert {(r["label"], r["class_weight"]) for r in weighted} == {(1, 2.0), (0, 4 / 6)}


def test_tail_probabilities():
    # Known values: t = 2.0 with 10 degrees of freedom; signed-rank 3 of 8 pairs.
    assert T.student_t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert T.student_t_tail(0.0, 5) == pytest.approx(1.0)
    assert T.wilcoxon_tail(3.0, 8, 0, 0.0, False) == pytest.approx(0.0390625)
    assert T.wilcoxon_tail(0.0, 0, 3, 0.0, True) == 1.0


def test_paired_tests_table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for split in ("validation", "test"):
        for i in range(60):
            base = rng.random()
            rows += [(split, f"r{i}", G.BEST_LABEL, base + 0.2 + 0.05 * rng.random()), (split, f"r{i}", G.NEAREST, base)]
    df = spark.createDataFrame(rows, "split string, route_id string, method string, lcs_similarity double")
    out = T.paired_tests(df, [(G.BEST_LABEL, G.NEAREST)], iterations=300).toPandas().set_index("split")
    assert set(out.index) == {"validation", "test", "all_splits"}
    assert out.loc["all_splits", "n_pairs"] == 120
    assert (out["preferred_method_by_mean"] == G.BEST_LABEL).all() and out["paired_t_significant"].all()
    assert (out["bootstrap_ci_low"] < out["mean_improvement"]).all() and (out["mean_improvement"] < out["bootstrap_ci_high"]).all()
    width = out.loc["test", "bootstrap_ci_high"] - out.loc["test", "bootstrap_ci_low"]
    values = np.array([r[3] for r in rows if r[0] == "test"]).reshape(-1, 2)
    assert width == pytest.approx(3.92 * (values[:, 0] - values[:, 1]).std(ddof=1) / np.sqrt(60), rel=0.3)
    again = T.bootstrap_intervals(T.paired_values(df.repartition(7), [(G.BEST_LABEL, G.NEAREST)], ["lcs_similarity"]), 300).toPandas()
    assert np.allclose(sorted(again["bootstrap_ci_low"]), sorted(out.loc[["validation", "test"], "bootstrap_ci_low"]))
    with pytest.raises(ValueError):
        T.parse_comparison("only_one")


def test_figures_of_walked_routes_equal_those_of_their_steps(spark):
    """Routes of several lengths walk together; their figures are those that route_metrics finds on the listed steps."""
    members, edges = members_frame(spark, (9, 5, 2, 9, 14))
    actual, zones = members.select("route_id", "position", "stop_id"), members.select("route_id", "stop_id", "zone")
    keys = ["route_id", "method", "weight_id"]
    plans = [*PLANS, *[(G.HYBRID, f"v{i}", (0.2 + i / 20, 0.3, 0.2, 0.1, 0.2 - i / 50)) for i in range(7)]]
    stops = members.select("route_id", "stop_id", F.pmod(F.xxhash64("route_id", "stop_id"), F.lit(50)).cast("double").alias("x"))
    sources = members.select("route_id", F.lit("a").alias("source")).distinct()
    odd = lambda s: s["x"] % 2 == 1
    worked = StopTravel(
        stops, sources, ("x",), lambda a, b, s: F.when(~(odd(a) & odd(b)), F.abs(a["x"] - b["x"]) + 1),
        lambda a, b, s: np.where(odd(a) & odd(b), np.nan, np.abs(a["x"] - b["x"]) + 1),
    )
    for travel in (edges, worked):
        steps = G.generate_routes(members, travel, plans, SCORER, plans_at_once=4)
        want = G.route_metrics(steps, actual, travel, zones).orderBy(*keys).toPandas()
        got = G.generated_metrics(members, travel, plans, SCORER, actual, plans_at_once=4).orderBy(*keys).toPandas()
        assert len(got) == 5 * len(plans) and list(got.columns) == list(want.columns)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)
        alone = pd.concat([G.generate_routes(members.where(F.col("route_id") == f"r{r}"), travel, plans, SCORER, plans_at_once=4).toPandas() for r in range(5)])
        order = [*keys, "position"]
        pd.testing.assert_frame_equal(steps.toPandas().sort_values(order).reset_index(drop=True), alone.sort_values(order).reset_index(drop=True))


def test_lcs_of_sequences_cut_by_batches(spark):
    rng = np.random.default_rng(5)
    orders = {(f"k{i}" if i else None): rng.permutation(int(rng.integers(1, 12))) for i in range(20)}
    rows = [(k, i, int(v)) for k, p in orders.items() for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "key string, position long, actual_position long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = {r["key"]: r["lcs_length"] for r in G.lcs_lengths(df, ["key"]).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {k: len(G.patience_tile([], list(enumerate(p.tolist())))[0]) for k, p in orders.items()}


def test_drawn_rows_are_shuffled_once(spark):
    """Where times follow from the stops, the drawn pairs meet their candidates and nothing else; rows equal those with listed times."""
    n = 40
    travel = stop_travel(spark, n)
    moves = spark.range(n - 1).selectExpr("'r' AS route_id", "concat('s', id) AS from_stop", "concat('s', id + 1) AS to_stop", "id AS position", "1L AS label")
    stops = travel.stops.select("route_id", "stop_id", F.lit("A").alias("zone_id"), F.lit("Dropoff").alias("type"), F.lit(0).cast("long").alias("is_station"), F.lit(1).cast("long").alias("is_dropoff"))
    packages = stops.limit(0).select("route_id", "stop_id", *[F.lit(0).cast("long").alias(c) for c in P.PACKAGE_COLUMNS])
    wanted = spark.createDataFrame([("r", "train", "High", n, "a"), ("q", "train", "High", n, "b")], "route_id string, split string, route_score string, number_of_stops long, source string")
    left = travel.stops.select("route_id", F.col("stop_id").alias("from_stop"))
    pairs = left.join(travel.stops.select("route_id", F.col("stop_id").alias("to_stop")), "route_id")
    listed = with_times(pairs, travel, "travel_time").where("travel_time IS NOT NULL").withColumn("source", F.lit("a"))
    made = P.candidate_rows(moves, travel, stops, packages, wanted)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan[: plan.index("Generate explode")].count("Join ") == 1
    keys = ["route_id", "position", "negative_sample_rank"]
    one, two = (P.candidate_rows(moves, t, stops, packages, wanted).orderBy(*keys).toPandas() for t in (travel, listed))
    assert one["travel_time_ij"].isna().any() and len(one) > 5 * (n - 6)
    pd.testing.assert_frame_equal(one, two)
