import random

import pytest
from pyspark.sql import functions as F

from paywake.operators import insights as ins
from paywake.operators import peers as peer
from paywake.operators import scores
from paywake.plans.positions import page_of_group, select_intervals, split_positions
from paywake.plans.value_counts import value_bin, value_counts

COLUMNS = ("merchant_key string, category_id string, category_title string, sessions long, "
           "attempted_sessions long, no_attempt_sessions long, successful_sessions long, "
           "first_success_sessions long, recovered_sessions long, unrecovered_sessions long, "
           "retried_sessions long, successful_volume double, successful_fee double, "
           "unrecovered_volume double, recovered_volume double, aov double, final_success_rate double, "
           "first_attempt_success_rate double, recovery_rate double, retry_rate double, "
           "no_attempt_rate double, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
NAMES = [part.split()[0] for part in COLUMNS.split(", ")]


def merchant(key, category="c", **values):
    row = dict.fromkeys(NAMES)
    row.update(merchant_key=key, category_id=category, sessions=100, attempted_sessions=100,
               successful_volume=1.0, **values)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def merchants(spark):
    rows = []
    for i in range(11):
        rows.append(merchant(f"m{i:02}", final_success_rate=i // 2 / 10, recovery_rate=0.5, aov=float(-i)))
        rows[-1]["successful_volume"] = 10.0 ** i
    rows.append(merchant("m11"))  # all rates NULL
    rows.append(merchant("alone", "d", final_success_rate=0.9))
    rows.append(merchant("stray", None, final_success_rate=0.1))
    rows.append(merchant("stray2", None, final_success_rate=0.2))
    return frame(spark, rows)


def percentiles(df):
    return {r["merchant_key"]: tuple(r[c] for c in peer.PERCENTILES.values()) for r in df.collect()}


@pytest.mark.parametrize("split", [False, True])
def test_percentiles_ties_nulls_and_single_peers(merchants, split):
    got = percentiles(peer.peer_metrics(merchants, split=split))
    assert len(got) == 15
    assert got["m00"][0] == got["m01"][0] == 0.0
    assert got["m02"][0] == got["m03"][0] == 2 / 11
    assert got["m11"][0] == 1.0 and got["m11"][1] == 1.0  # NULL ranks last
    assert {got[f"m{i:02}"][1] for i in range(11)} == {0.0}  # all tied
    assert got["m10"][2] == 0.0 and got["m00"][2] == 10 / 11
    assert got["alone"] == (0.0, 0.0, 0.0, 0.0)
    assert got["stray"][0] == 0.0 and got["stray2"][0] == 1.0  # NULL is a category


@pytest.mark.parametrize("band", [False, True])
def test_split_equals_window(merchants, band):
    window = peer.peer_metrics(merchants, band=band, min_peers=2)
    split = peer.peer_metrics(merchants, band=band, min_peers=2, split=True)
    assert window.columns == split.columns
    assert sorted(map(str, window.collect())) == sorted(map(str, split.collect()))


def test_bands_and_small_groups(merchants):
    banded = peer.peer_metrics(merchants, band=True, min_peers=2)
    rows = {r["merchant_key"]: r for r in banded.collect()}
    assert rows["m07"]["volume_band"] == 0 and rows["m08"]["volume_band"] == 1
    assert rows["m08"]["success_rate_percentile"] is None  # alone in its band
    assert rows["m10"]["volume_band"] == 3
    assert rows["m07"]["success_rate_percentile"] is not None


@pytest.mark.parametrize("split", [False, True])
def test_rank_and_median(merchants, split):
    ranks = {r["merchant_key"]: (r["peer_rank"], r["peer_count"])
             for r in peer.peer_rank(merchants, split=split).collect()}
    assert ranks["m10"] == (1, 12) and ranks["m08"] == (2, 12) and ranks["m09"] == (3, 12)
    assert ranks["m11"] == (12, 12)  # NULL counts as 0, ties by key
    assert ranks["alone"] == (1, 1)
    rows = {r["merchant_key"]: r for r in peer.peer_median(merchants).collect()}
    assert rows["m00"]["peer_median"] == 0.2 and rows["m00"]["peers"] == 11
    assert rows["stray"]["peer_median"] == pytest.approx(0.15)
    assert rows["m11"]["gap_to_median"] is None
    assert len(rows) == 15


def test_value_counts_of_a_hot_value_and_odd_numbers(spark):
    """Ranks and medians from counts equal those of sorted rows: ties, signs, zeros, NaN, infinities and NULL."""
    rng = random.Random(3)
    odd = [0.0, -0.0, float("nan"), float("inf"), float("-inf"), None, 5e-324, -5e-324, 1.7e308, 1.0, -1.0]
    rows = [("hot", 0.25 if rng.random() < 0.4 else rng.choice([*odd, rng.uniform(-9, 9)])) for _ in range(3000)]
    rows += [(None, float(k % 5)) for k in range(30)] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for r in value_counts(df, ["g"], "v").collect():
        own = [v for g, v in rows if g == r["g"]]
        place = lambda v: (2, 0) if v is None else (1, 0) if v != v else (0, v)
        assert r["size"] == len(own)
        assert r["lower"] == sum(place(v) < place(r["v"]) for v in own)
        assert r["rows"] == sum(place(v) == place(r["v"]) for v in own)
    plan = value_counts(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.index("partial_count") > 0


def test_value_bins_never_fall(spark):
    values = sorted([0.0, 1e-320, 1e300, *(2.0 ** k for k in range(-1000, 1000, 37)), *(1 + k / 997 for k in range(997))])
    values = sorted({*values, *(-v for v in values)})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = df.select("v", value_bin(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(found, found[1:]))
    assert len({r["b"] for r in found if 1 <= r["v"] < 2}) == 64


def test_peer_table(merchants):
    peers = peer.peer_metrics(merchants)
    listed = peer.peer_table(peers, k=3).where("category_id = 'c'").orderBy("peer_no").collect()
    assert [r["merchant_key"] for r in listed] == ["m10", "m08", "m09"]
    asked = peer.peer_table(peers, k=3, members=merchants.where("merchant_key IN ('m00', 'alone')"))
    assert {(r["member_key"], r["merchant_key"]) for r in asked.collect()} == {
        ("m00", "m10"), ("m00", "m08"), ("m00", "m09"), ("alone", "alone")}


def test_split_positions_over_many_partitions(spark):
    rows = [("hot", random.choice([1.0, 1.0, 2.0, None]), i) for i in range(3000)]
    rows += [(f"g{i % 50}", float(i % 7), 5000 + i) for i in range(500)] + [(None, 1.0, 9000), (None, 1.0, 9001)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(7)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = split_positions(df, ["g"], order, "n", "size").collect()
    expected = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        expected.update({r[2]: (n, len(own)) for n, r in enumerate(own, 1)})
    assert {r["id"]: (r["n"], r["size"]) for r in got} == expected


def test_deep_page_equals_shallow_pages(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id"))
    order = [F.col("id").desc()]
    deep = page_of_group(df, ["g"], order, limit=1500, offset=600)
    ids = [r["id"] for r in deep.where("g = 0").orderBy("row_no").collect()]
    assert len(ids) == 1500 and ids[0] == 4998 - 2 * 600
    shallow = page_of_group(df, ["g"], order, limit=10, offset=600).where("g = 0").orderBy("row_no")
    assert [r["id"] for r in shallow.collect()] == ids[:10]


def test_deep_page_reads_the_intervals_it_touches(spark):
    """Ties, a hot interval, missing values and pages beyond the end, against sorted rows."""
    rng = random.Random(8)
    rows = [(("hot", "b", None)[min(k % 7, 2)], rng.choice([None, 5.0, 5.0, 5.0, rng.uniform(0, 100)]), k) for k in range(9000)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    interval = F.when(F.col("v").isNull(), value_bin(F.col("v"))).otherwise(-value_bin(F.col("v")))
    for limit, offset in ((700, 600), (3000, 0), (50, 4000), (10, 9_500)):
        got = {}
        for r in page_of_group(df, ["g"], order, limit, offset, interval=interval).orderBy("row_no").collect():
            got.setdefault(r["g"], []).append((r["row_no"], r["id"]))
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
            assert got.get(g, []) == [(n + 1, r[2]) for n, r in enumerate(own)][offset:offset + limit]
    near = select_intervals(df, ["g"], interval, 50, 4000, "before")
    assert near.where("g = 'hot'").count() < 400 and near.select("before").distinct().count() <= 3


def test_shallow_page_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id"))
    plan = page_of_group(df, ["g"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")  # printed below the exchange


def test_window_percentiles_use_one_exchange(spark, merchants, tmp_path):
    merchants.write.parquet(str(tmp_path / "m"))
    plan = peer.peer_metrics(spark.read.parquet(str(tmp_path / "m")), split=False)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange") == 1


def rule_frame(spark, rows):
    base = frame(spark, rows)
    return base.withColumn("success_rate_percentile", F.col("recovery_rate")).withColumns(
        {c: F.lit(None).cast("double") for c in
         ("recovery_rate_percentile", "aov_percentile", "volume_percentile")})


def test_thresholds_of_every_rule(spark):
    rows = [
        {**merchant("few"), "attempted_sessions": 99, "first_attempt_success_rate": 0.1,
         "unrecovered_volume": 5e9, "recovery_rate": 0.1, "retry_rate": 0.5},
        {**merchant("edge"), "first_attempt_success_rate": 0.40, "unrecovered_volume": 2.5e8,
         "recovery_rate": 0.25, "retry_rate": 0.10, "no_attempt_rate": 0.10},
        {**merchant("over"), "first_attempt_success_rate": 0.50, "unrecovered_volume": 1e9,
         "recovery_rate": 0.50, "retry_rate": 0.0999, "no_attempt_rate": 0.0999},
        {**merchant("low"), "first_attempt_success_rate": 0.39999, "unrecovered_volume": 1.0,
         "recovery_rate": 0.2499, "no_attempt_rate": 0.2, "sessions": 99},
        {**merchant("zero"), "unrecovered_volume": 0.0},
        {**merchant("huge"), "unrecovered_volume": 1.23456789e15},
    ]
    found = ins.build_insights(rule_frame(spark, rows))
    got = {(r["merchant_key"], r["insight_type"]): r["severity"] for r in found.collect()}
    assert got == {
        ("edge", "FIRST_ATTEMPT_GAP"): "warning", ("low", "FIRST_ATTEMPT_GAP"): "critical",
        ("edge", "RECOVERY_OPPORTUNITY"): "warning", ("over", "RECOVERY_OPPORTUNITY"): "critical",
        ("low", "RECOVERY_OPPORTUNITY"): "info", ("huge", "RECOVERY_OPPORTUNITY"): "critical",
        ("edge", "PEER_SUCCESS_GAP"): "warning", ("low", "PEER_SUCCESS_GAP"): "critical",
        ("edge", "HIGH_RETRY"): "warning", ("edge", "NO_ATTEMPT"): "info",
    }
    summary = {r["merchant_key"]: r["summary"] for r in
               found.where("insight_type = 'RECOVERY_OPPORTUNITY'").collect()}
    assert "1234567890.0 million" in summary["huge"]  # no exponent
    peer_text = found.where("insight_type = 'PEER_SUCCESS_GAP' AND merchant_key = 'edge'").first()
    assert "percentile = 25 of 100" in peer_text["summary"] and peer_text["source_table"] == "peer_metrics"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan


def test_evidence_order_detail_and_audit(spark):
    rows = [{**merchant("a"), "first_attempt_success_rate": 0.3, "unrecovered_volume": 3e8,
             "recovery_rate": 0.1, "retry_rate": 0.2, "no_attempt_rate": 0.2, "category_title": "t"},
            {**merchant("b"), "unrecovered_volume": 2e9}]
    peers, method = rule_frame(spark, rows), ins.methodology(spark)
    found = ins.build_insights(peers)
    evidence = ins.insight_evidence(found, peers, method)
    assert len(evidence.columns) == 35 and evidence.count() == found.count() == 6
    order = [r["insight_type"] for r in
             ins.rank_insights(evidence).where("merchant_key = 'a'").orderBy("insight_no").collect()]
    assert order == ["FIRST_ATTEMPT_GAP", "PEER_SUCCESS_GAP", "RECOVERY_OPPORTUNITY", "HIGH_RETRY", "NO_ATTEMPT"]
    assert ins.rank_insights(evidence, severity="warning").count() == 2
    assert ins.rank_insights(evidence, k=1).count() == 2
    assert ins.top_insight(evidence).first()["merchant_key"] == "b"
    detail = ins.insight_detail(evidence, method).where("merchant_key = 'b'").first()
    assert detail["method_formula"] == detail["formula"] == "sum of session amount"
    checks = {r["insight_type"]: r for r in ins.traceability_checks(evidence).collect()}
    total = checks["RECOVERY_OPPORTUNITY"]
    assert total["total_unrecovered_volume"] == total["total_metric_value"] == 2.3e9
    assert {r["mismatches"] for r in checks.values()} == {0}
    assert method.count() == 5


def test_health_score_bounds_and_states(spark):
    rows = [
        {**merchant("best"), "final_success_rate": 1.0, "recovery_rate": 1.0, "retry_rate": 0.0,
         "no_attempt_rate": 0.0, "attempted_sessions": 5},
        {**merchant("good"), "final_success_rate": 0.85, "recovery_rate": 0.0, "retry_rate": 0.2,
         "no_attempt_rate": 0.1},
        {**merchant("null")},
    ]
    got = {r["merchant_key"]: r for r in scores.health_scores(rule_frame(spark, rows)).collect()}
    assert (got["best"]["score"], got["best"]["status"]) == (100.0, "excellent")
    assert (got["good"]["score"], got["good"]["status"]) == (76.5, "good")
    # missing retry and no-attempt rates count as 0, which earns their points
    assert (got["null"]["score"], got["null"]["status"]) == (20.0, "needs attention")
    assert got["null"]["percentile"] == 0.0
    gap = scores.kpi_row(frame(spark, [{**merchant("x"), "final_success_rate": 0.75,
                                        "first_attempt_success_rate": 0.5}])).first()
    assert gap["success_gap_points"] == 25.0
