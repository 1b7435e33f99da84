from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from paywake.operators import rollups as roll
from paywake.operators import sessions as ses
from tests import samples
from tests.samples import attempt, frame


@pytest.fixture(scope="module")
def sessions(spark):
    return ses.build_sessions(frame(spark, samples.SESSION_ROWS)).cache()


def test_merchant_metrics_of_the_sample(sessions):
    row = roll.merchant_metrics(sessions).first()
    assert [row[c] for c in roll.COUNTS] == [10, 9, 1, 7, 3, 2, 2, 7]
    assert row["successful_volume"] == 7e6 and row["aov"] == 1e6
    assert row["unrecovered_volume"] == 1e6  # s3; s5 has no amount
    assert row["final_success_rate"] == 7 / 9
    assert row["recovery_rate"] == 2 / 6
    assert row["retry_rate"] == 7 / 9
    assert row["no_attempt_rate"] == 1 / 10


def test_rates_are_null_without_attempts(spark):
    rows = [attempt("a", 0, None, None, None)]
    row = roll.merchant_metrics(ses.build_sessions(frame(spark, rows))).first()
    assert row["sessions"] == 1 and row["no_attempt_rate"] == 1.0
    for name in ("final_success_rate", "first_attempt_success_rate", "recovery_rate", "retry_rate", "aov"):
        assert row[name] is None
    assert row["successful_volume"] == 0.0


def test_merchant_in_two_categories_is_one_row(spark):
    rows = [attempt("a", category_id="1", category_title="x"), attempt("b", category_id="2", category_title="a"),
            attempt("c", 1, "Paid", category_id=None)]
    row = roll.merchant_metrics(ses.build_sessions(frame(spark, rows))).collect()
    assert len(row) == 1
    assert (row[0]["category_id"], row[0]["category_title"], row[0]["sessions"]) == ("2", "x", 3)
    assert row[0]["aov"] == 1e6


def test_amount_edges_and_missing_amount(spark):
    amounts = [0.0, 999999.99, 1e6, 4999999.0, 5e6, 1e7, 4.9e7, 5e7, None]
    rows = [attempt(f"s{i}", amount=a) for i, a in enumerate(amounts)]
    metrics = roll.amount_metrics(ses.build_sessions(frame(spark, rows)))
    counts = {r["amount_bucket"]: (r["bucket_no"], r["sessions"]) for r in metrics.collect()}
    assert counts == {"0-1M": (1, 2), "1M-5M": (2, 2), "5M-10M": (3, 1), "10M-50M": (4, 2), "50M+": (5, 2)}
    shares = {r["amount_bucket"]: r["share"] for r in roll.amount_share(metrics).collect()}
    assert shares["50M+"] == 2 / 9 and sum(shares.values()) == pytest.approx(1)


def test_providers_need_an_attempt_and_a_code(sessions):
    metrics = {r["psp_code"]: r["sessions"] for r in roll.psp_metrics(sessions).collect()}
    assert metrics == {"P1": 4, "P2": 3, "P3": 1, "P9": 1}
    assert {r["psp_code"] for r in roll.psp_metrics(sessions, min_sessions=3).collect()} == {"P1", "P2"}
    ranked = roll.psp_ranking(roll.psp_metrics(sessions), k=2).orderBy("psp_rank").collect()
    assert [r["psp_code"] for r in ranked] == ["P2", "P3"]  # all at 1.0, by code


CALENDAR_DAYS = [datetime(2024, 1, 6, 0, 0), datetime(2024, 1, 7, 23, 59), datetime(2024, 1, 31, 12, 0),
                 datetime(2024, 2, 1, 0, 1), None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tehran"])
def test_calendar_does_not_depend_on_the_session_zone(spark, zone):
    rows = [attempt(f"s{i}", created_at=t) for i, t in enumerate(CALENDAR_DAYS)]
    built = ses.build_sessions(frame(spark, rows))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        weekdays = {r["weekday"]: r["sessions"] for r in roll.weekday_metrics(built).collect()}
        months = {r["month"]: r["sessions"] for r in roll.monthly_metrics(built).collect()}
        hours = {r["hour_of_day"] for r in roll.hourly_metrics(built).collect()}
        days = {r["metric_date"] for r in roll.daily_metrics(built).collect()}
        cells = {(r["weekday"], r["month"]) for r in roll.calendar_metrics(built).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert weekdays == {6: 1, 0: 1, 3: 1, 4: 1}  # Saturday 6, Sunday 0
    assert months == {1: 3, 2: 1} and hours == {0, 23, 12}
    assert days == {date(2024, 1, 6), date(2024, 1, 7), date(2024, 1, 31), date(2024, 2, 1)}
    assert cells == {(6, 1), (0, 1), (3, 1), (4, 2)}


def test_daily_series_oldest_or_newest(spark):
    rows = [attempt(f"s{i}", created_at=datetime(2024, 1, 1 + i)) for i in range(10)]
    daily = roll.daily_metrics(ses.build_sessions(frame(spark, rows)))
    assert [r["metric_date"].day for r in roll.daily_series(daily, 3).orderBy("day_no").collect()] == [1, 2, 3]
    newest = roll.daily_series(daily, 3, latest=True).orderBy("day_no").collect()
    assert [r["metric_date"].day for r in newest] == [10, 9, 8]


def test_shared_scan_gives_the_same_tables(spark, sessions):
    more = frame(spark, [attempt("x1", merchant_key="m2", category_id=None, created_at=None),
                         attempt("x2", merchant_key=None, psp=None), attempt("x3", 0, None, "", None)])
    both = ses.build_sessions(frame(spark, samples.SESSION_ROWS).unionByName(more))
    single = {
        "merchant_metrics": roll.merchant_metrics(both),
        "merchant_daily_metrics": roll.daily_metrics(both),
        "merchant_hourly_metrics": roll.hourly_metrics(both),
        "merchant_amount_metrics": roll.amount_metrics(both),
        "merchant_psp_metrics": roll.psp_metrics(both),
    }
    shared = roll.roll_up_all(both)
    assert shared.keys() == single.keys()
    for name, df in single.items():
        assert shared[name].columns == df.columns
        assert sorted(map(str, shared[name].collect())) == sorted(map(str, df.collect())), name


def test_parts_add_up_to_the_merchant(sessions):
    whole = roll.merchant_metrics(sessions).first()
    for part in (roll.daily_metrics, roll.hourly_metrics, roll.amount_metrics):
        sums = part(sessions).agg(F.sum("sessions").alias("n"), F.sum("successful_volume").alias("v")).first()
        assert (sums["n"], sums["v"]) == (whole["sessions"], whole["successful_volume"])


def test_totals_of_nothing_are_zero(sessions):
    row = roll.session_totals(sessions.limit(0)).first()
    assert row["sessions"] == 0 and row["attempt_coverage"] == 0.0 and row["recovery_pct"] == 0.0


def test_search_treats_percent_as_wildcard_and_backslash_as_text(spark):
    rows = [attempt(str(i), merchant_key=k) for i, k in enumerate(["AbC", "a%c", "a\\c", "xyz"])]
    merchants = roll.merchant_metrics(ses.build_sessions(frame(spark, rows)))

    def found(text):
        return {r["merchant_key"] for r in roll.top_merchants(merchants, search=text).collect()}

    assert found("B") == {"AbC"}
    assert found("a%c") == {"AbC", "a%c", "a\\c"}
    assert found("A_C") == {"AbC", "a%c", "a\\c"}
    assert found("\\") == {"a\\c"}
    assert [r["merchant_key"] for r in roll.top_merchants(merchants, n=2).collect()] == ["AbC", "a%c"]


def test_rollups_use_hash_aggregation(spark, sessions, tmp_path):
    sessions.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    plan = roll.daily_metrics(stored)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1
    # the category fold is the only sort, over one row per merchant and category
    plan = roll.merchant_metrics(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("HashAggregate")
    one = roll.daily_metrics(stored).where("merchant_key = 'm1'")
    assert "EqualTo(merchant_key,m1)" in one._jdf.queryExecution().executedPlan().toString()


def test_calendars_fold_one_scan_of_the_sessions(spark, tmp_path, monkeypatch):
    """Days are added up once; months, weekdays and the calendar are folded from them."""
    rows = [attempt(f"s{k}", 1, ("Paid", "Failed")[k % 2], amount=float(k) if k % 5 else None,
                    created_at=datetime(2024, 1 + k % 3, 1 + k % 28) if k % 7 else None, merchant_key=f"m{k % 2}") for k in range(200)]
    ses.build_sessions(frame(spark, rows)).write.parquet(str(tmp_path / "stored_sessions"))
    sessions = spark.read.parquet(str(tmp_path / "stored_sessions"))
    written = []
    real = roll.materialize
    monkeypatch.setattr(roll, "materialize", lambda df, name: written.append(df) or real(df, name))
    folded = roll.seasonality(sessions)
    assert len(written) == 1
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in folded.items()}
    assert not any("final_success" in plan for plan in plans.values())      # no session is read again
    alone = {"daily": roll.daily_metrics, "monthly_lost": lambda s: roll.monthly_metrics(s, lost=True), "monthly": roll.monthly_metrics,
             "weekday": roll.weekday_metrics, "calendar": roll.calendar_metrics}
    assert set(alone) == set(folded)
    for name, build in alone.items():
        other = build(sessions)
        assert folded[name].columns == other.columns
        assert sorted(map(str, folded[name].collect())) == sorted(map(str, other.collect()))
