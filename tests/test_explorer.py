from datetime import datetime

import pytest

from paywake.operators import explorer
from paywake.operators import sessions as ses
from tests import samples
from tests.samples import attempt, frame


@pytest.fixture(scope="module")
def attempts(spark):
    return frame(spark, samples.SESSION_ROWS).cache()


@pytest.fixture(scope="module")
def sessions(attempts):
    return ses.build_sessions(attempts).cache()


def keys(df):
    return {r["session_key"] for r in df.collect()}


@pytest.mark.parametrize("status, expected", [
    ("success", {"s1", "s2", "s6", "s7", "s8", "s9", "s10"}),
    ("failed", {"s3", "s5"}),
    ("recovered", {"s2", "s9"}),
    ("retry", {"s2", "s3", "s6", "s7", "s8", "s9", "s10"}),
    ("no_attempt", {"s4"}),
    ("nonsense", {f"s{i}" for i in range(1, 11)}),
    (None, {f"s{i}" for i in range(1, 11)}),
])
def test_status_words(sessions, status, expected):
    assert keys(explorer.session_filter(sessions, status=status)) == expected


def test_other_filters(spark, sessions):
    assert keys(explorer.session_filter(sessions, search="S1")) == {"s1", "s10"}
    assert keys(explorer.session_filter(sessions, psp="P2")) == {"s2", "s6", "s8"}
    assert keys(explorer.session_filter(sessions, min_amount=1e6, max_amount=1e6, min_attempts=2, psp="P1")) == {
        "s3", "s7"}
    assert keys(explorer.session_filter(sessions, merchant_key="other")) == set()
    assert keys(explorer.session_filter(sessions, date_to="2024-01-07")) == set()  # the day itself is out
    assert len(keys(explorer.session_filter(sessions, date_from="2024-01-07", date_to="2024-01-08"))) == 10


def test_pages_and_totals(spark):
    rows = [attempt(f"a{i:02}", created_at=datetime(2024, 1, 1 + i)) for i in range(7)]
    rows += [attempt("late", created_at=None), attempt("b", merchant_key="m2")]
    built = ses.build_sessions(frame(spark, rows))
    first = explorer.session_page(built, limit=3).where("merchant_key = 'm1'").orderBy("row_no").collect()
    assert [r["session_key"] for r in first] == ["a06", "a05", "a04"]
    assert {r["total"] for r in first} == {8}
    last = explorer.session_page(built, limit=3, offset=6).orderBy("row_no").collect()
    assert [r["session_key"] for r in last] == ["a00", "late"]
    assert explorer.session_page(built, limit=5000).count() == 9


def test_sessions_behind_insights(spark):
    rows = [attempt(f"f{i}", amount=float(i)) for i in range(5)]
    rows += [attempt(f"r{i}", n, "Failed", amount=9.0) for i in range(3) for n in range(1, i + 3)]
    rows += [attempt("open", 0, None, None, None, created_at=datetime(2025, 1, 1))]
    built = ses.build_sessions(frame(spark, rows))
    types = ["RECOVERY_OPPORTUNITY", "NO_ATTEMPT", "HIGH_RETRY", "PEER_SUCCESS_GAP", "FIRST_ATTEMPT_GAP"]
    asked = spark.createDataFrame([("m1", t) for t in types] + [("m9", "HIGH_RETRY")],
                                  "merchant_key string, insight_type string")
    got = {}
    for r in explorer.insight_sessions(asked, built, limit=4).orderBy("row_no").collect():
        got.setdefault(r["insight_type"], []).append(r["session_key"])
    assert got["RECOVERY_OPPORTUNITY"] == ["r0", "r1", "r2", "f4"]
    assert got["NO_ATTEMPT"] == ["open"]
    assert got["HIGH_RETRY"] == ["r2", "r1", "r0"]
    assert got["PEER_SUCCESS_GAP"] == got["FIRST_ATTEMPT_GAP"] == ["open", "f0", "f1", "f2"]


def test_detail_of_one_session(sessions, attempts):
    detail = explorer.session_detail(sessions, attempts, "s8")
    assert detail["session"].first()["first_try_status"] == "Paid"
    assert [r["try_status"] for r in detail["attempts"].collect()] == ["Paid", "Failed"]


def test_timeline(sessions, attempts):
    lines = explorer.session_timeline(sessions, attempts)
    assert lines.count() == len(samples.SESSION_ROWS)
    opened = lines.where("session_key = 's4'").first()
    assert (opened["state"], opened["psp"], opened["status"], opened["response"]) == (
        "in progress", "No PSP", "NoAttempt", "no response code")
    assert opened["happened_at"] == samples.CREATED
    assert {r["state"] for r in lines.where("session_key IN ('s2')").collect()} == {"success"}
    assert lines.where("session_key = 's3'").first()["state"] == "lost"
    assert lines.where("session_key = 's9' AND try_seq = 2").first()["psp"] == "No PSP"


def test_only_asked_listings_are_sorted(spark, sessions):
    """Sessions meet the asked merchants and listings below the window; each row knows how many there are."""
    asked = spark.createDataFrame([("m1", "NO_ATTEMPT"), ("m9", "HIGH_RETRY")], "merchant_key string, insight_type string")
    found = explorer.insight_sessions(asked, sessions)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")        # printed above it
    assert [(r["session_key"], r["total"]) for r in found.collect()] == [("s4", 1)]
    newest = explorer.insight_sessions(asked.selectExpr("merchant_key", "'PEER_SUCCESS_GAP' AS insight_type"), sessions, limit=3, offset=8)
    assert [r["row_no"] for r in newest.orderBy("row_no").collect()] == [9, 10] and {r["total"] for r in newest.collect()} == {10}


def test_deep_pages_of_insights_and_categories(spark):
    rows = [attempt(f"s{k:04}", 1, "Failed", amount=float(k % 50), created_at=datetime(2024, 1, 1 + k % 20), merchant_key="m1") for k in range(1500)]
    built = ses.build_sessions(frame(spark, rows)).cache()
    asked = spark.createDataFrame([("m1", "RECOVERY_OPPORTUNITY"), ("m1", "FIRST_ATTEMPT_GAP")], "merchant_key string, insight_type string")
    got = {}
    for r in explorer.insight_sessions(asked, built, limit=100, offset=1000).orderBy("row_no").collect():
        got.setdefault(r["insight_type"], []).append(r["session_key"])
    by_amount = sorted(rows, key=lambda r: (-r["amount"], r["session_key"]))[1000:1100]
    by_time = sorted(rows, key=lambda r: (-r["created_at"].timestamp(), r["session_key"]))[1000:1100]
    assert got == {"RECOVERY_OPPORTUNITY": [r["session_key"] for r in by_amount], "FIRST_ATTEMPT_GAP": [r["session_key"] for r in by_time]}
    page = explorer.session_page(built, limit=50, offset=1200, by="category_id").orderBy("row_no").collect()
    assert [r["session_key"] for r in page] == [r["session_key"] for r in sorted(
        rows, key=lambda r: (-r["created_at"].timestamp(), r["session_key"]))[1200:1250]]
