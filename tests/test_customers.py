import random
from datetime import datetime

import pytest

from paywake.operators import customers as cust
from paywake.operators import rollups as roll
from paywake.operators import sessions as ses
from tests import samples
from tests.samples import attempt, frame


def orders(card, count, day=1, **more):
    return [attempt(f"{card}-{i}", 1, "Paid", payer_card_key=card,
                    created_at=datetime(2024, 1, day + i, 23, 59), **more) for i in range(count)]


ROWS = [
    *orders("one", 1), *orders("two", 2), *orders("four", 4), *orders("five", 5),
    attempt("fail", 1, "Failed", payer_card_key="none"),
    attempt("e1", 1, "Paid", payer_card_key=""), attempt("e2", 1, "Paid", payer_card_key=None),
    # two successes in one session
    attempt("double", 1, "Paid", payer_card_key="twice", amount=4e6),
    attempt("double", 2, "Verified", payer_card_key="twice", amount=3e6),
    attempt("m2s", 0, None, merchant_key="m2"),
]


@pytest.fixture(scope="module")
def attempts(spark):
    return frame(spark, ROWS).cache()


def profile_of(df):
    return {r["customer"]: r for r in df.collect()}


def test_profile_counts_sessions_and_adds_tries(attempts):
    got = profile_of(cust.customer_profile(attempts))
    assert set(got) == {"one", "two", "four", "five", "none", "twice"}
    assert (got["five"]["orders"], got["five"]["spend"]) == (5, 5e6)
    assert (got["none"]["orders"], got["none"]["all_orders"], got["none"]["spend"]) == (0, 1, None)
    assert (got["twice"]["orders"], got["twice"]["spend"]) == (1, 7e6)
    once = profile_of(cust.customer_profile(attempts, per_session=True))
    assert once["twice"]["spend"] == 4e6 and once["five"]["spend"] == 5e6


def test_summary_segments_and_zero_rows(attempts):
    profile = cust.customer_profile(attempts)
    row = cust.customer_summary(profile).first()
    assert (row["customers"], row["repeat_customers"]) == (5, 3)
    assert (row["vip"], row["loyal"], row["new_customers"]) == (1, 2, 2)
    assert row["repeat_rate"] == 60.0 and row["avg_orders"] == 13 / 5
    assert row["customer_spend"] == 19e6 and row["avg_purchase"] == 19e6 / 5
    every = cust.customer_summary_all(profile).first()
    assert (every["customers"], every["new_customers"]) == (6, 3)  # a failed session counts as an order
    segments = {r["segment"]: r["share"] for r in cust.customer_segments(cust.customer_summary(profile)).collect()}
    assert segments == {"vip": 0.2, "loyal": 0.4, "new_customers": 0.4}


def test_leaders(attempts):
    profile = cust.customer_profile(attempts)
    assert cust.top_customer_by_revenue(profile).first()["customer"] == "twice"
    assert cust.top_customer_by_orders(profile).first()["customer"] == "five"
    largest = cust.top_order_by_amount(attempts).first()
    assert (largest["customer"], largest["session_key"], largest["amount"]) == ("twice", "double", 4e6)
    tenure = cust.longest_tenure_customer(profile).first()
    assert (tenure["customer"], tenure["tenure_days"], tenure["orders"]) == ("five", 4, 5)
    newest = cust.newest_customer(profile).first()
    assert newest["customer"] == "twice" and newest["date"] == datetime(2024, 1, 7, 23, 0)


def test_ties_go_to_the_smaller_key_and_days_are_calendar_days(spark):
    rows = [attempt("a1", 1, "Paid", payer_card_key="B", created_at=datetime(2024, 1, 1, 23, 59)),
            attempt("a2", 1, "Paid", payer_card_key="B", created_at=datetime(2024, 1, 2, 0, 1)),
            attempt("b1", 1, "Paid", payer_card_key="A", amount=2e6, created_at=None)]
    profile = cust.customer_profile(frame(spark, rows))
    assert cust.top_customer_by_revenue(profile).first()["customer"] == "A"
    assert cust.longest_tenure_customer(profile).first()["tenure_days"] == 1
    assert cust.newest_customer(profile).first()["customer"] == "B"  # an unknown date is not the newest


def test_bundle(attempts):
    merchants = roll.merchant_metrics(ses.build_sessions(attempts))
    got = {r["merchant_key"]: r for r in cust.customer_analytics(attempts, merchants).collect()}
    assert got["m1"]["top_customer_by_orders"]["orders"] == 5
    assert got["m1"]["top_order_by_amount"]["session_key"] == "double"
    assert got["m2"]["customers"] == 0 and got["m2"]["avg_orders"] == 0.0
    assert got["m2"]["newest_customer"] is None
    assert cust.customer_analytics(attempts).count() == 1


def test_leaders_are_found_from_numbers_and_ties(spark, tmp_path, monkeypatch):
    """One scan of the attempts, hash aggregation only, and windows that keep one row per merchant in each map task."""
    frame(spark, samples.SESSION_ROWS).write.parquet(str(tmp_path / "attempts"))
    attempts = spark.read.parquet(str(tmp_path / "attempts"))
    written = []
    real = cust.materialize

    def watched(df, name):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(cust, "materialize", watched)
    final = cust.customer_analytics(attempts)._jdf.queryExecution().executedPlan().toString()
    plans = [*written, final]
    assert sum(plan.count("terminal_key") + plan.count(f"{tmp_path}/attempts"[:40]) > 0 for plan in plans) == 1
    assert not any("SortAggregate" in plan or "Expand" in plan for plan in plans)
    for window in final.split("- Window [")[1:]:
        assert "Final" in window.split("Exchange")[0] and "WindowGroupLimit" in window.split("Exchange")[1]


def test_ties_of_leaders(spark):
    """Equal numbers, missing amounts and merchants where everybody ties, against sorted rows."""
    rng = random.Random(2)
    rows = [attempt(f"s{k}", 1, rng.choice(["Paid", "Failed"]), payer_card_key=f"c{rng.randrange(12)}", merchant_key=f"m{k % 3}",
                    amount=rng.choice([None, 5.0, 7.0]), created_at=datetime(2024, 1, 1 + rng.randrange(4))) for k in range(400)]
    rows += [attempt(f"t{k}", 1, "Paid", payer_card_key=f"d{k:03}", merchant_key="even", amount=None) for k in range(50)]
    attempts = frame(spark, rows).repartition(4)
    got = {r["merchant_key"]: r for r in cust.customer_analytics(attempts).collect()}
    for merchant in {r["merchant_key"] for r in rows}:
        paid = [r for r in rows if r["merchant_key"] == merchant and r["try_status"] == "Paid"]
        by = {}
        for r in paid:
            by.setdefault(r["payer_card_key"], []).append(r)

        def spend(c):
            known = [r["amount"] for r in by[c] if r["amount"] is not None]
            return sum(known) if known else None

        revenue = min(by, key=lambda c: (spend(c) is None, -(spend(c) or 0), c))
        orders = min(by, key=lambda c: (-len(by[c]), c))
        newest = max(by, key=lambda c: (min(r["created_at"] for r in by[c]), c))
        largest = max(paid, key=lambda r: (r["amount"] is not None, r["amount"] or 0, r["created_at"], r["session_key"], r["payer_card_key"]))
        row = got[merchant]
        assert (row["top_customer_by_revenue"]["customer"], row["top_customer_by_revenue"]["amount"]) == (revenue, spend(revenue))
        assert (row["top_customer_by_orders"]["customer"], row["top_customer_by_orders"]["orders"]) == (orders, len(by[orders]))
        assert row["newest_customer"]["customer"] == newest
        assert (row["top_order_by_amount"]["session_key"], row["top_order_by_amount"]["amount"]) == (largest["session_key"], largest["amount"])
    assert got["even"]["top_customer_by_orders"]["customer"] == "d000" and got["even"]["longest_tenure_customer"] is None
