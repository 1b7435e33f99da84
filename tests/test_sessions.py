import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paywake.operators import sessions as ses
from tests import samples
from tests.samples import attempt, frame


def by_key(df, columns):
    return {r["session_key"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("small, codes", [(False, None), (True, None), (False, ["P3", "P1", "P2", "P9", "P1"])])
def test_flags_of_every_rule(spark, small, codes):
    built = ses.build_sessions(frame(spark, samples.SESSION_ROWS), small=small, codes=codes)
    assert by_key(built, samples.EXPECTED_COLUMNS) == samples.EXPECTED


def test_session_amount_counts_once_and_times_span_real_tries(spark):
    rows = [attempt("a", 1, amount=5.0), attempt("a", 2, "Paid", "P1", 9, amount=7.0),
            attempt("a", 0, None, None, 30, amount=6.0)]
    row = ses.build_sessions(frame(spark, rows)).first()
    assert row["amount"] == 7.0
    assert (row["first_attempt_at"].minute, row["last_attempt_at"].minute) == (1, 9)


def test_bitmaps_of_many_provider_codes(spark):
    """301 codes fill five bitmaps; the empty code, NULL and sessions that were only opened count as none."""
    rows = [attempt(f"s{k % 7}", 1 + k % 3, psp=f"É{k % 300}" if k % 2 else f"P{k % 300:03}") for k in range(900)]
    rows += [attempt("s0", 2, psp=""), attempt("s0", 2, psp=None), attempt("open", 0, None, "P001", None)]
    attempts = frame(spark, rows).repartition(5)
    codes = ses.provider_codes(attempts)
    assert len(codes) == 301 and codes == sorted(codes)
    built = ses.build_sessions(attempts, codes=codes)
    expected = {key: len({r["psp_code"] for r in rows if r["session_key"] == key and r["try_seq"] and r["psp_code"]})
                for key in {r["session_key"] for r in rows}}
    assert {k: v[0] for k, v in by_key(built, ["psp_count"]).items()} == expected
    assert by_key(ses.build_sessions(attempts), ["psp_count"]) == by_key(built, ["psp_count"])
    assert ses.build_sessions(attempts, codes=[]).agg(F.sum("psp_count")).first()[0] == 0


def test_latest_terminal_state(spark):
    rows = [attempt("a", 1, "Verified", "P9", 1, session_status="Verified"),
            attempt("a", 2, "Failed", "P1", 2, session_status="Failed"),
            attempt("b", 0, None, None, None, session_status="InBank")]
    columns = ["session_status", "last_attempt_status", "last_psp_code"]
    built = ses.build_sessions(frame(spark, rows), terminal="latest")
    assert by_key(built, columns) == {"a": ("Failed", "Failed", "P1"), "b": ("InBank", None, None)}
    with pytest.raises(ValueError):
        ses.build_sessions(frame(spark, rows), terminal="newest")


def test_first_attempts_and_ranks(spark):
    attempts = frame(spark, samples.SESSION_ROWS)
    first = by_key(ses.first_attempts(attempts), ["first_try_status", "first_psp_code", "first_try_seq"])
    assert "s4" not in first
    assert first["s8"] == ("Paid", "P2", 1)
    assert first["s9"] == ("Failed", "", 2)
    ranked = ses.rank_attempts(attempts).where("session_key = 's8'")
    assert {(r["try_status"], r["attempt_rank"]) for r in ranked.collect()} == {("Paid", 1), ("Failed", 2)}


def test_null_session_key_is_one_session_in_both_plans(spark):
    rows = [attempt(None, 1), attempt(None, 2, "Paid", "P2", 2), attempt("x", 1)]
    safe = ses.build_sessions(frame(spark, rows))
    small = ses.build_sessions(frame(spark, rows), small=True)
    assert sorted(map(str, safe.collect())) == sorted(map(str, small.collect()))
    assert safe.where("session_key IS NULL").first()["recovered"]


def model(rows):
    """The rules once more, in plain Python, for one session."""
    real = [r for r in rows if r["try_seq"] is not None and r["try_seq"] > 0]
    good = {"Verified", "Paid"}

    def place(r):
        late = r["try_created_at"] is None
        return (r["try_seq"], late, r["try_created_at"] if not late else samples.CREATED,
                r["psp_code"] is not None, r["psp_code"] or "", r["try_status"] is not None, r["try_status"] or "")

    first = min(real, key=place)["try_status"] if real else None
    won = any(r["try_status"] in good for r in real)
    later = any(r["try_status"] in good for r in real if r["try_seq"] > 1)
    failed = first is not None and first not in good
    return (len(real), len({r["psp_code"] for r in real if r["psp_code"]}), first in good,
            failed and later, failed and not won, len(real) > 1, not real, won)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(
    st.sampled_from(["a", "b", "c", None]), st.sampled_from([None, 0, 1, 2, 3]),
    st.sampled_from([None, "", "Verified", "Paid", "Failed", "Reversed"]),
    st.sampled_from([None, "", "P1", "P2", "P3"]), st.sampled_from([None, 1, 2, 3])),
    min_size=1, max_size=40), st.randoms())
def test_random_attempts_in_any_order(spark, drawn, rnd):
    rows = [attempt(*values) for values in drawn]
    expected = {}
    for key in {r["session_key"] for r in rows}:
        expected[key] = model([r for r in rows if r["session_key"] == key])
    rnd.shuffle(rows)
    columns = ["attempt_count", "psp_count", "first_attempt_success", "recovered", "unrecovered",
               "retried", "no_attempt", "final_success"]
    attempts = frame(spark, rows).repartition(random.randint(1, 5))
    assert by_key(ses.build_sessions(attempts), columns) == expected
    assert by_key(ses.build_sessions(attempts, small=True), columns) == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    frame(spark, samples.SESSION_ROWS).write.parquet(str(tmp_path / "attempts"))
    attempts = spark.read.parquet(str(tmp_path / "attempts"))
    for codes in (None, ["P1", "P2"]):
        safe = plan_of(ses.build_sessions(attempts, codes=codes))
        assert safe.count("Exchange hashpartitioning") == 1 and "Join" not in safe and "Window" not in safe
        assert "partial_max(merchant_key" in safe     # combined before the exchange
    small = plan_of(ses.build_sessions(attempts, small=True))
    assert small.count("Exchange hashpartitioning") == 1
    pruned = plan_of(ses.build_sessions(attempts).select("session_key", "attempt_count"))
    assert "terminal_key" not in pruned and "amount" not in pruned.split("ReadSchema")[1]


def test_hot_session_is_exact(spark):
    hot = spark.range(5000).select(
        F.lit("hot").alias("session_key"), (F.col("id") % 7 + 1).cast("int").alias("try_seq"),
        F.concat(F.lit("P"), (F.col("id") % 11).cast("string")).alias("psp_code"),
        F.when(F.col("id") % 1000 == 999, "Paid").otherwise("Failed").alias("try_status"))
    rest = spark.range(300).select(
        F.col("id").cast("string").alias("session_key"), F.lit(1).alias("try_seq"),
        F.lit("P1").alias("psp_code"), F.lit("Paid").alias("try_status"))
    base = hot.unionByName(rest)
    template = frame(spark, [attempt("z")]).drop(*base.columns)
    attempts = base.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in template.schema))
    columns = ["attempt_count", "psp_count", "any_success", "first_psp_code"]
    safe = by_key(ses.build_sessions(attempts), columns)
    assert safe == by_key(ses.build_sessions(attempts, small=True), columns)
    assert safe == by_key(ses.build_sessions(attempts, codes=ses.provider_codes(attempts)), columns)
    assert safe["hot"][:3] == (5000, 11, True) and len(safe) == 301
    # rows that agree in everything the order looks at may swap numbers
    looked_at = ["session_key", "try_seq", "psp_code", "try_status", "attempt_rank"]
    split, small = (ses.rank_attempts(attempts, split=split).select(*looked_at) for split in (True, False))
    assert sorted(map(str, split.collect())) == sorted(map(str, small.collect()))


def test_every_line_is_an_attempt(spark):
    from paywake.sources import orders

    folder = "/root/testdata/sf0.001"
    lines, heads = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("lineitem", "orders"))
    alone = heads.join(lines, heads.o_orderkey == lines.l_orderkey, "left_anti").count()
    attempts = orders.attempts_from_orders(spark, folder)
    assert attempts.count() == lines.join(heads, heads.o_orderkey == lines.l_orderkey).count() + alone
    plan = attempts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "l_linenumber" in plan


def test_join_tasks_are_counted_by_lines(spark):
    from paywake.sources import orders

    heads = spark.createDataFrame([(n, f"m{n}") for n in (*range(60), 7, 900)] + [(None, "none")], "o_orderkey long, name string")
    few = [(n % 50, n) for n in range(300)] + [(None, 1), (777, 1)]
    many = few + [(3, n) for n in range(400)] + [(3, 1)] * 100      # an order with most of the lines, some of them equal

    def placed(rows, per_task):
        found = orders.with_lines(heads, spark.createDataFrame(rows, "l_orderkey long, l_linenumber int"), per_task)
        placed_rows = found.select("o_orderkey", "name", "l_linenumber", "has_line", F.spark_partition_id()).collect()
        tasks = {}
        for row in placed_rows:
            if row["has_line"]:
                tasks.setdefault(row[4], []).append(row[0])
        return sorted(str(row[:4]) for row in placed_rows), tasks

    for rows in (few, many):
        whole, _ = placed(rows, 10**6)
        dealt, tasks = placed(rows, 20)
        lines = {}
        for key, number in rows:
            lines.setdefault(key, []).append(number)
        expected = [(key, name, number, number is not None or None) for key, name in heads.collect()
                    for number in (lines.get(key) if key is not None and key in lines else [None])]
        assert whole == dealt == sorted(map(str, expected))
        assert len(tasks) > 4       # more than the number of shuffle partitions here
    assert sum(3 in keys for keys in tasks.values()) > 4
    assert max(map(len, tasks.values())) < 150
