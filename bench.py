"""Time the batch build and the main reports; prints one JSON line.

BENCH_SF_DIR is the folder of input tables, BENCH_CPUS the number of local cores. With --duckdb the
same steps are timed as SQL in DuckDB instead.
"""

import json
import os
import statistics
import sys
import tempfile
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def timed(step):
    """Median seconds of RUNS runs after one warm-up."""
    step()
    seconds = []
    for _ in range(RUNS):
        start = time.perf_counter()
        step()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def spark_steps():
    from pyspark.sql import SparkSession

    from paywake.operators import context, customers, explorer, insights, peers, rollups, scores, sessions
    from paywake.plans.batch import build_all
    from paywake.plans.materialize import materialize
    from paywake.sources.orders import attempts_from_orders
    from paywake.sources.tables import read_table

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="run-")
    stored = build_all(spark, attempts_from_orders(spark, FOLDER), f"{work}/stored")

    def run(*frames):
        for df in frames:
            df.write.format("noop").mode("overwrite").save()

    def table(name):
        return read_table(spark, f"{work}/stored", name)

    def rollup_step():
        run(*rollups.roll_up_all(table("sessions")).values())

    def season_step():
        folded = rollups.seasonality(table("sessions"))
        run(*(folded[name] for name in ("monthly", "weekday", "calendar")))

    def insight_step():
        merchants = table("merchant_metrics")
        ranked = materialize(peers.peer_metrics(merchants), "peers")    # read three times, as in the build
        found = insights.build_insights(ranked)
        run(ranked, found, insights.insight_evidence(found, ranked, insights.methodology(spark)))

    def context_step():
        source = table("sessions")
        profile = customers.customer_profile(table("attempts"))
        run(context.context_json(context.merchant_context(
            table("merchant_metrics"), table("peer_metrics"), table("merchant_daily_metrics"),
            table("merchant_hourly_metrics"), table("merchant_psp_metrics"),
            customers.customer_summary_all(profile), table("insight_evidence"),
            rollups.monthly_metrics(source, lost=True))))

    del stored
    steps = {
        "attempts_to_sessions": lambda: run(
            sessions.build_sessions(table("attempts"))),
        "five_rollups": rollup_step,
        "seasonality": season_step,
        "peers_insights_evidence": insight_step,
        "health_scores": lambda: run(scores.health_scores(table("peer_metrics"))),
        "customer_analytics": lambda: run(customers.customer_analytics(table("attempts"))),
        "session_page": lambda: run(explorer.session_page(table("sessions"))),
        "insight_sessions": lambda: run(explorer.insight_sessions(table("insights"), table("sessions"))),
        "session_timeline": lambda: run(explorer.session_timeline(table("sessions"), table("attempts"))),
        "merchant_context": context_step,
        "batch_build": lambda: build_all(spark, table("attempts"), tempfile.mkdtemp(prefix="run-")),
        "merchants_from_raw": lambda: run(rollups.merchant_metrics(
            sessions.build_sessions(attempts_from_orders(spark, FOLDER)))),
    }
    return {name: timed(step) for name, step in steps.items()}


def duckdb_steps():
    import duckdb

    import oracle

    db = duckdb.connect()
    db.sql(f"SET threads = {CPUS}")
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")

    def store(*names):
        """Tables from the common table expressions, each reading the stored ones."""
        for name in names:
            db.sql(f"CREATE OR REPLACE TABLE {name} AS {oracle.TABLES[name]}")

    def via(result, *parts):
        """A result through intermediate expressions that are not stored."""
        ctes = ", ".join(f"{p} AS ({oracle.TABLES[p]})" for p in parts)
        db.sql(f"CREATE OR REPLACE TABLE {result} AS "
               f"{f'WITH {ctes} ' if ctes else ''}{oracle.TABLES.get(result) or oracle.FINAL[result]}")

    def final(*names):
        for name in names:
            db.sql(f"CREATE OR REPLACE TEMP TABLE result_{name} AS {oracle.FINAL[name]}")

    def sessions():
        via("sessions", "tries", "tried", "opened", "flagged")

    def rollups():
        for name in ("merchants", "daily", "hourly", "amounts", "psps"):
            via(name, "facts")

    def evidence():
        store("peers", "method")
        via("insights", "found", "texts")
        store("evidence")

    def customers():
        chain = ("known", "profile", "summary", "by_revenue", "by_orders", "by_amount", "newest", "longest")
        ctes = ", ".join(f"{p} AS ({oracle.TABLES[p]})" for p in chain)
        db.sql(f"CREATE OR REPLACE TEMP TABLE customers AS WITH {ctes} {oracle.FINAL['customer_analytics']}")

    def everything():
        sessions()
        rollups()
        evidence()
        for name in ("attempts", "sessions", "merchants", "daily", "hourly", "amounts", "psps", "peers",
                     "insights", "method", "evidence"):
            db.sql(f"COPY {name} TO '{work}/{name}.parquet'")

    def seasons():
        facts = f"WITH facts AS ({oracle.TABLES['facts']})"
        for name in ("monthly_metrics", "weekday_metrics", "calendar_metrics"):
            db.sql(f"CREATE OR REPLACE TEMP TABLE result AS {facts} {oracle.FINAL[name]}")

    work = tempfile.mkdtemp(prefix="run-")
    via("attempts", "lines")
    everything()
    store("explored")
    return {
        "attempts_to_sessions": timed(sessions),
        "five_rollups": timed(rollups),
        "seasonality": timed(seasons),
        "peers_insights_evidence": timed(evidence),
        "health_scores": timed(lambda: final("health_scores")),
        "customer_analytics": timed(customers),
        "session_page": timed(lambda: final("session_page")),
        "insight_sessions": timed(lambda: final("insight_sessions")),
        "session_timeline": timed(lambda: final("session_timeline")),
        "batch_build": timed(everything),
    }


if __name__ == "__main__":
    seconds = duckdb_steps() if "--duckdb" in sys.argv else spark_steps()
    print(json.dumps({
        "metric": "median seconds per step, summed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "runs": RUNS,
    }))
