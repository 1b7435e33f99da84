"""Payment attempts derived from an order / line item star schema.

The supplied tables hold no payments, so every order becomes a payment session of its customer's
nation and each of its lines a try. FIXTURES.md section 3 states the mapping.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LINES_PER_TASK = 500_000    # joined and sorted in some 150 MB


def _heavy_orders(lineitem: DataFrame, per_task: int) -> tuple[int, dict[int, int]]:
    """Number of lines, and orders with more lines than a task should join, with their number by a sketch.

    Such an order fills its hash bucket, so the sketch is needed only where a bucket holds as many lines. At most one
    order per ``per_task`` lines is found. They only decide where rows are joined.
    """
    known = lineitem.where(F.col("l_orderkey").isNotNull())
    buckets = known.groupBy(F.pmod(F.xxhash64("l_orderkey"), F.lit(4096))).agg(F.count(F.lit(1)).alias("lines"))
    lines, most = buckets.agg(F.coalesce(F.sum("lines"), F.lit(0)), F.coalesce(F.max("lines"), F.lit(0))).first()
    if most <= per_task:
        return lines, {}
    top = known.agg(F.expr("approx_top_k(l_orderkey, 1000, 10000)")).first()[0]
    return lines, {row["item"]: row["count"] for row in top if row["count"] > per_task}


def with_lines(orders: DataFrame, lineitem: DataFrame, per_task: int = LINES_PER_TASK) -> DataFrame:
    """Orders with each of their lines, or none.

    The inner join can be split at an order with very many lines, which an outer join cannot; orders
    without lines are added by an anti join. Spark sizes the tasks of a join by compressed bytes, and narrow
    lines compress to so few that a task would sort millions of them. So partitions are counted by lines, and
    an order with more than ``per_task`` lines meets them in several partitions.
    """
    own = F.col("o_orderkey") == F.col("l_orderkey")
    marked, keys, bare = lineitem.withColumn("has_line", F.lit(True)), lineitem.select("l_orderkey"), orders
    paired_on = own
    lines, heavy = _heavy_orders(lineitem, per_task)
    if lines > per_task:
        partitions = max(-(-lines // per_task), orders.sparkSession.sparkContext.defaultParallelism)
        by_order, by_line = ["o_orderkey"], ["l_orderkey"]
        if heavy:
            parts = -(-max(heavy.values()) // per_task)
            is_heavy, has_heavy = (F.coalesce(F.col(key).isin(*heavy), F.lit(False)) for key in ("o_orderkey", "l_orderkey"))
            # these have lines, so the anti join does without them
            bare, keys = orders.where(~is_heavy), keys.where(~has_heavy)
            every_part = F.sequence(F.lit(0), F.lit(parts - 1))
            orders = orders.withColumn("o_part", F.explode(F.when(is_heavy, every_part).otherwise(F.array(F.lit(0)))))
            part = F.when(has_heavy, F.monotonically_increasing_id() % parts).otherwise(F.lit(0))
            marked = marked.withColumn("l_part", part.cast("int"))
            by_order, by_line = [*by_order, "o_part"], [*by_line, "l_part"]
            paired_on = own & (F.col("o_part") == F.col("l_part"))
        orders, marked = orders.repartition(partitions, *by_order), marked.repartition(partitions, *by_line)
        keys = keys.repartition(partitions, "l_orderkey")
    paired = orders.join(marked, paired_on).drop("o_part", "l_part")
    return paired.unionByName(bare.join(keys, own, "left_anti"), allowMissingColumns=True)


def attempts_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    def table(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    flag, nation = F.col("l_returnflag"), F.col("n_nationkey")
    final_line = F.col("l_linestatus") == "F"
    cust, order_key = F.col("o_custkey"), F.col("o_orderkey")
    no_line = F.col("has_line").isNull()
    never = no_line | (order_key % 6 == 0)
    seq = F.when(~never, F.col("l_linenumber"))
    status = (
        F.when(never, None)
        .when((flag == "N") & (nation % 5 != 4), "Verified")
        .when((flag == "A") & (nation % 3 == 0), "Paid")
        .when((flag == "A") & final_line & (nation % 3 == 1), "Paid")
        .when((flag == "R") & final_line & (F.col("l_linenumber") == 1), "Reversed")
        .otherwise("Failed")
    )
    hours = F.make_dt_interval(hours=(order_key % 24).cast("int"))
    orders = (
        table("orders")
        .join(table("customer"), cust == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == nation)
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = (
        with_lines(orders, table("lineitem"))
        .withColumn("try_status", status)
        .withColumn("created_at", F.col("o_orderdate") + hours)
    )
    paid_at = F.when(F.col("try_status").isin("Verified", "Paid"), F.col("l_shipdate"))
    return joined.select(
        order_key.cast("string").alias("session_key"),
        F.coalesce(seq, F.lit(0)).cast("int").alias("try_seq"),
        F.concat(F.lit("T"), (cust % 40).cast("string")).alias("terminal_key"),
        F.col("n_name").alias("merchant_key"),
        F.col("n_regionkey").cast("string").alias("category_id"),
        F.col("r_name").alias("category_title"),
        (F.col("o_totalprice") * 200).alias("amount"),
        F.col("o_totalprice").alias("adjusted_fee"),
        F.when(F.col("o_orderstatus") == "F", "Verified")
        .when(F.col("o_orderstatus") == "O", "InBank").otherwise("Failed").alias("session_status"),
        "try_status",
        flag.alias("switch_response_code"),
        F.when(never, None).when(F.col("l_suppkey") % 17 == 0, "")
        .otherwise(F.concat(F.lit("PSP"), (F.col("l_suppkey") % 5).cast("string"))).alias("psp_code"),
        F.concat(F.lit("B"), (cust % 7).cast("string")).alias("issuer_bank_code"),
        F.when(cust % 33 == 0, None).when(cust % 20 == 0, "")
        .otherwise(F.concat(F.lit("C"), cust.cast("string"))).alias("payer_card_key"),
        F.col("o_orderpriority").alias("verify_type"),
        (F.col("l_quantity") * 10).alias("init_time_ms"),
        (F.col("l_discount") * 1000).alias("verify_time_ms"),
        "created_at",
        (F.col("created_at") + F.make_dt_interval(mins=seq)).alias("try_created_at"),
        paid_at.alias("verified_at"),
        F.lit(None).cast("timestamp_ntz").alias("settled_at"),
        (F.col("created_at") + F.make_dt_interval(mins=F.lit(15))).alias("expire_in"),
    )
