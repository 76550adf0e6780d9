"""Registered queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import ranks
from factloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "ag5_latency_distribution"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


@query(
    "ag5_latency_distribution",
    """
    SELECT event_type, min(value) AS min_value, quantile_disc(value, 0.5) AS median_value,
           quantile_disc(value, 0.95) AS p95_value, max(value) AS max_value, count(*) AS n
    FROM events WHERE value IS NOT NULL GROUP BY event_type
    """,
)
def ag5_latency_distribution(spark, sf_dir):
    found = ranks.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"median_value": 0.5, "p95_value": 0.95})
    return found.select("event_type", "min_value", "median_value", "p95_value", "max_value", "n")


from factloom.functions import columns as C  # noqa: E402
from factloom.operators import facts, quality  # noqa: E402


@query(
    "wn1_latest_order_per_customer",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def wn1_latest_order_per_customer(spark, sf_dir):
    newest = facts.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "bt1_status_versions",
    """WITH c AS (
      SELECT *, lag(o_orderstatus) OVER w AS b, row_number() OVER w AS n FROM orders
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    ), k AS (SELECT * FROM c WHERE n = 1 OR o_orderstatus IS DISTINCT FROM b)
    SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS valid_from,
           lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM k""",
)
def bt1_status_versions(spark, sf_dir):
    versions = facts.as_versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderstatus", "o_orderkey", F.date_trunc("month", "o_orderdate"))
    return versions.select("o_custkey", "o_orderkey", "o_orderstatus", "valid_from", "valid_to")


@query(
    "jn5_value_as_of",
    """SELECT user_id, event_type, value, ts FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def jn5_value_as_of(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    at = F.timestamp_micros(F.lit(low + (high - low) // 2)) if low is not None else F.lit(None).cast("timestamp")
    rows = facts.as_of(events, ["user_id", "event_type"], at, "ts", "event_id")
    return rows.select("user_id", "event_type", "value", "ts")


@query(
    "bt7_current_facts",
    """WITH m AS (SELECT max(ts) AS now FROM events), l AS (
      SELECT user_id, event_type, value, ts FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, event_type, value,
           greatest(0, CAST(floor(epoch(now)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) AS lag_seconds,
           CAST(floor(epoch(now)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) > 86400 AS stale FROM l, m""",
)
def bt7_current_facts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = events.agg(F.max("ts")).first()[0]
    newest = facts.latest_per_key(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return facts.freshness(newest, "ts", F.lit(86400), F.lit(now).cast("timestamp")).select("user_id", "event_type", "value", "lag_seconds", "stale")


FLAGSHIP = "bt7_current_facts"


@query(
    "rc1_reconcile_part_price",
    """WITH c AS (SELECT l_partkey, round(l_extendedprice / l_quantity, 2) AS value,
        CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS p, l_orderkey, l_linenumber, l_suppkey FROM lineitem),
    m AS (SELECT *, p = min(p) OVER (PARTITION BY l_partkey) AS best,
        row_number() OVER (PARTITION BY l_partkey ORDER BY p, l_orderkey, l_linenumber, l_suppkey, value) AS n FROM c)
    SELECT l_partkey, max(CASE WHEN n = 1 THEN value END) AS value, count(*) AS n_candidates,
           count(DISTINCT value) AS n_values, count(DISTINCT CASE WHEN best THEN value END) > 1 AS conflicted
    FROM m GROUP BY l_partkey""",
)
def rc1_reconcile_part_price(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    # Doubles are rounded as doubles: F.round would round their decimal form, which differs at ties.
    value = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    candidates = lines.select("l_partkey", value.alias("value"), "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey")
    priority = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    return facts.reconcile(candidates, ["l_partkey"], priority, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "value")])


@query(
    "cdc1_value_changes",
    """WITH o AS (SELECT *, lag(value) OVER w AS b0, row_number() OVER w AS n FROM events WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    k AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before_value FROM o
      WHERE n = 1 OR value IS DISTINCT FROM b0)
    SELECT event_id, user_id, event_type, value, before_value,
      CASE WHEN before_value IS NULL THEN 'created' WHEN value > before_value THEN 'increased' ELSE 'decreased' END AS change_type
    FROM k""",
)
def cdc1_value_changes(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    versions = facts.as_versions(events, ["user_id", "event_type"], "ts", "value", "event_id", F.to_date("ts"))
    # Ties in time are ordered by event_id as the versions are.
    versions = versions.withColumn("at", F.struct("ts", "event_id"))
    return facts.change_events(versions, ["user_id", "event_type"], "value", "at", F.to_date("ts")).select("event_id", "user_id", "event_type", "value", "before_value", "change_type")


@query(
    "dq2_price_contract",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_quantity <= 0 OR l_discount > 0.09 THEN 'quarantined'
           WHEN l_tax > 0.07 THEN 'needs_review' ELSE 'verified' END AS decision,
      concat_ws(',', CASE WHEN l_quantity <= 0 THEN 'quantity_not_positive' END, CASE WHEN l_discount > 0.09 THEN 'discount_too_high' END,
                CASE WHEN l_tax > 0.07 THEN 'tax_unusual' END) AS violations FROM lineitem""",
)
def dq2_price_contract(spark, sf_dir):
    gated = quality.gate(
        table(spark, sf_dir, "lineitem"),
        {"quantity_not_positive": F.col("l_quantity") <= 0, "discount_too_high": F.col("l_discount") > 0.09},
        {"tax_unusual": F.col("l_tax") > 0.07},
    )
    return gated.select("l_orderkey", "l_linenumber", "l_partkey", "decision", F.array_join("violations", ",").alias("violations"))


@query(
    "dq3_last_known_good",
    """SELECT event_id, user_id, last_value(CASE WHEN value < 100 THEN value END IGNORE NULLS) OVER (
      PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS released_value FROM events""",
)
def dq3_last_known_good(spark, sf_dir):
    out = quality.last_known_good(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("value") < 100, F.to_date("ts"))
    return out.select("event_id", "user_id", "released_value")


@query(
    "wn4_failure_streaks",
    """WITH f AS (SELECT event_id, user_id, ts, event_type = 'error' OR value < 5 OR value IS NULL AS failed FROM events),
    i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
    SELECT event_id, user_id, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS streak FROM i""",
)
def wn4_failure_streaks(spark, sf_dir):
    failed = (F.col("event_type") == "error") | (F.col("value") < 5) | F.col("value").isNull()
    return quality.failure_streaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], failed, F.to_date("ts")).select("event_id", "user_id", "streak")


@query(
    "wn3_transition_audit",
    """WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus,
        lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_state FROM orders)
    SELECT * FROM t WHERE from_state IS NOT NULL AND NOT ((from_state = 'O' AND o_orderstatus = 'P') OR
      (from_state = 'P' AND o_orderstatus = 'F') OR (from_state = 'O' AND o_orderstatus = 'O'))""",
)
def wn3_transition_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    out = quality.audit_transitions(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", [("O", "P"), ("P", "F"), ("O", "O")], F.date_trunc("month", "o_orderdate"))
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "from_state")


@query(
    "fn3_normalize_identity",
    """SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS identity,
      length(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS type_length FROM part""",
)
def fn3_normalize_identity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.normalize_identity(F.col("p_name")).alias("identity"), F.length(C.normalize_whitespace(F.col("p_type"))).cast("long").alias("type_length"))


@query(
    "jn1_supporting_sources",
    """SELECT l_partkey, count(DISTINCT l_suppkey) AS n_sources, count(*) AS n_evidence,
      CASE WHEN count(DISTINCT l_suppkey) >= 2 THEN 'verified' ELSE 'single_source' END AS trust
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey""",
)
def jn1_supporting_sources(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    n = F.count_distinct("l_suppkey")
    return joined.groupBy("l_partkey").agg(n.alias("n_sources"), F.count("*").alias("n_evidence"), F.when(n >= 2, "verified").otherwise("single_source").alias("trust"))


@query(
    "ag10_manifest",
    """SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM orders
    UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT 'events', count(*), count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM documents""",
)
def ag10_manifest(spark, sf_dir):
    out = None
    for name, key in (("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("events", "user_id"), ("documents", "doc_id")):
        part = table(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))
        out = part if out is None else out.unionByName(part)
    return out.select("table_name", "n_rows", "n_keys")


from factloom.plans import fleet, gauntlet, health, history, recovery, release, serving, trust, values, views  # noqa: E402, F401  (importing registers their queries)
