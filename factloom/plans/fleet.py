"""Queries of fleet operators: eligibility, schedules, stages, roll-backs, replays, signatures and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import fleet
from factloom.plans.registry import query
from factloom.session import table

_PF10 = {
    "binding_kind": "o_orderpriority[1] <> '5'",
    "binding_can_run": "o_orderstatus = 'O' OR (o_orderstatus = 'P' AND c_mktsegment = 'BUILDING' AND o_orderdate <= TIMESTAMP '1996-01-01')",
    "core_gate": "c_acctbal > 0",
    "core_not_bypassed": "o_totalprice < 400000",
    "certification": "c_acctbal > -500",
    "certification_matches": "c_nationkey <> 3",
    "source_approval": "c_nationkey <> 4",
    "source_lifecycle": "o_orderpriority[1] <> '4'",
    "source_visibility": "c_mktsegment <> 'MACHINERY'",
    "source_official": "c_custkey IS NOT NULL",
    "endpoint_approval": "c_nationkey <> 5",
    "endpoint_public": "c_nationkey <> 6",
    "policy_enabled": "c_nationkey <> 7",
    "not_failing": "c_mktsegment <> 'HOUSEHOLD'",
    "cooldown": "c_mktsegment <> 'BUILDING' OR coalesce(o_orderdate <= TIMESTAMP '1996-01-01', false)",
    "quota": "o_totalprice < 300000",
    "concurrency": "o_totalprice < c_acctbal * 50",
}


@query(
    "pf10_fair_eligibility",
    "SELECT o_orderkey, concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _PF10.items()) + ") AS failed FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def pf10_fair_eligibility(spark, sf_dir):
    """Orders as candidates of their customers' sources."""
    people, c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey").withColumn("known", F.lit(True)), F.col
    level, nation = F.substring("o_orderpriority", 1, 1), F.col("c_nationkey")
    pick = lambda condition, yes, no: F.when(condition, yes).otherwise(F.when(~condition, no))
    rows = table(spark, sf_dir, "orders").join(people, "o_custkey", "left").select(
        "o_orderkey",
        pick(level != "5", "production", "regression").alias("binding_kind"),
        F.when(c("o_orderstatus") == "O", "active").when(c("o_orderstatus") == "P", "cooling").otherwise("paused").alias("binding_lifecycle"),
        F.when(c("c_mktsegment") == "BUILDING", "cooling").when(c("c_mktsegment") == "HOUSEHOLD", "failing").when(c("c_mktsegment").isNotNull(), "healthy").alias("health_state"),
        c("o_orderdate").cast("timestamp").alias("cooldown_until"),
        pick(c("c_acctbal") > 0, "certified", "draft").alias("core_gate_status"),
        (c("o_totalprice") >= 400000).alias("bypass_core"),
        pick(c("c_acctbal") > -500, "certified", "revoked").alias("certification_status"),
        (nation != 3).alias("certification_matches"),
        pick(nation != 4, "approved", "pending").alias("source_approval_status"),
        pick(level != "4", "active", "paused").alias("source_lifecycle"),
        pick(c("c_mktsegment") != "MACHINERY", "public", "private").alias("source_visibility"),
        c("known").alias("source_official"),
        pick(nation != 5, "approved", "pending").alias("endpoint_approval_status"),
        (nation != 6).alias("endpoint_public"),
        (nation != 7).alias("policy_enabled"),
        c("o_totalprice").alias("quota_used"), F.lit(300000.0).alias("daily_quota"),
        c("o_totalprice").alias("active_leases"), (c("c_acctbal") * 50).alias("max_concurrency"),
    )
    return fleet.fair_eligibility(rows, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", F.array_join("failed", ",").alias("failed"))


@query(
    "wn4_next_due",
    """WITH f AS (SELECT event_id, user_id, ts, coalesce(event_type = 'error' OR value < 5, false) AS failed FROM events),
    i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
    s AS (SELECT event_id, ts, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS n FROM i)
    SELECT event_id, CASE WHEN n = 0 THEN 'healthy' WHEN n >= 3 THEN 'failing' ELSE 'cooling' END AS health_state,
      ts::TIMESTAMP + to_milliseconds(CASE WHEN n = 0 THEN 3600000 + (event_id::HUGEINT * 2654435761 % 60000)::BIGINT ELSE least(86400000, 60000 * (2 ** least(n - 1, 60)))::BIGINT END) AS next_due FROM s""",
)
def wn4_next_due(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error") | (F.col("value") < 5)
    out = fleet.outcome_schedule(events, "user_id", ["ts", "event_id"], failed, "ts", "event_id", 3, 3_600_000, 60_000, 86_400_000, 60_000, F.to_date("ts"))
    return out.select("event_id", "health_state", F.col("next_due").cast("timestamp_ntz").alias("next_due"))


@query(
    "dq9_stage_thresholds",
    """WITH r AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity >= 5) AS ok, count(*) FILTER (l_tax > 0.07) AS critical, count(*) FILTER (l_discount > 0.09) AS wrong, bool_and(l_returnflag <> 'R') AS a, count(DISTINCT l_linestatus) = 1 AS stable FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(coalesce(ok / nullif(n, 0), 0) >= 0.5 AND coalesce(critical, 0) <= 1 AND coalesce(wrong, 0) <= 1 AND a AND (o_orderpriority[1] <> '1' OR stable) AND (o_orderpriority[1] <> '2' OR o_orderstatus <> 'O' OR ok = n), false) AS passes
    FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""",
)
def dq9_stage_thresholds(spark, sf_dir):
    """The lines of an order are the cases of a stage; its priority sets the thresholds."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("total_cases"), F.count_if(F.col("l_quantity") >= 5).alias("passed_cases"), F.count_if(F.col("l_tax") > 0.07).alias("critical_failures"), F.count_if(F.col("l_discount") > 0.09).alias("false_events"),
        F.bool_and(F.col("l_returnflag") != "R").alias("extraction_ok"), (F.count_distinct("l_linestatus") == 1).alias("identity_stable"),
    )
    level, true = F.substring("o_orderpriority", 1, 1), F.lit(True)
    runs = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").fillna(0, ["critical_failures", "false_events"]).withColumns(
        {"events_ok": true, "schema_compatible": true, "mapping_compatible": true, "minimum_pass_rate": F.lit(0.5), "maximum_critical_failures": F.lit(1), "maximum_false_events": F.lit(1), "require_identity_stable": level == "1", "require_held_out_pass": level == "2"}
    )
    return fleet.stage_passes(runs, "o_orderstatus", "O").select("o_orderkey", "passes")


@query(
    "wn7_roll_backs",
    """WITH t AS (SELECT o_orderkey % 5000 AS revision, arg_max(o_custkey % 7, (o_orderdate, o_orderkey)) AS spec, arg_max(CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'draft' END, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1),
    a AS (SELECT l_orderkey % 5000 AS revision, arg_max(CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END, (l_shipdate, l_orderkey * 10 + l_linenumber, l_partkey)) AS decision FROM lineitem GROUP BY 1),
    r AS (SELECT c_custkey AS op, c_custkey % 5000 AS x, c_custkey % 5000 + c_nationkey AS y FROM customer),
    j AS (SELECT op, CASE WHEN p.spec IS NULL OR q.spec IS NULL THEN 'unknown_revision' WHEN p.spec <> q.spec THEN 'other_spec' WHEN p.status <> 'active' THEN 'not_active' WHEN decision IS NULL OR decision <> 'approved' THEN 'not_approved' ELSE 'done' END AS outcome
      FROM r LEFT JOIN t p ON p.revision = x LEFT JOIN t q ON q.revision = y LEFT JOIN a ON a.revision = y)
    SELECT op::VARCHAR AS operation_key, outcome FROM j""",
)
def wn7_roll_backs(spark, sf_dir):
    """Each customer asks to go from one revision to another one."""
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded").otherwise("draft")
    log = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("spec"), (F.col("o_orderkey") % 5000).alias("revision"), status.alias("to_status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("tie"))
    verdict = F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved")
    approvals = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5000).alias("revision"), verdict.alias("decision"), F.col("l_shipdate").alias("at"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey").alias("tie"))
    key = F.col("c_custkey") % 5000
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("operation_key"), key.alias("active_revision"), (key + F.col("c_nationkey")).alias("restore_revision"), F.lit(0).alias("at"))
    done, refused = fleet.roll_back(log, requests, approvals)
    met = done.where("to_status = 'active'").select(F.regexp_replace("operation_key", ":restored$", "").alias("operation_key"), F.lit("done").alias("outcome"))
    return met.unionByName(refused.select("operation_key", F.col("why").alias("outcome")))


@query(
    "cdc13_replays",
    """WITH d AS (SELECT event_id AS id, user_id % 9 AS sub, event_id % 400 AS ev, CASE event_type WHEN 'error' THEN 'dead_letter' ELSE 'delivered' END AS status, CASE WHEN event_type = 'view' THEN user_id % 9 || ':' || event_id % 400 || ':replay:b' || event_id % 3 ELSE event_id::VARCHAR END AS key FROM events),
    r AS (SELECT event_id AS op, event_id - user_id % 2 AS id, 'b' || event_id % 3 AS batch FROM events),
    j AS (SELECT r.op, d.id AS there, d.status, CASE WHEN d.status = 'dead_letter' THEN concat_ws(':', sub, ev, 'replay', batch) END AS k FROM r LEFT JOIN d ON d.id = r.id)
    SELECT lpad(op::VARCHAR, 12, '0') AS operation_key, CASE WHEN there IS NULL THEN 'unknown' WHEN status <> 'dead_letter' THEN 'not_dead' WHEN k IN (SELECT key FROM d WHERE key IS NOT NULL) OR op <> min(op) OVER (PARTITION BY k) THEN 'duplicate' ELSE 'queued' END AS state FROM j""",
)
def cdc13_replays(spark, sf_dir):
    """Every event asks for a replay of a delivery; some are dead letters, some replays are queued already."""
    e, batch = table(spark, sf_dir, "events"), F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string"))
    sub, ev = F.col("user_id") % 9, F.col("event_id") % 400
    key = F.when(F.col("event_type") == "view", F.when(F.col("user_id").isNotNull(), F.concat_ws(":", sub.cast("string"), ev.cast("string"), F.lit("replay"), batch))).otherwise(F.col("event_id").cast("string"))
    deliveries = e.select(F.col("event_id").alias("delivery_id"), sub.alias("subscription_id"), ev.alias("event_id"), F.when(F.col("event_type") == "error", "dead_letter").otherwise("delivered").alias("status"), key.alias("delivery_key"))
    requests = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("operation_key"), (F.col("event_id") - F.col("user_id") % 2).alias("delivery_id"), batch.alias("batch_key"))
    return fleet.replays(requests, deliveries).select("operation_key", "state")


@query(
    "fn16_webhook_states",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'malformed' WHEN event_id % 700 > 300 THEN 'expired' WHEN event_type = 'error' THEN 'mismatch' ELSE 'verified' END AS state FROM events WHERE event_type IS NOT NULL""",
)
def fn16_webhook_states(spark, sf_dir):
    """Events signed as they are sent, some of them late, changed on the way or without a time."""
    key = b"a signing key of a test"
    events = table(spark, sf_dir, "events").where("event_type is not null")
    sent = F.concat_ws("|", "event_id", "event_type", "props")
    at = F.lit(1_700_000_000) - F.col("event_id") % 700
    signed = C.hmac_sha256(key, F.concat(at.cast("string"), F.lit("."), sent))
    header = F.when(F.col("event_type") == "signup", F.concat(F.lit("v1="), signed)).otherwise(F.concat(F.lit("v1="), signed, F.lit(",t="), at.cast("string")))
    got = F.when(F.col("event_type") == "error", F.concat(sent, F.lit("x"))).otherwise(sent)
    return events.select("event_id", C.webhook_state(got, header, key, F.lit(1_700_000_000)).alias("state"))


_SQL_CATALOG = """s AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal >= 0 AND s_nationkey <> 3),
    e AS (SELECT p_partkey AS id, p_partkey % 97 + 1 AS src, CASE WHEN p_partkey % 97 + 1 NOT IN (SELECT id FROM s) THEN 'source_not_shown' WHEN p_size > 40 THEN 'not_public' END AS why FROM part),
    k AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 2),
    b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::BIGINT % 25 AS col, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS src, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS ep FROM lineitem),
    c AS (SELECT o_orderkey AS id, o_custkey % 25 AS col, o_orderkey % 97 + 1 AS src, o_orderkey % 200 + 1 AS ep FROM orders),
    r AS (SELECT 'endpoint' AS kind, src, why FROM e
      UNION ALL SELECT 'certification', src, CASE WHEN col NOT IN (SELECT id FROM k) THEN 'unknown_collector' WHEN src NOT IN (SELECT id FROM s) THEN 'source_not_shown' WHEN o.id IS NULL THEN 'endpoint_not_shown' WHEN o.osrc <> src THEN 'endpoint_of_other_source' END
        FROM c LEFT JOIN (SELECT id, src AS osrc FROM e WHERE why IS NULL) o ON o.id = ep
      UNION ALL SELECT 'binding', src, CASE WHEN col NOT IN (SELECT id FROM k) THEN 'unknown_collector' WHEN src IS NULL AND ep IS NULL THEN NULL WHEN src NOT IN (SELECT id FROM s) THEN 'source_not_shown' WHEN o.id IS NULL THEN 'endpoint_not_shown' WHEN o.osrc <> src THEN 'endpoint_of_other_source' END
        FROM b LEFT JOIN (SELECT id, src AS osrc FROM e WHERE why IS NULL) o ON o.id = ep)"""


def _catalog(spark, sf_dir):
    c = F.col
    sources = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("source_id"), F.when(c("s_nationkey") != 3, "active").otherwise("unknown").alias("lifecycle"), F.when(c("s_acctbal") >= 0, "public").otherwise("private").alias("visibility"))
    endpoints = table(spark, sf_dir, "part").select(c("p_partkey").alias("endpoint_id"), (c("p_partkey") % 97 + 1).alias("source_id"), (c("p_size") <= 40).alias("public"))
    collectors = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(c("n_nationkey").alias("collector_id"))
    ours = c("l_returnflag") != "R"
    bindings = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_quantity").cast("long") % 25).alias("collector_id"), F.when(ours, c("l_suppkey")).alias("source_id"), F.when(ours, c("l_partkey")).alias("endpoint_id"))
    certifications = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 25).alias("collector_id"), (c("o_orderkey") % 97 + 1).alias("source_id"), (c("o_orderkey") % 200 + 1).alias("endpoint_id"))
    return fleet.catalog(sources, endpoints, collectors, certifications, bindings)


@query("jn16_catalog_consistency", f"WITH {_SQL_CATALOG} SELECT kind, coalesce(why, 'shown') AS why, count(*) AS n FROM r GROUP BY ALL")
def jn16_catalog_consistency(spark, sf_dir):
    """How many endpoints, certifications and bindings are shown, and why others are not."""
    rows, _ = _catalog(spark, sf_dir)
    return rows.groupBy("kind", F.coalesce("why", F.lit("shown")).alias("why")).agg(F.count("*").alias("n"))


@query(
    "jn16_public_sources",
    f"""WITH {_SQL_CATALOG} SELECT s.id AS source_id, count(*) FILTER (kind = 'endpoint') AS n_endpoints, count(*) FILTER (kind = 'certification') AS n_certifications, count(*) FILTER (kind = 'binding') AS n_bindings
    FROM s LEFT JOIN (SELECT * FROM r WHERE why IS NULL) r ON r.src = s.id GROUP BY 1""",
)
def jn16_public_sources(spark, sf_dir):
    """The shown sources with their consistent children."""
    return _catalog(spark, sf_dir)[1]
