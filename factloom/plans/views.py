"""Queries of views, subscriptions, conflict rows, retractions and streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from factloom.functions import columns as C
from factloom.operators import bitemporal, governance, reconcile, views, visibility
from factloom.plans.registry import query
from factloom.plans.serving import _STATE, _projected, _support, _versions
from factloom.session import table
from factloom.streaming import jobs


@query(
    "jn12_fact_dossiers",
    f"""WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, {_STATE} AS st FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01'),
    p AS (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (st IN ('released', 'retracted')) AS cur FROM v GROUP BY o_custkey, o_orderpriority)
    SELECT cur AS fact_version_id, o_orderstatus AS decision, (SELECT count(*) FROM lineitem WHERE l_orderkey = cur) AS n_observations, (SELECT count(*) FROM lineitem WHERE l_orderkey = cur AND l_linestatus = 'F') AS n_evidence,
      coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT l_orderkey || ':' || l_linenumber AS r FROM lineitem WHERE l_orderkey = cur AND l_linestatus = 'F' ORDER BY r LIMIT 20)), '') AS refs
    FROM p JOIN orders ON o_orderkey = cur""",
)
def jn12_fact_dossiers(spark, sf_dir):
    """What was believed in the middle of 1998, with its order's status as the decision."""
    lines, evidence = _support(spark, sf_dir)
    believed = visibility.project(_versions(spark, sf_dir), ["entity_id", "predicate"], where=visibility.believed(None, F.lit("1998-06-01").cast("timestamp")))
    decisions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_version_id"), F.col("o_orderstatus").alias("decision"))
    out = views.fact_dossier(believed, decisions, lines.select("fact_version_id", F.col("ref").alias("observation_id")), evidence)
    return out.select("fact_version_id", "decision", "n_observations", "n_evidence", F.array_join("evidence.evidence_ref", ",").alias("refs"))


@query(
    "jn15_entity_timelines",
    """WITH t AS (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS versions FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 20) GROUP BY 1)
    SELECT c_custkey AS entity_id, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS n_facts, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_versions, 1::BIGINT AS n_relations, coalesce(versions, '') AS versions,
      (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'O') AS n_decisions, (SELECT max((o_orderdate, o_orderkey))[2] FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'O') AS last_decision
    FROM customer LEFT JOIN t ON o_custkey = c_custkey""",
)
def jn15_entity_timelines(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    relations = customers.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("target_id"))
    decided = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("decision_id"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderdate").alias("decided_at"))
    out = views.entity_timeline(relations.select("entity_id"), _projected(spark, sf_dir), _versions(spark, sf_dir), relations, decided)
    return out.select("entity_id", "n_facts", "n_versions", "n_relations", "n_decisions", F.get("decisions.decision_id", F.lit(0)).alias("last_decision"), F.array_join(F.col("versions.fact_version_id").cast("array<string>"), ",").alias("versions"))


@query(
    "jn17_identity_graphs",
    """WITH l AS (SELECT DISTINCT c_custkey AS f, c_nationkey::BIGINT AS t FROM customer), b AS (SELECT f AS id, f, t FROM l UNION SELECT t, f, t FROM l)
    SELECT c_custkey AS entity_id, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS n_external_ids, 2::BIGINT AS n_aliases, (SELECT count(*) FROM b WHERE id = c_custkey) AS n_lineage,
      array_to_string(list_sort([c_name, c_mktsegment]), ',') AS aliases, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_candidates, (SELECT arg_max(o_orderkey, (o_totalprice, -o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS best_candidate,
      (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R') AS n_decisions FROM customer""",
)
def jn17_identity_graphs(spark, sf_dir):
    """Customers whose nation's number stands for the entity they were merged into."""
    customers = table(spark, sf_dir, "customer").withColumn("entity_id", F.col("c_custkey"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("external_id"))
    aliases = customers.select("entity_id", F.explode(F.array("c_name", "c_mktsegment")).alias("alias"))
    lineage = customers.select(F.col("entity_id").alias("from_id"), F.col("c_nationkey").cast("long").alias("to_id"), F.lit("merged").alias("kind"))
    candidates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").alias("score"))
    decisions = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linestatus").alias("decision"), F.col("l_shipdate").alias("decided_at"))
    out = views.identity_graph(customers.select("entity_id"), ids, aliases, lineage, candidates, decisions)
    return out.select("entity_id", "n_external_ids", "n_aliases", "n_lineage", "n_candidates", F.get("candidates.candidate_id", F.lit(0)).alias("best_candidate"), "n_decisions", F.array_join("aliases.alias", ",").alias("aliases"))


@query(
    "jn18_bundle_views",
    """SELECT o_orderkey AS bundle_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_artifacts, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AS n_evidence,
      coalesce((SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), -1) AS first_artifact FROM orders""",
)
def jn18_bundle_views(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    artifacts = lines.select(F.col("l_orderkey").alias("bundle_id"), F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("digest"))
    evidence = lines.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").alias("evidence_ref"))
    out = views.bundle_view(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id")), artifacts, evidence)
    return out.select("bundle_id", "n_artifacts", "n_evidence", F.coalesce(F.get("artifacts.name", F.lit(0)), F.lit(-1)).alias("first_artifact"))


@query(
    "jn19_incident_details",
    """SELECT c_custkey AS incident_id, c_nationkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS last_run, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'O') AS last_review,
      count(o_orderkey) AS n_calls, array_to_string(list_slice(coalesce(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) FILTER (o_orderkey IS NOT NULL), []), 1, 25), ',') AS calls
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def jn19_incident_details(spark, sf_dir):
    """A customer as an incident, finished orders as its runs, open ones as its reviews, all as its calls."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "incident_id")
    at = ["o_orderdate", "o_orderkey"]
    logs = {"run": (orders.where("o_orderstatus = 'F'"), at, ["o_orderkey"]), "review": (orders.where("o_orderstatus = 'O'"), at, ["o_orderpriority"])}
    incidents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("incident_id"), "c_nationkey")
    out = views.incident_detail(incidents, "incident_id", logs, orders, ["o_totalprice", "o_orderkey"], ["o_orderkey"])
    calls = F.array_join(F.col("calls.o_orderkey").cast("array<string>"), ",").alias("calls")
    return out.select("incident_id", "c_nationkey", F.col("run.o_orderkey").alias("last_run"), F.col("review.o_orderpriority").alias("last_review"), "n_calls", calls)


@query(
    "gov5_operations",
    """WITH a AS (SELECT s_nationkey, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_returnflag, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT n_nationkey, count(*) FILTER (l_returnflag = 'R') AS n_open_alerts, max(l_shipdate) AS last_backup_at FROM nation LEFT JOIN a ON s_nationkey = n_nationkey GROUP BY 1""",
)
def gov5_operations(spark, sf_dir):
    """Nations as tenants: lines sent back are open alerts, the last shipped line is the last backup."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumnRenamed("s_nationkey", "n_nationkey")
    out = views.operations(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", lines, F.col("l_returnflag") == "R", {"backup": (lines, ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_shipdate"])})
    return out.select("n_nationkey", "n_open_alerts", F.col("backup.l_shipdate").alias("last_backup_at"))


@query(
    "jn8_subscribed_events",
    """WITH s AS (SELECT n_nationkey AS id, n_nationkey % 5 AS k FROM nation)
    SELECT event_id, id AS subscription_id FROM events JOIN s ON (k = 0 OR (k IN (1, 3) AND event_type = 'error') OR (k = 2 AND event_type IN ('error', 'click')) OR (k = 4 AND event_type = 'signup'))
    WHERE (k <> 3 OR coalesce(user_id >= 10, false)) AND (NOT coalesce(value > 150, false) OR k IN (0, 2))""",
)
def jn8_subscribed_events(spark, sf_dir):
    """Nations subscribe to events: every fifth to all kinds, some to one predicate only, some also to corrections (high values)."""
    k = F.col("n_nationkey") % 5
    kinds = F.when(k.isin(1, 3), F.array(F.lit("error"))).when(k == 2, F.array(F.lit("error"), F.lit("click"))).when(k == 4, F.array(F.lit("signup"))).otherwise(F.array().cast("array<string>"))
    subscriptions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subscription_id"), kinds.alias("kinds"), F.when(k == 3, F.array(F.lit("known"))).alias("predicates"), k.isin(0, 2).alias("corrections"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("user_id") >= 10, "known").alias("predicate"), (F.col("value") > 150).alias("correction"))
    return governance.subscribed(events, subscriptions).select("event_id", "subscription_id")


@query(
    "cdc4_open_conflicts",
    """WITH c AS (SELECT l_partkey, l_orderkey || ':' || l_linenumber AS obs, l_returnflag AS v, l_shipdate FROM lineitem),
    g AS (SELECT l_partkey, string_agg(DISTINCT obs, ',' ORDER BY obs) AS ids, count(DISTINCT v) AS n_values, max(l_shipdate) AS opened_at FROM c GROUP BY 1 HAVING count(DISTINCT v) > 1)
    SELECT l_partkey, n_values, opened_at, sha256('source-conflict|' || l_partkey || '|' || ids) AS conflict_id FROM g""",
)
def cdc4_open_conflicts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("obs", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return reconcile.conflict_rows(lines, ["l_partkey"], "obs", "l_returnflag", "l_shipdate").drop("observation_ids")


@query("set3_rejected_lines", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def set3_rejected_lines(spark, sf_dir):
    eligible = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return reconcile.rejected(table(spark, sf_dir, "lineitem"), eligible, "l_orderkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "set2_merged_sources",
    """SELECT l_orderkey, string_agg(DISTINCT x, ',' ORDER BY x) AS sources FROM (SELECT l_orderkey, l_returnflag AS x FROM lineitem UNION SELECT l_orderkey, l_linestatus FROM lineitem UNION SELECT o_orderkey, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1""",
)
def set2_merged_sources(spark, sf_dir):
    """The flags of an order's lines and its own status as one set."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    both = lists.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_orderstatus").alias("c")), "l_orderkey", "left")
    return both.select("l_orderkey", F.array_join(F.array_sort(C.union_of(F.col("a"), F.col("b"), F.col("c"))), ",").alias("sources"))


@query(
    "bt2_retractions",
    """WITH r AS (SELECT l_orderkey AS id, 'op' || l_orderkey || l_returnflag AS op, l_shipdate AS tx FROM lineitem WHERE l_returnflag = 'R'),
    k AS (SELECT id, op, min(tx) AS tx FROM r WHERE id IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2)
    SELECT id AS fact_version_id, tx AS transaction_at, sha256('fact-retraction|' || op) AS transition_id FROM k""",
)
def bt2_retractions(spark, sf_dir):
    """A line sent back asks to retract its order; an order is retracted once."""
    asked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fact_version_id"), F.concat(F.lit("op"), F.col("l_orderkey").cast("string"), F.col("l_returnflag")).alias("operation_key"), F.col("l_shipdate").alias("transaction_at"))
    none = asked.limit(0).select("operation_key")
    out = bitemporal.retract(asked, _versions(spark, sf_dir), none)
    return out.select("fact_version_id", "transaction_at", "transition_id")


@query(
    "st1_minute_counts",
    """SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n_requests, least(count(*), 1) AS n_authorized, greatest(count(*) - 1, 0) AS n_limited
    FROM events WHERE ts IS NOT NULL GROUP BY 1, 2 HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 5 MINUTE""",
)
def st1_minute_counts(spark, sf_dir):
    """Requests of each event type and minute as a stream; the last minutes stay open behind the watermark."""
    stream = jobs.read_stream(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.run_available(jobs.minute_counts(stream, "event_type", "ts", 1), "minutes")


@query(
    "st6_late_facts",
    """SELECT o_orderkey AS fact_version_id, o_custkey AS entity_id, coalesce(o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM orders""",
)
def st6_late_facts(spark, sf_dir):
    """Facts as a stream that is only appended to; keys grow with arrival, so a fact whose date lies before an earlier one is late, and stays."""
    stream = jobs.read_stream(spark, f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("fact_version_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("valid_from"))
    kept = jobs.run_available(stream, "facts")
    earlier = Window.partitionBy("entity_id").orderBy("fact_version_id").rowsBetween(Window.unboundedPreceding, -1)
    return kept.select("fact_version_id", "entity_id", F.coalesce(F.col("valid_from") < F.max("valid_from").over(earlier), F.lit(False)).alias("late"))
