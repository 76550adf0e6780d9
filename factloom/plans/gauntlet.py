"""Queries of gauntlet scores and public shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import gauntlet, visibility
from factloom.plans.registry import query
from factloom.session import table


@query(
    "ag4_case_runs",
    """WITH r AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS c, l_returnflag <> 'R' AS ok, l_tax > 0.06 AS critical, l_discount > 0.095 AS heal, l_quantity > 49.5 AS release, l_linestatus IS NOT NULL AS kept FROM lineitem)
    SELECT l_partkey, count(*) AS n_results, count(DISTINCT c) AS n_distinct, count(*) FILTER (ok) AS n_passed, count(*) FILTER (critical AND NOT ok) AS n_critical, count(*) FILTER (heal) AS n_false_heals, count(*) FILTER (release) AS n_false_releases,
      CASE WHEN count(*) <> 30 OR count(DISTINCT c) <> 30 THEN 'incomplete' WHEN count(*) FILTER (ok) = 30 AND count(*) FILTER (critical AND NOT ok) + count(*) FILTER (heal) + count(*) FILTER (release) = 0 AND bool_and(kept) THEN 'completed' ELSE 'failed' END AS status
    FROM r GROUP BY l_partkey""",
)
def ag4_case_runs(spark, sf_dir):
    """The lines of a part are the cases of its run, of which there should be thirty."""
    results = table(spark, sf_dir, "lineitem").select(
        "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.when(F.col("l_returnflag") != "R", "pass").otherwise("fail").alias("outcome"), (F.col("l_tax") > 0.06).alias("critical"),
        (F.col("l_discount") > 0.095).alias("false_heal"), (F.col("l_quantity") > 49.5).alias("false_release"), F.col("l_linestatus").isNotNull().alias("preserved"),
    )
    return gauntlet.case_runs(results, "l_partkey", 30)


_RATE = lambda among: f"coalesce(count(*) FILTER ({among} AND ok) / nullif(count(*) FILTER ({among}), 0), 1.0)"


@query(
    "ag2_fleet_metrics",
    f"""WITH c AS (SELECT p_partkey AS case_id, p_size % 3 = 0 AS held, p_size % 4 = 0 AS critical, p_type AS kind, CASE WHEN p_size > 25 THEN [p_type, 'N'] ELSE ['N'] END AS wanted FROM part),
    r AS (SELECT l_suppkey, l_partkey AS case_id, l_returnflag <> 'R' AND l_tax < 0.08 AND l_discount < 0.1 AND l_quantity > 2 AND l_quantity < 50 AS ok, l_quantity <= 2 AS heal, l_quantity >= 50 AS false_event, [l_returnflag, p_type] AS emitted, CASE WHEN l_returnflag = 'A' THEN l_quantity * 10 END AS ms FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
    j AS (SELECT r.*, held, critical, kind, len(list_filter(emitted, lambda e: list_contains(wanted, e))) AS hits, len(emitted) AS n FROM r LEFT JOIN c USING (case_id))
    SELECT l_suppkey, false AS complete, {_RATE("critical")} AS catch_rate, {_RATE("kind = 'ECONOMY'")} AS triage_rate, count(*) FILTER (heal) / count(*) AS false_heal_rate, {_RATE("held")} AS held_out_rate, {_RATE("kind = 'PROMO'")} AS identity_precision,
      coalesce(sum(hits) / nullif(sum(n), 0), 1.0) AS event_precision, coalesce(sum(hits) / (SELECT sum(len(wanted)) FROM c), 1.0) AS event_recall, {_RATE("kind = 'LARGE'")} AS correction_accuracy, count(*) FILTER (false_event) AS n_false_events,
      coalesce(avg(ms), 0.0) AS recovery_ms, count(*) FILTER (NOT heal) / count(*) AS availability, CASE WHEN count(*) FILTER (NOT ok) = 0 AND count(*) FILTER (false_event) = 0 THEN 1 ELSE 0 END AS fresh
    FROM j GROUP BY l_suppkey""",
)
def ag2_fleet_metrics(spark, sf_dir):
    """Parts are the cases of one suite; the lines of a supplier are the results of its run, none of which covers all parts once."""
    part = table(spark, sf_dir, "part")
    relation = F.when(F.col("p_type") == "ECONOMY", "quarantine").otherwise("equal")
    category = F.when(F.col("p_type") == "PROMO", "identity").when(F.col("p_type") == "LARGE", "semantic_decoy").otherwise("structural")
    cases = part.select(
        F.lit(1).alias("suite"), F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") % 3 == 0, "held_out").otherwise("visible").alias("visibility"), (F.col("p_size") % 4 == 0).alias("critical"), category.alias("category"),
        relation.alias("expected_relation"), F.when(F.col("p_size") > 25, F.array("p_type", F.lit("N"))).otherwise(F.array(F.lit("N"))).alias("expected_events"),
    )
    lines = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey", "left")
    results = lines.select(
        F.lit(1).alias("suite"), "l_suppkey", F.col("l_partkey").alias("case_id"), F.when(F.col("l_returnflag") != "R", "pass").otherwise("fail").alias("outcome"), (F.col("l_tax") < 0.08).alias("extraction_ok"), (F.col("l_discount") < 0.1).alias("event_ok"),
        (F.col("l_quantity") <= 2).alias("false_heal"), (F.col("l_quantity") >= 50).alias("false_event"), F.array("l_returnflag", "p_type").alias("emitted_events"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 10).alias("recovery_ms"),
    )
    return gauntlet.fleet_metrics(cases, results, "suite", "l_suppkey")


@query(
    "ag3_fleet_suites",
    """WITH r AS (SELECT o_custkey, o_orderpriority[1] AS kind, coalesce(o_totalprice > 60000, false) AS ex, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END = 1 AS matched, o_orderpriority[1] = '1' AS held, o_orderstatus = 'F' AS reg, o_orderkey % 50 AS ms FROM orders)
    SELECT o_custkey, count(*) AS n_cases, count(*) FILTER (ex AND matched) AS n_passed, count(*) FILTER (NOT matched) AS n_false_events, avg(ms) AS mean_ms,
      concat_ws(',', CASE WHEN NOT bool_or(kind = '1') THEN '1' END, CASE WHEN NOT bool_or(kind = '5') THEN '5' END) AS missing_kinds, bool_or(held) AND NOT coalesce(bool_or(NOT (ex AND matched)) FILTER (held), false) AS held_out_passed, bool_or(reg AND ex AND matched) AS regression_passed,
      bool_or(kind = '1') AND bool_or(kind = '5') AND bool_and(ex AND matched) AND bool_or(held) AND bool_or(reg AND ex AND matched) AS passed FROM r GROUP BY o_custkey""",
)
def ag3_fleet_suites(spark, sf_dir):
    """The orders of a customer are its suite; priorities are kinds, of which the first and the last are required."""
    level = F.substring("o_orderpriority", 1, 1)
    results = table(spark, sf_dir, "orders").select(
        "o_custkey", level.alias("kind"), (F.col("o_totalprice") > 60000).alias("extraction_ok"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("observed_events"), F.lit(1).alias("expected_events"), (level == "1").alias("held_out"),
        F.when(F.col("o_orderstatus") == "F", "product_pricing").alias("regression_suite"), (F.col("o_orderkey") % 50).alias("duration_ms"),
    )
    return gauntlet.fleet_suites(results, "o_custkey", ("1", "5")).withColumn("missing_kinds", F.array_join("missing_kinds", ","))


@query(
    "src7_public_events",
    """WITH e AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS event_type, o_custkey::VARCHAR AS entity_id, coalesce(n, 0) AS evidence_count, sha256(o_orderkey || '|' || o_orderpriority || '|' || o_custkey || '|') AS event_hash
    FROM orders LEFT JOIN e ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""",
)
def src7_public_events(spark, sf_dir):
    state, none = F.when(F.col("o_orderstatus") == "F", "released").otherwise("withheld"), F.lit(None).cast("string")
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"), F.col("o_custkey").alias("entity_id"), none.alias("predicate"), state.alias("state"), F.col("o_orderdate").alias("observed_at"), none.alias("certificate_id"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("evidence_ref"))
    return visibility.public_events(events, evidence).select("id", "event_type", "entity_id", F.col("trust.evidence_count").alias("evidence_count"), "event_hash")


@query(
    "src7_public_conflicts",
    """WITH r AS (SELECT l_partkey, max((l_shipdate, l_orderkey)) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT p_partkey::VARCHAR AS id, p_brand AS entity_id, CASE WHEN r IS NULL THEN 'open' ELSE 'resolved' END AS status, r[2]::VARCHAR AS released_fact_version_id FROM part LEFT JOIN r ON p_partkey = l_partkey""",
)
def src7_public_conflicts(spark, sf_dir):
    conflicts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("conflict_id"), F.col("p_brand").alias("entity_id"), F.col("p_type").alias("predicate"), F.col("p_name").alias("reason"), F.array("p_partkey", "p_size").alias("observation_ids"), F.lit(0).alias("opened_at"))
    resolutions = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("conflict_id"), F.col("l_orderkey").alias("fact_version_id"), F.col("l_shipdate").alias("at"))
    return visibility.public_conflicts(conflicts, resolutions).select("id", "entity_id", "status", "released_fact_version_id")


@query(
    "src7_public_sources",
    """WITH m AS (SELECT max(l_shipdate) AS now FROM lineitem), h AS (SELECT l_suppkey, max(l_shipdate) FILTER (l_linestatus = 'F' AND l_quantity > 45) AS seen, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT s_suppkey::VARCHAR AS id, s_name AS name, CASE WHEN n IS NULL THEN 'draft' WHEN n % 2 = 0 THEN 'healthy' ELSE 'cooling' END AS status, CASE WHEN seen IS NULL THEN 'unknown' WHEN now > seen + INTERVAL 1200 HOUR THEN 'stale' ELSE 'fresh' END AS freshness
    FROM m, supplier LEFT JOIN h ON s_suppkey = l_suppkey""",
)
def src7_public_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    seen = F.max(F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), F.col("l_shipdate"))).cast("timestamp")
    health = lines.groupBy(F.col("l_suppkey").alias("source_id")).agg(seen.alias("last_success_at"), F.when(F.count("*") % 2 == 0, "healthy").otherwise("cooling").alias("state"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.lit("draft").alias("lifecycle"), F.lit("catalog").alias("source_type"))
    now = F.lit(lines.agg(F.max(F.col("l_shipdate").cast("timestamp"))).first()[0]).cast("timestamp")
    return visibility.public_sources(sources, health, now, 1200).select("id", "name", "status", "freshness")
