"""Queries of identity, provenance, governance, ingest and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import governance, identity, provenance
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources import ingest as sources
from factloom.streaming import jobs


@query(
    "id2_resolve_parts",
    """WITH e AS (SELECT p_brand, p_name, min(p_partkey) AS entity_id, min(p_type) AS family, min(p_size) AS version FROM part GROUP BY ALL),
    i AS (SELECT DISTINCT p_brand, p_name, p_type, p_size FROM part),
    s AS (SELECT i.*, e.entity_id, 40 + CASE WHEN e.version <= 25 AND e.p_name = i.p_name THEN 35 ELSE 0 END
        + CASE WHEN e.p_name = i.p_name THEN 20 ELSE 0 END + CASE WHEN e.family = p_type THEN 15 ELSE 0 END
        + CASE WHEN e.version = p_size THEN 15 ELSE -60 END AS score, e.version <> p_size AS conflict,
        e.version <= 25 AND e.p_name = i.p_name AS strong FROM i JOIN e ON i.p_brand = e.p_brand),
    r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next_score FROM s
      WINDOW w AS (PARTITION BY p_brand, p_name, p_type, p_size ORDER BY score DESC, entity_id)),
    d AS (SELECT *, CASE WHEN score <= 0 THEN 'create_new' WHEN conflict THEN 'rejected'
        WHEN (next_score IS NULL OR next_score < score) AND strong THEN 'auto_link' ELSE 'needs_review' END AS decision FROM r WHERE n = 1)
    SELECT p_partkey, d.score, d.decision, CASE WHEN d.decision = 'auto_link' THEN d.entity_id END AS entity_id
    FROM part JOIN d USING (p_brand, p_name, p_type, p_size)""",
)
def id2_resolve_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nothing, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    shape = lambda family, version: [F.col("p_brand").alias("provider"), nothing.alias("model_id"), no_list.alias("external_ids"), F.col("p_name").alias("name"), family.alias("family"), version.alias("version")]
    canonical = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("entity_id"), F.min("p_type").alias("t"), F.min("p_size").alias("v"))
    entities = canonical.select("entity_id", *shape(F.col("t"), F.col("v")), F.when(F.col("v") <= 25, F.array("p_name")).alias("aliases"))
    decided = identity.resolve(part.select(*shape(F.col("p_type"), F.col("p_size")), F.col("p_name").alias("key")), entities)
    own = part.select("p_partkey", F.col("p_brand").alias("provider"), F.col("p_name").alias("name"), F.col("p_type").alias("family"), F.col("p_size").alias("version"))
    return own.join(decided, ["provider", "name", "family", "version"]).select("p_partkey", "score", "decision", "entity_id")


def _places(spark, sf_dir):
    tag = lambda mark, c: F.concat(F.lit(f"{mark}:"), F.col(c))
    customers = table(spark, sf_dir, "customer").select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"))
    nations = table(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"))
    return customers, nations


@query(
    "gr2_evidence_paths",
    """SELECT 'c:' || c_custkey AS root, 'region' AS kind, 2 AS depth, 'c:' || c_custkey || '>n:' || n_nationkey || '>r:' || n_regionkey AS path
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def gr2_evidence_paths(spark, sf_dir):
    customers, nations = _places(spark, sf_dir)
    regions = nations.select(F.col("dst").alias("node"), F.lit("region").alias("kind")).distinct()
    found = provenance.evidence_paths(customers.unionByName(nations), customers.select(F.col("src").alias("root")), regions)
    return found.select("root", "kind", "depth", F.array_join("path", ">").alias("path"))


@query(
    "gr3_neighbourhood",
    """WITH e AS (SELECT DISTINCT 'n:' || n_nationkey AS n, 'r:' || n_regionkey AS r FROM nation)
    SELECT DISTINCT r AS root, r AS node, 0 AS depth FROM e UNION ALL SELECT r, n, 1 FROM e
    UNION ALL SELECT DISTINCT r, 'c:' || c_custkey, 2 FROM e JOIN customer ON n = 'n:' || c_nationkey""",
)
def gr3_neighbourhood(spark, sf_dir):
    customers, nations = _places(spark, sf_dir)
    return provenance.neighbourhood(customers.unionByName(nations), nations.select(F.col("dst").alias("root")), 2)


@query(
    "gr5_unsupported_parts",
    """WITH r AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
    c AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -700)
    SELECT 'p:' || p_partkey AS root, 'run' AS kind FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM r) UNION ALL SELECT 'p:' || p_partkey, 'certificate' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM c)""",
)
def gr5_unsupported_parts(spark, sf_dir):
    """Parts that no path over lines and orders leads to an open order (their run) or to a customer far in debt (their certificate)."""
    tag = lambda mark, c: F.concat(F.lit(f"{mark}:"), F.col(c))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = lines.select(tag("p", "l_partkey").alias("src"), tag("o", "l_orderkey").alias("dst")).unionByName(orders.select(tag("o", "o_orderkey").alias("src"), tag("c", "o_custkey").alias("dst")))
    runs = orders.where("o_orderstatus = 'P'").select(tag("o", "o_orderkey").alias("node"), F.lit("run").alias("kind"))
    certificates = table(spark, sf_dir, "customer").where("c_acctbal < -700").select(tag("c", "c_custkey").alias("node"), F.lit("certificate").alias("kind"))
    roots = table(spark, sf_dir, "part").select(tag("p", "p_partkey").alias("root"))
    found = provenance.evidence_paths(edges, roots, runs.unionByName(certificates))
    return provenance.uncovered(roots, found.select("root", "kind"), ["run", "certificate"])


@query(
    "ag6_blast_radius",
    """WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0),
    c AS (SELECT DISTINCT o_custkey FROM orders JOIN l ON o_orderkey = l_orderkey)
    SELECT 'order' AS kind, count(*) AS n_targets FROM l HAVING count(*) > 0 UNION ALL SELECT 'customer', count(*) FROM c HAVING count(*) > 0""",
)
def ag6_blast_radius(spark, sf_dir):
    bad = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return provenance.blast_radius(bad, (lines, "order"), (orders, "customer")).groupBy("kind").agg(F.count("*").alias("n_targets"))


@query(
    "gov1_order_retention",
    """WITH m AS (SELECT max(o_orderdate) - INTERVAL 1000 DAY AS cut FROM orders), s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
    r AS (SELECT o_orderkey, o_orderpriority, CASE WHEN NOT o_orderdate < cut THEN 'kept' WHEN l_orderkey IS NOT NULL THEN 'preserved' ELSE 'redacted' END AS retention
      FROM m, orders LEFT JOIN s ON o_orderkey = l_orderkey)
    SELECT o_orderkey, retention, CASE WHEN retention <> 'redacted' THEN o_orderpriority END AS o_orderpriority,
      CASE WHEN retention = 'redacted' THEN sha256(o_orderpriority) END AS o_orderpriority_sha256 FROM r""",
)
def gov1_order_retention(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    newest = F.lit(orders.agg(F.max("o_orderdate")).first()[0]).cast("timestamp")
    safe = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    out = governance.retain(orders, "o_orderdate", newest, 1000, safe, "o_orderkey", ["o_orderpriority"])
    return out.select("o_orderkey", "retention", "o_orderpriority", "o_orderpriority_sha256")


@query(
    "gov2_customer_erasure",
    """SELECT c_custkey, CASE WHEN n_regionkey <> 1 THEN c_name END AS c_name, n_regionkey = 1 AS erased
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def gov2_customer_erasure(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    out = governance.erase(table(spark, sf_dir, "customer"), nations, "c_nationkey", ["c_name", "c_acctbal"])
    return out.select("c_custkey", "c_name", F.col("tombstone").isNotNull().alias("erased"))


@query(
    "gov4_alerts",
    """SELECT 'shop:' || CASE event_type WHEN 'error' THEN 'source_outage' ELSE 'duplicate_event' END || ':' || user_id AS alert_key,
      CASE event_type WHEN 'error' THEN 'firing' ELSE 'observed' END AS status, CASE event_type WHEN 'error' THEN 'critical' ELSE 'info' END AS severity,
      CASE event_type WHEN 'error' THEN 'runbooks/source-outage.md' ELSE 'runbooks/duplicate-event.md' END AS runbook
    FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type, user_id""",
)
def gov4_alerts(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    kind = F.when(F.col("event_type") == "error", "source_outage").otherwise("duplicate_event")
    signals = events.select(F.lit("shop").alias("scope"), kind.alias("kind"), F.col("user_id").cast("string").alias("resource"), F.lit("info").alias("severity"), F.col("ts").alias("observed_at"))
    return governance.alerts(signals).select("alert_key", "status", "severity", "runbook")


@query(
    "wn6_delivery_states",
    """WITH a AS (SELECT user_id, count(*) AS n_attempts, max_by(event_type, (ts, event_id)) AS t FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
    s AS (SELECT user_id, n_attempts, CASE WHEN t = 'purchase' THEN 'delivered' WHEN t = 'error' OR n_attempts >= 40 THEN 'dead_letter' ELSE 'retrying' END AS state FROM a)
    SELECT user_id, n_attempts, state, CASE WHEN state = 'retrying' THEN [60, 300, 1800, 7200, 43200, 86400][least(n_attempts, 6)] END::BIGINT AS wait_seconds FROM s""",
)
def wn6_delivery_states(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "permanent_failure").otherwise("failure")
    attempts = table(spark, sf_dir, "events").where("user_id is not null").withColumn("outcome", outcome)
    return governance.delivery_states(attempts, "user_id", "ts", "event_id", 40)


@query(
    "ag11_freshness_report",
    """WITH m AS (SELECT max(o_orderdate) AS now FROM orders), l AS (SELECT o_orderpriority, o_orderdate FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    f AS (SELECT o_orderpriority, epoch(now) - epoch(o_orderdate) > 86400 * 90 AS stale FROM l, m)
    SELECT o_orderpriority, count(*) AS n_released, count(*) FILTER (NOT stale) AS n_fresh, count(*) FILTER (stale) AS n_stale,
      round(100.0 * count(*) FILTER (NOT stale) / count(*), 4) AS fresh_percent FROM f GROUP BY o_orderpriority""",
)
def ag11_freshness_report(spark, sf_dir):
    from factloom.operators import facts

    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0]).cast("timestamp")
    newest = facts.latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return governance.freshness_report(facts.freshness(newest, "o_orderdate", F.lit(86400 * 90), now), "o_orderpriority")


@query(
    "ag1_benchmark_summary",
    """WITH r AS (SELECT source AS system, CASE doc_id % 3 WHEN 0 THEN 'held_out' WHEN 1 THEN 'negative_control' ELSE 'visible' END AS v,
      quality = 1 AS ok, toxic = 1 AS bad FROM labels JOIN documents USING (doc_id))
    SELECT system, count(*) AS n_cases, count(*) FILTER (ok) AS n_passed,
      coalesce(count(*) FILTER (v = 'negative_control' AND bad) / nullif(count(*) FILTER (v = 'negative_control'), 0), 0) AS false_heal_rate,
      count(*) FILTER (v = 'held_out' AND ok) / nullif(count(*) FILTER (v = 'held_out'), 0) AS held_out_pass_rate,
      count(*) FILTER (bad) AS n_false_releases FROM r GROUP BY system""",
)
def ag1_benchmark_summary(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    visibility = F.when(F.col("doc_id") % 3 == 0, "held_out").when(F.col("doc_id") % 3 == 1, "negative_control").otherwise("visible")
    bad = F.col("toxic") == 1
    rows = cases.select(F.col("source").alias("system"), visibility.alias("visibility"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("outcome"), bad.alias("false_heal"), bad.alias("false_release"))
    return governance.benchmark_summary(rows)


@query(
    "st1_request_verdicts",
    """WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id % 5, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, user_id, CASE WHEN n <= 1 THEN 'authorized' ELSE 'rate_limited' END AS verdict, greatest(0, 1 - n) AS remaining FROM n""",
)
def st1_request_verdicts(spark, sf_dir):
    requests = table(spark, sf_dir, "events").withColumn("tenant", F.col("user_id") % 5)
    return governance.request_verdicts(requests, "tenant", "ts", "event_id", 1).select("event_id", "user_id", "verdict", "remaining")


@query(
    "src4_page_fields",
    r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, nullif(regexp_extract(html, '<html[^>]* lang="([a-z-]+)"', 1), '') AS lang,
      nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '') AS heading,
      len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""",
)
def src4_page_fields(spark, sf_dir):
    return sources.page_fields(table(spark, sf_dir, "pages"))


@query(
    "src5_idempotent_ingest",
    """WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
    n AS (SELECT l_orderkey, l_linenumber, l_returnflag, o_orderkey, row_number() OVER w AS n, first_value(l_returnflag) OVER w AS f
      FROM lineitem LEFT JOIN s ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
    SELECT CASE WHEN o_orderkey IS NULL AND n = 1 THEN 'accepted'
      WHEN l_returnflag = CASE WHEN o_orderkey IS NULL THEN f ELSE 'R' END THEN 'duplicate' ELSE 'rejected' END AS ingest_state, count(*) AS n FROM n GROUP BY 1""",
)
def src5_idempotent_ingest(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("R").alias("l_returnflag"))
    out = sources.ingest(table(spark, sf_dir, "lineitem"), stored, "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.groupBy("ingest_state").agg(F.count("*").alias("n"))


@query("st2_streaming_ingest", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def st2_streaming_ingest(spark, sf_dir):
    stream = jobs.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_available(jobs.deduplicated(stream, ["event_id"], "ts").select("event_id", "user_id", "event_type"), "ingested")


@query(
    "st7_streaming_deliveries",
    """WITH s AS (SELECT n_nationkey AS subscription_id, unnest(['error', CASE WHEN n_regionkey = 0 THEN 'signup' ELSE 'purchase' END]) AS event_type FROM nation)
    SELECT subscription_id || ':' || event_id AS delivery_key, event_id FROM events JOIN s USING (event_type)""",
)
def st7_streaming_deliveries(spark, sf_dir):
    kinds = F.array(F.lit("error"), F.when(F.col("n_regionkey") == 0, "signup").otherwise("purchase"))
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subscription_id"), kinds.alias("kinds"))
    queue = jobs.deliveries(jobs.read_stream(spark, f"{sf_dir}/events.parquet"), wanted)
    return jobs.run_available(queue.select("delivery_key", "event_id"), "deliveries")
