"""Queries of release decisions, gates, rules and event states."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import release
from factloom.plans.registry import query
from factloom.session import table


@query(
    "dq2_semantic_price",
    """WITH p AS (SELECT p_partkey, p_retailprice AS o, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice ELSE p_retailprice / 12 END AS m, p_retailprice + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS a,
      p_retailprice + CASE WHEN p_partkey % 15 = 0 THEN 1 ELSE 0 END AS b, p_partkey % 4 = 0 OR p_partkey % 9 = 0 OR p_partkey % 7 = 0 AS swapped,
      CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice * CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 1.25 END END AS pv FROM part),
    v AS (SELECT *, abs(a - b) > 0.01 AS d, abs(o - a) > 0.01 OR abs(o - b) > 0.01 AS x, coalesce(abs(o - pv) / pv >= 0.5, false) AS h FROM p),
    r AS (SELECT *, CASE WHEN swapped OR d OR x THEN 'quarantined' WHEN h THEN 'needs_review' ELSE 'verified' END AS decision FROM v)
    SELECT p_partkey, decision, concat_ws(',', CASE WHEN swapped THEN 'semantic_swap' END, CASE WHEN d THEN 'source_disagreement' END, CASE WHEN x THEN 'independent_source_mismatch' END, CASE WHEN h THEN 'historical_delta' END) AS violations,
      CASE WHEN decision = 'verified' THEN o ELSE pv END AS released_value, CASE WHEN decision = 'verified' THEN 'verified' WHEN pv IS NOT NULL THEN 'stale' ELSE decision END AS proof_state,
      CASE WHEN NOT coalesce(o < pv, false) THEN 'not_triggered' WHEN decision = 'verified' THEN 'sent' ELSE 'blocked' END AS alert FROM r""",
)
def dq2_semantic_price(spark, sf_dir):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    context = F.concat(F.initcap("p_type"), F.when(k % 4 != 0, F.lit(" ONE-TIME")).otherwise(F.lit(" each")), F.when(k % 9 == 0, F.lit(" per Month")).otherwise(F.lit("")))
    prices = table(spark, sf_dir, "part").select(
        "p_partkey",
        price.alias("observed"),
        F.when(k % 7 == 0, price).otherwise(price / 12).alias("monthly"),
        (price + F.when(k % 10 == 0, 1).otherwise(0)).alias("channel_a"),
        (price + F.when(k % 15 == 0, 1).otherwise(0)).alias("channel_b"),
        context.alias("context"),
        F.when(k % 6 != 0, price * F.when(k % 5 == 0, 4.0).otherwise(1.25)).alias("previous"),
    )
    out = release.price_contract(prices)
    return out.select("p_partkey", "decision", F.array_join("violations", ",").alias("violations"), "released_value", "proof_state", "alert")


@query(
    "dq6_page_risk",
    r"""WITH h AS (SELECT page_id, html, regexp_matches(html, '(?i)aria-label|purchase-heading|one-time|buy now') AS a, regexp_matches(html, '(?i)jsonld|product_api|tag_response') AS b,
      regexp_matches(html, '(?i)monthly|financing|purchase_context|nearby_text') AS c, regexp_matches(html, '(?i)nth-child|nth-of-type') AS d, regexp_matches(html, '(?i)\._?next|__[A-Za-z0-9_-]{5,}|class\*?=') AS e,
      regexp_matches(html, '(?i)\$\("body"\)|document\.body|first\(\).*\d') AS f FROM pages),
    s AS (SELECT *, 25 * coalesce(a, false)::INT + 25 * coalesce(b, false)::INT + 20 * coalesce(c, false)::INT - 20 * coalesce(d, false)::INT - 15 * coalesce(e, false)::INT - 20 * coalesce(f, false)::INT AS risk_score FROM h)
    SELECT page_id, risk_score, CASE WHEN coalesce(html, '') = '' THEN 'deferred' WHEN risk_score >= 40 THEN 'pass' ELSE 'needs_review' END AS risk_status,
      concat_ws(',', CASE WHEN a THEN 'semantic_anchor' END, CASE WHEN b THEN 'structured_source' END, CASE WHEN c THEN 'context_validation' END, CASE WHEN d THEN 'positional_selector' END, CASE WHEN e THEN 'generated_class' END, CASE WHEN f THEN 'broad_number' END) AS matched_rules FROM s""",
)
def dq6_page_risk(spark, sf_dir):
    return release.risk_score(table(spark, sf_dir, "pages"), "html").select("page_id", "risk_score", "risk_status", F.array_join("matched_rules", ",").alias("matched_rules"))


@query(
    "dq1_observation_checks",
    """WITH d AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(turn ORDER BY turn, role, text) AS turns, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS body, count(*) AS n FROM conversations GROUP BY conv_id),
    v AS (SELECT *, conv_id % 4 = 0 AS a, conv_id % 5 <> 0 AND list_has_any(roles, ['system', 'tool', 'assistant']) AS b, len(list_distinct(list_transform(list_zip(roles, turns), lambda x: x[1] || ':' || x[2]))) <> n AS c, conv_id % 3 = 0 AS e FROM d)
    SELECT conv_id, CASE WHEN a OR b OR c OR e THEN 'quarantined' ELSE 'verified' END AS decision,
      concat_ws(',', CASE WHEN a THEN 'source_policy_mismatch' END, CASE WHEN b THEN 'record_type_mismatch' END, CASE WHEN c THEN 'duplicate_source_key' END, CASE WHEN e THEN 'evidence_hash_mismatch' END) AS violations FROM v""",
)
def dq1_observation_checks(spark, sf_dir):
    cid = F.col("conv_id")
    item = F.struct("turn", "role", "text")
    # Conversations are bounded records; each becomes one nested observation.
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    contexts = F.transform("items", lambda i: F.coalesce(i["text"], F.lit("")))
    digest = F.sha2(F.array_join("contexts", "\n"), 256)
    observations = nested.select(
        "conv_id",
        F.when(cid % 5 == 0, "any").otherwise("chat").alias("source_type"),
        F.concat(F.lit("https://Chat.example/"), F.when(cid % 4 == 0, "private").otherwise("threads/1")).alias("url"),
        F.transform("items", lambda i: F.struct(i["role"].alias("kind"), i["turn"].alias("key"))).alias("records"),
        contexts.alias("contexts"),
    ).withColumn("content_hash", F.when(cid % 3 != 0, digest).otherwise("-"))
    kinds = spark.createDataFrame([("chat", "chat.example", "user", ["/threads/"]), ("any", "chat.example", None, ["/threads/"])], "source_type string, host string, kind string, prefixes array<string>")
    return release.check_observations(observations, kinds).select("conv_id", "decision", F.array_join("violations", ",").alias("violations"))


@query(
    "pf10_order_eligibility",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'settled' END, CASE WHEN NOT coalesce(o_totalprice < 200000, false) THEN 'within_quota' END, CASE WHEN NOT coalesce(c_acctbal > 0, false) THEN 'funded' END,
      CASE WHEN coalesce(c_mktsegment = 'BUILDING', true) THEN 'segment_open' END) AS failed FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def pf10_order_eligibility(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(people, "o_custkey", "left")
    checks = {"settled": F.col("o_orderstatus") != "P", "within_quota": F.col("o_totalprice") < 200000, "funded": F.col("c_acctbal") > 0, "segment_open": F.col("c_mktsegment") != "BUILDING"}
    return release.failed_conditions(rows, checks).select("o_orderkey", F.array_join("failed", ",").alias("failed"))


@query(
    "ag15_release_eligibility",
    """WITH f AS (SELECT o_custkey, count(*) AS n_cases, count(*) FILTER (o_totalprice >= 60000) AS n_passed, count(*) FILTER (o_totalprice > 440000) AS n_critical, bool_or(o_orderpriority[1] = '5') AS h,
      bool_or(o_orderstatus = 'O' AND o_totalprice >= 60000) AS a, bool_or(o_orderstatus = 'F' AND o_totalprice >= 60000) AS b FROM orders GROUP BY 1)
    SELECT o_custkey, n_cases, n_passed, n_critical, concat_ws(',', CASE WHEN NOT a THEN 'O' END, CASE WHEN NOT b THEN 'F' END) AS missing, a AND b AND h AND n_critical = 0 AS can_release FROM f""",
)
def ag15_release_eligibility(spark, sf_dir):
    price = F.col("o_totalprice")
    out = release.stage_gate(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", price >= 60000, F.substring("o_orderpriority", 1, 1) == "5", price > 440000, ["O", "F"])
    return out.withColumn("missing", F.array_join("missing", ","))


@query(
    "ag3_fleet_summary",
    """WITH r AS (SELECT source, lang AS kind, quality = 1 AS ok, doc_id % 4 AS e, doc_id % 4 + toxic AS o, doc_id % 3 = 0 AS held, n_chars AS ms FROM documents JOIN labels USING (doc_id)), g AS (SELECT *, ok AND e = o AS good FROM r)
    SELECT source, count(*) AS n_cases, count(*) FILTER (good) AS n_passed, count(*) FILTER (e <> o) AS n_false_events, CAST(sum(ms) AS BIGINT) AS total_ms, count(DISTINCT kind) AS n_kinds,
      coalesce(sum(least(e, o)) / nullif(sum(o), 0), 1) AS precision, coalesce(sum(least(e, o)) / nullif(sum(e), 0), 1) AS recall,
      count(*) FILTER (held) > 0 AND count(*) FILTER (held AND NOT good) = 0 AS held_out_passed, count(*) FILTER (held) > 0 AND count(*) FILTER (NOT good) = 0 AS passed FROM g GROUP BY source""",
)
def ag3_fleet_summary(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("kind"), F.col("n_chars").alias("duration_ms")).join(table(spark, sf_dir, "labels"), "doc_id")
    results = cases.select("source", "kind", "duration_ms", (F.col("quality") == 1).alias("passed"), (F.col("doc_id") % 4).alias("expected"), (F.col("doc_id") % 4 + F.col("toxic")).alias("observed"), (F.col("doc_id") % 3 == 0).alias("held_out"))
    return release.fleet_summary(results, "source")


@query(
    "cdc5_semantic_events",
    """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice) END AS b, CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice) + CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE o_orderkey % 2 END END AS a,
      o_orderkey % 17 = 0 AS c, CASE o_orderkey % 8 WHEN 1 THEN 'correction' WHEN 2 THEN 'rename' WHEN 4 THEN 'removal' WHEN 5 THEN 'deprecation' END AS i, o_orderkey % 6 = 0 AS x, o_orderkey % 4 AS n, o_orderkey % 3 = 0 AS look FROM orders),
    e AS (SELECT *, CASE WHEN c THEN 'source_conflict_started' WHEN a IS NULL THEN NULL WHEN coalesce(abs(a - b) <= 1, false) THEN CASE WHEN look THEN 'presentation_drift' END
      WHEN (coalesce(i = 'removal', false) OR x) AND NOT (n >= 2 AND x) THEN NULL WHEN b IS NULL THEN 'fact_created' WHEN i = 'correction' THEN 'fact_corrected' WHEN i = 'rename' THEN 'entity_renamed' WHEN i = 'deprecation' THEN 'entity_deprecated'
      WHEN i = 'removal' OR x THEN 'fact_removed' ELSE 'fact_updated' END AS event_type FROM b)
    SELECT k, event_type, event_type IS NOT NULL AND event_type <> 'presentation_drift' AS business_event,
      CASE WHEN event_type IS NOT NULL THEN sha256(k || '|' || event_type || '|' || coalesce(b::BIGINT::VARCHAR, '') || '|' || coalesce(a::BIGINT::VARCHAR, '')) END AS event_id FROM e""",
)
def cdc5_semantic_events(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    step = F.when(k % 4 == 0, 50).otherwise(k % 2)
    intent = F.when(k % 8 == 1, "correction").when(k % 8 == 2, "rename").when(k % 8 == 4, "removal").when(k % 8 == 5, "deprecation")
    changes = table(spark, sf_dir, "orders").select(
        k.alias("k"),
        F.when(k % 9 != 0, price).alias("before_value"),
        F.when(k % 13 != 0, price + step).alias("after_value"),
        (k % 17 == 0).alias("conflicted"),
        intent.alias("intent"),
        (k % 6 == 0).alias("explicit_removal"),
        (k % 4).alias("n_absences"),
        F.lit(None).cast("boolean").alias("approved"),
        F.lit("a").alias("before_look"),
        F.when(k % 3 == 0, "b").otherwise("a").alias("after_look"),
    )
    out = release.semantic_events(changes, ["k"], F.abs(F.col("after_value") - F.col("before_value")) <= 1)
    return out.select("k", "event_type", "business_event", "event_id")


@query(
    "cdc8_corrected_events",
    """WITH o AS (SELECT l_partkey * 10 + l_linenumber AS op, min((l_shipdate, l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_partkey END)) AS r FROM lineitem GROUP BY 1),
    f AS (SELECT r[2] AS id, min((r[1], op, r[3])) AS r FROM o GROUP BY 1)
    SELECT o_orderkey AS event_id, CASE WHEN f.id IS NULL THEN 'released' WHEN f.r[3] IS NULL THEN 'retracted' ELSE 'corrected' END AS state, f.r[3] AS corrected_value FROM orders LEFT JOIN f ON o_orderkey = f.id""",
)
def cdc8_corrected_events(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("value"))
    lines = table(spark, sf_dir, "lineitem")
    operations = lines.select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("operation_id"), F.col("l_orderkey").alias("event_id"), F.col("l_shipdate").alias("at"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("value"))
    states, fixed = release.retract_and_correct(events, operations)
    return states.join(fixed.select(F.col("corrects").alias("event_id"), F.col("value").alias("corrected_value")), "event_id", "left").select("event_id", "state", "corrected_value")


@query(
    "jn7_first_rules",
    """WITH r AS (SELECT (n_nationkey * 7 + 24) % 25 AS n, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS a, CASE n_nationkey % 4 WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'HOUSEHOLD' END AS b, 100 - n_nationkey AS p FROM nation)
    SELECT c_custkey, (SELECT arg_min(p, n) FROM r WHERE (a IS NULL OR a = c_nationkey) AND (b IS NULL OR b = c_mktsegment)) AS rule_priority FROM customer""",
)
def jn7_first_rules(spark, sf_dir):
    n = F.col("n_nationkey")
    segment = F.when(n % 4 == 1, "BUILDING").when(n % 4 == 2, "MACHINERY").when(n % 4 == 3, "HOUSEHOLD")
    rules = table(spark, sf_dir, "nation").select(((n * 7 + 24) % 25).alias("ordinal"), F.when(n % 3 != 0, n).alias("c_nationkey"), segment.alias("c_mktsegment"), (100 - n).alias("rule_priority"))
    return release.first_rule(table(spark, sf_dir, "customer"), rules, ["c_nationkey", "c_mktsegment"], "ordinal", ["rule_priority"]).select("c_custkey", "rule_priority")


@query(
    "jn3_key_chain",
    """WITH x AS (SELECT p_partkey AS k, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_size <= 10 GROUP BY 1), a AS (SELECT p_name AS k, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_type = 'PROMO' GROUP BY 1),
    c AS (SELECT p_type AS k, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_size > 40 GROUP BY 1),
    j AS (SELECT p_partkey, CASE WHEN x.k IS NOT NULL THEN 1 WHEN a.k IS NOT NULL THEN 2 WHEN c.k IS NOT NULL THEN 3 END AS level, coalesce(x.lo, a.lo, c.lo) AS lo, CASE WHEN x.k IS NOT NULL THEN x.hi WHEN a.k IS NOT NULL THEN a.hi ELSE c.hi END AS hi
      FROM part LEFT JOIN x ON p_partkey = x.k LEFT JOIN a ON p_name = a.k LEFT JOIN c ON p_type = c.k)
    SELECT p_partkey, level, CASE WHEN lo = hi THEN lo END AS entity_id, CASE WHEN level IS NULL THEN 'new' WHEN lo <> hi THEN 'ambiguous' ELSE 'linked' END AS state FROM j""",
)
def jn3_key_chain(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = lambda rows, column: (column, rows.select(column, F.col("p_size").alias("entity_id")))
    levels = [known(part.where("p_size <= 10"), "p_partkey"), known(part.where("p_type = 'PROMO'"), "p_name"), known(part.where("p_size > 40"), "p_type")]
    return release.resolve_keys(part.select("p_partkey", "p_name", "p_type"), levels).select("p_partkey", "level", "entity_id", "state")


@query(
    "cdc12_proposals",
    """WITH n AS (SELECT l_orderkey, count(*) FILTER (l_quantity >= 20) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS event_id, CASE o_orderpriority[1] WHEN '1' THEN 'add' WHEN '2' THEN 'deprecate' WHEN '3' THEN 'update' ELSE 'review' END AS action
    FROM orders JOIN n ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND n > 0""",
)
def cdc12_proposals(spark, sf_dir):
    level = F.substring("o_orderpriority", 1, 1)
    kind = F.when(level == "1", "fact_created").when(level == "2", "entity_deprecated").when(level == "3", "fact_corrected").otherwise("entity_renamed")
    evidence = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") >= 20).alias("n_evidence"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("event_type"), F.when(F.col("o_orderstatus") != "P", "released").alias("state"))
    return release.proposals(orders.join(evidence, "o_orderkey").withColumnRenamed("o_orderkey", "event_id"))


@query(
    "cdc11_resolved_conflicts",
    """WITH c AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1),
    r AS (SELECT l_partkey, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS resolution FROM lineitem GROUP BY 1)
    SELECT l_partkey, resolution, CASE WHEN resolution IS NULL THEN 'open' ELSE 'resolved' END AS status FROM c LEFT JOIN r USING (l_partkey)""",
)
def cdc11_resolved_conflicts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    conflicts = lines.groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n > 1").select("l_partkey")
    verdicts = lines.withColumn("tie", F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return release.apply_resolutions(conflicts, verdicts, "l_partkey", "l_shipdate", "tie", "l_suppkey").select("l_partkey", "resolution", "status")
