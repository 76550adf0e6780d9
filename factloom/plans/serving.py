"""Queries of visibility, intake, certification, triage and schema operators.

Facts are taken from orders: an order is a version of the fact "priority" of a
customer, its lines are the supporting observations of their suppliers, and
finished lines are its evidence.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import certify, health, identity, intake, visibility
from factloom.plans.registry import query
from factloom.session import table

_STATE = "CASE WHEN o_totalprice < 20000 THEN 'retracted' WHEN o_orderstatus = 'F' THEN 'released' WHEN o_orderstatus = 'P' THEN 'conflicted' ELSE 'quarantined' END"


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_version_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("predicate"), F.expr(_STATE).alias("state"),
        F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("transaction_from"),
    )


def _support(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_version_id"), F.col("l_suppkey").alias("source_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("ref"), "l_linestatus", "l_returnflag")
    return lines, lines.where("l_linestatus = 'F'").select("fact_version_id", F.col("ref").alias("evidence_ref"))


def _projected(spark, sf_dir):
    """Current facts of every customer and priority, evaluated two years after the last decision on any."""
    versions = _versions(spark, sf_dir)
    current = visibility.project(versions, ["entity_id", "predicate"])
    own = versions.select(F.col("fact_version_id").alias("current_version_id"), "value", "transaction_from", F.col("state").alias("version_state"))
    newest = F.lit(versions.agg(F.max("transaction_from")).first()[0]).cast("timestamp")
    facts = current.join(own, "current_version_id", "left").withColumnRenamed("current_version_id", "fact_version_id")
    return visibility.materialized(facts, newest, F.col("transaction_from") + F.expr("INTERVAL 730 DAY"), F.col("value") >= 50000)


_PROJECTED = f"""v AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate, {_STATE} AS st FROM orders),
    d AS (SELECT o_custkey AS entity_id, o_orderpriority AS predicate,
        arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (st IN ('released', 'retracted')) AS cur,
        arg_max(st, (o_orderdate, o_orderkey)) AS last_state FROM v GROUP BY ALL),
    b AS (SELECT entity_id, predicate, cur, CASE WHEN last_state IN ('released', 'retracted') THEN last_state WHEN cur IS NULL THEN 'retracted'
        WHEN last_state = 'conflicted' THEN 'conflicted' ELSE 'last_known_good' END AS base_state FROM d),
    m AS (SELECT max(o_orderdate) AS now FROM orders),
    f AS (SELECT b.*, v.o_totalprice AS value, v.o_orderdate AS tx, v.st AS version_state,
        CASE WHEN base_state IN ('retracted', 'conflicted') THEN base_state WHEN now > v.o_orderdate + INTERVAL 730 DAY THEN 'stale' ELSE base_state END AS state
        FROM b LEFT JOIN v ON cur = o_orderkey, m),
    l AS (SELECT *, CASE WHEN state = 'retracted' THEN 'unavailable' WHEN state IN ('conflicted', 'stale') THEN CASE WHEN value >= 50000 THEN 'last_known_good' ELSE 'unavailable' END
        WHEN state = 'last_known_good' THEN state ELSE 'verified' END AS serving_label FROM f),
    t AS (SELECT l.*, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = cur) AS n_sources,
        (SELECT count(*) FROM (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_orderkey = cur AND l_linestatus = 'F')) AS n_evidence FROM l)"""


@query("bt6_projections", f"WITH {_PROJECTED} SELECT entity_id, predicate, cur AS fact_version_id, base_state, state, serving_label FROM l")
def bt6_projections(spark, sf_dir):
    return _projected(spark, sf_dir).select("entity_id", "predicate", "fact_version_id", "base_state", "state", "serving_label")


@query(
    "bt6_believed_projections",
    f"""WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, {_STATE} AS st, o_orderdate + INTERVAL 400 DAY AS valid_to FROM orders),
    e AS (SELECT * FROM v WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND valid_to > TIMESTAMP '1998-01-01')
    SELECT o_custkey AS entity_id, o_orderpriority AS predicate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (st IN ('released', 'retracted')) AS current_version_id,
      arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS decision_version_id FROM e GROUP BY ALL""",
)
def bt6_believed_projections(spark, sf_dir):
    """What was believed in the middle of 1998 of what is valid at its start; an order is valid from its date on for 400 days."""
    versions = _versions(spark, sf_dir).withColumn("valid_from", F.lit(None).cast("timestamp")).withColumn("valid_to", F.col("transaction_from") + F.expr("INTERVAL 400 DAY"))
    seen = visibility.believed(F.lit("1998-01-01").cast("timestamp"), F.lit("1998-06-01").cast("timestamp"))
    return visibility.project(versions, ["entity_id", "predicate"], where=seen).drop("base_state")


@query("jn1_trust_blocks", f"WITH {_PROJECTED} SELECT entity_id, predicate, cur AS fact_version_id, state, n_sources AS supporting_source_count, n_evidence AS evidence_count, CASE WHEN n_evidence = 0 THEN 'missing_evidence' END AS uncertainty FROM t WHERE cur IS NOT NULL")
def jn1_trust_blocks(spark, sf_dir):
    return _trusted(spark, sf_dir).select("entity_id", "predicate", "fact_version_id", "state", "supporting_source_count", "evidence_count", "uncertainty")


def _trusted(spark, sf_dir):
    lines, evidence = _support(spark, sf_dir)
    return visibility.trust(_projected(spark, sf_dir).where("fact_version_id is not null"), lines, evidence)


@query("pf5_visible_facts", f"WITH {_PROJECTED} SELECT entity_id, predicate, cur AS fact_version_id, state, serving_label FROM l WHERE serving_label <> 'unavailable' AND state NOT IN ('conflicted', 'retracted') AND version_state = 'released'")
def pf5_visible_facts(spark, sf_dir):
    return visibility.released(_projected(spark, sf_dir)).select("entity_id", "predicate", "fact_version_id", "state", "serving_label")


@query(
    "pf6_machine_facts",
    f"""WITH {_PROJECTED} SELECT entity_id, predicate, cur AS fact_version_id FROM t WHERE state = 'released' AND serving_label = 'verified' AND version_state = 'released'
      AND n_evidence > 0 AND n_sources > 0 AND predicate IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY predicate) <= 2""",
)
def pf6_machine_facts(spark, sf_dir):
    """At most two facts of a customer, as the reading interface pages them."""
    return visibility.machine_readable(_trusted(spark, sf_dir), ["1-URGENT", "2-HIGH", "3-MEDIUM"], 2).select("entity_id", "predicate", "fact_version_id")


@query("pf7_evidence_aware_facts", f"WITH {_PROJECTED} SELECT entity_id, predicate, state, n_evidence AS evidence_count FROM t WHERE state IN ('released', 'last_known_good', 'stale') AND n_evidence > 0")
def pf7_evidence_aware_facts(spark, sf_dir):
    return visibility.evidence_aware(_trusted(spark, sf_dir)).select("entity_id", "predicate", "state", "evidence_count")


@query(
    "src7_public_facts",
    f"""WITH {_PROJECTED} SELECT CAST(cur AS VARCHAR) AS id, CAST(entity_id AS VARCHAR) AS entity_id, predicate, value, tx AS transaction_from, state,
      CASE WHEN state = 'stale' THEN 'stale' ELSE 'fresh' END AS freshness, n_sources AS supporting_source_count, n_evidence AS evidence_count
    FROM t WHERE serving_label <> 'unavailable' AND state NOT IN ('conflicted', 'retracted') AND version_state = 'released'""",
)
def src7_public_facts(spark, sf_dir):
    shaped = visibility.public_facts(visibility.released(_trusted(spark, sf_dir)))
    return shaped.select("id", "entity_id", "predicate", "value", "transaction_from", "trust.state", "trust.freshness", "trust.supporting_source_count", "trust.evidence_count")


@query(
    "jn13_verification_bundles",
    f"""WITH v AS (SELECT o_orderkey, {_STATE} AS st FROM orders)
    SELECT o_orderkey AS fact_version_id, st AS state,
      coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT l_orderkey || ':' || l_linenumber AS r FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')), '') AS evidence_refs,
      coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT l_orderkey || ':' || l_linenumber AS r FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')), '') AS observation_ids
    FROM v WHERE st IN ('released', 'retracted')""",
)
def jn13_verification_bundles(spark, sf_dir):
    lines, evidence = _support(spark, sf_dir)
    observations = lines.select("fact_version_id", F.col("ref").alias("observation_id"), F.when(F.col("l_returnflag") != "R", "verified").alias("trust_state"))
    out = visibility.verification(_versions(spark, sf_dir), observations, evidence)
    return out.select("fact_version_id", "state", F.array_join("evidence_refs", ",").alias("evidence_refs"), F.array_join("observation_ids", ",").alias("observation_ids"))


@query(
    "jn10_source_freshness",
    """WITH m AS (SELECT max(l_shipdate) AS now FROM lineitem), h AS (SELECT l_suppkey, max(l_shipdate) FILTER (l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1)
    SELECT s_suppkey, ok AS last_success_at, CASE WHEN ok IS NULL THEN 'unknown' WHEN now - ok > INTERVAL 240 HOUR THEN 'stale' ELSE 'fresh' END AS freshness
    FROM m, supplier LEFT JOIN h ON s_suppkey = l_suppkey""",
)
def jn10_source_freshness(spark, sf_dir):
    """Suppliers by their last line that was not sent back; ten days count as fresh, as lines have no hours."""
    lines = table(spark, sf_dir, "lineitem")
    done = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))).alias("last_success_at"))
    now = F.lit(lines.agg(F.max("l_shipdate")).first()[0]).cast("timestamp")
    return visibility.source_freshness(table(spark, sf_dir, "supplier").select("s_suppkey"), done, "s_suppkey", now, hours=240).select("s_suppkey", "last_success_at", "freshness")


@query("pf9_urgent_orders", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def pf9_urgent_orders(spark, sf_dir):
    """The newest 100 open urgent orders: a listing has a length."""
    rows = visibility.listing(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 100, o_orderpriority="1-URGENT", o_orderstatus="O", o_custkey=None)
    return rows.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("pf8_foreign_suppliers", "SELECT DISTINCT o_orderkey AS order_id, c_nationkey AS left_project, s_nationkey AS right_project FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def pf8_foreign_suppliers(spark, sf_dir):
    """A nation stands for a project: orders whose lines come from another nation than their customer."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("order_id"), F.col("c_nationkey").alias("project_id"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("order_id"), F.col("s_nationkey").alias("project_id"))
    return visibility.scope_violations(orders, lines, "order_id")


@query(
    "src3_normalized_products",
    """SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS title, p_retailprice AS observed_purchase_price, p_retailprice / 8 AS monthly_payment, 'USD' AS currency,
      CASE WHEN p_size <= 25 THEN 'in_stock' END AS availability, p_retailprice + p_size AS jsonld_price FROM part""",
)
def src3_normalized_products(spark, sf_dir):
    """Parts as JSON texts of the nested product shape, read back under its schema and flattened."""
    price = F.struct(F.col("p_retailprice").alias("amount"), F.lit("USD").alias("currency"))
    product = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") <= 25, "in_stock").alias("availability"), price.alias("purchase_price"),
        F.struct((F.col("p_retailprice") / 8).alias("amount")).alias("monthly_payment"),
    )
    texts = table(spark, sf_dir, "part").select(F.to_json(F.struct(product.alias("product"), F.struct((F.col("p_retailprice") + F.col("p_size")).alias("jsonld_price")).alias("independent_sources"))).alias("body"))
    rows = intake.normalize_products(intake.parse_nested(texts, "body", intake.PRODUCT_SCHEMA))
    return rows.select("entity_id", "title", "observed_purchase_price", "monthly_payment", "currency", "availability", "jsonld_price")


@query(
    "pf1_flat_records",
    """WITH r AS (SELECT l_orderkey, o_orderpriority, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
        CASE l_returnflag WHEN 'R' THEN 'pricing' WHEN 'A' THEN 'model' ELSE 'notice' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS observation_id, CAST(pos AS INTEGER) AS pos, kind, CAST(l_linenumber AS VARCHAR) AS record_key,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'pricing' WHEN '2-HIGH' THEN 'catalog' ELSE 'status' END AS source_type FROM r
    WHERE kind = CASE o_orderpriority WHEN '1-URGENT' THEN 'pricing' WHEN '2-HIGH' THEN 'model' ELSE 'notice' END""",
)
def pf1_flat_records(spark, sf_dir):
    """Orders as observations of the nested shape (SRC-2), their lines as records."""
    kind = F.when(F.col("l_returnflag") == "R", "pricing").when(F.col("l_returnflag") == "A", "model").otherwise("notice")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    record = F.struct(*order, kind.alias("kind"))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(record)).alias("lines"))
    records = F.transform("lines", lambda r: F.struct(r["kind"].alias("kind"), r["l_linenumber"].cast("string").alias("key"), r["l_extendedprice"].alias("amount")))
    source = F.when(F.col("o_orderpriority") == "1-URGENT", "pricing").when(F.col("o_orderpriority") == "2-HIGH", "catalog").otherwise("status")
    nested = table(spark, sf_dir, "orders").join(grouped, F.col("o_orderkey") == F.col("l_orderkey")).select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("observation_id"), source.alias("source_type"), records.alias("records"))).alias("body"))
    flat = intake.flatten_records(intake.parse_nested(nested, "body", intake.OBSERVATION_SCHEMA))
    return flat.select(intake.source_value("$observation.observation_id").alias("observation_id"), "pos", intake.source_value("kind").alias("kind"), intake.source_value("key").alias("record_key"), "source_type")


@query(
    "pf3_page_endpoints",
    r"""SELECT page_id, regexp_matches(url, '^(?i)https://') AND NOT regexp_matches(url, '^[A-Za-z]+://[^/?#]*@') AND lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) = h
      AND (p = b OR starts_with(p, b || '/')) AS matches
    FROM (SELECT page_id, replace(url, 'http://', 'https://') AS url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h,
      regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1) AS p, CASE WHEN page_id <= 150 THEN '/es' ELSE '/en' END AS b FROM pages WHERE url IS NOT NULL)""",
)
def pf3_page_endpoints(spark, sf_dir):
    """Pages, as if all were https, against an endpoint of their own host in upper case."""
    pages = table(spark, sf_dir, "pages").where("url is not null").withColumn("url", F.replace("url", F.lit("http://"), F.lit("https://")))
    prefix = F.when(F.col("page_id") <= 150, "/es/").otherwise("/en")
    return pages.select("page_id", intake.matches_endpoint(F.col("url"), F.upper(F.try_parse_url("url", F.lit("HOST"))), prefix).alias("matches"))


@query(
    "dq12_admitted_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'inactive_mapping' END, CASE WHEN l_returnflag = 'R' THEN 'unverified_source' END,
      CASE WHEN l_linestatus = 'O' AND p_size > 25 THEN 'undefined_target' END, CASE WHEN l_linenumber > 4 THEN 'transform_not_allowed' END, CASE WHEN l_quantity < 3 OR l_quantity > 22 THEN 'source_paths' END) AS violations
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def dq12_admitted_lines(spark, sf_dir):
    """Lines as canonical fields of their supplier, parts as mappings; a line's quantity less 2 is its number of source paths."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "source_id").withColumnRenamed("l_partkey", "mapping_id")
    fields = lines.select(
        "l_orderkey", "l_linenumber", "source_id", "mapping_id", F.when(F.col("l_linestatus") == "O", "price").otherwise("name").alias("canonical_path"), F.when(F.col("l_linenumber") > 4, "run_code").otherwise("trim").alias("transform"),
        F.when(F.col("l_quantity") >= 3, F.sequence(F.lit(1), F.col("l_quantity").cast("int") - 2)).otherwise(F.array().cast("array<int>")).alias("source_paths"), F.array(F.lit("e")).alias("evidence_refs"),
        F.when(F.col("l_returnflag") == "R", "observed").otherwise("verified").alias("trust"),
    )
    active = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "shadow").otherwise("active")
    targets = F.when(F.col("p_size") > 25, F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("price")))
    mappings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mapping_id"), active.alias("mapping_state"), F.lit("active").alias("schema_state"), targets.alias("targets"))
    out = intake.admit(fields, mappings, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id")), ["trim", "rename"])
    return out.select("l_orderkey", "l_linenumber", F.col("mapping_id").alias("l_partkey"), F.col("source_id").alias("l_suppkey"), F.array_join("violations", ",").alias("violations"))


@query(
    "jn2_authority",
    """SELECT g AS outcome, count(*) AS n, count(DISTINCT l_suppkey) AS n_sources FROM (SELECT l_suppkey, CASE WHEN s_acctbal < 0 OR p_type = 'PROMO' OR (s_nationkey < 5 AND p_type = 'ECONOMY') THEN 'rejected'
      WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN 'quarantined' ELSE 'eligible' END AS g
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey) GROUP BY 1""",
)
def jn2_authority(spark, sf_dir):
    """Suppliers in credit are in the policy; a part's type is the predicate, for which those of some nations lack authority."""
    suppliers = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    candidates = lines.select(
        F.col("l_suppkey").alias("source_id"), F.col("p_type").alias("predicate"), F.when(F.col("l_returnflag") != "R", "verified").alias("trust_state"), F.when(F.col("l_linestatus") != "O", "verified").alias("field_state")
    )
    # A supplier declares its authority for each type that it has a line of.
    forbidden = (F.col("s_nationkey") < 5) & (F.col("predicate") == "ECONOMY")
    declared = candidates.select(F.col("source_id").alias("s_suppkey"), "predicate").distinct()
    authorities = suppliers.select("s_suppkey", "s_nationkey").join(declared, "s_suppkey").select(
        F.col("s_suppkey").alias("source_id"), "predicate", (F.col("predicate") != "PROMO").alias("active"), F.when(forbidden, "forbidden").otherwise("primary").alias("authority")
    )
    policy = suppliers.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("source_id"))
    parts = zip(("eligible", "quarantined", "rejected"), intake.gate_authority(candidates, policy, authorities), strict=True)
    counted = [df.agg(F.lit(name).alias("outcome"), F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources")).where("n > 0") for name, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(
    "cdc7_appended_events",
    """WITH e AS (SELECT DISTINCT user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS k, ts < TIMESTAMP '2024-01-08' AS old FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL)
    SELECT k AS event_key FROM e GROUP BY k HAVING NOT bool_or(old)""",
)
def cdc7_appended_events(spark, sf_dir):
    """Daily keys of later events that the first week's log does not hold."""
    events = table(spark, sf_dir, "events").where("ts is not null").withColumn("event_key", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")))
    early = F.col("ts") < F.lit("2024-01-08").cast("timestamp")
    return intake.append_new(events.where(early).select("event_key"), events.where(~early).select("event_key"), "event_key")


_PRICE = """SELECT p_partkey, p_retailprice AS expected, CASE WHEN p_size % 10 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS observed,
      CASE WHEN p_size % 7 = 0 THEN p_retailprice + 5 ELSE CASE WHEN p_size % 10 = 0 THEN p_retailprice + 1 ELSE p_retailprice END END AS channel, p_type = 'PROMO' AS monthly, p_name, p_size FROM part"""


def _prices(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    observed = F.when(F.col("p_size") % 10 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    return part.select(
        F.col("p_partkey").alias("candidate_id"), F.col("p_retailprice").alias("expected"), observed.alias("observed"), F.lit(1.0).alias("monthly"), observed.alias("channel_a"),
        F.when(F.col("p_size") % 7 == 0, F.col("p_retailprice") + 5).otherwise(observed).alias("channel_b"), F.when(F.col("p_type") == "PROMO", "per month").otherwise("one-time purchase price").alias("context"),
        F.when(F.col("p_size") <= 25, F.lit('[aria-label="buy now"] jsonld')).alias("selector"), "p_size",
    )


@query(
    "dq7_tribunal_checks",
    f"""WITH p AS ({_PRICE}), c AS (SELECT *, NOT monthly AND abs(observed - channel) <= 0.01 AS verified FROM p)
    SELECT p_partkey AS candidate_id, 'preview_contract' AS "check", CASE WHEN verified AND observed = expected THEN 'pass' ELSE 'fail' END AS status FROM c
    UNION ALL SELECT p_partkey, 'evidence_support', CASE WHEN observed = expected AND channel = expected AND NOT monthly THEN 'pass' ELSE 'fail' END FROM c
    UNION ALL SELECT p_partkey, 'selector_risk', CASE WHEN p_size <= 25 THEN 'pass' ELSE 'deferred' END FROM c UNION ALL SELECT p_partkey, 'human_review', 'needs_review' FROM c""",
)
def dq7_tribunal_checks(spark, sf_dir):
    return certify.tribunal(_prices(spark, sf_dir))


@query(
    "dq8_case_results",
    f"""WITH p AS ({_PRICE}), c AS (SELECT *, p_size > 45 AS control, NOT monthly AND abs(observed - channel) <= 0.01 AS verified FROM p),
    o AS (SELECT *, CASE WHEN control THEN p_size <> 47 ELSE verified AND observed = expected END AS ok FROM c)
    SELECT p_partkey AS case_id, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS outcome, control AND NOT ok AS false_heal, NOT control AND verified AND observed <> expected AS false_release FROM o""",
)
def dq8_case_results(spark, sf_dir):
    """Parts as cases, those of the largest sizes as negative controls."""
    out = certify.case_results(_cases(spark, sf_dir))
    return out.select("case_id", "outcome", "false_heal", "false_release")


def _cases(spark, sf_dir):
    control = F.col("p_size") > 45
    return _prices(spark, sf_dir).select(
        "*", F.col("candidate_id").alias("case_id"), F.when(control, "negative_control").otherwise("hidden").alias("visibility"), F.lit("blocked").alias("expected_state"), F.when(F.col("p_size") != 47, "blocked").alias("detected")
    )


@query(
    "dq10_may_certify",
    f"""WITH p AS ({_PRICE}), c AS (SELECT *, NOT monthly AND abs(observed - channel) <= 0.01 AND observed = expected AS ok FROM p),
    g AS (SELECT p_name AS candidate_id, count(*) AS n_cases, count(*) FILTER (NOT CASE WHEN p_size > 45 THEN p_size <> 47 ELSE ok END) AS n_failed,
      bool_and(p_size % 10 <> 0 AND p_size % 7 <> 0) AS checks_pass FROM c GROUP BY 1)
    SELECT candidate_id, n_cases, n_failed, checks_pass, checks_pass AND n_failed = 0 AND n_cases = 8 AND candidate_id > 'l' AS can_release FROM g""",
)
def dq10_may_certify(spark, sf_dir):
    """A part's name is the candidate, its parts are the cases; evidence checks pass where channels agree with the expected price."""
    results = certify.case_results(_cases(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), "p_name"), "case_id"))
    own = results.withColumn("candidate_id", F.col("p_name"))
    agree = (F.col("observed") == F.col("expected")) & (F.col("channel_b") == F.col("expected"))
    checks = own.select("candidate_id", F.lit("evidence_support").alias("check"), F.when(agree, "pass").otherwise("fail").alias("status"))
    approvals = own.select("candidate_id").distinct().withColumn("approved", F.col("candidate_id") > "l")
    return certify.may_certify(checks, own.select("candidate_id", "outcome"), approvals).drop("approved")


@query(
    "ag13_tribunal_context",
    """WITH i AS (SELECT l_suppkey, 'field' AS kind, l_partkey AS t FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, 'fact', l_orderkey FROM lineitem WHERE l_returnflag = 'N'
      UNION ALL SELECT l_suppkey, 'entity', l_partkey FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT p_partkey, p_size > 40 AS several, p_retailprice > 1000 AS risk FROM part WHERE p_type = 'PROMO')
    SELECT s_suppkey AS assessment_id, count(*) FILTER (kind = 'field') AS field_count, count(*) FILTER (kind = 'fact') AS fact_count, count(*) FILTER (kind = 'entity' AND p_partkey IS NOT NULL) AS open_conflict_count,
      s_acctbal > 8000 OR coalesce(bool_or(several) FILTER (kind = 'entity'), false) AS independent_support, coalesce(bool_or(r.p_retailprice > 1000) FILTER (kind = 'entity'), false) AS identity_change_risk
    FROM supplier LEFT JOIN i ON s_suppkey = l_suppkey LEFT JOIN c ON kind = 'entity' AND t = c.p_partkey LEFT JOIN (SELECT p_partkey AS rk, p_retailprice FROM part) r ON kind = 'entity' AND t = rk GROUP BY s_suppkey, s_acctbal""",
)
def ag13_tribunal_context(spark, sf_dir):
    """A supplier's assessment: its lines are impacts on fields (parts), facts (orders) and entities (parts sent back); parts on promotion have a conflict open."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    kind = F.when(F.col("l_returnflag") == "A", "canonical_field").when(F.col("l_returnflag") == "N", "current_fact").otherwise("entity")
    impacts = lines.select(F.col("l_suppkey").alias("assessment_id"), kind.alias("kind"), F.when(kind == "current_fact", F.col("l_orderkey")).otherwise(F.col("l_partkey")).alias("target_id"), (F.col("p_retailprice") > 1000).alias("identity_risk"))
    conflicts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_type") == "PROMO", "open").otherwise("resolved").alias("status"), F.when(F.col("p_size") > 40, 2).otherwise(1).alias("independent_group_count"))
    assessments = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("assessment_id"), (F.col("s_acctbal") > 8000).alias("alternate_coverage"))
    return certify.tribunal_context(impacts, conflicts, assessments)


@query(
    "gr6_extended_certificates",
    """WITH t AS (SELECT l_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS affected_fields, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT s_suppkey AS certificate_id, coalesce(affected_fields, '') AS affected_fields, coalesce(n, 0) AS affected_entity_count, sha256(coalesce(affected_fields, '') || chr(10) || coalesce(n, 0) || chr(10) || s_name) AS extension_digest
    FROM supplier LEFT JOIN t ON s_suppkey = l_suppkey WHERE s_acctbal >= 0 AND s_nationkey <> 7""",
)
def gr6_extended_certificates(spark, sf_dir):
    """Suppliers' certificates with the types and parts of their lines; those in credit passed, those of one nation have no canary."""
    suppliers = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    affected = lines.select(F.col("l_suppkey").alias("certificate_id"), F.col("p_type").alias("canonical_field"), F.col("l_partkey").alias("entity_id"))
    bundles = suppliers.select(F.col("s_suppkey").alias("certificate_id"), F.col("s_name").alias("manifest_digest"), (F.col("s_acctbal") >= 0).alias("passed"), (F.col("s_nationkey") != 7).alias("canary_active"))
    out = certify.extend_certificates(suppliers.select(F.col("s_suppkey").alias("certificate_id")), affected, bundles)
    return out.select("certificate_id", F.array_join("affected_fields", ",").alias("affected_fields"), "affected_entity_count", "extension_digest")


@query("ud1_evaluated_parts", "SELECT p_partkey, CASE WHEN p_retailprice > 950 AND p_name LIKE '%e%' THEN 'pass' ELSE 'fail' END AS outcome FROM part")
def ud1_evaluated_parts(spark, sf_dir):
    return certify.gauntlet(table(spark, sf_dir, "part"), lambda rows: rows.withColumn("fits", F.col("p_name").contains("e")), F.col("fits") & (F.col("p_retailprice") > 950)).select("p_partkey", "outcome")


@query(
    "dq5_classified_failures",
    """WITH r AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_variants, count(DISTINCT l_linestatus) AS n_presences, count(*) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 700 AS status, o_orderstatus = 'O' AS missing, o_orderpriority AS p, coalesce(n_variants, 0) AS n_variants, coalesce(n_presences, 0) AS n_presences, coalesce(n, 0) AS n
      FROM orders LEFT JOIN r ON o_orderkey = l_orderkey),
    c AS (SELECT *, CASE WHEN status IN (404, 410) THEN 'dead_page' WHEN status IN (401, 403, 429) OR p = '5-LOW' THEN 'soft_block' WHEN status >= 500 THEN 'transport_failure'
      WHEN missing AND p = '4-NOT SPECIFIED' THEN 'legitimate_empty' WHEN status < 20 THEN 'semantic_swap' WHEN p = '1-URGENT' AND status > 300 THEN 'render_timing'
      WHEN n_variants > 1 OR n_presences > 1 THEN 'ab_variant' WHEN missing AND p = '2-HIGH' THEN 'structural_drift' ELSE 'unknown' END AS classification FROM s)
    SELECT o_orderkey, n_variants, n_presences, classification, CASE classification WHEN 'dead_page' THEN 'mark_dead' WHEN 'soft_block' THEN 'quarantine' WHEN 'transport_failure' THEN 'retry' WHEN 'legitimate_empty' THEN 'do_not_heal'
      WHEN 'ab_variant' THEN 'gather_more_evidence' WHEN 'unknown' THEN 'human_review' ELSE 'heal' END AS action, classification = 'ab_variant' OR (classification = 'unknown' AND n < 3) AS requires_repeated_fetch FROM c""",
)
def dq5_classified_failures(spark, sf_dir):
    """Orders as failures: the price gives the status, the lines are repeated fetches."""
    fetches = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("dom_fingerprint"), (F.col("l_linestatus") == "F").alias("field_present"))).alias("fetches"))
    status, priority, missing = F.floor("o_totalprice").cast("long") % 700, F.col("o_orderpriority"), F.col("o_orderstatus") == "O"
    signals = table(spark, sf_dir, "orders").join(fetches, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "fetches", status.cast("int").alias("http_status"), F.lit(None).cast("string").alias("network_error"), F.lit("ok").alias("page_state"),
        F.when(priority == "5-LOW", F.array(F.lit("captcha"))).alias("block_markers"), F.when(status < 20, F.array(F.lit("semantic_swap"))).alias("violation_codes"), missing.alias("field_missing"),
        (priority == "4-NOT SPECIFIED").alias("optional_field"), F.lit(True).alias("sold_out"), F.lit(None).cast("boolean").alias("alternate_evidence"), (priority == "2-HIGH").alias("selector_failure"),
        F.when((priority == "1-URGENT") & (status > 300), 6000).alias("appeared_after_ms"), F.lit(None).cast("int").alias("deadline_ms"),
    )
    out = health.classify_failure(signals)
    return out.select("o_orderkey", F.col("n_variants").cast("long").alias("n_variants"), F.col("n_presences").cast("long").alias("n_presences"), "classification", "action", "requires_repeated_fetch")


@query(
    "fn18_equivalent_names",
    """WITH x AS (SELECT p_partkey, p_name AS a, upper(replace(p_name, ' ', '  ')) || ' ' AS b, p_retailprice AS u, p_retailprice * (1 + p_size / 100000.0) AS w, p_brand, p_type FROM part)
    SELECT p_partkey, false AS exact_same, true AS text_same, abs(u - w) / greatest(abs(u), abs(w)) * 100 <= 0.02 OR u = w AS price_same, p_type = 'PROMO' AS alias_same, true AS set_same FROM x""",
)
def fn18_equivalent_names(spark, sf_dir):
    """A part's name against a badly typed copy, its price against a slightly raised one, its type under an alias, its words in another order."""
    part = table(spark, sf_dir, "part")
    typed = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("  "))), F.lit(" "))
    raised = F.col("p_retailprice") * (1 + F.col("p_size") / 100000.0)
    words = F.split("p_name", " ")
    return part.select(
        "p_partkey",
        C.equivalent(F.col("p_name"), typed, {"kind": "exact"}).alias("exact_same"),
        C.equivalent(F.col("p_name"), typed, {"kind": "text", "collapse_whitespace": True, "case_insensitive": True}).alias("text_same"),
        C.equivalent(F.col("p_retailprice"), raised, {"kind": "numeric", "percent": 0.02}).alias("price_same"),
        C.equivalent(F.col("p_type"), F.lit("promotion"), {"kind": "identifier", "case_insensitive": True, "aliases": {"promo": "promotion"}}).alias("alias_same"),
        C.equivalent(words, F.concat(F.reverse(F.transform(words, F.upper)), words), {"kind": "set", "case_insensitive": True}).alias("set_same"),
    )


@query("fn19_injection_states", "SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'too_large' WHEN contains(lower(text), 'ignore previous') OR contains(lower(text), 'system prompt') OR contains(lower(text), 'developer message') OR contains(lower(text), 'tool call') THEN 'blocked' ELSE 'accepted' END AS state FROM documents")
def fn19_injection_states(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.injection_state(F.col("text")).alias("state"))


@query(
    "fn_parsed_texts",
    """SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS number, CAST(p_size * 1000000 AS DOUBLE) AS magnitude, p_size <= 25 AS flag, 'a|' || p_name AS items,
      CASE WHEN p_type = 'PROMO' THEN 'active' ELSE 'other' END AS status, CASE WHEN p_size BETWEEN 10 AND 31 THEN '2024-05-' || p_size ELSE '2024-05' END AS version, least(86400, 60 * pow(2, p_size - 1))::BIGINT AS wait FROM part""",
)
def fn_parsed_texts(spark, sf_dir):
    """Parts' values written as texts and read again by the helpers (FN-4, 5, 7, 9, 11, 14, 21)."""
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.parse_number(F.concat(F.lit("USD "), F.col("p_retailprice").cast("string"))).alias("number"),
        C.parse_magnitude(F.concat(size, F.lit(" m"))).alias("magnitude"),
        C.normalize_boolean(F.when(F.col("p_size") <= 25, " YES").otherwise("0")).alias("flag"),
        F.array_join(C.normalize_list(F.concat(F.lit("a, ,a,"), F.col("p_name"))), "|").alias("items"),
        C.enum_map(F.concat(F.col("p_type"), F.lit(" ")), {"promo": "active"}, "other").alias("status"),
        C.version_token(F.concat(F.lit("model-2024-05-"), size, F.lit("x"))).alias("version"),
        C.backoff_seconds(F.col("p_size")).alias("wait"),
    )


@query(
    "ag9_schema_changes",
    """WITH f AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS old, o_custkey AS k, min(o_orderpriority) AS t, min(floor(o_totalprice / 50000)) AS lo, max(floor(o_totalprice / 50000)) AS hi,
        list_sort(list(DISTINCT o_orderstatus)) AS vals, count(*) AS ev FROM orders GROUP BY 1, 2), p AS (SELECT * FROM f WHERE old), n AS (SELECT * FROM f WHERE NOT old),
    j AS (SELECT coalesce(p.k, n.k) AS k, p.k IS NULL AS fresh, n.k IS NULL AS gone, p.t <> n.t AS typed, p.lo <> n.lo OR p.hi <> n.hi AS ranged, n.lo <= p.lo AND n.hi >= p.hi AS wider,
        p.vals <> n.vals AS enumed, len(list_filter(p.vals, lambda x: NOT list_contains(n.vals, x))) > 0 AS lost, p.ev <> n.ev AS evid FROM p FULL JOIN n ON p.k = n.k),
    r AS (SELECT k, concat_ws(',', CASE WHEN gone AND k IN (SELECT k + 1 FROM n) THEN 'field_renamed' END, CASE WHEN gone AND k NOT IN (SELECT k + 1 FROM n) THEN 'field_removed' END,
      CASE WHEN fresh AND k + 1 NOT IN (SELECT k FROM p) THEN 'field_added' END, CASE WHEN typed THEN 'type_changed' END, CASE WHEN ranged AND wider THEN 'range_widened' END, CASE WHEN ranged AND NOT wider THEN 'range_narrowed' END,
      CASE WHEN enumed AND NOT lost THEN 'enum_widened' END, CASE WHEN enumed AND lost THEN 'enum_narrowed' END, CASE WHEN evid THEN 'evidence_policy_changed' END) AS changes FROM j)
    SELECT CAST(k AS VARCHAR) AS path, changes, CASE WHEN changes LIKE '%removed%' OR changes LIKE '%type_changed%' OR changes LIKE '%narrowed%' THEN 'breaking'
      WHEN changes LIKE '%evidence%' THEN 'policy_migration' ELSE 'backward_compatible' END AS classification FROM r WHERE changes <> ''""",
)
def ag9_schema_changes(spark, sf_dir):
    """A customer is a field; the orders before 1998 give the old revision, the others the new one, in which it also answers for the next customer."""
    orders = table(spark, sf_dir, "orders")
    amount = F.floor(F.col("o_totalprice") / 50000)
    fields = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(
        F.min("o_orderpriority").alias("data_type"), F.lit("usd").alias("unit"), F.min(amount).alias("minimum"), F.max(amount).alias("maximum"), F.lit(False).alias("required"), F.lit(True).alias("nullable"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("enum_values"), F.count("*").cast("int").alias("evidence_minimum"),
    ).withColumn("path", F.col("k").cast("string"))
    split = F.lit("1998-01-01").cast("timestamp")
    current = fields(orders.where(F.col("o_orderdate") >= split)).withColumn("aliases", F.array((F.col("k") + 1).cast("string"))).drop("k")
    out = health.schema_changes(fields(orders.where(F.col("o_orderdate") < split)).drop("k"), current)
    return out.select("path", F.array_join("changes", ",").alias("changes"), "classification")


@query(
    "id1_cross_provider",
    """WITH e AS (SELECT p_brand, p_name, min(p_partkey) AS entity_id, min(p_type) AS family, min(p_size) AS version, p_name || ':' || min(p_size) AS model FROM part GROUP BY p_brand, p_name),
    i AS (SELECT DISTINCT p_brand, p_name, p_type, p_size, p_name || ':' || p_size AS model FROM part),
    s AS (SELECT i.*, e.entity_id, CASE WHEN e.p_brand = i.p_brand THEN 40 ELSE -100 END + CASE WHEN e.model = i.model THEN 40 ELSE 0 END + CASE WHEN e.p_name = i.p_name THEN 20 ELSE 0 END
        + CASE WHEN e.family = p_type THEN 15 ELSE 0 END + CASE WHEN e.version = p_size THEN 15 ELSE -60 END + CASE WHEN p_type = 'PROMO' THEN -20 ELSE 0 END AS score,
        e.version <> p_size OR e.p_brand <> i.p_brand AS conflict, e.model = i.model AS strong FROM i JOIN e ON i.p_brand = e.p_brand OR e.model = i.model),
    r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next_score FROM s WINDOW w AS (PARTITION BY p_brand, p_name, p_type, p_size ORDER BY score DESC, entity_id))
    SELECT p_brand, p_name, p_type, p_size, score, CASE WHEN score <= 0 THEN 'create_new' WHEN conflict THEN 'rejected' WHEN (next_score IS NULL OR next_score < score) AND strong THEN 'auto_link' ELSE 'needs_review' END AS decision
    FROM r WHERE n = 1""",
)
def id1_cross_provider(spark, sf_dir):
    """Parts against one entity for each brand and name; a name with a size is a model id that several brands share, parts on promotion have a critical conflict."""
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("array<string>")
    canonical = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("entity_id"), F.min("p_type").alias("family"), F.min("p_size").alias("version"))
    entities = canonical.select(F.col("p_brand").alias("provider"), F.concat_ws(":", "p_name", "version").alias("model_id"), none.alias("external_ids"), F.col("p_name").alias("name"), "family", "version", "entity_id", none.alias("aliases"))
    inputs = part.select(
        F.col("p_brand").alias("provider"), F.concat_ws(":", "p_name", "p_size").alias("model_id"), none.alias("external_ids"), F.lit("-").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("family"),
        F.col("p_size").alias("version"), (F.col("p_type") == "PROMO").alias("critical_conflict"),
    )
    out = identity.resolve(inputs, entities)
    return out.select(F.col("provider").alias("p_brand"), F.col("name").alias("p_name"), F.col("family").alias("p_type"), F.col("version").alias("p_size"), "score", "decision")
