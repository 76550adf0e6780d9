"""Queries of fact histories, mappings, identity logs, ordered state, dossiers and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import bitemporal, dossier, identity, mapping, ordered, progress, provenance, reconcile
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources import ingest as sources
from factloom.streaming import jobs


def _history(spark, sf_dir):
    """Orders as versions of a customer's fact, line items as transitions."""
    made = F.col("o_orderdate").cast("timestamp")
    versions = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderpriority",
        F.col("o_orderkey").alias("version_id"),
        F.col("o_orderkey").alias("operation_key"),
        F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderkey") % 7 != 0, made).alias("valid_from"),
        F.timestamp_micros(F.unix_micros(made) + F.col("o_orderkey") % 60 * 86_400_000_000).alias("transaction_from"),
        F.timestamp_micros(F.unix_micros(made) - 864_000_000_000).alias("verified_at"),
        F.when(F.col("o_orderstatus") == "P", "withheld").otherwise("released").alias("state"),
    )
    large = F.col("l_quantity") >= 40
    kind = F.when(large & (F.col("l_returnflag") == "R"), "retraction").when(large & (F.col("l_returnflag") == "A"), "correction").otherwise("supersession")
    lines = table(spark, sf_dir, "lineitem")
    transitions = lines.select(F.col("l_orderkey").alias("previous_version_id"), kind.alias("kind"), F.col("l_shipdate").cast("timestamp").alias("transaction_at"))
    return versions, transitions


_SQL_HISTORY = """v AS (SELECT o_custkey, o_orderpriority, o_orderkey AS version_id, o_totalprice AS value, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::TIMESTAMP END AS valid_from,
      o_orderdate::TIMESTAMP + to_days((o_orderkey % 60)::INT) AS transaction_from, o_orderdate::TIMESTAMP - INTERVAL 10 DAY AS verified_at, o_orderstatus <> 'P' AS released FROM orders),
    t AS (SELECT l_orderkey AS id, CASE WHEN l_quantity < 40 THEN 'supersession' WHEN l_returnflag = 'R' THEN 'retraction' WHEN l_returnflag = 'A' THEN 'correction' ELSE 'supersession' END AS kind, l_shipdate::TIMESTAMP AS moment FROM lineitem)"""


def _sql_standing(at: str) -> str:
    return f"SELECT * FROM v WHERE released AND transaction_from <= TIMESTAMP '{at}' AND version_id NOT IN (SELECT id FROM t WHERE kind <> 'supersession' AND moment <= TIMESTAMP '{at}')"


def _sql_believed(at: str, keys: str = "o_custkey") -> str:
    return f"SELECT * FROM ({_sql_standing(at)}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY transaction_from DESC, version_id DESC) = 1"


def _at(text: str):
    return F.lit(text).cast("timestamp")


@query("bt3_believed_at", f"WITH {_SQL_HISTORY} SELECT o_custkey, version_id, value, transaction_from FROM ({_sql_believed('1997-01-01')})")
def bt3_believed_at(spark, sf_dir):
    return bitemporal.believed_at(*_history(spark, sf_dir), ["o_custkey"], _at("1997-01-01")).select("o_custkey", "version_id", "value", "transaction_from")


@query(
    "bt4_valid_at",
    f"""WITH {_SQL_HISTORY} SELECT o_custkey, version_id, value FROM ({_sql_standing("1998-01-01")}) WHERE coalesce(valid_from, verified_at) <= TIMESTAMP '1996-06-01'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(valid_from, verified_at) DESC, transaction_from DESC, version_id DESC) = 1""",
)
def bt4_valid_at(spark, sf_dir):
    found = bitemporal.valid_at(*_history(spark, sf_dir), ["o_custkey"], _at("1996-06-01"), _at("1998-01-01"))
    return found.select("o_custkey", "version_id", "value")


@query(
    "bt5_regenerated_facts",
    f"""WITH {_SQL_HISTORY}, f AS (SELECT *, 1 <= o_orderpriority[1]::INT AND o_orderpriority[1]::INT <= 3 AS has_policy, o_orderpriority[1] <> '1' AS healthy,
      epoch(TIMESTAMP '1998-01-01')::BIGINT - epoch(verified_at)::BIGINT AS age FROM ({_sql_believed("1998-01-01", "o_custkey, o_orderpriority")})),
    s AS (SELECT *, has_policy AND age > 31536000 AS stale FROM f)
    SELECT o_custkey, o_orderpriority, version_id, CASE WHEN stale AND NOT healthy THEN 'last_known_good' WHEN stale THEN 'stale' ELSE 'released' END AS fresh_state, stale, greatest(0, age) AS lag_seconds FROM s""",
)
def bt5_regenerated_facts(spark, sf_dir):
    level = F.substring("o_orderpriority", 1, 1)
    policies = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().where(level.isin("1", "2", "3"))
    policies = policies.withColumn("freshness_seconds", F.lit(31536000)).withColumn("source_healthy", level != "1")
    found = bitemporal.regenerate(*_history(spark, sf_dir), ["o_custkey", "o_orderpriority"], policies, _at("1998-01-01"), "o_orderpriority")
    return found.select("o_custkey", "o_orderpriority", "version_id", "fresh_state", "stale", "lag_seconds")


@query(
    "bt9_intervals",
    f"""WITH {_SQL_HISTORY}, e AS (SELECT id, min({{'at': moment, 'k': CASE kind WHEN 'correction' THEN 'corrected' WHEN 'retraction' THEN 'retracted' ELSE 'changed' END}}) AS f FROM t GROUP BY id)
    SELECT version_id, transaction_from, f['at'] AS transaction_to, f['k'] AS ended_as FROM v LEFT JOIN e ON version_id = id""",
)
def bt9_intervals(spark, sf_dir):
    return bitemporal.intervals(*_history(spark, sf_dir)).select("version_id", "transaction_from", "transaction_to", "ended_as")


@query(
    "set5_projection_drift",
    f"""WITH {_SQL_HISTORY}, a AS (SELECT o_custkey, version_id FROM ({_sql_believed("1997-01-01")})), b AS (SELECT o_custkey, version_id FROM ({_sql_believed("1997-06-01")}))
    SELECT *, 'persisted' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'regenerated' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def set5_projection_drift(spark, sf_dir):
    versions, transitions = _history(spark, sf_dir)
    before, now = (bitemporal.believed_at(versions, transitions, ["o_custkey"], _at(t)) for t in ("1997-01-01", "1997-06-01"))
    return bitemporal.drift(before, now, ["o_custkey", "version_id"])


@query(
    "bt1_admissions",
    """WITH s AS (SELECT o_orderkey AS id, o_orderkey // 2 % 50 AS g FROM orders WHERE o_orderkey % 2 = 0),
    n AS (SELECT o_orderkey AS version_id, o_orderkey // 2 % 50 AS g, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS op, o_orderkey % 3 AS i,
      CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey - 1 END AS prev, o_orderkey % 13 = 0 AS bare, o_orderkey % 17 = 0 AS undated, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1),
    p AS (SELECT n.*, CASE WHEN op IN (SELECT id FROM s) THEN 'duplicate' WHEN bare THEN 'no_provenance' WHEN i = 0 AND n.g IN (SELECT g FROM s WHERE g < 25) THEN 'already_initial'
      WHEN i <> 0 AND s.g IS DISTINCT FROM n.g THEN 'no_previous' WHEN i = 1 AND undated THEN 'no_valid_from' END AS problem FROM n LEFT JOIN s ON prev = id)
    SELECT version_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN o_orderstatus IN ('F', 'O') THEN 'released' ELSE 'withheld' END END AS state FROM p""",
)
def bt1_admissions(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("g", F.floor(key / 2) % 50)
    stored = orders.where(key % 2 == 0).select("g", key.alias("version_id"), key.alias("operation_key"), F.when(F.col("g") < 25, "released").otherwise("withheld").alias("state"))
    new = orders.where(key % 2 == 1).select(
        "g",
        key.alias("version_id"),
        F.when(key % 11 == 0, key - 1).otherwise(key).alias("operation_key"),
        F.when(key % 3 == 0, "initial").when(key % 3 == 1, "real_change").otherwise("correction").alias("intent"),
        F.when(key % 5 == 0, key + 1).otherwise(key - 1).alias("previous_version_id"),
        F.when(key % 13 != 0, F.array(F.lit("page"))).alias("evidence_refs"),
        F.when(key % 17 != 0, F.col("o_orderdate")).alias("valid_from"),
        F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "last_known_good").otherwise("observed").alias("field_state"),
    )
    return bitemporal.admit_versions(new, stored, ["g"]).select("version_id", "problem", "state")


PART_SPEC = mapping.Spec(
    "parts_v1",
    1,
    "active",
    "p_partkey",
    ("provider", "model"),
    (
        mapping.Rule("provider", ("p_brand",), (("normalize_identifier", {}),)),
        mapping.Rule("model", ("p_name",), (("normalize_whitespace", {}), ("normalize_identifier", {})), evidence=("p_type",)),
        mapping.Rule("kind", ("p_type", "p_brand"), (("combine", {"separator": " / "}), ("normalize_case", {"case": "upper"}))),
        mapping.Rule("size_ms", ("p_size",), (("unit_convert", {"unit": "seconds"}),)),
        mapping.Rule("tier", ("p_name",), (("split", {"separator": " ", "index": 2}),), required=False),
    ),
)


@query(
    "map2_part_mapping",
    r"""WITH m AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9._-]+', '-', 'g'), '-') AS provider,
      trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9._-]+', '-', 'g'), '-') AS model, upper(p_type || ' / ' || p_brand) AS kind, p_size * 1000.0::DOUBLE AS size_ms,
      CASE WHEN len(string_split(p_name, ' ')) > 2 THEN string_split(p_name, ' ')[3] END AS tier FROM part)
    SELECT p_partkey::VARCHAR AS source_key, provider || ':' || model AS canonical_key, kind, size_ms, 0 AS n_errors,
      'sha256:' || sha256('{"provider":"' || provider || '","model":"' || model || '","kind":"' || kind || '","size_ms":' || size_ms::VARCHAR || ',"tier":' || coalesce('"' || tier || '"', 'null') || '}') AS output_digest FROM m""",
)
def map2_part_mapping(spark, sf_dir):
    out = mapping.execute(table(spark, sf_dir, "part"), PART_SPEC)
    return out.select("source_key", "canonical_key", "kind", "size_ms", F.size("errors").alias("n_errors"), "output_digest")


@query(
    "map2_field_evidence",
    r"""WITH m AS (SELECT p_partkey::VARCHAR AS source_key, p_name, p_size, p_brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9._-]+', '-', 'g'), '-') AS provider,
      trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9._-]+', '-', 'g'), '-') AS model, p_type || ' / ' || p_brand AS kind,
      CASE WHEN len(string_split(p_name, ' ')) > 2 THEN string_split(p_name, ' ')[3] END AS tier FROM part)
    SELECT source_key, 'provider' AS field, provider AS value, concat_ws('>', p_brand, provider) AS trail, 'p_brand' AS source_fields FROM m
    UNION ALL SELECT source_key, 'model', model, concat_ws('>', p_name, trim(p_name), model), 'p_name,p_type' FROM m
    UNION ALL SELECT source_key, 'kind', upper(kind), concat_ws('>', regexp_replace(kind, ' / .*$', ''), kind, upper(kind)), 'p_type,p_brand' FROM m
    UNION ALL SELECT source_key, 'size_ms', (p_size * 1000.0::DOUBLE)::VARCHAR, concat_ws('>', p_size::VARCHAR, (p_size * 1000.0::DOUBLE)::VARCHAR), 'p_size' FROM m
    UNION ALL SELECT source_key, 'tier', tier, concat_ws('>', p_name, tier), 'p_name' FROM m""",
)
def map2_field_evidence(spark, sf_dir):
    out = mapping.field_evidence(table(spark, sf_dir, "part"), PART_SPEC)
    trail = F.array_join(F.transform("trail", lambda s: s["output"]), ">")
    return out.select("source_key", "field", "value", trail.alias("trail"), F.array_join("source_fields", ",").alias("source_fields"))


def _candidates(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    events = table(spark, sf_dir, "events").where("user_id is not null")
    return events.select("user_id", "event_id", "ts", "value", (F.col("event_id") % 13).alias("org"), F.when(k % 3 != 0, k % 31).alias("endpoint"), F.floor(F.col("value") * 4).alias("evidence"))


_SQL_INDEPENDENT = """c AS (SELECT user_id, event_id, ts, value, event_id % 13 AS org, CASE WHEN k % 3 <> 0 THEN k % 31 END AS endpoint, CAST(floor(value * 4) AS BIGINT) AS evidence,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE user_id IS NOT NULL)),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS orgs, []::BIGINT[] AS endpoints, []::BIGINT[] AS evidences, NULL::BIGINT AS event_id, NULL::DOUBLE AS value, false AS kept FROM c
      UNION ALL SELECT user_id, n, CASE WHEN ok THEN list_append(orgs, org) ELSE orgs END, CASE WHEN ok AND endpoint IS NOT NULL THEN list_append(endpoints, endpoint) ELSE endpoints END,
        CASE WHEN ok AND evidence IS NOT NULL THEN list_append(evidences, evidence) ELSE evidences END, event_id, value, ok
      FROM (SELECT c.user_id, c.n, orgs, endpoints, evidences, c.org, c.endpoint::BIGINT AS endpoint, c.evidence, c.event_id, c.value,
          NOT (list_contains(orgs, c.org) OR coalesce(list_contains(endpoints, c.endpoint), false) OR coalesce(list_contains(evidences, c.evidence), false)) AS ok
        FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1))"""


@query("cdc1_independent_events", f"WITH RECURSIVE {_SQL_INDEPENDENT} SELECT user_id, event_id, value FROM s WHERE kept")
def cdc1_independent_events(spark, sf_dir):
    kept = reconcile.independent(_candidates(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["org", "endpoint", "evidence"])
    return kept.select("user_id", "event_id", "value")


@query(
    "cdc3_policy_decisions",
    f"""WITH RECURSIVE {_SQL_INDEPENDENT}, i AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM s WHERE kept AND value IS NOT NULL),
    g AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::DOUBLE[] AS leads, 0::BIGINT AS mine FROM s
      UNION ALL SELECT user_id, n, CASE WHEN p = 0 THEN list_append(leads, value) ELSE leads END, CASE WHEN p = 0 THEN len(leads) + 1 ELSE p END
      FROM (SELECT i.user_id, i.n, leads, value, coalesce(list_position([abs(x - value) <= 12.0 for x in leads], true), 0)::BIGINT AS p FROM g JOIN i ON i.user_id = g.user_id AND i.n = g.n + 1)),
    m AS (SELECT g.user_id, g.mine, count(*) AS members, arg_min(value, g.n) AS lead FROM g JOIN i ON i.user_id = g.user_id AND i.n = g.n GROUP BY ALL),
    w AS (SELECT user_id, arg_max({{'v': lead, 'n': members}}, members * 1000 - mine) AS b, count(*) AS n_groups FROM m GROUP BY user_id),
    u AS (SELECT DISTINCT user_id FROM s)
    SELECT user_id, CASE WHEN b.n >= 3 THEN 'release' ELSE 'continue_last_known_good' END AS outcome, CASE WHEN b.n >= 3 THEN b.v END AS value, CASE WHEN b.n >= 3 THEN b.n ELSE 0 END AS n_supporting,
      coalesce(n_groups, 0) AS n_groups, CASE WHEN b IS NULL THEN 'no_candidate' WHEN b.n >= 3 THEN 'quorum_met' ELSE 'quorum_not_met' END AS reason FROM u LEFT JOIN w USING (user_id)""",
)
def cdc3_policy_decisions(spark, sf_dir):
    kept = reconcile.independent(_candidates(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["org", "endpoint", "evidence"])
    return reconcile.by_policy(kept, ["user_id"], "value", [-F.col("event_id")], "quorum", 12.0, 3, conflict_on_disagreement=False)


_SQL_GROUPS = """g AS (SELECT DISTINCT key, 0::BIGINT AS n, []::DOUBLE[] AS leads, 0::BIGINT AS mine FROM i
      UNION ALL SELECT key, n, CASE WHEN p = 0 THEN list_append(leads, value) ELSE leads END, CASE WHEN p = 0 THEN len(leads) + 1 ELSE p END
      FROM (SELECT i.key, i.n, leads, value, coalesce(list_position([{near} for x in leads], true), 0)::BIGINT AS p FROM g JOIN i ON i.key = g.key AND i.n = g.n + 1)),
    m AS (SELECT i.id, i.key, i.value, leads[mine] AS group_value FROM g JOIN i ON i.key = g.key AND i.n = g.n)"""


@query(
    "cdc2_value_groups",
    f"""WITH RECURSIVE i AS (SELECT event_id AS id, event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
    {_SQL_GROUPS.format(near="abs(x - value) <= 0.5 OR abs(x - value) / greatest(abs(x), abs(value), 2.220446049250313e-16) * 100 <= 10")}
    SELECT id AS event_id, group_value, count(*) OVER (PARTITION BY key, group_value) AS group_size FROM m""",
)
def cdc2_value_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value is not null and event_type is not null")
    grouped = reconcile.equivalence_groups(events, ["event_type"], ["ts", "event_id"], "value", {"kind": "numeric", "absolute": 0.5, "percent": 10.0})
    return grouped.select("event_id", "group_value", "group_size")


@query(
    "cdc2_name_groups",
    r"""WITH p AS (SELECT *, lower(trim(regexp_replace(p_type, '\s+', ' ', 'g'))) AS form FROM part)
    SELECT p_partkey, first_value(p_type) OVER (PARTITION BY p_brand, form ORDER BY p_partkey) AS group_value, count(*) OVER (PARTITION BY p_brand, form) AS group_size FROM p""",
)
def cdc2_name_groups(spark, sf_dir):
    rule = {"kind": "text", "collapse_whitespace": True, "case_insensitive": True}
    return reconcile.equivalence_groups(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_type", rule).select("p_partkey", "group_value", "group_size")


_SQL_RECONCILED = """c AS (SELECT coalesce(user_id, -1) AS user_id, event_type, event_id, ts, value, k % 5 AS org, CASE WHEN k % 3 <> 0 THEN k % 31 END AS endpoint, CAST(floor(value * 4) AS BIGINT) AS evidence,
      k % 4 <> 0 AND value IS NOT NULL AND value < 80 AS good, CASE WHEN k % 5 < 3 THEN k % 5 ELSE 9007199254740992 END AS p FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM c WHERE good),
    s AS (SELECT DISTINCT user_id, event_type, 0::BIGINT AS n, []::BIGINT[] AS orgs, []::BIGINT[] AS endpoints, []::BIGINT[] AS evidences, NULL::BIGINT AS event_id, false AS kept FROM o
      UNION ALL SELECT user_id, event_type, n, CASE WHEN ok THEN list_append(orgs, org) ELSE orgs END, CASE WHEN ok AND endpoint IS NOT NULL THEN list_append(endpoints, endpoint) ELSE endpoints END, CASE WHEN ok THEN list_append(evidences, evidence) ELSE evidences END, event_id, ok
      FROM (SELECT o.user_id, o.event_type, o.n, orgs, endpoints, evidences, o.org::BIGINT AS org, o.endpoint::BIGINT AS endpoint, o.evidence, o.event_id,
          NOT (coalesce(list_contains(orgs, o.org), false) OR coalesce(list_contains(endpoints, o.endpoint), false) OR list_contains(evidences, o.evidence)) AS ok
        FROM s JOIN o ON o.user_id = s.user_id AND o.event_type = s.event_type AND o.n = s.n + 1)),
    i AS (SELECT o.user_id || ':' || o.event_type AS key, o.event_id AS id, o.value, row_number() OVER (PARTITION BY o.user_id, o.event_type ORDER BY p, o.ts DESC, o.event_id) AS n FROM o JOIN s USING (event_id) WHERE s.kept),
    {groups},
    x AS (SELECT m.key, group_value, count(*) AS size, min(i.n) AS first FROM m JOIN i ON i.id = m.id GROUP BY ALL),
    y AS (SELECT key, sum(size)::BIGINT AS n_eligible, count(*) AS n_groups, arg_min(struct_pack(v := group_value, n := size), first) AS best, arg_max(struct_pack(v := group_value, n := size), size * 100000 - first) AS most FROM x GROUP BY key),
    q(event_type, strategy, quorum, open_conflict, keep_last) AS (VALUES ('click', 'quorum', 2, false, true), ('view', 'quorum', 3, true, true), ('purchase', 'authoritative', NULL, false, false), ('error', 'human_review', NULL, true, true)),
    z AS (SELECT c.user_id, c.event_type, count(*) AS total FROM c GROUP BY ALL),
    d AS (SELECT z.*, y.* EXCLUDE key, q.* EXCLUDE event_type, CASE WHEN strategy IS NULL THEN 'no_policy' WHEN n_eligible IS NULL THEN 'no_fresh_verified_candidate' WHEN strategy = 'human_review' THEN 'human_review_required'
        WHEN n_groups > 1 AND open_conflict THEN 'verified_source_disagreement' WHEN strategy = 'quorum' AND most.n < quorum THEN 'independent_quorum_not_met' WHEN strategy = 'quorum' THEN 'independent_quorum_met' ELSE 'highest_authority_verified_source' END AS reason
      FROM z LEFT JOIN y ON y.key = z.user_id || ':' || z.event_type LEFT JOIN q ON q.event_type = z.event_type),
    e AS (SELECT *, CASE reason WHEN 'no_policy' THEN 'blocked' WHEN 'human_review_required' THEN CASE WHEN n_groups > 1 THEN 'conflict' ELSE 'withhold' END WHEN 'verified_source_disagreement' THEN 'conflict'
        WHEN 'independent_quorum_met' THEN 'release' WHEN 'highest_authority_verified_source' THEN 'release' ELSE CASE WHEN keep_last THEN 'continue_last_known_good' ELSE 'withhold' END END AS outcome FROM d)"""


@query(
    "cdc3_reconciled",
    f"""WITH RECURSIVE {_SQL_RECONCILED.format(groups=_SQL_GROUPS.format(near="abs(x - value) <= 12.0"))}
    SELECT user_id, event_type, outcome, reason, CASE WHEN outcome = 'release' THEN CASE WHEN strategy = 'quorum' THEN most.v ELSE best.v END END AS value,
      CASE WHEN outcome = 'release' THEN CASE WHEN strategy = 'quorum' THEN most.n ELSE best.n END ELSE 0 END AS n_supporting, coalesce(n_eligible, 0) AS n_eligible, total - coalesce(n_eligible, 0) AS n_rejected FROM e""",
)
def cdc3_reconciled(spark, sf_dir):
    """All events as candidates for a user's value of their type, under a policy of each type (none for sign-ups)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    events = table(spark, sf_dir, "events").select(
        F.coalesce("user_id", F.lit(-1)).alias("user_id"), "event_type", "event_id", "ts", "value", (k % 5).alias("org"), F.when(k % 3 != 0, k % 31).alias("endpoint"), F.floor(F.col("value") * 4).alias("evidence"),
        F.when(k % 4 != 0, "verified").alias("trust_state"), (F.col("value") < 80).alias("fresh"), F.when(k % 5 < 3, k % 5).alias("priority"),
    )
    policies = spark.createDataFrame(
        [("click", "quorum", 2, False, True), ("view", "quorum", 3, True, True), ("purchase", "authoritative", None, False, False), ("error", "human_review", None, True, True)],
        "event_type string, strategy string, quorum int, open_conflict boolean, keep_last boolean",
    )
    decisions, _ = reconcile.reconcile_candidates(
        events, policies, ["user_id", "event_type"], "event_type", ["ts", "event_id"], ["org", "endpoint", "evidence"], "priority", "ts", "event_id", "value", {"kind": "numeric", "absolute": 12.0}
    )
    return decisions.select("user_id", "event_type", "outcome", F.col("reasons")[0].alias("reason"), "value", "n_supporting", "n_eligible", "n_rejected")


def _identity_log(spark, sf_dir):
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_nationkey") % 3).alias("provider"))
    orders = table(spark, sf_dir, "orders").withColumn("s", F.col("o_orderstatus"))
    op, source = F.col("o_orderkey").alias("op_id"), F.col("o_custkey").alias("source_id")
    child = lambda n: (F.col("o_custkey") % n + 1)
    merges = orders.where("s = 'F'").select(op, F.lit("merge").alias("kind"), source, child(97).alias("target_id"))
    splits = orders.where("s = 'O'").select(op, F.lit("split").alias("kind"), source, F.explode(F.array(child(89), child(83))).alias("target_id"))
    undone = orders.where("s = 'P'").select(op, F.lit("reverse").alias("kind"), (F.col("o_orderkey") - 1).alias("undoes"))
    return entities, identity.check_operations(entities, merges.unionByName(splits).unionByName(undone, allowMissingColumns=True))


_SQL_IDENTITY = """e AS (SELECT c_custkey AS id, c_nationkey % 3 AS p FROM customer),
    o AS (SELECT o_orderkey AS op_id, 'merge' AS kind, o_custkey AS source_id, o_custkey % 97 + 1 AS target_id FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey, 'split', o_custkey, unnest([o_custkey % 89 + 1, o_custkey % 83 + 1]) FROM orders WHERE o_orderstatus = 'O'
      UNION ALL SELECT o_orderkey, 'reverse', NULL, o_orderkey - 1 FROM orders WHERE o_orderstatus = 'P'),
    r AS (SELECT o.*, CASE WHEN kind = 'reverse' THEN CASE WHEN target_id NOT IN (SELECT op_id FROM o WHERE kind <> 'reverse') THEN 'unknown_operation' END
      WHEN a.id IS NULL OR b.id IS NULL THEN 'unknown_entity' WHEN source_id = target_id THEN 'same_entity' WHEN a.p <> b.p THEN 'other_provider' END AS bad
      FROM o LEFT JOIN e a ON a.id = source_id LEFT JOIN e b ON b.id = target_id),
    q AS (SELECT op_id, any_value(kind) AS kind, coalesce(min(bad), CASE WHEN any_value(kind) = 'split' AND count(DISTINCT target_id) < 2 THEN 'few_children' END) AS problem FROM r GROUP BY op_id)"""


@query("id4_operation_problems", f"WITH {_SQL_IDENTITY} SELECT kind, problem, count(*) AS n_operations FROM q GROUP BY kind, problem")
def id4_operation_problems(spark, sf_dir):
    _, checked = _identity_log(spark, sf_dir)
    return checked.groupBy("kind", "problem").agg(F.count_distinct("op_id").alias("n_operations"))


@query(
    "id6_entity_states",
    f"""WITH {_SQL_IDENTITY}, x AS (SELECT o.* FROM o JOIN q USING (op_id) WHERE problem IS NULL AND o.kind <> 'reverse' AND op_id NOT IN (SELECT target_id FROM o JOIN q USING (op_id) WHERE problem IS NULL AND o.kind = 'reverse')),
    w AS (SELECT source_id, arg_min(target_id, op_id) FILTER (kind = 'merge') AS merged_into, count(*) FILTER (kind = 'split') AS n FROM x GROUP BY source_id)
    SELECT id AS entity_id, CASE WHEN merged_into IS NOT NULL THEN 'merged' WHEN n > 0 THEN 'split' ELSE 'active' END AS state, merged_into FROM e LEFT JOIN w ON id = source_id""",
)
def id6_entity_states(spark, sf_dir):
    states, _ = identity.apply_operations(*_identity_log(spark, sf_dir))
    return states


@query(
    "id8_first_reviews",
    "SELECT c_custkey, coalesce(r, 'pending') AS resolution FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS r FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
)
def id8_first_reviews(spark, sf_dir):
    reviews = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return identity.apply_reviews(table(spark, sf_dir, "customer").select("c_custkey"), reviews, "c_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")


@query(
    "wn5_circuit_states",
    """WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN value >= 30 THEN 'success' WHEN event_type = 'error' AND value < 3 THEN 'config_error' ELSE 'failure' END AS r,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'closed' AS circuit, 0::BIGINT AS f, 0::BIGINT AS o, true AS allowed, NULL::BIGINT AS event_id FROM c
      UNION ALL SELECT user_id, n, CASE WHEN NOT ok THEN 'open' WHEN r = 'success' THEN 'closed' WHEN trips THEN 'open' ELSE 'closed' END,
        CASE WHEN NOT ok THEN f WHEN r = 'success' THEN 0 ELSE f + 1 END, CASE WHEN ok AND r <> 'success' AND trips THEN t ELSE o END, ok, event_id
      FROM (SELECT c.*, f, o, circuit = 'closed' OR t - o >= 21600000000 AS ok, circuit = 'open' OR r = 'config_error' OR f + 1 >= 3 AS trips FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1))
    SELECT event_id, user_id, circuit, allowed FROM s WHERE n > 0""",
)
def wn5_circuit_states(spark, sf_dir):
    result = F.when(F.col("value") >= 30, "success").when((F.col("event_type") == "error") & (F.col("value") < 3), "config_error").otherwise("failure")
    calls = table(spark, sf_dir, "events").where("user_id is not null").select("event_id", "user_id", "ts", result.alias("outcome"))
    return progress.circuit_states(calls, "user_id", "ts", "event_id", "outcome", 3, 21600, F.to_date("ts")).select("event_id", "user_id", "circuit", "allowed")


@query(
    "wn8_stage_progress",
    """WITH r AS (SELECT o_custkey, o_orderstatus AS s, (o_orderdate, o_orderkey) AS m, o_totalprice >= 120000 AS ok FROM orders), k AS (SELECT DISTINCT o_custkey FROM orders),
    a AS (SELECT o_custkey, min(m) AS m, arg_min(ok, m) AS ok FROM r WHERE s = 'O' GROUP BY 1),
    b AS (SELECT o_custkey, min(r.m) AS m, arg_min(r.ok, r.m) AS ok FROM r JOIN a USING (o_custkey) WHERE s = 'P' AND a.ok AND r.m > a.m GROUP BY 1),
    c AS (SELECT o_custkey, min(r.m) AS m, arg_min(r.ok, r.m) AS ok FROM r JOIN b USING (o_custkey) WHERE s = 'F' AND b.ok AND r.m > b.m GROUP BY 1),
    j AS (SELECT o_custkey, coalesce(a.ok, false)::BIGINT + coalesce(b.ok, false)::BIGINT + coalesce(c.ok, false)::BIGINT AS n_passed,
      CASE WHEN NOT a.ok THEN 'O' WHEN NOT b.ok THEN 'P' WHEN NOT c.ok THEN 'F' END AS stopped_at_stage FROM k LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (o_custkey) LEFT JOIN c USING (o_custkey))
    SELECT o_custkey, n_passed, CASE WHEN stopped_at_stage IS NOT NULL THEN 'rolled_back' WHEN n_passed = 3 THEN 'active' ELSE 'running' END AS state, stopped_at_stage FROM j""",
)
def wn8_stage_progress(spark, sf_dir):
    results = table(spark, sf_dir, "orders").withColumn("passed", F.col("o_totalprice") >= 120000)
    return progress.stage_progress(results, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "passed", ["O", "P", "F"])


@query(
    "wn7_active_revisions",
    """WITH l AS (SELECT o_custkey, o_orderkey % 5 AS rev, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, max((o_orderdate, o_orderkey)) AS m FROM orders GROUP BY 1, 2)
    SELECT o_custkey, arg_max(rev, m) FILTER (s = 'F') AS active_revision, greatest(count(*) FILTER (s = 'F') - 1, 0) AS n_superseded FROM l GROUP BY 1""",
)
def wn7_active_revisions(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "active").otherwise("draft")
    rows = table(spark, sf_dir, "orders").withColumn("revision", F.col("o_orderkey") % 5).withColumn("state", state)
    return progress.active_revisions(rows, "o_custkey", "revision", "o_orderdate", "o_orderkey", "state")


def _usage(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").try_cast("bigint").alias("units"))


@query(
    "ag16_running_units",
    """SELECT event_id, user_id, CAST(coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS running_total FROM events""",
)
def ag16_running_units(spark, sf_dir):
    return ordered.running_sum(_usage(spark, sf_dir), "running_total", ["user_id"], ["ts", "event_id"], F.col("units"), F.col("day")).select("event_id", "user_id", "running_total")


@query(
    "ag16_budget_use",
    """WITH u AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS used FROM events GROUP BY 1, 2)
    SELECT *, greatest(0.0::DOUBLE, 4000 * (1 - 0.3::DOUBLE) - used) AS available, used >= 4000 * (1 - 0.3::DOUBLE) AS exhausted FROM u""",
)
def ag16_budget_use(spark, sf_dir):
    return progress.budget_use(_usage(spark, sf_dir), ["event_type", "day"], "units", 4000)


@query(
    "ag12_usage_rollup",
    """SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS period, count(*) FILTER (event_type = 'error') AS n_failed, coalesce(sum(CAST(json_extract(props, '$.k') AS DOUBLE)) FILTER (event_type = 'error'), 0) AS cost_failed,
      count(*) FILTER (event_type = 'purchase') AS n_bought, coalesce(sum(CAST(json_extract(props, '$.k') AS DOUBLE)) FILTER (event_type = 'purchase'), 0) AS cost_bought
    FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2""",
)
def ag12_usage_rollup(spark, sf_dir):
    usage = _usage(spark, sf_dir)
    out = progress.usage_rollup({"failed": (usage.where("event_type = 'error'"), "units"), "bought": (usage.where("event_type = 'purchase'"), "units")}, "user_id", "ts")
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


def _text(name: str, *columns: str):
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in columns])), ",").alias(name)


@query(
    "jn9_customers_with_orders",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY n) FILTER (n <= 20), '') AS orders
    FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def jn9_customers_with_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    child = dossier.Child(orders, ["o_orderkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return dossier.dossier(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", {"orders": child}).select("c_custkey", "n_orders", _text("orders", "o_orderkey", "o_orderstatus"))


@query(
    "jn11_order_dossiers",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, s_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    d AS (SELECT l_orderkey, count(*) AS c, string_agg(l_linenumber || ':' || l_partkey || ':' || s_name, ',' ORDER BY n) FILTER (n <= 20) AS t FROM l GROUP BY l_orderkey)
    SELECT o_orderkey, c_name, n_name, coalesce(c, 0) AS n_lines, coalesce(t, '') AS lines
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN d ON o_orderkey = l_orderkey""",
)
def jn11_order_dossiers(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(supplier, "l_suppkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    roots = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(people, "o_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey").select("o_orderkey", "c_name", "n_name")
    child = dossier.Child(lines, ["l_linenumber", "l_partkey", "s_name"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])
    return dossier.dossier(roots, "o_orderkey", {"lines": child}).select("o_orderkey", "c_name", "n_name", "n_lines", _text("lines", "l_linenumber", "l_partkey", "s_name"))


@query(
    "jn16_source_catalog",
    """WITH s AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier),
    a AS (SELECT s_nationkey, count(*) AS c, string_agg(s_suppkey || ':' || s_name, ',' ORDER BY n) FILTER (n <= 5) AS t FROM s GROUP BY 1),
    b AS (SELECT c_nationkey, count(*) AS c, string_agg(c_custkey::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS t FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) GROUP BY 1)
    SELECT r_name, n_name, coalesce(a.c, 0) AS n_suppliers, coalesce(a.t, '') AS suppliers, coalesce(b.c, 0) AS n_customers, coalesce(b.t, '') AS customers
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN a ON s_nationkey = n_nationkey LEFT JOIN b ON c_nationkey = n_nationkey""",
)
def jn16_source_catalog(spark, sf_dir):
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    roots = table(spark, sf_dir, "nation").join(regions, "n_regionkey").select("n_nationkey", "r_name", "n_name")
    children = {
        "suppliers": dossier.Child(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), ["s_suppkey", "s_name"], [F.desc("s_acctbal"), F.col("s_suppkey")], 5),
        "customers": dossier.Child(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), ["c_custkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3),
    }
    out = dossier.dossier(roots, "n_nationkey", children)
    return out.select("r_name", "n_name", "n_suppliers", _text("suppliers", "s_suppkey", "s_name"), "n_customers", _text("customers", "c_custkey"))


@query(
    "set1_newest_activity",
    """SELECT o_orderkey::VARCHAR AS id, o_orderdate::TIMESTAMP AS happened_at, 'order' AS kind, o_orderstatus AS label FROM orders
    UNION ALL SELECT event_id::VARCHAR, ts::TIMESTAMP, 'event', event_type FROM events ORDER BY happened_at DESC, kind, id LIMIT 200""",
)
def set1_newest_activity(spark, sf_dir):
    logs = {"order": (table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", F.col("o_orderstatus")), "event": (table(spark, sf_dir, "events"), "event_id", "ts", F.col("event_type"))}
    return dossier.timeline(logs, 200).withColumn("at", F.col("at").cast("timestamp_ntz")).withColumnRenamed("at", "happened_at")


@query("tk1_order_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def tk1_order_page(spark, sf_dir):
    return dossier.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 80)


@query(
    "tk3_fair_sources",
    """WITH w AS (SELECT l_suppkey, l_orderkey, l_extendedprice / nullif(l_quantity * (l_linenumber % 3), 0) AS f, l_shipdate FROM lineitem),
    b AS (SELECT l_suppkey, min({'f': coalesce(f, 'inf'::DOUBLE), 'i': l_orderkey}) AS b, max(l_shipdate) AS l_shipdate FROM w GROUP BY 1)
    SELECT l_suppkey, b.i AS l_orderkey, CASE WHEN isinf(b.f) THEN NULL ELSE b.f END AS weighted_finish FROM b""",
)
def tk3_fair_sources(spark, sf_dir):
    due = table(spark, sf_dir, "lineitem").withColumn("weight", F.col("l_quantity") * (F.col("l_linenumber") % 3))
    out = dossier.fair_order(due, "l_suppkey", "l_extendedprice", "weight", "l_shipdate", "l_orderkey")
    return out.select("l_suppkey", "l_orderkey", F.when(F.col("weighted_finish") < float("inf"), F.col("weighted_finish")).alias("weighted_finish"))


@query(
    "gr4_order_bundles",
    """WITH a AS (SELECT o_orderpriority AS b, o_custkey::VARCHAR AS name, min(sha256(o_orderstatus)) AS d, count(*) AS n FROM orders GROUP BY 1, 2),
    s AS (SELECT b, sha256(name)[1:2] AS shard, sha256(string_agg(name || ':' || d, chr(10) ORDER BY name || ':' || d)) AS d, count(*) AS n, count(*) FILTER (n > 1) AS r FROM a GROUP BY 1, 2)
    SELECT b AS o_orderpriority, CAST(sum(n) AS BIGINT) AS n_artifacts, CAST(sum(r) AS BIGINT) AS n_repeated, sha256(string_agg(shard || d, chr(10) ORDER BY shard || d)) AS bundle_digest FROM s GROUP BY b""",
)
def gr4_order_bundles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("digest", F.sha2("o_orderstatus", 256))
    return provenance.bundles(orders, "o_orderpriority", "o_custkey", "digest")


@query(
    "gr1_supply_graph",
    """WITH n AS (SELECT sha256('part|' || p_partkey) AS id FROM part WHERE p_size <= 40 UNION SELECT sha256('supplier|' || s_suppkey) FROM supplier),
    e AS (SELECT DISTINCT sha256('part|' || l_partkey) AS src, sha256('supplier|' || l_suppkey) AS dst FROM lineitem)
    SELECT sha256('supplied_by|' || src || '|' || dst) AS edge_id, NOT (src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) AS orphan FROM e""",
)
def gr1_supply_graph(spark, sf_dir):
    ref = lambda kind, c: (F.lit(kind).alias("kind"), F.col(c).cast("string").alias("ref"))
    nodes = table(spark, sf_dir, "part").where("p_size <= 40").select(*ref("part", "p_partkey")).unionByName(table(spark, sf_dir, "supplier").select(*ref("supplier", "s_suppkey")))
    ends = (F.lit("part").alias("src_kind"), F.col("l_partkey").alias("src_ref"), F.lit("supplier").alias("dst_kind"), F.col("l_suppkey").alias("dst_ref"))
    edges = table(spark, sf_dir, "lineitem").select(*ends, F.lit("supplied_by").alias("kind"))
    return provenance.marked_edges(nodes, edges).select("edge_id", "orphan")


@query(
    "src4_page_links",
    r"""WITH l AS (SELECT page_id, unnest(x) AS link, generate_subscripts(x, 1) - 1 AS position FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS x FROM pages))
    SELECT page_id, position::INT AS position, regexp_extract(link, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(link, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM l""",
)
def src4_page_links(spark, sf_dir):
    return sources.page_links(table(spark, sf_dir, "pages"))


_SQL_RELEASES = """WITH RECURSIVE c AS (SELECT event_id, user_id, value, event_type <> 'error' AND value IS NOT NULL AS fine, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS d, NULL::DOUBLE AS r FROM c
      UNION ALL SELECT user_id, n, event_id, d, CASE WHEN d = 'verified' THEN value ELSE r END FROM (SELECT c.*, r, CASE WHEN NOT fine THEN 'quarantined'
        WHEN r IS NOT NULL AND CASE WHEN r = 0 THEN c.value <> 0 ELSE abs(c.value - r) >= 0.5 * abs(r) END THEN 'needs_review' ELSE 'verified' END AS d FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1))
    SELECT event_id, user_id, d AS gate_decision, r AS released_value FROM s WHERE n > 0"""


def _gate_rows(events):
    return events.where("user_id is not null").select("event_id", "user_id", "ts", "value", (F.col("event_type") != "error").alias("good"))


@query("bt7_released_values", _SQL_RELEASES)
def bt7_released_values(spark, sf_dir):
    out = progress.released_values(_gate_rows(table(spark, sf_dir, "events")), "user_id", ["ts", "event_id"], "value", "good", bucket=F.to_date("ts"))
    return out.select("event_id", "user_id", "gate_decision", "released_value")


@query("st3_streaming_gate", _SQL_RELEASES)
def st3_streaming_gate(spark, sf_dir):
    stream = _gate_rows(jobs.read_stream(spark, f"{sf_dir}/events.parquet"))
    return jobs.gated_releases(stream, "user_id", ["ts", "event_id"], "value", "good").select("event_id", "user_id", "gate_decision", "released_value")


@query(
    "st4_expired_facts",
    """WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, event_type, max(ts) AS v FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, v::TIMESTAMP + INTERVAL 72 HOUR AS deadline FROM l, m WHERE now > v + INTERVAL 72 HOUR""",
)
def st4_expired_facts(spark, sf_dir):
    stream = jobs.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stale = jobs.expiries(stream, ["user_id", "event_type"], "ts", 72 * 3600)
    return stale.select("user_id", "event_type", F.col("deadline").cast("timestamp_ntz").alias("deadline"))
