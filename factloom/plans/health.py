"""Queries of reconciliation, health, schema and text-column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import facts, health, reconcile
from factloom.plans.registry import query
from factloom.session import table

# A public example key for signatures, and its pads.
_KEY = b"example-signing-key"
_INNER, _OUTER = (bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(
    "cdc3_quorum",
    """WITH c AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, CAST(floor(value / 50) AS BIGINT) AS bucket, event_id % 3 AS g
      FROM events WHERE value IS NOT NULL),
    v AS (SELECT user_id, event_type, day, bucket, count(*) AS n, count(DISTINCT g) >= 2 AS enough FROM c GROUP BY ALL)
    SELECT user_id, event_type, day, CASE WHEN count(*) FILTER (enough) = 1 THEN max(bucket) FILTER (enough) END AS value,
      CAST(sum(n) AS BIGINT) AS n_candidates, count(*) AS n_values,
      CASE WHEN count(*) FILTER (enough) = 1 THEN 'release' WHEN count(*) FILTER (enough) > 1 THEN 'conflict' ELSE 'withhold' END AS outcome
    FROM v GROUP BY user_id, event_type, day""",
)
def cdc3_quorum(spark, sf_dir):
    candidates = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), F.floor(F.col("value") / 50).alias("bucket"), (F.col("event_id") % 3).alias("g"))
    return reconcile.by_quorum(candidates, ["user_id", "event_type", "day"], "bucket", "g", 2)


@query(
    "cdc5_status_changes",
    """WITH b AS (SELECT o_custkey, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    a AS (SELECT o_custkey, o_orderstatus AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    j AS (SELECT o_custkey, b.s AS before_value, a.s AS after_value, CASE WHEN b.s IS NULL THEN 'created' WHEN a.s IS NULL THEN 'absent' ELSE 'updated' END AS change_type
      FROM b FULL JOIN a USING (o_custkey) WHERE b.s IS DISTINCT FROM a.s)
    SELECT *, sha256(concat_ws('|', o_custkey::VARCHAR, change_type, coalesce(before_value, ''), coalesce(after_value, ''))) AS event_id FROM j""",
)
def cdc5_status_changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    newest = lambda rows: facts.latest_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    before = newest(orders.where("o_orderdate < timestamp '1996-01-01'"))
    after = newest(orders.where("o_orderdate >= timestamp '1998-01-01'"))
    return reconcile.detect_changes(before, after, ["o_custkey"], "o_orderstatus")


@query(
    "dq5_triage",
    """SELECT event_id, CASE WHEN k = 4 THEN 'dead_page' WHEN k IN (1, 3, 29) THEN 'soft_block' WHEN k >= 90 THEN 'transport_failure'
      WHEN event_type = 'signup' AND value < 5 THEN 'legitimate_empty' WHEN value > 200 THEN 'semantic_swap' WHEN event_type = 'error' THEN 'structural_drift' ELSE 'unknown' END AS classification,
      CASE WHEN k = 4 THEN 'mark_dead' WHEN k IN (1, 3, 29) THEN 'quarantine' WHEN k >= 90 THEN 'retry' WHEN event_type = 'signup' AND value < 5 THEN 'do_not_heal'
      WHEN value > 200 OR event_type = 'error' THEN 'heal' ELSE 'human_review' END AS action
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""",
)
def dq5_triage(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    k, kind, value = F.col("k"), F.col("event_type"), F.col("value")
    conditions = {
        "dead_page": k == 4,
        "soft_block": k.isin(1, 3, 29),
        "transport_failure": k >= 90,
        "legitimate_empty": (kind == "signup") & (value < 5),
        "semantic_swap": value > 200,
        "structural_drift": kind == "error",
    }
    return health.triage(events, conditions).select("event_id", "classification", "action")


@query(
    "ag8_source_health",
    """WITH m AS (SELECT user_id, ts, event_id, coalesce(value >= 20, false) AS ok FROM events),
    s AS (SELECT user_id, max((ts, event_id)) AS good FROM m WHERE ok GROUP BY user_id),
    j AS (SELECT m.*, s.good FROM m LEFT JOIN s USING (user_id))
    SELECT user_id, CASE WHEN count(*) FILTER (good IS NULL OR (ts, event_id) > good) = 0 THEN 'healthy' ELSE 'failing' END AS state,
      count(*) FILTER (good IS NULL OR (ts, event_id) > good) AS consecutive_failures, count(*) AS n_observations, max(ts) FILTER (ok) AS last_success_at FROM j GROUP BY user_id""",
)
def ag8_source_health(spark, sf_dir):
    return health.source_health(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("value") >= 20)


@query(
    "st5_job_states",
    """WITH m AS (SELECT max(ts) AS now FROM events), j AS (SELECT user_id, count(*) AS n_attempts, epoch_us(max(ts)) AS l, epoch_us(min(ts)) AS f FROM events GROUP BY user_id)
    SELECT user_id, n_attempts, epoch_us(now) - l AS idle_micros, CASE WHEN n_attempts >= 75 THEN 'exhausted' WHEN epoch_us(now) - f > 2550000 * 1000000::BIGINT THEN 'timed_out'
      WHEN epoch_us(now) - l > 21600 * 1000000::BIGINT THEN 'stuck' ELSE 'active' END AS state FROM j, m""",
)
def st5_job_states(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp")
    return health.job_states(events, "user_id", "ts", now, 21600, 2550000, 75)


@query(
    "wn2_value_jumps",
    """WITH l AS (SELECT event_id, user_id, value, last_value(CASE WHEN value < 100 THEN value END IGNORE NULLS) OVER (
      PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_verified FROM events)
    SELECT event_id, user_id, last_verified, coalesce(abs(value - last_verified) / nullif(abs(last_verified), 0) >= 0.5, false) AS jumped FROM l""",
)
def wn2_value_jumps(spark, sf_dir):
    out = health.jumps(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("value") < 100, bucket=F.to_date("ts"))
    return out.select("event_id", "user_id", "last_verified", "jumped")


@query(
    "pf4_page_urls",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([A-Za-z]+://[^/]+/.*[^/])/+$', '\1') AS url,
      CASE WHEN url IS NULL OR NOT starts_with(url, 'https://') THEN 'not_https' WHEN regexp_matches(url, '^https://[^/?#]*@') THEN 'credentials' END AS reason FROM pages""",
)
def pf4_page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.normalize_url(F.col("url")).alias("url"), C.unsafe_url_reason(F.col("url")).alias("reason"))


@query(
    "fn16_signed_events",
    f"""SELECT event_id, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(event_id || '.' || event_type)))) AS signature FROM events""",
)
def fn16_signed_events(spark, sf_dir):
    body = F.concat_ws(".", F.col("event_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", C.hmac_sha256(_KEY, body).alias("signature"))


@query(
    "gov3_masked_documents",
    rf"""SELECT doc_id, len(regexp_extract_all(text, '{C.SECRET_PAIR}')) AS n_masked, sha256(regexp_replace(text, '{C.SECRET_PAIR}', '\1="[REDACTED]"', 'g')) AS text_sha256 FROM documents""",
)
def gov3_masked_documents(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(text, F.lit(C.SECRET_PAIR)).cast("long").alias("n_masked"), F.sha2(C.mask_secret_pairs(text), 256).alias("text_sha256"))
