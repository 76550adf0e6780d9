"""Queries of single-value helpers: dates, quantities, paths, URLs and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import bitemporal
from factloom.plans.registry import query
from factloom.session import table


@query(
    "fn6_order_dates",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE::TIMESTAMP WHEN 1 THEN date_trunc('second', o_orderdate::TIMESTAMP) WHEN 2 THEN date_trunc('minute', o_orderdate::TIMESTAMP) - INTERVAL 90 MINUTE WHEN 3 THEN date_trunc('second', o_orderdate::TIMESTAMP) + INTERVAL 2 HOUR END AS parsed FROM orders""",
)
def fn6_order_dates(spark, sf_dir):
    """Order times written in four ISO forms, and as a day's text that is none."""
    at, n = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 5
    form = lambda f: F.date_format(at, f)
    text = (
        F.when(n == 0, form("yyyy-MM-dd")).when(n == 1, F.concat(F.lit(" "), form("yyyy-MM-dd'T'HH:mm:ss"))).when(n == 2, F.concat(form("yyyy-MM-dd HH:mm"), F.lit("+01:30"))).when(n == 3, F.concat(form("yyyy-MM-dd'T'HH:mm:ss'.000'"), F.lit("-0200"))).otherwise(form("dd/MM/yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", C.parse_date(text).cast("timestamp_ntz").alias("parsed"))


@query(
    "fn10_quantities",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_tax * 1000000.0::DOUBLE WHEN l_returnflag = 'R' THEN l_tax * 1000.0::DOUBLE ELSE l_tax END AS usd_per_million, CASE WHEN l_linestatus = 'O' THEN l_quantity * 1000.0::DOUBLE END AS n_tokens,
      CASE WHEN l_linestatus = 'F' THEN l_quantity * 3600000.0::DOUBLE ELSE l_quantity * 60000.0::DOUBLE END AS ms FROM lineitem""",
)
def fn10_quantities(spark, sf_dir):
    c = F.col
    per = F.when(c("l_returnflag") == "A", "token").when(c("l_returnflag") == "R", "thousand_tokens").otherwise("million_input_tokens")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", C.usd_per_million(c("l_tax"), per).alias("usd_per_million"), C.tokens(c("l_quantity"), F.when(c("l_linestatus") == "O", "thousand_tokens").otherwise("words")).alias("n_tokens"),
        C.duration_ms(c("l_quantity"), F.when(c("l_linestatus") == "F", "hours").otherwise("minutes")).alias("ms"),
    )


@query("fn13_record_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, NULL::VARCHAR AS gone, user_id::VARCHAR AS user_id FROM events")
def fn13_record_paths(spark, sf_dir):
    """Events as records with nested properties, under an observation that names their user."""
    record = F.try_parse_json(F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "props": '), "props", F.lit("}")))
    observation = F.try_parse_json(F.to_json(F.struct(F.struct("user_id").alias("source"))))
    value = lambda path: C.path_value(record, observation, path)
    return table(spark, sf_dir, "events").select("event_id", value("props.k").alias("k"), value("kind").alias("kind"), value("props.k.deeper").alias("gone"), value("$observation.source.user_id").alias("user_id"))


@query(
    "pf4_approved_hosts",
    r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages)
    SELECT page_id, CASE WHEN url IS NULL OR NOT starts_with(url, 'https://') THEN 'not_https' WHEN page_id % 4 = 1 THEN 'private_host' WHEN page_id % 4 = 2 OR NOT ends_with(host, '.example.com') THEN 'host_not_approved' END AS reason FROM u""",
)
def pf4_approved_hosts(spark, sf_dir):
    """Page addresses, some of them moved to private or unapproved hosts; approved are the hosts of one domain."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]*)", 1))
    n, other = F.col("page_id") % 4, F.when(F.col("page_id") % 8 == 1, "172.16.0.9").otherwise("a.localhost.")
    moved = F.when(n == 1, F.regexp_replace("url", r"^(https://)[^/?#:]*", F.concat(F.lit("$1"), other))).when(n == 2, F.regexp_replace("url", r"^(https://)[^/?#:]*", "$110.example.org")).otherwise(F.col("url"))
    # An allow-list is a short configuration; here it is one name for all hosts of the domain.
    plain = F.when(host.endswith(".example.com") & ~n.isin(1, 2), F.regexp_replace(moved, r"^(https://)[^/?#:]*", "$1www.example.com")).otherwise(moved)
    return pages.select("page_id", C.unsafe_url_reason(plain, ["WWW.example.com"]).alias("reason"))


@query(
    "pf12_provenance_gaps",
    """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN o_custkey IS NULL THEN 'canonical_observation_id' END, CASE WHEN l_tax > 0.07 THEN 'semantic_contract_id' END, CASE WHEN l_returnflag = 'R' THEN 'collector_binding_id' END, CASE WHEN l_quantity < 3 THEN 'source_paths' END, CASE WHEN l_linestatus = 'O' AND l_quantity > 40 THEN 'evidence_refs' END) AS missing
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'""",
)
def pf12_provenance_gaps(spark, sf_dir):
    c, empty = F.col, F.array().cast("array<string>")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left").select(
        "l_orderkey", "l_linenumber", c("o_custkey").alias("canonical_observation_id"), c("l_partkey").alias("canonical_field_id"), c("l_suppkey").alias("source_observation_id"), F.when(c("l_tax") <= 0.07, c("l_shipdate")).alias("semantic_contract_id"),
        c("l_linestatus").alias("mapping_revision_id"), F.when(c("l_returnflag") == "R", "").otherwise(c("l_returnflag")).alias("collector_binding_id"), F.when(c("l_quantity") >= 3, F.array("l_linestatus")).alias("source_paths"),
        F.when((c("l_linestatus") == "O") & (c("l_quantity") > 40), empty).otherwise(F.array("l_returnflag")).alias("evidence_refs"),
    )
    return bitemporal.provenance_gaps(rows).select("l_orderkey", "l_linenumber", F.array_join("missing", ",").alias("missing"))
