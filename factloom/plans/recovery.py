"""Queries of manifests, erasure, JSON payloads, page tables and identity chains."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import columns as C, payloads
from factloom.operators import identity, provenance, recovery
from factloom.plans.registry import query
from factloom.session import materialize, shared_dir, table
from factloom.sources import ingest, tables

_TEXT = lambda *columns: " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
_DIGEST = lambda lo, text: f"CAST(coalesce(sum(CAST('0x' || substr(sha256({text}), {lo}, 15) AS BIGINT)::HUGEINT), 0) AS VARCHAR)"


def _kept(spark, sf_dir):
    return {
        "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
        "orders": table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"),
        "documents": table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source", "text"),
    }


_SQL_MANIFEST = " UNION ALL ".join(
    f"SELECT '{name}' AS name, 'table' AS kind, count(*) AS n_rows, {_DIGEST(1, _TEXT(*columns))} AS digest_a, {_DIGEST(16, _TEXT(*columns))} AS digest_b FROM {name}"
    for name, columns in (
        ("customer", ("c_custkey", "c_mktsegment", "c_name", "c_nationkey")),
        ("orders", ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")),
        ("documents", ("doc_id", "lang", "n_chars", "source", "text")),
    )
)


@query("ag10_table_digests", f"{_SQL_MANIFEST} UNION ALL SELECT 'first_finished', 'witness', count(*), coalesce(sha256(CAST(min(o_orderkey) AS VARCHAR)), ''), '' FROM orders WHERE o_orderstatus = 'F'")
def ag10_table_digests(spark, sf_dir):
    """Counts, content digests and a witness of whole tables."""
    return recovery.manifest(_kept(spark, sf_dir), {"first_finished": ("orders", F.col("o_orderstatus") == "F", "o_orderkey")})


@query(
    "ag10_restore_check",
    """SELECT * FROM (VALUES ('customer', 'table', 'same'), ('orders', 'table', 'content_differs'), ('documents', 'table', 'count_differs'), ('benchmark', 'table', 'added')) t(name, kind, state)""",
)
def ag10_restore_check(spark, sf_dir):
    """A restored copy in another order, with the priorities of finished orders lost and the documents there twice."""
    before = _kept(spark, sf_dir)
    after = dict(before)
    after["customer"] = materialize(before["customer"].repartition(5, "c_name"), "restored")
    after["orders"] = before["orders"].withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    after["documents"] = before["documents"].unionByName(before["documents"])
    after["benchmark"] = table(spark, sf_dir, "benchmark")
    return recovery.verify_restore(recovery.manifest(before), recovery.manifest(after))


@query(
    "gov2_project_erasure",
    """WITH s AS (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)
    SELECT 'deleted' AS state, (SELECT count(*) FROM customer) AS customer_rows, (SELECT count(*) FROM customer WHERE c_custkey IN (FROM s)) AS customer_erased,
      (SELECT count(*) FROM orders) AS orders_rows, (SELECT count(*) FROM orders WHERE o_custkey IN (FROM s)) AS orders_erased""",
)
def gov2_project_erasure(spark, sf_dir):
    """Customers of one region and their orders, erased after their tables were restored and compared."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    gone = customers.join(table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    copies = {"customer": materialize(customers, "backup"), "orders": materialize(orders, "backup")}
    report = recovery.verify_restore(recovery.manifest({"customer": customers, "orders": orders}), recovery.manifest(copies))
    stages = {
        "customer": (customers, "c_custkey", {"c_name": "[DELETED]", "c_acctbal": None}),
        "orders": (orders, "o_custkey", {"o_orderpriority": None}),
    }
    return recovery.erase_project(spark, f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}", stages, gone, report)


@query(
    "fn15_canonical_events",
    """SELECT event_id, 'sha256:' || sha256('{"id":' || event_id || ',"kind":[' || '"' || event_type || '",null,true],"props":' || replace(props, ' ', '') || ',"unit":129}') AS digest FROM events""",
)
def fn15_canonical_events(spark, sf_dir):
    """Events as JSON texts with odd blanks, orders and numbers, and the digest of their canonical form."""
    text = F.format_string('{ "unit": 129.0, "props":%s,"kind" :["%s", null,true], "id": %d}', "props", "event_type", "event_id")
    return payloads.canonical_json(table(spark, sf_dir, "events").select("event_id", text.alias("body")), "body").select("event_id", "digest")


_SQL_SECRET = r"(?i)\b(?:kv_(?:live|test|dev)|whsec|sk|Bearer)[_-]?[A-Za-z0-9._-]{12,}\b"


@query(
    "gov3_redacted_json",
    rf"""SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '{_SQL_SECRET}')) AS BIGINT) AS n_hits,
      sha256('{{"api_token":"[REDACTED]","parts":[{{"n":' || n_chars || ',"text":' || to_json(regexp_replace(text, '{_SQL_SECRET}', '[REDACTED]', 'g')) || '}}]}}') AS redacted_sha256 FROM documents WHERE text IS NOT NULL""",
)
def gov3_redacted_json(spark, sf_dir):
    """Whole documents inside JSON payloads, without their secrets."""
    body = F.to_json(F.struct(F.array(F.struct("text", F.col("n_chars").alias("n"))).alias("parts"), F.col("source").alias("api_token")))
    rows = table(spark, sf_dir, "documents").where("text is not null and source is not null").select("doc_id", body.alias("body"))
    return payloads.redacted_json(rows, "body").select("doc_id", "n_hits", F.sha2("redacted", 256).alias("redacted_sha256"))


@query(
    "fn2_unicode_identifiers",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(regexp_replace('fi 12 KM.' || nfc_normalize(text), '[^\x00-\x7F]', ' ', 'g')), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS identifier_sha256 FROM documents WHERE text IS NOT NULL""",
)
def fn2_unicode_identifiers(spark, sf_dir):
    """Whole documents, after a ligature, circled and full-width letters, as identifiers."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("ﬁ ①② ＫＭ."), "text").alias("name"))
    return rows.select("doc_id", F.sha2(C.normalize_identifier(payloads.nfkc(F.col("name"))), 256).alias("identifier_sha256"))


@query(
    "src4_table_records",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || '&' || l_linestatus AS state, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) + 1 AS row_no FROM lineitem)
    SELECT l_orderkey, CAST(row_no AS INTEGER) AS row_no, unnest(['Line', 'Part', 'State']) AS field, unnest([CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), state]) AS text FROM l""",
)
def src4_table_records(spark, sf_dir):
    """The lines of each order as a page with a table, read back as records."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.format_string("<tr><td>%d<td> %d\n<td><b>%s</b>&amp;%s</tr>", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("row"))
    body = F.array_join(F.sort_array(F.collect_list(line))["row"], "")
    page = F.concat(F.format_string("<body><!-- <td> --><table><tr><th colspan=3>Order %d<tr><th>Line<th>Part<th>State</tr>", "l_orderkey"), "body", F.lit("</table><script>x='<td>'</script>"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(body.alias("body")).select("l_orderkey", page.alias("html"))
    return tables.page_records(pages).select("l_orderkey", "row_no", "field", "text")


@query(
    "id7_survivors",
    """WITH RECURSIVE m AS (SELECT c_custkey AS e, c_custkey + c_nationkey + 1 AS t FROM customer),
    w AS (SELECT e, t FROM m UNION ALL SELECT w.e, m.t FROM w JOIN m ON w.t = m.e)
    SELECT e AS entity_id, max(t) AS survivor_id, false AS on_cycle FROM w GROUP BY e""",
)
def id7_survivors(spark, sf_dir):
    """Each customer is merged into one further on, by steps of its nation's number."""
    return identity.survivors(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") + F.col("c_nationkey") + 1).alias("merged_into")))


@query(
    "id3_ambiguous_customers",
    "SELECT c_custkey, s_suppkey AS entity_id FROM customer JOIN (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) ON c_nationkey = s_nationkey WHERE n > 1",
)
def id3_ambiguous_customers(spark, sf_dir):
    keyed = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("entity_id"))
    return identity.ambiguous(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key")), keyed, "key").select("c_custkey", "entity_id")


@query("dq11_broken_bundles", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def dq11_broken_bundles(spark, sf_dir):
    """The lines of an order are its sealed artifacts; those that came back have another content by now."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("name"), F.sha2(F.col("l_returnflag"), 256).alias("d"), "l_returnflag")
    changed = lines.withColumn("d", F.when(F.col("l_returnflag") == "R", F.sha2(F.lit("changed"), 256)).otherwise(F.col("d")))
    return provenance.broken_bundles(provenance.bundles(lines, "l_orderkey", "name", "d"), changed, "l_orderkey", "name", "d").select("l_orderkey")


@query("src1_snapshot_rows", "SELECT CASE WHEN event_type = 'error' THEN 'invalid' ELSE 'ready' END AS state, count(*) AS n, coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id END), 0)::BIGINT AS ids FROM events GROUP BY 1")
def src1_snapshot_rows(spark, sf_dir):
    """Events written as JSON lines, those of errors cut off, and read back as a snapshot."""
    whole = F.to_json(F.struct("event_id", "event_type"))
    cut = F.when(F.col("event_type") == "error", F.substring(whole, 1, 20)).otherwise(whole)
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(cut.alias("value")).write.text(path)
    schema = spark.createDataFrame([], "event_id long, event_type string").schema
    rows = materialize(ingest.read_snapshot(spark, path, schema), "snapshot")
    good = F.when(F.col("state") == "ready", F.col("event_id"))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.coalesce(F.sum(good), F.lit(0)).alias("ids"))
