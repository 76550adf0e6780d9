"""Readers of collected snapshots, HTML fields and idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, whole_files: bool = False) -> DataFrame:
    """Rows of JSON lines, or of files that hold one array or object (SRC-1).

    Adds state: ready or invalid, with the source line in _corrupt. Blank files give no rows.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", whole_files)
    return read.json(path).withColumn("state", F.when(F.col("_corrupt").isNull(), "ready").otherwise("invalid"))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, host, lang, title, heading and n_links of raw pages (SRC-4); a field that is absent is null."""
    first = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    return pages.select(
        "page_id",
        F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"),
        first(r'<html[^>]* lang="([a-z-]+)"').alias("lang"),
        first(r"<title>([^<]*)</title>").alias("title"),
        first(r"<h1[^>]*>([^<]*)</h1>").alias("heading"),
        F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"),
    )


def ingest(new: DataFrame, stored: DataFrame, key: str, payload: str, order: list[str]) -> DataFrame:
    """Add ingest_state to new rows by operation key (SRC-5).

    accepted: the first row of a key that is not stored; duplicate: the key is
    stored or came before with an equal payload; rejected: with another
    payload. A null key is rejected. stored holds each key once; order is unique within a key.
    """
    known = stored.select(key, F.col(payload).alias("__stored"), F.lit(True).alias("__known"))
    # Rows without a key need no comparison, so they don't meet in one task; the first row of a key is a partial aggregate.
    keyed = new.where(F.col(key).isNotNull())
    at = F.struct(*order)
    first = keyed.groupBy(key).agg(F.min(F.struct(at.alias("at"), F.struct(payload).alias("row"))).alias("__first"))
    joined = keyed.join(known, key, "left").join(first, key)
    base = F.when(F.col("__known"), F.col("__stored")).otherwise(F.col(f"__first.row.{payload}"))
    state = (
        F.when(F.col("__known").isNull() & (at == F.col("__first.at")), "accepted")
        .when(F.col(payload).eqNullSafe(base), "duplicate")
        .otherwise("rejected")
    )
    none = new.where(F.col(key).isNull()).withColumn("ingest_state", F.lit("rejected"))
    return joined.withColumn("ingest_state", state).select(*new.columns, "ingest_state").unionByName(none)


def page_links(pages: DataFrame) -> DataFrame:
    """Links of raw pages in order (SRC-4): page_id, position int (from 0), href, label without tags."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("position", "link"))
    label = F.trim(F.regexp_replace(F.regexp_replace("link", "<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "position", F.regexp_extract("link", '(?i)href="([^"]*)"', 1).alias("href"), label.alias("label"))
