"""Retention, erasure, alerts, deliveries and freshness reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Seconds before each next delivery attempt, and the kinds of signal that always fire.
RETRY_SECONDS = [60, 300, 1800, 7200, 43200, 86400]
FIRING = ["source_outage", "webhook_failure", "freshness_breach"]


def retain(df: DataFrame, time: str, as_of: Column, days: int, preserved: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Redact payloads older than `days`, unless their key is preserved (GOV-1).

    Adds retention: kept, preserved or redacted. A redacted column becomes null
    and its hash stays in <column>_sha256. Rows without a time are kept.
    """
    old = F.coalesce(F.col(time) < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
    safe = preserved.select(key).distinct().withColumn("__safe", F.lit(True))
    marked = df.join(safe, key, "left").withColumn("retention", F.when(~old, "kept").when(F.col("__safe"), "preserved").otherwise("redacted"))
    gone = F.col("retention") == "redacted"
    for c in payload:
        marked = marked.withColumn(f"{c}_sha256", F.when(gone, F.sha2(F.col(c).cast("string"), 256))).withColumn(c, F.when(~gone, F.col(c)))
    return marked.drop("__safe")


def retention_report(retained: DataFrame) -> DataFrame:
    """Counts of a retention run: n_scanned, n_eligible, n_redacted, n_preserved."""
    state = F.col("retention")
    return retained.agg(
        F.count("*").alias("n_scanned"),
        F.count_if(state != "kept").alias("n_eligible"),
        F.count_if(state == "redacted").alias("n_redacted"),
        F.count_if(state == "preserved").alias("n_preserved"),
    )


def erase(df: DataFrame, subjects: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Blank the payload of the subjects' rows and keep its hash in `tombstone` (GOV-2); other rows have none."""
    gone = subjects.select(key).distinct().withColumn("__gone", F.lit(True))
    joined = df.join(gone, key, "left")
    digest = F.sha2(F.to_json(F.struct(*payload)), 256)
    joined = joined.withColumn("tombstone", F.when(F.col("__gone"), digest))
    for c in payload:
        joined = joined.withColumn(c, F.when(F.col("__gone").isNull(), F.col(c)))
    return joined.drop("__gone")


def alerts(signals: DataFrame) -> DataFrame:
    """One alert per scope, kind and resource, from its newest signal (GOV-4).

    signals: scope, kind, resource, severity, observed_at. Ties go to the larger severity text.
    """
    fires = F.col("kind").isin(FIRING)
    newest = signals.groupBy("scope", "kind", "resource").agg(F.max(F.struct("observed_at", "severity")).alias("s"))
    return newest.select(
        F.concat_ws(":", "scope", "kind", "resource").alias("alert_key"),
        F.when(fires, "firing").otherwise("observed").alias("status"),
        F.when(fires, "critical").otherwise(F.col("s.severity")).alias("severity"),
        F.concat(F.lit("runbooks/"), F.replace("kind", F.lit("_"), F.lit("-")), F.lit(".md")).alias("runbook"),
        F.col("s.observed_at").alias("observed_at"),
    )


def delivery_states(attempts: DataFrame, key: str, time: str, tie: str, max_attempts: int = 6) -> DataFrame:
    """State of each delivery after its last attempt (WN-6).

    attempts has outcome: success, permanent_failure or another failure.
    Returns key, n_attempts, state, wait_seconds (null unless retrying).
    """
    last = F.max_by("outcome", F.struct(time, tie))
    done = attempts.groupBy(key).agg(F.count("*").alias("n_attempts"), last.alias("__last"))
    dead = (F.col("__last") == "permanent_failure") | (F.col("n_attempts") >= max_attempts)
    state = F.when(F.col("__last") == "success", "delivered").when(dead, "dead_letter").otherwise("retrying")
    ladder = F.array(*[F.lit(s) for s in RETRY_SECONDS])
    step = F.least(F.col("n_attempts"), F.lit(len(RETRY_SECONDS))).cast("int")
    done = done.withColumn("state", state)
    return done.withColumn("wait_seconds", F.when(F.col("state") == "retrying", F.element_at(ladder, step).cast("long"))).drop("__last")


def subscribed(events: DataFrame, subscriptions: DataFrame, salts: int = 64) -> DataFrame:
    """Pairs of events and matching subscriptions (JN-8).

    events: kind, and optionally predicate and correction (boolean);
    subscriptions: kinds and optionally predicates (arrays; empty or null
    matches all) and corrections (boolean, false by default). A null predicate
    matches no list; corrections go to those that ask for them.

    Subscriptions with kinds are split into one row for each, so this stays an
    equi-join; wildcards are dealt to `salts` copies, one for each part of the
    events, so that no task gets all events.
    """
    listed = F.coalesce(F.size("kinds"), F.lit(0)) > 0
    named = events.join(subscriptions.where(listed).withColumn("__kind", F.explode(F.array_distinct("kinds"))), F.col("kind") == F.col("__kind")).drop("__kind")
    wild = subscriptions.where(~listed).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = events.withColumn("__salt", F.pmod(F.xxhash64(*events.columns), F.lit(salts)).cast("int"))
    out = named.unionByName(salted.join(wild, "__salt").drop("__salt"))
    if "predicates" in subscriptions.columns:
        out = out.where((F.coalesce(F.size("predicates"), F.lit(0)) <= 0) | F.coalesce(F.array_contains("predicates", F.col("predicate")), F.lit(False)))
    if "corrections" in subscriptions.columns:
        out = out.where(~F.coalesce("correction", F.lit(False)) | F.coalesce("corrections", F.lit(False)))
    return out


def freshness_report(facts: DataFrame, scope: str) -> DataFrame:
    """Released, fresh and stale facts of each scope and the fresh share in percent (AG-11); facts has stale."""
    return facts.groupBy(scope).agg(
        F.count("*").alias("n_released"),
        F.count_if(~F.col("stale")).alias("n_fresh"),
        F.count_if("stale").alias("n_stale"),
        F.round(F.try_divide(100.0 * F.count_if(~F.col("stale")), F.count("*")), 4).alias("fresh_percent"),
    )


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Per system: cases, passes, false-heal rate over negative controls (0 without any) and held-out pass rate (null without any) (AG-1).

    results: system, visibility, outcome, false_heal, false_release.
    """
    negative, held_out, passed = F.col("visibility") == "negative_control", F.col("visibility") == "held_out", F.col("outcome") == "pass"
    return results.groupBy("system").agg(
        F.count("*").alias("n_cases"),
        F.count_if(passed).alias("n_passed"),
        F.coalesce(F.try_divide(F.count_if(negative & F.col("false_heal")), F.count_if(negative)), F.lit(0.0)).alias("false_heal_rate"),
        F.try_divide(F.count_if(held_out & passed), F.count_if(held_out)).alias("held_out_pass_rate"),
        F.count_if("false_release").alias("n_false_releases"),
    )


def request_verdicts(requests: DataFrame, key: str, time: str, tie: str, limit: int) -> DataFrame:
    """Each request's verdict in its minute, authorized or rate_limited, and what remains (ST-1 in batch)."""
    from pyspark.sql import Window

    minute = F.date_trunc("minute", F.col(time))
    nth = F.row_number().over(Window.partitionBy(key, minute).orderBy(time, tie))
    return requests.withColumn("verdict", F.when(nth <= limit, "authorized").otherwise("rate_limited")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - nth).cast("long"))
