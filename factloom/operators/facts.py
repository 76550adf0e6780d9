"""Bitemporal facts: versions, as-of queries, current facts, reconciliation and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.operators.ordered import carry
from factloom.session import materialize


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key (WN-1); order names the sort, newest first, with a tie-break."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def as_versions(observations: DataFrame, keys: list[str], time: str, value: str, tie: str, bucket: Column | None = None) -> DataFrame:
    """Append-only versions of a value: one row where it changes, valid until the next change (BT).

    Adds valid_from, valid_to (null for the open version) and before_value (null
    for the first). Repeated equal values make no new version. The versions are
    written once, as they are read twice. bucket: see ordered.carry.
    """
    order = [time, tie]
    marked = carry(observations, "__last", keys, order, F.struct(F.col(value).alias("x")), F.lit(True), bucket)
    kept = marked.where(F.col("__last").isNull() | ~F.col(value).eqNullSafe(F.col("__last.x"))).withColumn("before_value", F.col("__last.x")).drop("__last").withColumn("valid_from", F.col(time))
    kept = materialize(kept, "versions") if bucket is not None else kept
    return carry(kept, "valid_to", keys, order, F.col(time), F.lit(True), bucket, backward=True)


def as_of(versions: DataFrame, keys: list[str], at: Column, time: str = "valid_from", tie: str | None = None) -> DataFrame:
    """The version of each key that held at a moment (JN-5): the newest that had begun."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return latest_per_key(versions.where(F.col(time) <= at), keys, order)


def freshness(facts: DataFrame, verified: str, ttl_seconds: Column, now: Column) -> DataFrame:
    """Add lag_seconds (never negative) and stale (past the deadline, strictly) (FN-20)."""
    age = F.unix_timestamp(now) - F.unix_timestamp(verified)
    return facts.withColumn("lag_seconds", F.greatest(F.lit(0).cast("long"), age)).withColumn("stale", age > ttl_seconds)


def reconcile(candidates: DataFrame, keys: list[str], priority: Column, tie: list[Column]) -> DataFrame:
    """Choose one candidate per key by source priority (RC) and tell whether the best sources disagree.

    Returns keys, value, n_candidates, n_values and conflicted: several values
    at the best priority. priority is never null. Aggregates with partial
    results throughout, so a hot key is no hot task.
    """
    at = F.struct(priority.alias("p"), *[t.alias(f"t{n}") for n, t in enumerate(tie)])
    per_value = candidates.groupBy(*keys, "value").agg(F.count("*").alias("__n"), F.min(at).alias("__at"))
    # Each value now stands at its best priority, so counts of values add up over priorities.
    per_priority = per_value.groupBy(*keys, F.col("__at.p").alias("__p")).agg(F.sum("__n").alias("__n"), F.count("value").alias("__values"), F.min(F.struct("__at", "value")).alias("__first"))
    return per_priority.groupBy(*keys).agg(
        F.min("__first")["value"].alias("value"),
        F.sum("__n").alias("n_candidates"),
        F.sum("__values").alias("n_values"),
        (F.min_by("__values", "__p") > 1).alias("conflicted"),
    )


def change_events(versions: DataFrame, keys: list[str], value: str, time: str = "valid_from", bucket: Column | None = None) -> DataFrame:
    """Semantic change events between versions: created, increased, decreased, with the relative change (CDC). before_value is taken from as_versions() where it is there. bucket: see ordered.carry."""
    out = versions if "before_value" in versions.columns else carry(versions, "before_value", keys, [time], F.col(value), F.lit(True), bucket)
    kind = F.when(F.col("before_value").isNull(), "created").when(F.col(value) > F.col("before_value"), "increased").otherwise("decreased")
    return out.withColumn("change_type", kind).withColumn("change_ratio", F.try_divide(F.col(value) - F.col("before_value"), F.abs("before_value")))
