"""Contract gates, failure streaks and transition audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.ordered import carry, running_sum


def gate(df: DataFrame, critical: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """Add violations array<string> and decision: quarantined, needs_review or verified (DQ-2).

    Each condition is true where the row violates it; null counts as a violation.
    """
    names = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    bad, doubtful = names(critical), names(warnings)
    out = df.withColumn("__bad", bad).withColumn("__doubtful", doubtful)
    decision = F.when(F.size("__bad") > 0, "quarantined").when(F.size("__doubtful") > 0, "needs_review").otherwise("verified")
    return out.withColumn("violations", F.concat("__bad", "__doubtful")).withColumn("decision", decision).drop("__bad", "__doubtful")


def last_known_good(df: DataFrame, keys: list[str], order: list[str], value: str, good: Column, bucket: Column | None = None) -> DataFrame:
    """Add released_value: the row's value where good, else the key's last good one before it (DQ-3). bucket: see ordered.carry."""
    return carry(df, "released_value", keys, order, F.col(value), good & F.col(value).isNotNull(), bucket, inclusive=True)


def failure_streaks(df: DataFrame, keys: list[str], order: list[str], failed: Column, bucket: Column | None = None) -> DataFrame:
    """Add streak: failures in a row up to and with this row, 0 on success (WN-4); null counts as success. bucket: see ordered.carry."""
    bad = F.coalesce(failed, F.lit(False))
    counted = running_sum(df.withColumn("__bad", bad), "__n", keys, order, F.when(F.col("__bad"), 1).otherwise(0), bucket)
    marked = carry(counted, "__since", keys, order, F.col("__n"), ~F.col("__bad"), bucket, inclusive=True)
    return marked.withColumn("streak", F.col("__n") - F.coalesce("__since", F.lit(0))).drop("__bad", "__n", "__since")


def audit_transitions(df: DataFrame, keys: list[str], order: list[str], state: str, allowed: list[tuple[str, str]], bucket: Column | None = None) -> DataFrame:
    """Rows whose step from the key's previous state is not allowed (WN-3), with that state as from_state. bucket: see ordered.carry."""
    fine = F.lit(False)
    for a, b in allowed:
        fine = fine | ((F.col("from_state") == a) & (F.col(state) == b))
    out = carry(df, "from_state", keys, order, F.col(state), F.lit(True), bucket)
    return out.where(F.col("from_state").isNotNull() & ~fine)
