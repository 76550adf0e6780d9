"""Bitemporal fact histories: append-only versions and transitions, and what they say at a moment.

versions: version_id, operation_key, the fact's keys, value, valid_from, transaction_from,
verified_at, state. transitions: previous_version_id, kind (supersession, correction,
retraction), transaction_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def admit_versions(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Add state and problem to new versions (BT-1, PF-11, PF-12).

    new also has intent (initial, real_change, correction), field_state and
    previous_version_id. problem is null or the first that holds: duplicate
    (operation stored), no_provenance, already_initial, no_previous,
    no_valid_from. state is released, withheld (the field isn't trusted) or
    null with a problem. stored holds each version_id and operation_key once.
    """
    done = stored.select("operation_key", F.lit(True).alias("__done")).where("operation_key is not null")
    begun = stored.where("state = 'released'").select(*keys).distinct().withColumn("__begun", F.lit(True))
    same = [F.col(k).alias(f"__{k}") for k in keys]
    before = stored.select(F.col("version_id").alias("previous_version_id"), *same, F.lit(True).alias("__found"))
    out = new.join(done, "operation_key", "left").join(begun, keys, "left").join(before, "previous_version_id", "left")
    of_fact = F.col("__found").isNotNull()
    for k in keys:
        of_fact = of_fact & F.col(k).eqNullSafe(F.col(f"__{k}"))
    later = F.coalesce(F.col("intent") != "initial", F.lit(True))
    problem = (
        F.when(F.col("__done"), "duplicate")
        .when(F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0, "no_provenance")
        .when(~later & F.col("__begun"), "already_initial")
        .when(later & ~of_fact, "no_previous")
        .when((F.col("intent") == "real_change") & F.col("valid_from").isNull(), "no_valid_from")
    )
    trusted = F.coalesce(F.col("field_state").isin("verified", "last_known_good"), F.lit(False))
    out = out.withColumn("problem", problem).withColumn("state", F.when(F.col("problem").isNull(), F.when(trusted, "released").otherwise("withheld")))
    return out.drop("__done", "__begun", "__found", *[f"__{k}" for k in keys])


# The ids that a fact's provenance names.
PROVENANCE_IDS = ("canonical_observation_id", "canonical_field_id", "source_observation_id", "semantic_contract_id", "mapping_revision_id", "collector_binding_id")


def provenance_gaps(facts: DataFrame) -> DataFrame:
    """Add missing: which of the six provenance ids, source_paths and evidence_refs a fact lacks (PF-12).

    An id lacks if it is null or, as a text, empty; a list if it is null or
    empty. Facts without gaps have an empty list.
    """
    ids = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in PROVENANCE_IDS]
    lists = [F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, c) for c in ("source_paths", "evidence_refs")]
    return facts.withColumn("missing", F.array_compact(F.array(*ids, *lists)))


def standing(versions: DataFrame, transitions: DataFrame, believed_at: Column) -> DataFrame:
    """Released versions known at a moment and neither corrected nor retracted by then (BT-3).

    A supersession takes nothing away, so retracting a change brings the version before it back.
    """
    taken = transitions.where(F.col("kind").isin("correction", "retraction") & (F.col("transaction_at") <= believed_at))
    known = versions.where((F.col("transaction_from") <= believed_at) & (F.col("state") == "released"))
    return known.join(taken.select(F.col("previous_version_id").alias("version_id")), "version_id", "left_anti")


def _newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of greatest order for each key, by an aggregate with partial results: a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order, F.col("version_id"))).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col("__top")[c].alias(c) for c in rest])


def believed_at(versions: DataFrame, transitions: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The version of each fact that was believed at a moment; equal times go to the greater version_id."""
    return _newest(standing(versions, transitions, at), keys, F.col("transaction_from"))


def valid_at(versions: DataFrame, transitions: DataFrame, keys: list[str], at: Column, believed: Column) -> DataFrame:
    """The version valid at one moment as believed at another (BT-4); without valid_from, verified_at counts."""
    begins = F.coalesce("valid_from", "verified_at")
    return _newest(standing(versions, transitions, believed).where(begins <= at), keys, begins, F.col("transaction_from"))


def regenerate(versions: DataFrame, transitions: DataFrame, keys: list[str], policies: DataFrame, now: Column, on: str) -> DataFrame:
    """Current facts with freshness (BT-5, JN-6): adds fresh_state, stale and lag_seconds.

    policies: `on` (once each), freshness_seconds, source_healthy. A fact
    without a policy never gets stale. fresh_state is released, stale, or
    last_known_good (stale from an unhealthy source).
    """
    facts = believed_at(versions, transitions, keys, now).join(policies.select(on, "freshness_seconds", "source_healthy"), on, "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("verified_at")
    stale = F.coalesce(age > F.col("freshness_seconds"), F.lit(False))
    state = F.when(stale & ~F.coalesce(F.col("source_healthy"), F.lit(True)), "last_known_good").when(stale, "stale").otherwise("released")
    out = facts.withColumn("stale", stale).withColumn("fresh_state", state).withColumn("lag_seconds", F.greatest(F.lit(0).cast("long"), age))
    return out.drop("freshness_seconds", "source_healthy")


def drift(persisted: DataFrame, regenerated: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one of two projections holds, with side: persisted or regenerated (SET-5); no rows if equal."""
    a, b = persisted.select(*columns), regenerated.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("persisted")).unionByName(b.exceptAll(a).withColumn("side", F.lit("regenerated")))


def intervals(versions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Add transaction_to, the first transition away from each version, and ended_as: changed, corrected or retracted (BT-8, BT-9)."""
    ended = F.when(F.col("kind") == "correction", "corrected").when(F.col("kind") == "retraction", "retracted").otherwise("changed")
    first = transitions.groupBy(F.col("previous_version_id").alias("version_id")).agg(F.min(F.struct(F.col("transaction_at").alias("t"), ended.alias("k"))).alias("__end"))
    return versions.join(first, "version_id", "left").withColumn("transaction_to", F.col("__end.t")).withColumn("ended_as", F.col("__end.k")).drop("__end")


def retract(requests: DataFrame, versions: DataFrame, transitions: DataFrame, version_id: str = "fact_version_id") -> DataFrame:
    """Retraction transitions to append (BT-2); versions themselves never change.

    requests: version_id, operation_key, transaction_at; versions: version_id;
    transitions: operation_key of what is stored. Requests for unknown versions
    are left out, as are operation keys that are stored; of requests that share
    a key the earliest counts. Adds transition_id and kind.
    """
    known = requests.join(versions.select(version_id), version_id, "left_semi").join(transitions.select("operation_key"), "operation_key", "left_anti")
    first = known.where(F.col("operation_key").isNotNull()).groupBy("operation_key").agg(F.min(F.struct("transaction_at", version_id)).alias("__first"))
    out = first.select("operation_key", f"__first.{version_id}", "__first.transaction_at")
    return out.withColumn("transition_id", F.sha2(F.concat_ws("|", F.lit("fact-retraction"), "operation_key"), 256)).withColumn("kind", F.lit("retraction"))
