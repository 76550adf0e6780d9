"""What consumers may see: projections of fact versions, trust blocks, visibility rules and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: States in which a version stands as the current one of its key.
DECIDED = ("released", "retracted")


def project(versions: DataFrame, keys: list[str], version_id: str = "fact_version_id", state: str = "state", time: str = "transaction_from", where: Column | None = None) -> DataFrame:
    """The current version and base state of each key (BT-6).

    The last released or retracted version is current. The base state follows
    the key's last decision: released and retracted as they are, conflicted
    and any other (then last_known_good) only where a current version exists,
    else retracted. Equal times go to the larger id. `where` restricts the
    versions first, for instance to those believed and valid at some time.

    Returns the keys, current_version_id, decision_version_id and base_state.
    """
    rows = versions if where is None else versions.where(where)
    order = F.struct(time, version_id)
    decided = F.when(F.col(state).isin(*DECIDED), order)
    found = rows.groupBy(*keys).agg(F.max(decided).alias("__current"), F.max(F.struct(time, version_id, state)).alias("__last"))
    last, current = F.col(f"__last.{state}"), F.col("__current").isNotNull()
    base = F.when(last.isin(*DECIDED), last).when(~current, "retracted").when(last == "conflicted", "conflicted").otherwise("last_known_good")
    return found.select(*keys, F.col(f"__current.{version_id}").alias("current_version_id"), F.col(f"__last.{version_id}").alias("decision_version_id"), base.alias("base_state"))


def believed(valid_at: Column | None = None, believed_at: Column | None = None) -> Column:
    """Versions known at believed_at and valid at valid_at; valid_to is exclusive, an open end is null (BT-6)."""
    out = F.lit(True)
    if believed_at is not None:
        out = out & (F.col("transaction_from") <= believed_at)
    if valid_at is not None:
        out = out & F.coalesce(F.col("valid_from") <= valid_at, F.lit(True)) & F.coalesce(F.col("valid_to") > valid_at, F.lit(True))
    return out


def materialized(projection: DataFrame, evaluated_at: Column, deadline: Column, keep_last: Column) -> DataFrame:
    """Add state and serving_label to projections (BT-6, ST-4): what is past its deadline is stale."""
    base = F.col("base_state")
    late = F.coalesce(evaluated_at > deadline, F.lit(False))
    state = F.when(base.isin("retracted", "conflicted"), base).when(late, "stale").otherwise(base)
    kept = F.when(keep_last, "last_known_good").otherwise("unavailable")
    label = F.when(state == "retracted", "unavailable").when(state.isin("conflicted", "stale"), kept).when(state == "last_known_good", state).otherwise("verified")
    return projection.withColumn("state", state).withColumn("serving_label", label)


def trust(current: DataFrame, observations: DataFrame, evidence: DataFrame, version_id: str = "fact_version_id") -> DataFrame:
    """Add the trust block of each current fact (JN-1).

    observations: version_id and source_id, a row for each supporting
    observation; evidence: version_id and evidence_ref. Adds
    supporting_source_count (distinct), evidence_count, stale and uncertainty
    (missing_evidence, else null). Both sides are counted before the join.
    """
    sources = observations.where(F.col("source_id").isNotNull()).groupBy(version_id).agg(F.count_distinct("source_id").alias("supporting_source_count"))
    refs = evidence.where(F.col("evidence_ref").isNotNull()).groupBy(version_id).agg(F.count_distinct("evidence_ref").alias("evidence_count"))
    out = current.join(sources, version_id, "left").join(refs, version_id, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumn("supporting_source_count", zero(F.col("supporting_source_count"))).withColumn("evidence_count", zero(F.col("evidence_count")))
    return out.withColumn("stale", F.col("state") == "stale").withColumn("uncertainty", F.when(F.col("evidence_count") == 0, "missing_evidence"))


def released(facts: DataFrame, version_state: str = "version_state") -> DataFrame:
    """Facts that may be shown (PF-5): not unavailable, conflicted or retracted, and of a released version. Filtered before any paging."""
    return facts.where((F.col("serving_label") != "unavailable") & ~F.col("state").isin("conflicted", "retracted") & (F.col(version_state) == "released"))


def machine_readable(facts: DataFrame, predicates: list[str] | None = None, most: int = 50, entity: str = "entity_id", order: str = "predicate", version_state: str = "version_state") -> DataFrame:
    """Facts for machine consumers (PF-6): released and verified, with evidence and a source, at most `most` of an entity by `order`.

    predicates: only these; an empty list or None means all.
    """
    strict = (F.col("state") == "released") & (F.col("serving_label") == "verified") & (F.col(version_state) == "released")
    out = facts.where(strict & (F.col("evidence_count") > 0) & (F.col("supporting_source_count") > 0))
    if predicates:
        out = out.where(F.col("predicate").isin(*predicates))
    # The cut is a rank, which Spark also takes before the shuffle, so no entity's facts are gathered.
    place = Window.partitionBy(entity).orderBy(order, *[c for c in out.columns if c not in (entity, order)])
    return out.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= most).drop("__place")


def evidence_aware(facts: DataFrame) -> DataFrame:
    """Facts that are released, last known good or stale and have evidence (PF-7)."""
    return facts.where(F.col("state").isin("released", "last_known_good", "stale") & (F.col("evidence_count") > 0))


def public_facts(facts: DataFrame) -> DataFrame:
    """Public shape of visible facts with a nested trust block (SRC-7): id, entity_id, predicate, value, value_hash, transaction_from, trust."""
    block = F.struct(
        "state", F.when(F.col("stale"), "stale").otherwise("fresh").alias("freshness"), "supporting_source_count", "evidence_count", F.col("transaction_from").alias("observed_at"),
    )
    value_hash = F.sha2(F.col("value").cast("string"), 256)
    return facts.select(F.col("fact_version_id").cast("string").alias("id"), F.col("entity_id").cast("string").alias("entity_id"), "predicate", "value", value_hash.alias("value_hash"), "transaction_from", block.alias("trust"))


def public_events(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Public shape of released events (SRC-7): id, event_type, entity_id, predicate, state, observed_at, event_hash, trust.

    events: event_id, event_type, entity_id, predicate, state, observed_at,
    certificate_id; evidence: event_id, evidence_ref. The hash covers the shown
    fields. Events of other states, or without an id, are not shown.
    """
    refs = evidence.where(F.col("evidence_ref").isNotNull()).groupBy("event_id").agg(F.count_distinct("evidence_ref").alias("n"))
    text = [F.col(c).cast("string") for c in ("event_id", "event_type", "entity_id")]
    rows = events.where((F.col("state") == "released") & F.col("event_id").isNotNull()).join(refs, "event_id", "left")
    block = F.struct(
        F.lit("released").alias("state"), F.lit("fresh").alias("freshness"), F.coalesce("n", F.lit(0)).alias("evidence_count"), F.col("certificate_id").cast("string").alias("certificate_ref"), "observed_at"
    )
    content = F.sha2(F.concat_ws("|", *[F.coalesce(t, F.lit("")) for t in (*text, F.col("predicate").cast("string"))]), 256)
    return rows.select(text[0].alias("id"), "event_type", text[2].alias("entity_id"), "predicate", "state", "observed_at", content.alias("event_hash"), block.alias("trust"))


def public_conflicts(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Public shape of conflicts (SRC-7): id, entity_id, predicate, status, reason, candidate_observation_ids, released_fact_version_id, opened_at.

    conflicts: conflict_id, entity_id, predicate, reason, observation_ids,
    opened_at; resolutions: conflict_id, fact_version_id, at. The newest
    resolution counts (of equal times the larger version); without one a
    conflict is open.
    """
    newest = resolutions.groupBy("conflict_id").agg(F.max(F.struct("at", "fact_version_id")).alias("r"))
    rows = conflicts.join(newest, "conflict_id", "left")
    status = F.when(F.col("r").isNull(), "open").otherwise("resolved")
    return rows.select(
        F.col("conflict_id").cast("string").alias("id"), F.col("entity_id").cast("string").alias("entity_id"), "predicate", status.alias("status"), "reason",
        F.col("observation_ids").cast("array<string>").alias("candidate_observation_ids"), F.col("r.fact_version_id").cast("string").alias("released_fact_version_id"), "opened_at",
    )


def public_sources(sources: DataFrame, health: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Public shape of sources (SRC-7): id, name, status (of health, else of the source), source_type, last_verified_at, freshness.

    sources: source_id, name, lifecycle, source_type; health: source_id, state, last_success_at.
    """
    rows = source_freshness(sources, health, "source_id", now, hours=hours)
    return rows.select(F.col("source_id").cast("string").alias("id"), "name", F.coalesce("state", "lifecycle").alias("status"), "source_type", F.col("last_success_at").alias("last_verified_at"), "freshness")


def source_freshness(sources: DataFrame, health: DataFrame, key: str, now: Column, last_success: str = "last_success_at", state: str | None = None, hours: int = 6) -> DataFrame:
    """Sources with their health and freshness (JN-10): unknown without a success, stale from `hours` after the last one, else fresh.

    state: only sources in this health state; by default also those without any health row.
    """
    out = sources.join(health, key, "left")
    if state is not None:
        out = out.where(F.col("state") == state)
    age = F.unix_micros(now) - F.unix_micros(F.col(last_success).cast("timestamp"))
    return out.withColumn("freshness", F.when(F.col(last_success).isNull(), "unknown").when(age > hours * 3_600_000_000, "stale").otherwise("fresh"))


def listing(rows: DataFrame, order: list[str], most: int, **wanted) -> DataFrame:
    """The newest `most` rows by `order`, descending, of those that equal each wanted value; None leaves a column open (PF-9)."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def verification(versions: DataFrame, observations: DataFrame, evidence: DataFrame, version_id: str = "fact_version_id") -> DataFrame:
    """Released and retracted versions with what supports them (JN-13).

    observations: version_id, observation_id and trust_state; evidence:
    version_id and evidence_ref. Adds evidence_refs (at most 100) and
    observation_ids (at most 50, verified only), sorted; empty without any.
    """
    shown = versions.where(F.col("state").isin(*DECIDED))

    def firsts(rows: DataFrame, column: str, name: str, most: int) -> DataFrame:
        distinct = rows.where(F.col(column).isNotNull()).join(shown.select(version_id), version_id, "left_semi").select(version_id, column).distinct()
        ranked = distinct.withColumn("__place", F.row_number().over(Window.partitionBy(version_id).orderBy(column))).where(F.col("__place") <= most)
        return ranked.groupBy(version_id).agg(F.array_sort(F.collect_list(column)).alias(name))

    refs = firsts(evidence, "evidence_ref", "evidence_refs", 100)
    seen = firsts(observations.where("trust_state = 'verified'"), "observation_id", "observation_ids", 50)
    out = shown.join(refs, version_id, "left").join(seen, version_id, "left")
    for name, kind in (("evidence_refs", refs.schema["evidence_refs"].dataType), ("observation_ids", seen.schema["observation_ids"].dataType)):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def scope_violations(left: DataFrame, right: DataFrame, on: str, project: str = "project_id") -> DataFrame:
    """Related rows that belong to different projects (PF-8): on, left_project, right_project; a null project differs from any other."""
    pairs = left.select(on, F.col(project).alias("left_project")).join(right.select(on, F.col(project).alias("right_project")), on)
    return pairs.where(~F.col("left_project").eqNullSafe(F.col("right_project"))).distinct()
